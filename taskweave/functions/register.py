"""The name and package rules as SQL functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from taskweave.functions import names as N
from taskweave.functions import packages as K


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")


def _any(words) -> str:
    return " or ".join(f"contains(lower(image), '{w}')" for w in words)


def sql_rules() -> dict[str, str]:
    """name -> 'parameters returns type return body' of each rule."""
    trimmed = "lower(regexp_replace(c, '^\\\\s+|\\\\s+$', ''))"
    gyms = f"array_distinct(transform(filter(gyms, g -> lower(g) rlike '{K.GYM_NAME}'), g -> regexp_replace(lower(g), '-gym$', '')))"
    bench = [
        (("aster", *K.ASTER_IMAGES), "company bench aster"),
        (K.SYNTHETIC_DIGESTS, "computer bench synth"),
        (("zeta", *K.ZETA_DIGESTS), "company bench zeta"),
        (("real-data",), "computer bench real"),
        (("connectors-rl-gym",), "computer bench synth"),
        (K.ZETA_IMAGES, "company bench zeta"),
        (("connectors-harness",), "computer bench synth"),
    ]
    cases = " ".join(f"when {_any(words)} then '{label}'" for words, label in bench)
    return {
        "name_key": f"(c string) returns string return regexp_replace({trimmed}, '{_text(N.NAMESPACE)}', '')",
        "norm_name": f"(c string) returns string return regexp_replace(name_key(c), '{_text(N.VERSION_SUFFIX)}', '')",
        "bench_of_image": f"(image string) returns string return case {cases} end",
        "connector_count_kind": f"(gyms array<string>) returns string return case when size({gyms}) = 1 then 'single' when size({gyms}) > 1 then 'multi' end",
    }


def register_rules(spark: SparkSession) -> None:
    for name, definition in sql_rules().items():
        spark.sql(f"create or replace temporary function {name}{definition}")
