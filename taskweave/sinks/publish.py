"""Publish tables only when their invariants hold; else the previous ones stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from taskweave.operators.quality import holds
from taskweave.session import create_new, listed


def latest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and name of the latest published version."""
    pointers = [name.split("-") for name, _ in listed(spark, f"{root}/pointers") if "-" in name]
    return max(((int(number), version) for number, version in pointers), default=None)


def highest_claim(spark: SparkSession, root: str) -> int:
    return max((int(name) for name, _ in listed(spark, f"{root}/claims") if name.isdigit()), default=0)


def claim(spark: SparkSession, root: str) -> int:
    """A version number of one's own: the first that could be created, whatever was read before."""
    number = highest_claim(spark, root) + 1
    while not create_new(spark, f"{root}/claims/{number}"):
        number += 1
    return number


def publish_if_reconciled(tables: DataFrame | dict[str, DataFrame], checks: DataFrame, root: str) -> bool:
    """Write a new version beside the old, then point to it, if every check holds.

    Several tables of one version become readable together. The rows are written first, under
    a name of their own; then a number is claimed, by creating a file that must not be there
    yet, so two publishers never share one; then the pointer appears, an empty file whose name
    holds both. A reader therefore never sees half a table, and a failed or lost job leaves
    the previous version, at most with a number that nobody uses.
    """
    if not holds(checks):
        return False
    parts = tables if isinstance(tables, dict) else {"rows": tables}
    spark = next(iter(parts.values())).sparkSession
    name = uuid.uuid4().hex
    for part, df in parts.items():
        df.write.parquet(f"{root}/versions/{name}/{part}")
    number = claim(spark, root)
    return create_new(spark, f"{root}/pointers/{number}-{name}")


def read_published(spark: SparkSession, root: str, part: str = "rows") -> DataFrame:
    """One table of the latest published version."""
    found = latest(spark, root)
    if found is None:
        raise ValueError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root}/versions/{found[1]}/{part}")
