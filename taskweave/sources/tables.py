"""Reference tables, workbook tabs and data embedded in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.functions.names import blank_to_null

RATE = 300
EMBEDDED = r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>'


def read_reference_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A headed table of text columns; the header must name exactly ``columns``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False)
    return rows.select(*[blank_to_null(F.col(c)).alias(c) for c in columns])


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys listed twice, compared without case."""
    return rows.groupBy(*[F.lower(k).alias(k) for k in keys]).agg(F.count("*").alias("n")).where("n > 1")


def clean_text(c: Column) -> Column:
    """Trimmed text; an identifier read as a float loses its ``.0``."""
    return F.regexp_replace(blank_to_null(c), r"^(-?\d+)\.0+$", "$1")


def clean_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def payment_tab(tab: DataFrame, rate: int = RATE) -> DataFrame:
    """Payment rows of a tab (email, cj, requested_on, tasks, amount), cleaned.

    ``priced`` is false where the amount is not the tasks at the rate; those
    rows are rejected by the caller, never silently used.
    """
    tasks, amount = clean_number(F.col("tasks")), clean_number(F.col("amount"))
    return tab.select(
        F.lower(clean_text(F.col("email"))).alias("email"), clean_text(F.col("cj")).alias("cj"), F.to_date(F.substring("requested_on", 1, 10)).alias("requested_on"),
        tasks.cast("bigint").alias("paid_tasks"), amount.cast("decimal(12,2)").alias("paid_amount"), (amount == tasks * rate).alias("priced"),
    ).where("email is not null")


def embedded_rows(pages: DataFrame, columns: str) -> DataFrame:
    """Rows of the JSON block inside each page, in the whitelisted columns only."""
    block = F.nullif(F.regexp_extract("html", EMBEDDED, 1), F.lit(""))
    parsed = F.from_json(block, f"rows array<struct<{columns}>>")
    return pages.withColumn("_j", parsed).select("page", F.inline("_j.rows"))


def scan_roll_up(sheet: DataFrame, sections: dict[str, tuple[str, str]]) -> DataFrame:
    """(section, label, value): label and value pairs at fixed columns, made long."""
    pairs = [
        F.struct(F.lit(name).alias("section"), blank_to_null(F.col(label)).alias("label"), clean_number(F.col(value)).alias("value"))
        for name, (label, value) in sections.items()
    ]
    return sheet.select(F.inline(F.array(*pairs))).where("label is not null and value <> 0")


def read_plan(wide: DataFrame, days: list[str]) -> DataFrame:
    """(bench, day, plan, actual) of a sheet with one column per day.

    ``wide`` has bench, kind (plan or actual) and one column per day.
    """
    long = wide.unpivot(["bench", "kind"], days, "day", "value")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0)).alias(k)
    return long.groupBy("bench", "day").agg(of("plan"), of("actual"))
