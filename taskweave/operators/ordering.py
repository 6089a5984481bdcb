"""Orders, pages, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.functions.names import batch_order, plain_key
from taskweave.session import output_path, stored


def sort_rows(rows: DataFrame, key: str, descending: bool = False, ties: tuple[str, ...] = ("task",)) -> DataFrame:
    """A typed sort; missing values come last either way, ties by ``ties``."""
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return rows.orderBy(first, *ties)


def top_k(rows: DataFrame, who: str, k: int) -> DataFrame:
    """The k accounts with the most rows."""
    return rows.where(F.col(who).contains("@")).groupBy(who).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), who).limit(k)


def people_order(people: DataFrame) -> DataFrame:
    return people.orderBy(F.col("pending_tasks").desc(), F.col("paid_tasks").desc(), "email")


def folder_order(rows: DataFrame) -> DataFrame:
    """Latest decision first, undated last, then by name."""
    return rows.orderBy(F.col("decided").desc_nulls_last(), "name")


def sample_groups(rows: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """A repeatable sample of n duplicate groups: the smallest digests of key and seed."""
    groups = rows.groupBy(key.alias("key")).agg(F.count("*").alias("submissions")).where("submissions > 1")
    return groups.withColumn("_h", F.md5(F.concat("key", F.lit(f":{seed}")))).orderBy("_h", "key").limit(n).drop("_h")


def not_found_listing(traced: DataFrame) -> DataFrame:
    """Deliveries no folder holds: gone, then unnamed, then elsewhere; by batch and task."""
    rank = F.when(F.col("reason") == "gone", 0).when(F.col("reason") == "unnamed", 1).otherwise(2)
    series, number, text = batch_order(F.col("batch"))
    # Stored first: the range sampler would run the joins behind the rows a second time.
    return stored(traced.where("not found"), "not-found").orderBy(rank, series, number, text, "task", "pos")


class StoredOrder:
    """Rows written once in a total order, in parts whose sizes are known, for pages anywhere in it."""

    def __init__(self, rows: DataFrame, order: list) -> None:
        self.spark, self.columns = rows.sparkSession, rows.columns
        self.path = output_path(self.spark, "order")
        # What the sampler and the sort read is there already, so the rows are made once.
        laid = stored(rows, "unordered").repartitionByRange(*order).sortWithinPartitions(*order)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        laid.withColumns({"_part": F.spark_partition_id(), "_row": row}).write.partitionBy("_part").parquet(self.path)
        counted = self._rows().groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row per part
        self.sizes = sorted((r["_part"], r["n"]) for r in counted)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows number * size and on, ``size`` at most: only the parts that hold them are read."""
        first, last, begin, wanted = number * size, (number + 1) * size, 0, []
        for part, n in self.sizes:
            lo, hi = max(first - begin, 0), min(last - begin, n)
            if lo < hi:
                wanted.append((part, lo, hi))
            begin += n
        hit = F.lit(False)
        for part, lo, hi in wanted:
            hit = hit | ((F.col("_part") == part) & (F.col("_row") >= lo) & (F.col("_row") < hi))
        return self._rows().where(F.col("_part").isin([p for p, _, _ in wanted]) if wanted else hit).where(hit).orderBy("_part", "_row").limit(size).select(self.columns)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a total order; for several pages keep the :class:`StoredOrder`."""
    return StoredOrder(rows, order).page(number, size)


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def membership_overlap(member: DataFrame, current: str, gate_only: str, retired: list[str]) -> DataFrame:
    """(measure, n): gate-only keys that are also current, retired keys that are not."""
    keys = lambda cond: member.where(cond).select("key").distinct()
    now, gated, old = keys(F.col("cohort") == current), keys(F.col("cohort") == gate_only), keys(F.col("cohort").isin(*retired))
    count = lambda df, m: df.agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), "n")
    return union_sources(
        count(now, "current"), count(gated, "gate_only"), count(gated.intersect(now), "gate_only_also_current"), count(old.subtract(now), "retired_only")
    )


def gap_explained(packages: DataFrame, rows: DataFrame) -> DataFrame:
    """(reason, packages): packages at the bar with no accepted row, and what holds them."""
    states = rows.groupBy(plain_key(F.col("name")).alias("key")).agg(
        F.bool_or(F.col("state") == "accepted").alias("accepted"), F.min_by("state", "pos").alias("held")
    )
    open_packages = packages.select("key").distinct().join(states, "key", "left").where(~F.coalesce("accepted", F.lit(False)))
    reason = F.when(F.col("held").isNull(), F.lit("not in scope")).otherwise(F.concat(F.lit("canonical state "), "held"))
    return open_packages.groupBy(reason.alias("reason")).agg(F.count("*").alias("packages"))


def semi_members(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key is in a list of keys."""
    return rows.withColumn("_k", key).join(keys.select(F.col("key").alias("_k")), "_k", "left_semi").drop("_k")
