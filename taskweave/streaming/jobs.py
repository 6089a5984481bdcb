"""The derivation as streams: best run per identity, daily counts, grace matching.

Each job writes files in a shared folder through Spark's committing sinks or an
idempotent per-batch write, so it restarts from its checkpoint after any loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from taskweave.operators.canonical import RANK, best_first, with_identity
from taskweave.session import drop, listed


def read_stream(spark: SparkSession, folder: str, schema: StructType, name_filter: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder, as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name_filter).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def stream_canonical(runs: DataFrame) -> DataFrame:
    """The best run per identity as runs arrive; a maximum, so replays change nothing."""
    kept = ["source", "state", "depth", "outcome"]
    return (
        with_identity(runs)
        .groupBy("identity")
        .agg(F.max_by(F.struct(*kept), best_first(RANK, "pos")).alias("w"), F.max(best_first(RANK, "pos")).alias("rank"))
        .select("identity", "w.*", "rank")
    )


KEPT_VERSIONS = 2
# Buckets that identities are dealt into, deltas a bucket may have, and how often the deltas'
# bytes go into the base's before the base is written anew.
BUCKETS = 32
DELTAS = 16
REWRITE = 4
PART = "bucket int, folder string, base boolean, bytes bigint"


def write_updates(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a current table of the changed rows, merged when it is read."""
    return (
        df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, out)).start()
    )


def merge_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Add one batch to the current table below ``out``: a small delta per bucket that it touches.

    A version is the list of its parts, a base and some deltas per bucket. A batch reads the
    list before it, writes its rows once, and then its own list, so a replay gives the same
    version and a reader never sees half of one. A bucket of too many deltas is compacted: its
    deltas to one, or all into a new base once they are a share of it; what a batch writes
    follows its rows, not the table's. Parts that the kept versions don't list are dropped.
    """
    spark, schema = batch.sparkSession, batch.schema
    versions = _versions(spark, out)
    known = [v for v in versions if v < batch_id]
    live = _parts(spark, out, max(known)) if known else []
    rows = _best(batch).withColumn("bucket", F.pmod(F.xxhash64("identity"), F.lit(BUCKETS)).cast("int"))
    live += _write(spark, out, rows, f"deltas/v={batch_id}", False)
    by_bucket: dict[int, list] = {}
    for part in live:
        by_bucket.setdefault(part["bucket"], []).append(part)
    small, whole = [], []
    for bucket, parts in by_bucket.items():
        deltas = [p for p in parts if not p["base"]]
        if len(deltas) > DELTAS:
            grown = REWRITE * sum(p["bytes"] for p in deltas) >= sum(p["bytes"] for p in parts if p["base"])
            (whole if grown else small).append(bucket)
    for buckets, base in ((small, False), (whole, True)):
        merged = [p for b in buckets for p in by_bucket[b] if base or not p["base"]]
        if merged:
            folder = f"{'bases' if base else 'merged'}/v={batch_id}"
            live = [p for p in live if p not in merged] + _write(spark, out, _read(spark, out, merged, schema, keyed=True), folder, base)
    spark.createDataFrame(live, PART).coalesce(1).write.mode("overwrite").parquet(f"{out}/lists/v={batch_id}")
    kept = sorted(known)[1 - KEPT_VERSIONS :] if KEPT_VERSIONS > 1 else []
    used = {p["folder"] for p in live} | {p["folder"] for v in kept for p in _parts(spark, out, v)}
    for old in set(known) - set(kept):
        drop(spark, f"{out}/lists/v={old}")
    for kind in ("deltas", "merged", "bases"):
        for name, _ in listed(spark, f"{out}/{kind}"):
            # A later batch, left over from before a replay, is written anew when it comes.
            parts = [] if int(name.removeprefix("v=")) > batch_id else [p for p, _ in listed(spark, f"{out}/{kind}/{name}") if p.startswith("bucket=")]
            gone = [p for p in parts if f"{kind}/{name}/{p}" not in used]
            if parts and len(gone) == len(parts):
                drop(spark, f"{out}/{kind}/{name}")
            else:
                for part in gone:
                    drop(spark, f"{out}/{kind}/{name}/{part}")


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest rank per identity."""
    others = [c for c in rows.columns if c not in ("identity", *keys)]
    return rows.groupBy("identity", *keys).agg(F.max_by(F.struct(*others), "rank").alias("w")).select("identity", "w.*", *keys)


def _write(spark: SparkSession, out: str, rows: DataFrame, folder: str, base: bool) -> list[dict]:
    """Write rows by bucket; the parts that came of it."""
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{folder}")
    return [
        {"bucket": int(name.removeprefix("bucket=")), "folder": f"{folder}/{name}", "base": base, "bytes": size}
        for name, size in listed(spark, f"{out}/{folder}")
        if name.startswith("bucket=")
    ]


def _parts(spark: SparkSession, out: str, version: int) -> list[dict]:
    """The parts of a version: BUCKETS * (DELTAS + 1) at most."""
    return [row.asDict() for row in spark.read.schema(PART).parquet(f"{out}/lists/v={version}").collect()]


def _read(spark: SparkSession, out: str, parts: list[dict], schema: StructType, keyed: bool = False) -> DataFrame:
    rows = spark.read.schema(schema).parquet(*[f"{out}/{p['folder']}" for p in parts])
    if keyed:
        return _best(rows.withColumn("bucket", F.pmod(F.xxhash64("identity"), F.lit(BUCKETS)).cast("int")), "bucket")
    return _best(rows)


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Versions whose list is written; a few at most."""
    names = [name for name, _ in listed(spark, f"{out}/lists")]
    return [int(n.removeprefix("v=")) for n in names if any(f == "_SUCCESS" for f, _ in listed(spark, f"{out}/lists/{n}"))]


def latest_updates(spark: SparkSession, out: str) -> DataFrame:
    """The current row per identity: the highest rank over the base and the deltas of its bucket."""
    parts = _parts(spark, out, max(_versions(spark, out)))
    schema = spark.read.parquet(f"{out}/{parts[0]['folder']}").schema
    return _read(spark, out, parts, schema).drop("rank")


def write_appends(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def stream_daily_delta(events: DataFrame, delay: str) -> DataFrame:
    """Closed days' counts per state; rows later than the watermark are dropped."""
    return (
        events.withWatermark("at", delay)
        .groupBy(F.window("at", "1 day").alias("window"), "state")
        .agg(F.count("*").alias("n"))
        .select(F.to_date("window.start").alias("day"), "state", "n")
    )


def stream_grace(accepts: DataFrame, packages: DataFrame, delay: str, grace: str = "30 minutes") -> DataFrame:
    """Accepted runs with a package written within the grace window, else unmatched."""
    a = accepts.withWatermark("accepted_at", delay).alias("a")
    p = packages.withWatermark("written_at", delay).alias("p")
    within = F.expr(f"a.key = p.key and p.written_at >= a.accepted_at and p.written_at <= a.accepted_at + interval {grace}")
    return a.join(p, within, "left_outer").select("a.run", "p.package")
