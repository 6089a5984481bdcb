"""Streams fed in several batches give the batch answer."""

from pyspark.sql import functions as F

from taskweave.operators import canonical as C
from taskweave.plans.views import VIEWS, Tables
from taskweave.session import drop, listed, output_path
from taskweave.streaming import jobs as J

SMALL = "/root/testdata/sf0.001"


def split_events(spark, parts=4):
    """The events as several files."""
    path = output_path(spark, "events-in-parts")
    events = Tables(spark, SMALL).events
    for i in range(parts):
        events.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return path, events


def test_canonical_over_batches_equals_batch(spark):
    path, events = split_events(spark)
    J.read_stream(spark, path, events.schema, files_per_batch=1).createOrReplaceTempView("events_parts")
    runs = spark.sql(VIEWS["r1_runs"].replace("from events)", "from events_parts)"))
    out = output_path(spark, "canonical")
    J.write_updates(J.stream_canonical(runs), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    got = J.latest_updates(spark, f"{out}/rows").select("identity", "source")
    batch = C.canonical_run(C.with_identity(Tables(spark, SMALL).r1_runs)).select("identity", "source")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def canonical_in_batches(spark, monkeypatch, parts, deltas):
    monkeypatch.setattr(J, "DELTAS", deltas)
    path, events = split_events(spark, parts)
    J.read_stream(spark, path, events.schema, files_per_batch=1).createOrReplaceTempView("events_parts")
    runs = spark.sql(VIEWS["r1_runs"].replace("from events)", "from events_parts)"))
    out = output_path(spark, "many-batches")
    query = J.write_updates(J.stream_canonical(runs), f"{out}/rows", f"{out}/checkpoint")
    query.awaitTermination()
    assert len(query.recentProgress) >= parts
    return f"{out}/rows"


def test_many_batches_are_compacted(spark, monkeypatch):
    """However many batches came, a bucket has a base and a few deltas, and old parts are gone."""
    out = canonical_in_batches(spark, monkeypatch, 9, 2)
    versions = J._versions(spark, out)
    assert len(versions) <= J.KEPT_VERSIONS
    parts = J._parts(spark, out, max(versions))
    assert any(p["base"] for p in parts)
    for bucket in range(J.BUCKETS):
        assert sum(p["bucket"] == bucket and not p["base"] for p in parts) <= 2
        assert sum(p["bucket"] == bucket and p["base"] for p in parts) <= 1
    used = {p["folder"] for v in versions for p in J._parts(spark, out, v)}
    there = {f"{kind}/{v}/{p}" for kind in ("deltas", "merged", "bases") for v, _ in listed(spark, f"{out}/{kind}") for p, _ in listed(spark, f"{out}/{kind}/{v}") if p.startswith("bucket=")}
    assert there == used
    got = J.latest_updates(spark, out).select("identity", "source")
    batch = C.canonical_run(C.with_identity(Tables(spark, SMALL).r1_runs)).select("identity", "source")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def ranked_rows(spark, first, last, rank):
    return spark.range(first, last).select(F.concat(F.lit("identity-"), "id").alias("identity"), F.sha2(F.concat("id", F.lit(rank)), 256).alias("source"), F.struct(F.lit(rank).alias("depth")).alias("rank"))


def test_a_small_batch_on_a_large_table_writes_little(spark):
    out = output_path(spark, "large-table")
    J.merge_batch(ranked_rows(spark, 0, 1_000_000, 1), 0, out)
    bytes_of = lambda: sum(size for _, size in listed(spark, out))
    whole = bytes_of()
    J.merge_batch(ranked_rows(spark, 500, 600, 2), 1, out)
    assert bytes_of() - whole < 0.01 * whole
    got = J.latest_updates(spark, out)
    assert got.count() == 1_000_000
    new = ranked_rows(spark, 500, 600, 2).select("identity", "source")
    assert got.join(new, ["identity", "source"]).count() == 100


def test_a_replayed_batch_changes_nothing(spark, monkeypatch):
    """A batch that was lost before its list was written, or written whole, is written again."""
    monkeypatch.setattr(J, "DELTAS", 1)
    out = output_path(spark, "replay")
    batches = [ranked_rows(spark, 10 * k, 10 * k + 60, k) for k in range(5)]
    for k, batch in enumerate(batches):
        J.merge_batch(batch, k, out)
        if k in (2, 3):
            J.merge_batch(batch, k, out)
        if k == 3:
            drop(spark, f"{out}/lists/v=3")
            J.merge_batch(batch, k, out)
    best = {}
    for batch in batches:
        best.update({r["identity"]: r["source"] for r in batch.collect()})
    assert {r["identity"]: r["source"] for r in J.latest_updates(spark, out).collect()} == best


def test_restart_writes_nothing_twice(spark):
    path, events = split_events(spark, 2)
    out = output_path(spark, "daily")

    def run():
        rows = J.read_stream(spark, path, events.schema).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("state"))
        J.write_appends(J.stream_daily_delta(rows, "6 hours"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{out}/rows").count()

    assert run() == run() > 0
