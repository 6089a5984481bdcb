"""Queries with oracle SQL against DuckDB, and every query and the pipeline on empty tables and with clashing columns."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from taskweave.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def bag(table, columns):
    return Counter(tuple(map(plain, row)) for row in zip(*[table.column(c).to_pylist() for c in columns]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert bag(ours, columns) == bag(theirs, columns)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables without rows, and tables with nulls, repeated rows and columns named like the operators' own."""
    root = tmp_path_factory.mktemp("odd")
    clash = ["id", "n", "text_", "print", "keys", "place", "row", "size", "vec", "score", "found", "spans", "base", "_text", "tag", "key", "g", "b", "kept"]
    for table in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{table}.parquet")
        few = df.limit(40)
        holes = few.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).limit(1)
        some = few.union(few.limit(2)).union(holes)
        some.select("*", *[F.lit("x").alias(c) for c in clash if c not in df.columns]).write.parquet(f"{root}/clash/{table}.parquet")
    return root


def test_names():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_clashing(spark, odd, name):
    columns = QUERIES[name](spark, FOLDER).columns
    empty = QUERIES[name](spark, f"{odd}/empty")
    assert empty.columns == columns
    assert empty.count() == 0
    clash = QUERIES[name](spark, f"{odd}/clash")
    assert clash.columns == columns
    rows = clash.count()
    if name not in ("op2_nndescent", "op4_bitslice", "op11_lexical", "op12_hardneg"):
        assert rows == 43


def test_pipeline_on_empty_and_clashing_tables(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/empty").count() == 0
    docs = spark.read.parquet(f"{odd}/clash/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{odd}/clash")
        assert out.dtypes == docs.dtypes, name
        assert out.count() > 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its rule."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.count() >= 0.99 * docs.count()
    junk = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("12 34 !!").alias("text"), "lang", "source", "n_chars")
    assert corpus_pipeline.language(spark, docs.union(junk), FOLDER).where("doc_id = 1000000").count() == 0
    one = corpus_pipeline.near_duplicates(spark, docs.union(docs.limit(5)), FOLDER)
    want = QUERIES["op5_minhash"](spark, FOLDER).where("kept").count()
    assert one.count() == want
    clean = corpus_pipeline.redact(spark, docs, FOLDER)
    assert clean.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    mixed = corpus_pipeline.mix(spark, docs, FOLDER).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 3
