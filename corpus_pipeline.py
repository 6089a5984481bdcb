"""The corpus pipeline: each stage's rows are written and read again as the next one's documents.

Every stage works on all rows that the one before kept. The first four return the columns of
the table of documents, whatever these are beside doc_id, text, lang, source and n_chars.

1. language: texts whose language is ``und`` or ambiguous go. Without any labelled row a
   language can't be learned, and texts without a letter go.
2. near_duplicates: one document of each group of near copies stays.
3. pii: personal data is replaced by its kind in brackets, and n_chars is counted again.
4. mixing: a document stays as often as the schedule takes its first word, 0 to 3 times, and the
   rows are written in the order of the slots. Rows sharing id, source and size are taken alike.
5. tokens: ids and decoded text of each document, as digests.

Rows without an id go through all stages: they are no near copies of anything and are mixed
like others. Repeated rows count as near copies, so one stays. Empty tables pass as empty
tables. Whole texts are worked on, however long; one text must fit a task's memory.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskweave.llm import bpe, langid, minhash, mixing, pii
from taskweave.session import output_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, F.lit(True))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if not model.languages:
        return rows.where(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    judged = rows.withColumn("found", langid.language_of(F.col("row.text"), model))
    return judged.where((F.col("found.lang_pred") != langid.UNKNOWN) & ~F.col("found.ambiguous")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    found = pii.find(rows, pii.learn(docs))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    cleaned = found.withColumn("clean", pii.redacted(F.col("text"), F.col("spans")))
    return cleaned.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.copies(docs).select(F.col("id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_words"), F.col("slot").alias("_slot"), F.col("share").alias("_share"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), mixing.word_count(docs["text"]).alias("size"))
    # Texts are not sorted for the join: the ids that the mix takes are hashed, a part at a time.
    mixed = rows.join(taken.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_from")) & (F.col("size") == F.col("_words")))
    # Parts of equal stretches of the schedule, in its order.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(parts, (F.col("_share") * parts).cast("int")).sortWithinPartitions("_slot", "row.doc_id").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", redact), ("mixing", mix), ("tokens", tokens)]
# The language is learned, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = output_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
