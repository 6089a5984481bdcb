"""Text search by trigrams: which pages of rows can hold a term, then the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.session import output_path, stored

# Rows of a page, pages of one bitmap, and pages that a search names one by one.
PAGE = 4096
BITMAP = 1 << 15
NAMED = 2000
SHORTEST = 3


class Postings:
    """Rows stored in pages, and for every trigram of a text the bitmap of the pages that hold it.

    A term is looked for in the pages that hold all of its trigrams only, and is compared there
    in full, so the answer is that of ``contains`` on lower-cased text. A term that more pages may
    hold than a filter should name is looked for in all of them.
    """

    def __init__(self, rows: DataFrame, text: Column) -> None:
        self.spark, self.columns = rows.sparkSession, rows.columns
        self.path = output_path(self.spark, "pages")
        at = F.monotonically_increasing_id()
        page = F.shiftleft(F.shiftright(at, 33), 20) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / PAGE)
        paged = rows.select("*", F.lower(text).alias("_text"), page.cast("bigint").alias("_page"))
        paged.write.option("parquet.page.row.count.limit", PAGE).parquet(self.path)
        grams = F.transform(F.sequence(F.lit(1), F.length("_text") - SHORTEST + 1), lambda i: F.col("_text").substr(i, F.lit(SHORTEST)))
        each = self.rows().where(F.length("_text") >= SHORTEST).select("_page", F.explode(F.array_distinct(grams)).alias("gram"))
        bits = each.groupBy("gram", F.floor(F.col("_page") / BITMAP).alias("map")).agg(F.bitmap_construct_agg(F.col("_page") % BITMAP).alias("bits"))
        self.index = stored(bits.repartitionByRange("gram").sortWithinPartitions("gram"), "postings")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def pages(self, term: str) -> DataFrame:
        """(page): the pages that hold every trigram of a lower-case term."""
        grams = sorted({term[i : i + SHORTEST] for i in range(len(term) - SHORTEST + 1)})
        both = self.index.where(F.col("gram").isin(grams)).groupBy("map").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(grams))
        bytes_ = both.select("map", F.posexplode(F.regexp_extract_all(F.hex("bits"), F.lit("(..)"), F.lit(1))).alias("at", "hex")).where("hex <> '00'")
        value = F.conv("hex", 16, 10).cast("int")
        bits = bytes_.select("map", "at", value.alias("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.getbit("value", "bit") == 1)
        return bits.select((F.col("map") * BITMAP + F.col("at") * 8 + F.col("bit")).alias("page"))

    def candidates(self, term: str) -> DataFrame:
        found = [r["page"] for r in self.pages(term).limit(NAMED + 1).collect()]
        return self.rows() if len(found) > NAMED else self.rows().where(F.col("_page").isin(found) if found else F.lit(False))

    def search(self, term: str) -> DataFrame:
        """Rows whose text contains a term, whatever the case; a term of fewer than three characters finds nothing."""
        needle = term.strip().lower()
        if len(needle) < SHORTEST:
            return self.rows().where(F.lit(False)).select(self.columns)
        return self.candidates(needle).where(F.col("_text").contains(needle)).select(self.columns)
