"""Texts of wanted ids, without shuffling most of the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the filter: 4 MB, whatever the number of ids. When it fills up it lets more
# rows pass, and the join behind it still decides.
BITS = 1 << 25
PAGE = 1 << 15


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows reduced by their keys, dealt out by an exchange of their own.

    AQE splits a hot key only where both sides of a join come straight from an exchange. The
    keys are made anew, so the join deals the reduced side again instead of taking it as it is.
    """
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) if kinds[k] == "string" else F.col(k).bitwiseXOR(F.lit(0).cast(kinds[k])) for k in keys})


def place(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(BITS))


def maybe_wanted(ids: Column, wanted: DataFrame) -> Column:
    """Whether an id may be among the ``id`` of ``wanted``: true for all that are, and for few others. Null: false."""
    bits = wanted.select(place(F.col("id")).alias("p")).groupBy((F.col("p") / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % PAGE).alias("bits"))
    filled = np.zeros(BITS // 8, np.uint8)
    for page, raw in bits.collect():
        filled[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(raw, np.uint8)

    def run(places: pa.Array) -> pa.Array:
        p = places.to_numpy(zero_copy_only=False)
        return pa.array((filled[p >> 3] >> (p & 7)) & 1 == 1, pa.bool_())

    return F.arrow_udf(run, "boolean")(place(ids)) & ids.isNotNull()


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (id, text) of ``texts`` whose id is among the ``id`` of ``wanted``."""
    return texts.where(maybe_wanted(F.col("id"), wanted)).join(wanted.select("id"), "id", "left_semi")
