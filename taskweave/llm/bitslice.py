"""Exact top-k by a bit-sliced index.

Components are quantised to whole numbers. A block of at most ``BLOCK`` rows, ordered by
id, keeps for every dimension one bitmap per bit of (component - least component of the
block). A query's score is a sum of shifted slices: each signed binary digit of a query
component adds the dimension's slices at that shift, or their complements for a negative
digit, with full adders on whole bitmaps. The sum's slices, most significant first, part
the rows into those surely among the best k, those out, and those that are equal so far;
what is equal at the end is taken by smaller id, and scores are computed from the rows.

Queries meet blocks in groups: one task holds one block and up to about ``GROUP`` queries, which
go through it one after the other. Each gives k rows per query, and the best k of these are
the answer, so nothing is approximate. Slices and sums are as wide as the components ask
for; the scores of the rows found are exact, by whole numbers of any size where 64 bits
could overflow on the way.

Defined cases: vectors that are null, or hold a null or non-finite component, take no
part; a shorter vector counts as ending in zeros, an empty one scores 0; of rows sharing an
id the least vector counts; rows without an id take no part; a query's own row is none of
its candidates; ties go to the smaller id; fewer candidates than k are all returned. A
component or a returned score that 64 bits can't hold is an error that shows the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskweave.llm.vectors import matrix, padded, products, query_groups, valid, whole

SCALE = 256
BLOCK = 65_536
GROUP = 65_536
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Row i as bit i % 64 of word i // 64."""
    packed = np.packbits(bits, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), np.uint64)


def digits(number: int) -> list[tuple[int, int]]:
    """(shift, +1 or -1) of the signed binary form without neighbouring digits."""
    sign, number, out, shift = (1 if number >= 0 else -1), abs(number), [], 0
    while number:
        if number & 1:
            d = 2 - (number & 3)
            out.append((shift, sign * d))
            number -= d
        number >>= 1
        shift += 1
    return out


class Block:
    """The slices of one block of rows in id order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        low = self.rows.min(axis=0) if len(ids) else np.zeros(rows.shape[1], np.int64)
        # Differences of 64-bit numbers fit 64 bits without a sign.
        above = self.rows.view(np.uint64) - low.view(np.uint64)
        self.plus, self.minus = [], []
        for j in range(rows.shape[1]):
            column = np.ascontiguousarray(above[:, j])
            width = int(column.max()).bit_length() if len(column) else 0
            slices = [bitmap((column >> np.uint64(b)) & np.uint64(1)) for b in range(width)]
            self.plus.append(slices)
            self.minus.append([s ^ ONES for s in slices])
        self.all = bitmap(np.ones(len(ids), np.uint8))

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's score, less a constant, least significant first."""
        by_weight: list[list[np.ndarray]] = []
        for j, q in enumerate(query.tolist()):
            for shift, sign in digits(q):
                slices = self.plus[j] if sign > 0 else self.minus[j]
                while len(by_weight) < shift + len(slices):
                    by_weight.append([])
                for b, s in enumerate(slices):
                    by_weight[shift + b].append(s)
        out, weight = [], 0
        while weight < len(by_weight):
            todo = by_weight[weight]
            carries = []
            while len(todo) > 1:
                a, b = todo.pop(), todo.pop()
                half = a ^ b
                if todo:
                    c = todo.pop()
                    carries.append((a & b) | (half & c))
                    half ^= c
                else:
                    carries.append(a & b)
                todo.append(half)
            out.append(todo[0] if todo else np.zeros_like(self.all))
            if carries:
                if weight + 1 == len(by_weight):
                    by_weight.append([])
                by_weight[weight + 1] += carries
            weight += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows, in any order."""
        equal, sure = self.all.copy(), np.zeros_like(self.all)
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            equal[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        for s in reversed(self.sum_slices(query)):
            high = equal & s
            n = int(np.bitwise_count(sure | high).sum())
            if n >= k:
                equal = high
                if n == k:
                    break
            else:
                sure |= high
                equal &= ~s
        rows = set_bits(sure)
        rows = np.concatenate([rows, set_bits(equal)[: k - len(rows)]])
        return self.ids[rows], products(query[None], self.rows[rows])[0]


def set_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``df`` with the largest inner product for each query."""
    rows, asked = (valid(x, id_col, vec_col).select("id", whole(F.col("vec"), scale).alias("q")) for x in (df, queries))
    blocks = max(1, -(-rows.count() // block))
    groups = query_groups(asked.count(), blocks, group)
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    # A block is sent to each group of queries, a query to each block.
    left = rows.withColumn("b", place(blocks, 1)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", place(groups, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and wanted.num_rows:
            index = Block(held["id"].to_numpy(), matrix(held["q"], np.int64))
            vectors = padded(matrix(wanted["q"], np.int64), index.rows.shape[1])
            for query_id, query in zip(wanted["id"].to_pylist(), vectors):
                ids, scores = index.top(query_id, query, k)
                out[0] += [query_id] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
