"""Hard negatives for training pairs, by lists that the anchors of a cluster share.

A row's score is its inner product with the anchor, on components as whole numbers. For each
anchor the best rows of its own label are positives; for each positive the best rows of other
labels are wanted whose score lies between two shares of the positive's score.

Anchors are clustered by direction, around centroids fitted on a bounded sample of them. For
a cluster whose members lie within an angle ``b`` of the centroid, a row at an angle ``t``
from it scores at most |anchor| * |row| * cos(max(0, t - b)) with any member. The rows are
sorted by that bound once per cluster, and every member walks the list: it ends when its
wanted rows are full and the next bound is below the last of them, or below all that is
allowed. So the end is certified, and nothing is approximate; centroids decide the cost only.

Rows are dealt by hash into blocks, so that no list is longer than a block; anchors are dealt
into groups of whole clusters, large clusters in pieces. A task holds one block and one group
and gives no more rows than are wanted of each list; the best of all blocks are the answer.

Defined cases: rows without an id or label, or whose vector is null or holds a null or
non-finite component, take no part; a shorter vector counts as ending in zeros; of rows
sharing an id the least (label, vector) counts; an anchor is none of its own positives; ties
go to the smaller id; fewer rows than wanted are all returned, and an anchor without
positives has none; an empty table gives no rows. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.llm.vectors import matrix, padded, products, valid, whole
from taskweave.session import stored

SCALE = 256
# Rows of a block, anchors of a piece of a cluster and, about, of a group.
BLOCK = 16_384
PIECE = 1024
GROUP = 16_384
# Centroids and the anchors they are fitted on, at most.
CLUSTERS = 64
SAMPLE = 2048
TURNS = 8
# Rows of a list that are scored at once.
STEP = 1024
# Rounding in norms and angles stays far below this share.
SLACK = 1e-6


def labelled(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, q): rows that take part, one per id, with components as whole numbers."""
    pairs = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("string").alias("label"), df[vec_col].alias("vec"))
    rows = valid(pairs.where("label is not null"), "id", "vec", extra="label")
    return rows.select("id", "label", whole(F.col("vec"), scale).alias("q"))


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, zero for zero, and norms."""
    rows = rows.astype(np.float64)
    most = np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1) if rows.shape[1] else np.ones((len(rows), 1))
    norms = np.linalg.norm(rows / most, axis=1) * most[:, 0]
    return rows / np.where(norms > 0, norms, 1)[:, None], norms


def centroids(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started at rows far from those before."""
    unit, norms = directions(sample)
    unit = unit[norms > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(clusters, max(1, len(unit) // 16)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(TURNS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        means, size = directions(sums)
        centres = np.where(size[:, None] > 0, means, centres)
    return centres


def clustered(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds the nearest centroid of each anchor."""

    def run(batches):
        for batch in batches:
            unit, _ = directions(padded(matrix(batch["q"], np.int64), centres.shape[1]))
            own = (unit @ centres.T).argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "cluster"])

    return anchors.mapInArrow(run, T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())]))


class Best:
    """The best ``k`` of several lists, larger scores first, then smaller ids."""

    def __init__(self, lists: int, k: int) -> None:
        self.k, self.row, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The score that a further row has to reach, once a list is full.
        self.full, self.last = np.zeros(lists, bool), np.zeros(lists, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], ids[kept]
        end = place == self.k - 1
        self.full[row[end]], self.last[row[end]] = True, score[end]


class Rows:
    """A block's rows, as one sorted list per cluster of anchors."""

    def __init__(self, held: pa.Table, width: int) -> None:
        self.ids = held["id"].to_numpy()
        self.labels = np.array(held["label"].to_pylist(), object)
        self.q = padded(matrix(held["q"], np.int64), width)
        self.unit, self.norms = directions(self.q)

    def walk(self, centre: np.ndarray, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, owner: np.ndarray, k: int) -> Best:
        """The best k rows of each wish: of anchor ``owner``, its label or another, scores from low to high."""
        angle = lambda unit: np.arccos(np.clip(unit @ centre, -1, 1))
        unit, norms = directions(anchors)
        wide = float(angle(unit).max()) + SLACK
        bound = self.norms * np.cos(np.maximum(0, angle(self.unit) - wide)) * (1 + SLACK)
        order = np.argsort(-bound, kind="stable")
        best, live = Best(len(owner), k), np.flatnonzero(low <= high)
        for a in range(0, len(order), STEP):
            most = np.maximum(bound[order[a]], 0) * norms[owner[live]] * (1 + SLACK) + SLACK
            live = live[~((best.full[live] & (most < best.last[live])) | (most < low[live]))]
            if not len(live):
                break
            rows = order[a : a + STEP]
            members, at = np.unique(owner[live], return_inverse=True)
            scores = products(anchors[members], self.q[rows])
            agree = (labels[members][:, None] == self.labels[rows][None]) == same
            agree &= ids[members][:, None] != self.ids[rows][None]
            least = np.where(best.full[live], np.maximum(best.last[live], low[live]), low[live])
            good = agree[at] & (scores[at] >= least[:, None]) & (scores[at] <= high[live][:, None])
            wish, column = np.nonzero(good)
            best.add(live[wish], scores[at[wish], column], self.ids[rows][column])
        return best


LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor_id long, wish int, id long, score long"


def walked(rows: DataFrame, wishes: DataFrame, counts: tuple[int, int], centres: np.ndarray, same: bool, k: int, shares: tuple[int, int]) -> DataFrame:
    """(anchor_id, wish, id, score): the k best of every block for each wish of each anchor.

    ``wishes`` has (id, label, q, cluster, grp) and, unless ``same``, the ``scores`` of the positives.
    """
    blocks, groups = counts
    left = rows.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = wishes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if held.num_rows and wanted.num_rows:
            width = max(matrix(held["q"], np.int64).shape[1], matrix(wanted["q"], np.int64).shape[1], centres.shape[1])
            block, centre = Rows(held, width), padded(centres, width)
            anchors, ids = padded(matrix(wanted["q"], np.int64), width), wanted["id"].to_numpy()
            labels, cluster = np.array(wanted["label"].to_pylist(), object), wanted["cluster"].to_numpy()
            scores = [[0]] * len(ids) if same else wanted["scores"].to_pylist()
            for c in np.unique(cluster):
                for part in np.array_split(np.flatnonzero(cluster == c), -(-int((cluster == c).sum()) // PIECE)):
                    own = [scores[i] for i in part]
                    owner = np.repeat(np.arange(len(part)), [len(s) for s in own])
                    wish = np.concatenate([np.arange(len(s)) for s in own])
                    flat = [s for some in own for s in some]
                    # In Python's whole numbers, where no product overflows.
                    low = np.array([LEAST if same else -(-s * shares[0] // 100) for s in flat], np.int64)
                    high = np.array([MOST if same else s * shares[1] // 100 for s in flat], np.int64)
                    best = block.walk(centre[c], anchors[part], labels[part], ids[part], same, low, high, owner, k)
                    for column, values in zip(out, (ids[part][owner[best.row]], wish[best.row], best.id, best.score)):
                        column.append(values)
        columns = [np.concatenate(c) for c in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32), pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["anchor_id", "wish", "id", "score"])

    found = left.groupBy("b", "grp").cogroup(right.groupBy("b", "grp")).applyInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("anchor_id", "wish").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows ``anchors`` of ``df``.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's score.
    """
    rows = stored(labelled(df, id_col, label_col, vec_col, scale), "hard-rows")
    asked = labelled(anchors, id_col, label_col, vec_col, scale)
    sample = asked.select("q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centres = centroids(matrix(sample["q"], np.int64), CLUSTERS) if sample.num_rows else np.zeros((1, 0))
    asked = stored(clustered(asked, centres), "hard-anchors")
    sizes = asked.groupBy("cluster").count().collect()  # CLUSTERS rows at most
    groups = max(1, -(-sum(r["count"] for r in sizes) // GROUP))
    pieces = F.create_map(*[F.lit(x) for r in sizes for x in (r["cluster"], -(-r["count"] // PIECE))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    piece = F.pmod(F.xxhash64("id", F.lit(3)), pieces[F.col("cluster")])
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("cluster", piece), F.lit(groups)).cast("int"))
    counts = (max(1, -(-rows.count() // BLOCK)), groups)
    first = stored(walked(rows, asked, counts, centres, True, positives, (low, high)).select("anchor_id", "rank", F.col("id").alias("positive_id"), "score"), "hard-positives")
    of_anchor = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("own"))
    wishes = asked.join(of_anchor, asked["id"] == of_anchor["anchor_id"]).withColumn("scores", F.col("own.score"))
    second = walked(rows, wishes.drop("anchor_id", "own"), counts, centres, False, negatives, (low, high))
    named = first.select("anchor_id", (F.col("rank") - 1).alias("wish"), "positive_id", F.col("score").alias("positive_score"))
    return second.join(named, ["anchor_id", "wish"]).select("anchor_id", "positive_id", F.col("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
