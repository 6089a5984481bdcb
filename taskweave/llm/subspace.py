"""Near-duplicate vectors of one label by a pigeonhole join over subspaces.

Unit vectors of cosine c are at a squared distance of 2 - 2c. They are rotated (principal
axes of a bounded sample, so that the strongest axes can be dealt out) and split into
``BLOCKS`` blocks of coordinates. The squared distance is the sum over the blocks, so two
vectors within a budget are, in at least one block, within that block's share of it, in
proportion to its coordinates.

Range join of a block: its two strongest axes form a grid, no cell narrower than the block's
radius. A vector is at home in one cell and visits the later of the neighbouring cells that
its radius reaches, so two vectors within it meet in exactly one cell. Cells of many rows
are split into chunks, and a task holds a pair of chunks, so a hot label or a large group of
near copies is no large task. Where rows meet, those within the block's share are verified
by their cosine in double precision on the original vectors; a pair counts in the first
block whose share holds it, and only there. A task gives counts per vector and as many links
as join its components, never its pairs.

Equal vectors of one label are one row from the start. All work inside a cell grows with
the square of its rows, whatever it returns: vectors without structure lie in few cells, and
so does a large group of near copies.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component,
and rows without a label, link with nothing; a shorter vector counts as ending in zeros;
rows sharing an id are one vector, of which the least (label, vector) that can link counts;
rows without an id link with nothing, are kept and are in no component; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.llm.arrays import parts
from taskweave.llm.candidates import dealt
from taskweave.llm.minhash import components
from taskweave.llm.nndescent import units
from taskweave.llm.vectors import matrix, padded, valid
from taskweave.session import stored

COSINE = 0.93
BLOCKS = 4
# Width of a grid cell in radii, 1 at least.
WIDTH = 2
# Vectors that the rotation is fitted on, at most.
SAMPLE = 4096
# Rows of a chunk of a cell, about; a pair of chunks, or a cell of no more rows, is a task's unit.
CHUNK = 2048
# Pairs that are verified at once.
PAIRS = 20_000
# Turned coordinates are kept in single precision; squared distances err far less than this.
SLACK = 1e-5


def packed(vectors: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that holds all of them."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    rows = single if (single == vectors).all() else vectors
    return [(b"s" if rows is single else b"d") + r.tobytes() for r in rows]


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"s" else np.float64, offset=1).astype(np.float64)


class Side:
    """Rows of one chunk: their unit vectors in double precision and the turned ones."""

    def __init__(self, rows: dict[str, list], width: int) -> None:
        self.node, self.n = np.array(rows["node"], np.int64), np.array(rows["n"], np.int64)
        self.turned = np.frombuffer(b"".join(rows["turned"]), np.float32).reshape(len(self.node), width)
        vectors = np.array([unpacked(v) for v in rows["vec"]]).reshape(len(self.node), width)
        self.unit = units(vectors) if len(vectors) else vectors

    def __len__(self) -> int:
        return len(self.node)


class Split:
    """The rotation, its blocks, and each block's budget and radius."""

    def __init__(self, sample: np.ndarray, width: int, cosine: float, blocks: int = BLOCKS) -> None:
        unit = units(padded(sample, width))
        _, axes = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(width, width)) if len(unit) else (0, np.eye(width))
        axes = axes[:, ::-1]  # strongest first
        blocks = max(1, min(blocks, width))
        dealt_axes = [np.arange(b, width, blocks) for b in range(blocks)]
        self.axes = axes[:, np.concatenate(dealt_axes)]
        self.sizes = np.array([len(a) for a in dealt_axes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.budget = 2 * (1 - cosine) * self.sizes / width
        self.radius = np.sqrt(self.budget + SLACK)
        self.cosine, self.width = cosine, width

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (units(padded(vectors, self.width)) @ self.axes).astype(np.float32)

    def cells(self, turned: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray, bool]]:
        """(rows, block, x, y, home): the cells that rows are at home in, and those they visit."""
        out = []
        for b, start in enumerate(self.starts):
            radius = float(self.radius[b])
            wide = WIDTH * radius
            plane = turned[:, start : start + min(2, self.sizes[b])].astype(np.float64)
            if plane.shape[1] == 1:
                plane = np.column_stack([plane, np.zeros(len(plane))])
            x, y = (np.floor(plane[:, k] / wide).astype(np.int64) for k in range(2))
            inside = plane - np.column_stack([x, y]) * wide
            every = np.arange(len(turned))
            out.append((every, b, x, y, True))
            for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
                gap = [np.zeros(len(turned)) if d == 0 else wide - inside[:, k] if d > 0 else inside[:, k] for k, d in enumerate((dx, dy))]
                near = np.flatnonzero(gap[0] ** 2 + gap[1] ** 2 <= radius**2 * (1 + SLACK))
                out.append((near, b, x[near] + dx, y[near] + dy, False))
        return out

    def linked(self, block: int, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of a row of ``left`` and one of ``right`` that count in ``block``."""
        own = slice(self.starts[block], self.starts[block] + self.sizes[block])
        a, b = left.turned[:, own].astype(np.float64), right.turned[:, own].astype(np.float64)
        far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        close = far <= self.budget[block] + SLACK
        if left is right:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(i), PAIRS):
            p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            hit = np.einsum("ij,ij->i", left.unit[p], right.unit[q]) >= self.cosine
            p, q = p[hit], q[hit]
            # Elementwise, so that every task sees the same distances of a pair.
            squares = (left.turned[p].astype(np.float64) - right.turned[q]) ** 2
            within = np.add.reduceat(squares, self.starts, axis=1) <= self.budget + SLACK / 2
            first = within.argmax(axis=1) == block
            found.append((p[first], q[first]))
        return tuple(np.concatenate(x) for x in zip(*found))


KEY = ("label", "block", "x", "y", "kind", "p", "q")
ROW = ("node", "n", "turned", "vec")


def compared(split: Split, key: tuple, homes: list[dict[str, list]]) -> pa.RecordBatch:
    """(node, links, root) of the nodes that are linked in one pair of chunks.

    Kind 0 compares the homes of a small cell with each other and its visitors, kind 1 two
    chunks of homes (or one with itself), kind 2 a chunk of homes with one of visitors.
    """
    first, second = (Side(rows, split.width) for rows in homes)
    todo = {0: [(first, first), (first, second)], 1: [(first, first)] if key[5] == key[6] else [(first, second)], 2: [(first, second)]}[key[4]]
    node, n = np.concatenate([first.node, second.node]), np.concatenate([first.n, second.n])
    links, low = np.zeros(len(node), np.int64), np.arange(len(node))
    for left, right in todo:
        if not len(left) or not len(right):
            continue
        i, j = split.linked(key[1], left, right)
        if right is not left:
            j = j + len(left)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        while len(i):
            # Names of both ends take the smaller one, then are followed to their ends.
            least = np.minimum(low[i], low[j])
            open_ = low[i] != low[j]
            i, j, least = i[open_], j[open_], least[open_]
            for at in (low[i], low[j]):
                np.minimum.at(low, at, least)
            while (low[low] != low).any():
                low = low[low]
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[some], pa.int64()), pa.array(links[some], pa.int64()), pa.array(node[low[some]], pa.int64())], names=["node", "links", "root"])


def joined(dealt_out: DataFrame, split: Split) -> DataFrame:
    """``compared`` for every pair of chunks; rows arrive sorted by it."""

    def run(batches):
        key, homes = None, []
        for batch in parts(batches):
            for row in batch.to_pylist():
                if (own := tuple(row[c] for c in KEY)) != key:
                    if key:
                        yield compared(split, key, homes)
                    key, homes = own, [{c: [] for c in ROW} for _ in range(2)]
                for c in ROW:
                    homes[row["side"]][c].append(row[c])
        if key:
            yield compared(split, key, homes)

    return dealt_out.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, "node long, links long, root long")


def placed(classes: DataFrame, split: Split) -> DataFrame:
    """(label, node, n, turned, vec, cells): each class with the grid cells that it is in."""

    def run(batches):
        for batch in batches:
            vectors = padded(matrix(batch["vec"]), split.width)
            turned = split.turned(vectors) if len(vectors) else np.zeros((0, split.width), np.float32)
            own: list[list[dict]] = [[] for _ in range(len(vectors))]
            for rows, block, x, y, home in split.cells(turned):
                for i, cx, cy in zip(rows.tolist(), x.tolist(), y.tolist()):
                    own[i].append({"block": block, "x": cx, "y": cy, "home": home})
            cells = pa.array(own, pa.list_(pa.struct([("block", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("home", pa.bool_())])))
            raw = [pa.array(r, pa.binary()) for r in ([r.tobytes() for r in turned], packed(vectors))]
            yield pa.RecordBatch.from_arrays([batch["label"], batch["node"], batch["n"], *raw, cells], names=["label", "node", "n", "turned", "vec", "cells"])

    return classes.select("label", "node", "n", "vec").mapInArrow(run, "label string, node long, n long, turned binary, vec binary, cells array<struct<block:int,x:long,y:long,home:boolean>>")


def dealt_to_chunks(rows: DataFrame) -> DataFrame:
    """Every row once for each pair of chunks that it takes part in, with its side in the pair."""
    cell = ["label", "block", "x", "y"]
    chunks = lambda own: F.ceil(F.count_if(own) / CHUNK).cast("int")
    entries = rows.select("label", "node", F.inline("cells"))
    sizes = entries.groupBy(*cell).agg(F.count_if("home").alias("homes"), chunks(F.col("home")).alias("h"), chunks(~F.col("home")).alias("v"), F.count("*").alias("all"))
    small = (F.col("homes") <= CHUNK) & (F.col("all") <= 2 * CHUNK)
    open_ = stored(sizes.where("homes > 0 and all > 1").select(*cell, "h", "v", small.alias("small")), "subspace-cells")
    met = entries.join(dealt(open_, *cell), cell)
    home = F.col("home")
    own = F.pmod(F.xxhash64("node"), F.when(home, F.col("h")).otherwise(F.col("v"))).cast("int")
    tag = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    zero, others, visits = F.lit(0), F.sequence(F.lit(0), F.col("h") - 1), F.when(F.col("v") > 0, F.sequence(F.lit(0), F.col("v") - 1)).otherwise(F.array().cast("array<int>"))
    of_home = F.concat(
        F.transform(others, lambda j: tag(1, F.least("own", j), F.greatest("own", j), F.when(j < F.col("own"), 1).otherwise(0))),
        F.transform(visits, lambda j: tag(2, F.col("own"), j, zero)),
    )
    of_visit = F.transform(others, lambda j: tag(2, j, F.col("own"), F.lit(1)))
    whole = F.array(tag(0, zero, zero, F.when(home, 0).otherwise(1)))
    out = met.withColumn("own", own).select("label", "node", "block", "x", "y", F.inline(F.when(F.col("small"), whole).when(home, of_home).otherwise(of_visit)))
    return out.join(rows.select("node", "n", "turned", "vec"), "node")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``df``; ``kept`` is true for one id of each component."""
    pairs = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("string").alias("label"), df[vec_col].alias("vec"))
    some = pairs.where(F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0))
    members = valid(some, "id", "vec", extra="label").withColumns({"one": F.xxhash64(F.lit(1), "label", "vec"), "two": F.xxhash64(F.lit(2), "label", "vec")})
    members = stored(members, "subspace-members")
    # Equal prints mean equal labels and vectors.
    classes = members.groupBy("one", "two").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = stored(classes, "subspace-classes")
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    sample = classes.select("vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
    split = Split(matrix(sample["vec"]) if sample.num_rows else np.zeros((0, width)), width, cosine, blocks)
    rows = stored(placed(classes, split), "subspace-rows")
    found = stored(joined(dealt_to_chunks(rows), split), "subspace-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "subspace-components")
    judged = classes.select("one", "two", "node", "n").join(links, "node", "left").join(tied, "node", "left")
    judged = judged.select("one", "two", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = members.select("id", "one", "two").join(dealt(judged, "one", "two"), ["one", "two"]).select("id", "n_links", "component")
    out = pairs.select("id").join(dealt(own, "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
