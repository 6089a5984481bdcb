"""Approximate nearest neighbours by cosine: NN-descent graphs and greedy graph search.

Equal vectors form one node, named by its smallest id, that keeps its ``k + 1`` smallest
ids: no other of them can be among the k nearest of anything. Nodes are dealt by hash into
shards of about ``SHARD`` nodes; each shard has a graph of its own, so a task that searches
one holds a bounded index.

NN-descent: each node starts with the best of two random groups. In a round every node's
neighbours (its own list, and a sample of the nodes that list it) are brought together by
joins, compared with each other, and each takes those that are nearer than the last of its
list. Only improvements are shuffled.

Search: for a shard and a group of queries, a beam starts at the query's own vector if it is
there and at the entries nearest to the query. Tight groups of vectors fall into pieces that
no link joins, so entries are chosen over the pieces: one node of every piece, and one in
``EVERY`` of its nodes. The best nodes that are not yet expanded are, until the beam has no
new ones or ``STEPS`` rounds are over. What is found is scored again in double precision
on the original vectors; the answers of all shards are merged. Recall is measured against
brute force in the tests.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, nor do rows without an id; a shorter vector counts as ending in zeros; of
rows that share an id the least vector counts; a query's own id is none of its candidates;
ties go to the smaller id; fewer candidates than k are all returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskweave.llm.candidates import dealt
from taskweave.llm.vectors import matrix, padded, query_groups, valid
from taskweave.session import stored

NEIGHBOURS = 20
REVERSE = 20
OFFERS = 5
ROUNDS = 6
START_GROUP = 512
SHARD = 50_000
# Queries that one copy of a shard is searched for, about; they go through it one block after the other.
GROUP = 65_536
ENTRIES = 64
EVERY = 16
WIDTH = 96
STEPS = 12
BEAM = 512


def nodes_of(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(node, members, vec): one row per distinct vector with its k + 1 smallest ids."""
    rows = valid(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    place = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return grouped.select(F.col("members")[0].alias("node"), "members", "vec")


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed(df: DataFrame) -> DataFrame:
    """Adds ``q``: the unit vector as 8-bit steps behind its scale, for comparisons while the graph is built."""

    def run(batches):
        for batch in batches:
            out = []
            if batch.num_rows:
                unit = units(matrix(batch["vec"]))
                scale = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
                steps = np.rint(unit / scale).astype(np.int8)
                out = [s.tobytes() + q.tobytes() for s, q in zip(scale, steps)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "q"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("q", T.BinaryType())]))


def unpacked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scales and steps; products of steps are exact in float32."""
    width = max(map(len, raw)) if raw else 4
    data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
    return data[:, :4].copy().view(np.float32)[:, 0], np.ascontiguousarray(data[:, 4:]).view(np.int8).astype(np.float32)


EDGES = "u long, v long, score float"


def edges_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], names=["u", "v", "score"])


def start_edges(nodes: DataFrame, count: int, neighbours: int) -> DataFrame:
    """For each node the best of two random groups of about START_GROUP nodes of its shard."""
    groups = max(1, round(count / START_GROUP))

    def run(batches):
        for batch in batches:
            parts = []
            for ids, raw in zip(batch["nodes"].to_pylist(), batch["qs"].to_pylist()):
                own = np.array(ids, np.int64)
                scale, steps = unpacked(raw)
                for a in range(0, len(own), START_GROUP):  # a group may be larger than meant
                    s = (steps[a : a + START_GROUP] @ steps.T) * scale[a : a + START_GROUP, None] * scale
                    s[np.arange(len(s)), a + np.arange(len(s))] = -2
                    n = min(neighbours, s.shape[1] - 1)
                    if n < 1:
                        continue
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    parts.append((np.repeat(own[a : a + START_GROUP], n), own[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
            yield edges_batch(parts)

    twice = nodes.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("g", F.pmod(F.xxhash64("node", "turn"), F.lit(groups)))
    return twice.groupBy("shard", "turn", "g").agg(F.collect_list("node").alias("nodes"), F.collect_list("q").alias("qs")).select("nodes", "qs").mapInArrow(run, EDGES)


def best(edges: DataFrame, neighbours: int) -> DataFrame:
    """The best edges of each node, without repeats; ``last`` is the score that a new one has to beat."""
    distinct = edges.repartition("u").groupBy("u", "v").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("score"), "v"))
    kept = distinct.withColumn("place", place).where(F.col("place") <= neighbours)
    full = F.min("score").over(W.partitionBy("u"))
    n = F.count("*").over(W.partitionBy("u"))
    return kept.withColumn("last", F.when(n == neighbours, full).otherwise(F.lit(-2.0).cast("float"))).drop("place")


def lists(graph: DataFrame, reverse: int) -> DataFrame:
    """(x, y): the neighbours of each node, and a sample of the nodes that list it."""
    place = F.row_number().over(W.partitionBy("v").orderBy(F.xxhash64("u", "v")))
    back = graph.select("u", "v").withColumn("place", place).where(F.col("place") <= reverse).select(F.col("v").alias("x"), F.col("u").alias("y"))
    return graph.select(F.col("u").alias("x"), F.col("v").alias("y")).union(back).distinct()


def offers(graph: DataFrame, nodes: DataFrame, reverse: int) -> DataFrame:
    """Neighbours of one node, offered to each other where that improves a list."""
    last = graph.groupBy("u").agg(F.max("last").alias("last"))
    known = nodes.select("node", "q").join(last, nodes["node"] == last["u"], "left").select(F.col("node").alias("y"), "q", F.coalesce("last", F.lit(-2.0).cast("float")).alias("last"))
    # A node that very many list is dealt anew, so that its part of the join can be split.
    met = lists(graph, reverse).join(dealt(known, "y"), "y").groupBy("x").agg(F.collect_list(F.struct("y", "q", "last")).alias("met")).select("met")

    def run(batches):
        for batch in batches:
            parts = []
            for lo in range(0, batch.num_rows, 500):
                column = batch["met"].slice(lo, 500)
                ends, flat = np.diff(column.offsets.to_numpy()), column.flatten()
                y, q, last = (flat.field(i) for i in range(3))
                y, last = y.to_numpy(), last.to_numpy()
                scale, steps = unpacked(q.to_pylist())
                size = int(ends.max()) if len(ends) else 0
                if size < 2:
                    continue
                # Lists padded to one size, so that all are compared in one product.
                row, col = np.repeat(np.arange(len(ends)), ends), np.arange(len(y)) - np.repeat(np.cumsum(ends) - ends, ends)
                block = np.zeros((len(ends), size, steps.shape[1]), np.float32)
                block[row, col] = steps
                factor, name, bar = np.zeros((len(ends), size), np.float32), np.full((len(ends), size), -1, np.int64), np.full((len(ends), size), 2, np.float32)
                factor[row, col], name[row, col], bar[row, col] = scale, y, last
                s = (block @ block.transpose(0, 2, 1)) * (factor[:, :, None] * factor[:, None, :])
                s[np.broadcast_to((name < 0)[:, None, :], s.shape)] = -2
                s[:, np.arange(size), np.arange(size)] = -2
                n = min(OFFERS, size - 1)
                top = np.argpartition(-s, n - 1, axis=2)[:, :, :n]
                s = np.take_along_axis(s, top, 2)
                u = np.broadcast_to(name[:, :, None], s.shape)
                v = np.take_along_axis(np.broadcast_to(name[:, None, :], (*name.shape, size)), top, 2)
                good = (s > bar[:, :, None]) & (u >= 0) & (s > -2)
                parts.append((u[good], v[good], s[good]))
            yield edges_batch(parts)

    return met.mapInArrow(run, EDGES)


def descend(nodes: DataFrame, count: int, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, score, last): the neighbour graph, written once per round."""
    graph = stored(best(start_edges(nodes, count, neighbours), neighbours), "graph")
    for _ in range(rounds):
        graph = stored(best(graph.select("u", "v", "score").union(offers(graph, nodes, reverse)), neighbours), "graph")
    return graph


def pieces(near: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its piece, the rows that links join in either direction."""
    row, col = np.nonzero(near >= 0)
    other = near[row, col]
    low = np.arange(len(near))
    while True:
        new = low.copy()
        least = np.minimum(low[row], low[other])
        # The names of both ends take the smaller one, then all names are followed to their ends.
        for at in (row, other, low[row], low[other]):
            np.minimum.at(new, at, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


class Shard:
    """One shard's nodes and graph, for greedy search."""

    def __init__(self, nodes: pa.Table) -> None:
        self.ids = nodes["node"].to_numpy()
        self.members = nodes["members"].to_pylist()
        self.vec = matrix(nodes["vec"])
        self.unit = units(self.vec).astype(np.float32)
        order = np.argsort(self.ids)
        links = [np.array(x or [], np.int64) for x in nodes["near"].to_pylist()]
        size = max([1, *map(len, links)])
        self.near = np.full((len(links), size), -1, np.int64)
        if sum(map(len, links)):
            row = np.repeat(np.arange(len(links)), [len(x) for x in links])
            col = np.concatenate([np.arange(len(x)) for x in links])
            self.near[row, col] = order[np.searchsorted(self.ids, np.concatenate(links), sorter=order)]
        self.at = {v.tobytes(): i for i, v in enumerate(self.vec)}
        # Rows piece by piece; of each the first and every ``step``-th.
        name = pieces(self.near)
        by_piece = np.argsort(name, kind="stable")
        name = name[by_piece]
        inside = np.arange(len(name)) - np.searchsorted(name, name)
        step = max(1, min(EVERY, len(name) // ENTRIES))
        self.entries = by_piece[inside % step == 0]

    def search(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Rows of the beam of each query, nearest first."""
        n, count = len(self.ids), len(vectors)
        unit = units(vectors).astype(np.float32)
        seen = np.zeros(count * n, bool)
        own = np.array([self.at.get(v.tobytes(), -1) for v in vectors])
        # A beam holds no more than BEAM, so the nearest entries are all that it can start from.
        start = np.broadcast_to(self.entries, (count, len(self.entries)))
        if len(self.entries) > BEAM:
            start = self.entries[np.argpartition(-(unit @ self.unit[self.entries].T), BEAM - 1, axis=1)[:, :BEAM]]
        query = np.concatenate([np.repeat(np.arange(count), start.shape[1]), np.flatnonzero(own >= 0)])
        row = np.concatenate([start.ravel(), own[own >= 0]])
        beam_q, beam_row, beam_s, beam_new = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
        for _ in range(STEPS):
            key = np.unique(query * n + row)
            key = key[~seen[key]]
            seen[key] = True
            query, row = key // n, key % n
            s = np.empty(len(key), np.float32)
            for a in range(0, len(key), 100_000):
                b = slice(a, a + 100_000)
                s[b] = np.einsum("ij,ij->i", unit[query[b]], self.unit[row[b]])
            beam_q, beam_row, beam_s, beam_new = np.concatenate([beam_q, query]), np.concatenate([beam_row, row]), np.concatenate([beam_s, s]), np.concatenate([beam_new, np.ones(len(key), bool)])
            order = np.lexsort((-beam_s, beam_q))
            beam_q, beam_row, beam_s, beam_new = beam_q[order], beam_row[order], beam_s[order], beam_new[order]
            keep = np.arange(len(beam_q)) - np.searchsorted(beam_q, beam_q) < BEAM
            beam_q, beam_row, beam_s, beam_new = beam_q[keep], beam_row[keep], beam_s[keep], beam_new[keep]
            fresh = np.flatnonzero(beam_new)
            fresh = fresh[np.arange(len(fresh)) - np.searchsorted(beam_q[fresh], beam_q[fresh]) < WIDTH]
            if not len(fresh):
                break
            beam_new[fresh] = False
            near = self.near[beam_row[fresh]]
            query, row = np.repeat(beam_q[fresh], near.shape[1]), near.ravel()
            query, row = query[row >= 0], row[row >= 0]
        return [beam_row[a:b] for a, b in zip(np.searchsorted(beam_q, np.arange(count)), np.searchsorted(beam_q, np.arange(count), "right"))]


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, on the original vectors; equal rows get equal scores."""
    scale, most = np.abs(query).max(), np.abs(rows).max(axis=1)
    if scale < 1e150 and most.max() < 1e150 and scale > 1e-150 and most.min() > 1e-150:
        return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))
    return cosine(query / scale, rows / most[:, None])


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` that the search finds for each query."""
    distinct = stored(packed(nodes_of(df, id_col, vec_col, k)), "ann-nodes")
    count = distinct.count()
    shards = max(1, -(-count // SHARD))
    nodes = distinct.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    # Start groups lie inside shards, and so does all that follows from them.
    graph = descend(nodes.select("node", "q", "shard"), -(-count // shards), neighbours, reverse, rounds)
    near = lists(graph, reverse).groupBy("x").agg(F.collect_list("y").alias("near"))
    asked = valid(queries, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    groups = query_groups(asked.count(), shards, GROUP)
    left = nodes.join(near, nodes["node"] == near["x"], "left").select("node", "members", "vec", "near", "shard").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and wanted.num_rows:
            index = Shard(held)
            vectors = padded(matrix(wanted["vec"]), index.vec.shape[1])
            asked_ids = wanted["id"].to_pylist()
            live = np.flatnonzero(np.abs(vectors).max(axis=1) > 0)
            for a in range(0, len(live), 64):
                part = live[a : a + 64]
                for i, beam in zip(part.tolist(), index.search(vectors[part])):
                    beam = beam[: 4 * k + 1]
                    found = [(-s, member) for s, b in zip(cosine(vectors[i], index.vec[beam]).tolist(), beam.tolist()) for member in index.members[b] if member != asked_ids[i]]
                    for s, member in sorted(found)[:k]:
                        out[0].append(asked_ids[i])
                        out[1].append(member)
                        out[2].append(-s)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "g").cogroup(right.groupBy("shard", "g")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
