"""Ranked lexical search for many queries at once, sharing what their term sets have in common.

A score is a sum over an item's terms, so items that share terms share sums. What is shared
is mined once per block of items:

1. Terms that occur in the same items are one atom; they are found by a digest of the items
   that hold a term, in Spark, whatever the number of items.
2. The pair of nodes that most items hold becomes a new node in both's place, again and
   again (many disjoint pairs a round), until no two items share a pair. Nodes and their two
   parts are a graph without cycles, an item is the sum of the few nodes left to it.

Documents are read once per block: one row each with their number of terms and the counts of
those that items ask for, written to the shared folder. Document frequencies come from these
rows. Then tasks take documents a batch at a time: an atom's partial sum is made from the
weighted counts, every node is added up once from its two parts, items from their nodes, and
each task keeps the best ``k`` documents of each item.

A block holds items of about ``BLOCK`` terms in all, so what a task is sent (its codes,
weights and nodes) is bounded by that, or by one item's terms; more items make more blocks.
Terms are known by 64-bit hashes: with 500,000 terms asked for and 1e9 in the corpus, two
are taken for one with probability 3e-5.

Defined cases: a null text has no terms; a document without terms is not counted and never
found; items without an id, or without terms, take no part; rows sharing an item id are one
item with the terms of all; rows sharing a document id are documents of their own; documents
without an id count, and come last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskweave.llm.arrays import BYTES, chunks, parts, prefix_sums, span_hashes, texts_of
from taskweave.session import stored

TOP = 10
# (item, term) pairs of a block of items, about.
BLOCK = 500_000
# Node pairs that become nodes in one round of mining.
PAIRS = 256
# Atoms that are mined for pairs, those of the most items first; the rest are summed as they are.
SHARED = 4096
# Sums that a task holds at once.
CELLS = 4_000_000
LAST = np.iinfo(np.int64).max

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def term_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every term of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IN_TERM[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, span_hashes(prefix_sums(BYTES[LOWER[data]]), starts, ends)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every term of the texts."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, hashes = term_hashes(np.frombuffer(b" ".join(raw), np.uint8))
    return np.searchsorted(ends, starts, "right"), hashes


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of every item, as hashes."""

    def run(batches):
        for batch in parts(batches):
            owner, hashes = hashed(texts_of(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(owner)), pa.array(hashes.astype(np.int64))], names=["item", "term"])

    rows = items.select(items[id_col].cast("long").alias("item"), items[text_col].cast("string").alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "item long, term long").distinct()


def atoms_of(pairs: DataFrame) -> DataFrame:
    """(block, atom, item, terms): the terms that occur in the same items of a block, listed once per item.

    The atom is named by its least term; only that term's rows carry it on.
    """
    digest = [F.bit_xor(F.xxhash64("item", F.lit(k))).alias(f"d{k}") for k in (1, 2)]
    alike = pairs.groupBy("block", "term").agg(F.count("*").alias("n"), *digest)
    atoms = alike.groupBy("block", "n", "d1", "d2").agg(F.min("term").alias("atom"), F.array_sort(F.collect_list("term")).alias("terms"))
    return pairs.withColumnRenamed("term", "atom").join(atoms.select("block", "atom", "terms"), ["block", "atom"]).select("block", "atom", "item", "terms")


class Plan:
    """One block's terms, atoms, shared nodes and items."""

    def __init__(self, rows: pa.Table) -> None:
        items, atoms = rows["item"].to_numpy(), rows["atom"].to_numpy()
        self.items, item = np.unique(items, return_inverse=True)
        names, first, atom = np.unique(atoms, return_index=True, return_inverse=True)
        lists = rows["terms"].take(pa.array(first)).to_pylist()
        terms = np.array([t for own in lists for t in own], np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        order = np.argsort(terms)
        self.terms, self.atom_of = terms[order], owner[order]
        self.atoms = len(names)
        self.left, self.right, uses = self.shared(item, atom)
        # The nodes of each item, one item after the other.
        item, node = uses
        order = np.lexsort((node, item))
        self.node, self.from_ = node[order], np.searchsorted(item[order], np.arange(len(self.items)))

    def shared(self, item: np.ndarray, atom: np.ndarray) -> tuple[list[int], list[int], tuple[np.ndarray, np.ndarray]]:
        """The parts of each new node, and the (item, node) pairs that are left."""
        times = np.bincount(atom, minlength=self.atoms)
        common = np.flatnonzero(times > 1)
        common = common[np.argsort(-times[common], kind="stable")][:SHARED]
        place = np.full(self.atoms, -1)
        place[common] = np.arange(len(common))
        mined = place[atom] >= 0
        held = np.zeros((len(common), len(self.items)), bool)
        held[place[atom[mined]], item[mined]] = True
        node, left, right = list(common), [], []
        while True:
            live = np.flatnonzero(held.sum(axis=1) > 1)
            both = held[live].astype(np.float32) @ held[live].T.astype(np.float32)
            both = np.triu(both, 1)
            i, j = np.nonzero(both > 1)
            if not len(i):
                break
            used = np.zeros(len(live), bool)
            made = 0
            for at in np.lexsort((j, i, -both[i, j])):
                a, b = i[at], j[at]
                if used[a] or used[b]:
                    continue
                used[[a, b]] = True
                together = held[live[a]] & held[live[b]]
                held[live[a]] &= ~together
                held[live[b]] &= ~together
                held = np.vstack([held, together])
                left.append(node[live[a]])
                right.append(node[live[b]])
                node.append(self.atoms + len(left) - 1)
                made += 1
                if made == PAIRS:
                    break
        row, at = np.nonzero(held)
        return left, right, (np.concatenate([item[~mined], at]), np.concatenate([atom[~mined], np.array(node, np.int64)[row]]))

    def scores(self, doc: np.ndarray, atom: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """Score of every item (row) for every document, from the parts of atoms."""
        sums = np.zeros((self.atoms + len(self.left), docs), np.int64)
        key = atom * docs + doc
        order = np.argsort(key, kind="stable")
        key, part = key[order], part[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            sums.reshape(-1)[key[first]] = np.add.reduceat(part, first)
        for k, (a, b) in enumerate(zip(self.left, self.right), self.atoms):
            np.add(sums[a], sums[b], out=sums[k])
        if not len(self.items):
            return np.zeros((0, docs), np.int64)
        return np.stack([sums[own].sum(axis=0) for own in np.split(self.node, self.from_[1:])])


def counted(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, codes, times): the number of terms of each document, and those of ``terms`` with their counts."""
    kinds = terms.view(np.uint64)
    order = np.argsort(kinds)
    sorted_, code_of = kinds[order], order

    def run(batches):
        for batch in parts(batches):
            texts = texts_of(batch["text"])
            for a, b in chunks([len(t) for t in texts]):
                owner, hashes = hashed(texts[a:b])
                n = np.bincount(owner, minlength=b - a)
                at = np.minimum(np.searchsorted(sorted_, hashes), max(0, len(sorted_) - 1))
                wanted = sorted_[at] == hashes if len(sorted_) else np.zeros(len(hashes), bool)
                key, times = np.unique(owner[wanted] * len(terms) + code_of[at[wanted]], return_counts=True)
                starts = pa.array(np.searchsorted(key // max(1, len(terms)), np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, kind)) for x, kind in ((key % max(1, len(terms)), pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc"].slice(a, b - a), pa.array(n, pa.int64()), *lists], names=["doc", "n", "codes", "times"])

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc long, n long, codes array<int>, times array<long>").where("n > 0")


def ranked(rows: DataFrame, plan: Plan, weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item in every task, or more where rows tie with null ids."""
    batch_docs = max(1, CELLS // max(1, plan.atoms + len(plan.left) + len(plan.items)))

    def run(batches):
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        least = np.zeros(len(plan.items), np.int64)
        for batch in parts(batches, batch_docs):
            ids = batch["doc"].fill_null(LAST).to_numpy()
            n = batch["n"].to_numpy()
            codes, times = batch["codes"].flatten().to_numpy(), batch["times"].flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(batch["codes"].offsets.to_numpy()))
            m = 10 + (90 * n * docs) // length
            part = weights[codes] * ((1_000_000_000 * times) // (1000 * times + 8 * m[owner]))
            found = plan.scores(owner, plan.atom_of[codes], part, len(ids))
            row, column = np.nonzero((found > 0) & (found >= least[:, None]))
            item, score, doc = np.concatenate([item, row]), np.concatenate([score, found[row, column]]), np.concatenate([doc, ids[column]])
            order = np.lexsort((doc, -score, item))
            order = order[np.arange(len(order)) - np.searchsorted(item[order], item[order]) < k]
            item, score, doc = item[order], score[order], doc[order]
            full = np.arange(len(item)) - np.searchsorted(item, item) == k - 1
            least[item[full]] = score[full]
        yield pa.RecordBatch.from_arrays([pa.array(plan.items[item], pa.int64()), pa.array(doc, pa.int64(), mask=doc == LAST), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return rows.select("doc", "n", "codes", "times").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item."""
    pairs = stored(item_terms(items, item_col, item_text), "lexical-items")
    blocks = max(1, -(-pairs.count() // BLOCK))
    atoms = stored(atoms_of(pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))), "lexical-atoms")
    best = None
    for block in range(blocks):
        plan = Plan(atoms.where(F.col("block") == block).select("item", "atom", "terms").toArrow().combine_chunks())
        rows = stored(counted(docs, plan.terms, id_col, text_col), "lexical-documents")
        total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        holding = rows.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()
        weights = np.zeros(len(plan.terms), np.int64)
        held = holding["count"].to_numpy()
        weights[holding["code"].to_numpy()] = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * held + 1))).astype(np.int64)
        found = ranked(rows, plan, weights, total["docs"], total["length"] or 1, k)
        best = found if best is None else best.union(found)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
