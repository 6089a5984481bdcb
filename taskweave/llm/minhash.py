"""Near-duplicates by b-bit MinHash, with exact links.

A document's set is its distinct 5-word shingles. Equal sets are one class, so copies are
one row from then on. Of each set HASHES minima are taken; bands of ROWS minima give the
candidate buckets, and the minima's low BITS bits, packed into bit planes, an estimate of
the similarity: the share of equal slots, corrected for the 2**-BITS that are equal by
chance. Two sets of similarity 0.75 share a band with probability 1 - 1e-8.

Candidates are not all pairs of a bucket. First each member meets the bucket's smallest
class only; pairs whose estimate is far below the threshold (over six standard errors) go,
the others are confirmed on the full sets, and confirmed links make components. Most groups
are one component then and done. In the others, members outside the smallest class's
component are compared with each other and with those inside, a pair of bounded blocks in a
task, and only links that join components leave it. So rows grow with a group's size, and
a pair that is never looked at lies inside one component; what is compared grows with the
product of the members inside and outside.

Only the texts of candidates travel, and their sets are made anew where they meet: sorted
64-bit hashes of shingles. Components come from repeated joins to the smallest neighbour, written to the shared folder per round.

Defined cases: a text without words, or null, has an empty set and links with nothing, not
even its like; a text of fewer than 5 words has its whole sequence as one shingle; rows
without an id are in no component and are kept; rows sharing an id are judged by their own
texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskweave.llm.arrays import U, mix, parts, prefix_sums, span_hashes, texts_of, word_hashes
from taskweave.llm.candidates import dealt, maybe_wanted, wanted_texts
from taskweave.session import stored

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
ROWS = 4
BANDS = 48
HASHES = ROWS * BANDS
BITS = 2
# An estimate errs by at most this but once in 1e9: over six standard errors of HASHES slots.
MARGIN = 0.25
# A block of a group: so many rows and shingles at most, as expected by hash.
BLOCK_ROWS = 1000
BLOCK_SHINGLES = 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEEDS = mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
MASKS = (SEEDS >> U(32)).astype(np.uint32)
FACTORS = SEEDS.astype(np.uint32) | np.uint32(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the lower-cased (A-Z) words."""
    data = np.frombuffer(text.encode().translate(LOWER), np.uint8)
    _, _, words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    starts = np.arange(max(1, n - size + 1))
    return np.unique(span_hashes(prefix_sums(words), starts, np.minimum(starts + size, n)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    small = hashes.astype(np.uint32)
    for a in range(0, len(small), 512):
        np.minimum(low, ((small[a : a + 512, None] ^ MASKS) * FACTORS).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of minima."""
    key = np.arange(1, BANDS + 1, dtype=U)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key + column.astype(U) * U(0x9E3779B97F4A7C15))
    return key.astype(np.int64)


def planes(low: np.ndarray) -> np.ndarray:
    """The low bits of all minima: bit plane p holds bit p of each, 64 slots a word."""
    mixed = mix(low.astype(U))
    bits = np.stack([(mixed >> U(p)) & U(1) for p in range(BITS)]).astype(np.uint8)
    return np.packbits(bits.reshape(BITS, -1, 64), axis=2, bitorder="little").view(np.int64).ravel()


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for slots that are equal by chance."""
    words = HASHES // 64
    unequal = F.lit(0)
    for w in range(words):
        differ = None
        for p in range(BITS):
            x = a[p * words + w].bitwiseXOR(b[p * words + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-BITS
    return ((HASHES - unequal) / HASHES - chance) / (1 - chance)


def sketches(texts: DataFrame) -> DataFrame:
    """(id, tag, n, print, keys, signature) of every (id, text); rows without words have only n = 0."""

    def run(batches):
        for batch in parts(batches):
            n, prints, keys, signatures = [], [], [], []
            for text in texts_of(batch["text"]):
                own = shingles(text)
                n.append(len(own))
                if len(own):
                    low = minima(own)
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    keys.append(bands(low))
                    signatures.append(planes(low))
                else:
                    for column in (prints, keys, signatures):
                        column.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["tag"], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, longs), pa.array(signatures, longs)], names=["id", "tag", "n", "print", "keys", "signature"])

    return texts.withColumn("tag", F.xxhash64("text")).mapInArrow(run, "id long, tag long, n long, print binary, keys array<long>, signature array<long>")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    if min(len(x), len(y)) * DENOMINATOR < max(len(x), len(y)) * NUMERATOR:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * DENOMINATOR >= (len(x) + len(y) - common) * NUMERATOR


def confirmed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of stored ``pairs`` that are linked on the full sets of their texts (id, text)."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-wanted")
    few = stored(wanted_texts(texts, wanted), "near-texts")

    def run(batches):
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, U))
        for batch in parts(batches):
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                # Neighbouring rows have the same first text, which is read once.
                if (first := x.as_py()) != last[0]:
                    last = (first, shingles(first or ""))
                other = shingles(y.as_py() or "")
                keep.append(bool(len(other)) and linked(last[1], other))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    right = few.select(F.col("id").alias("b"), F.col("text").alias("y"))
    left = few.select(F.col("id").alias("a"), F.col("text").alias("x"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "near-components") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Rounds of: every node's neighbours are tied to the smallest among them and itself; when
    each node is tied to nothing but its smallest, the ties are the components.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # Larger neighbours of a node are tied to its smallest neighbour ...
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        # ... and the smaller neighbours and the node itself to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least, "u"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = stored(small.distinct(), name)
        # Done when no node is both tied and tied to.
        if small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            tied = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return tied.union(tied.select(F.col("component").alias("node"), "component").distinct())
        edges = small


def rejoined(tied: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``tied`` after further links: only components meet, not their nodes."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = tied.union(nodes.join(tied, "node", "left_anti").select("node", F.col("node").alias("component")))
    known = stored(known, "near-known")
    first, second = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = components(links.join(first, "a").join(second, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = between.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stored(known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "near-joined")


class Found:
    """Links between different components, as few as join what is joined."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (up := self.low.get(c, c)) != c:
            c = up
        return c

    def join(self, c: int, d: int) -> bool:
        c, d = sorted((self.root(c), self.root(d)))
        self.low[d] = c
        return c != d


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of x with every row of y, from packed signatures."""
    words, out = HASHES // 64, np.empty((len(x), len(y)), np.float32)
    for lo in range(0, len(x), 32):
        differ = (x[lo : lo + 32, None, :] ^ y[None]).reshape(-1, len(y), BITS, words)
        unequal = np.bitwise_count(np.bitwise_or.reduce(differ, axis=2)).sum(axis=2)
        out[lo : lo + 32] = ((HASHES - unequal) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)
    return out


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    every = np.concatenate([*x, *y])
    kinds, place, times = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    # A shingle of one set alone is in no intersection.
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (lo, lo + 2048))
        held = np.zeros((len(x) + len(y), 2048), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def compared(kind: int, rows: dict[str, list]) -> list[tuple[int, int]]:
    """Links between different components in one pair of blocks, confirmed on the full sets.

    Kind 0 compares all rows, kind 1 those outside the first's component with those inside.
    """
    outside = np.array(rows["outside"], bool)
    x = np.arange(len(outside)) if kind == 0 else np.flatnonzero(outside)
    y = x if kind == 0 else np.flatnonzero(~outside)
    component = np.array(rows["component"], np.int64)
    packed = np.array(rows["signature"], np.int64).reshape(len(outside), -1)
    maybe = (estimates(packed[x], packed[y]) >= NUMERATOR / DENOMINATOR - MARGIN) & (component[x][:, None] != component[y])
    if kind == 0:
        maybe = np.triu(maybe, 1)
    if not maybe.any():
        return []
    some_x, some_y = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    sets = {int(i): shingles(rows["text"][i] or "") for i in np.union1d(x[some_x], y[some_y])}
    left, right = [sets[int(i)] for i in x[some_x]], [sets[int(i)] for i in y[some_y]]
    both = common(left, right)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
    hit = maybe[np.ix_(some_x, some_y)] & (both * DENOMINATOR >= (total - both) * NUMERATOR)
    found, out = Found(), []
    for i, j in zip(*np.nonzero(hit)):
        p, q = int(x[some_x[i]]), int(y[some_y[j]])
        if found.join(int(component[p]), int(component[q])):
            out.append((rows["node"][p], rows["node"][q]))
    return out


def across(texts: DataFrame, met: DataFrame, tied: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): links between different components of ``tied``, among nodes that share a bucket.

    All nodes of buckets with one smallest node form a group. Those outside that node's
    component are compared with each other and with those inside, in blocks of bounded size:
    a task holds a pair of blocks, compares the signatures and then the full sets of what may
    be similar, and returns no more links than join the components.
    """
    place = met.select("first", "node").distinct().join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = place.where("node = first").select("first", F.col("component").alias("head"))
    sides = place.join(dealt(heads, "first"), "first").withColumn("outside", F.col("component") != F.col("head")).join(signed, "node")
    sides = stored(sides.select("first", "node", "component", "outside", "n", "signature"), "near-sides")
    blocks = lambda own: F.greatest(F.ceil(F.count_if(own) / BLOCK_ROWS), F.ceil(F.sum(F.when(own, F.col("n"))) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    open_ = sides.groupBy("first").agg(F.count_if("outside").alias("others"), blocks(F.col("outside")).alias("out"), blocks(~F.col("outside")).alias("inn")).where("others > 0")
    rows = sides.join(dealt(open_.select("first", "out", "inn"), "first"), "first")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("inn"))).cast("int")
    tag = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    outer, inner = F.sequence(F.lit(0), F.col("out") - 1), F.sequence(F.lit(0), F.col("inn") - 1)
    outside = F.concat(F.transform(outer, lambda j: tag(0, F.least("own", j), F.greatest("own", j))), F.transform(inner, lambda j: tag(1, F.col("own"), j)))
    inside = F.transform(outer, lambda j: tag(1, j, F.col("own")))
    dealt_out = rows.withColumn("own", own).select("first", "node", "component", "outside", "signature", F.inline(F.when(F.col("outside"), outside).otherwise(inside)))
    dealt_out = stored(dealt_out, "near-blocks")
    few = stored(wanted_texts(texts, dealt_out.select(F.col("node").alias("id")).distinct()), "near-texts")
    columns = ["first", "kind", "p", "q"]
    sorted_ = dealt_out.join(few.select(F.col("id").alias("node"), "text"), "node").repartition(*columns).sortWithinPartitions(*columns)

    def run(batches):
        key, rows = None, {}
        for batch in parts(batches):
            out: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if (own := tuple(row[c] for c in columns)) != key:
                    out += compared(key[1], rows) if key else []
                    key, rows = own, {c: [] for c in ("node", "component", "outside", "signature", "text")}
                for c, values in rows.items():
                    values.append(row[c])
            yield _links(out)
        if key:
            yield _links(compared(key[1], rows))

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ``kept`` is true for one id of each component."""
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    found = _judged(texts)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, repeated rows (same id and text) once; rows without an id all stay.

    Rows that are certainly kept are not shuffled.
    """
    own = F.struct(*[df[c] for c in df.columns]).alias("row")
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"), own)
    # The text's hash tells rows of one id apart.
    hashed = rows.withColumn("tag", F.xxhash64("text"))
    found = _judged(rows.select("id", "text"), tagged=True)
    doubtful = found.where("id is not null").groupBy("id", "tag").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("not kept or times > 1")
    doubtful = stored(doubtful.select("id", "tag", "kept"), "near-doubtful")
    maybe = maybe_wanted(F.col("id"), doubtful)
    sure = hashed.where(~maybe)
    judged = hashed.where(maybe).join(doubtful, ["id", "tag"], "left")
    # Of repeated rows one stays.
    place = F.row_number().over(W.partitionBy("id", "tag").orderBy(F.to_json("row")))
    once = judged.where(F.coalesce("kept", F.lit(True))).withColumn("place", place).where("place = 1")
    return sure.select("row.*").union(once.select("row.*"))


def _judged(texts: DataFrame, tagged: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every (id, text), with the text's hash if ``tagged``."""
    rows = stored(sketches(texts), "near-sketches")
    # Equal prints mean equal sets, so any row's columns stand for the class.
    classes = rows.where("id is not null and n > 0").groupBy("print").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "keys", "signature")])
    named = stored(classes.select("print", "node", "n", "signature"), "near-classes")
    signed = named.select("node", "n", "signature")
    entries = classes.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    # Entries of buckets of two members or more: all that follows reads these.
    met = stored(entries.join(dealt(shared, "key"), "key").select("key", "node", "first"), "near-buckets")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and estimates do not rule out, with the estimate."""
        a, b = signed.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("signature").alias("asig")), signed.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("signature").alias("bsig"))
        joined = pairs.join(b, "b").join(a, "a").withColumn("estimate", estimate(F.col("asig"), F.col("bsig")))
        size = F.least("an", "bn") * DENOMINATOR >= F.greatest("an", "bn") * NUMERATOR
        return joined.where(size & (F.col("estimate") >= NUMERATOR / DENOMINATOR - MARGIN)).select("a", "b", "estimate")

    star = stored(close(met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), "near-star")
    links = stored(confirmed(texts, star), "near-links")
    tied = components(links)
    rest = stored(across(texts, met, tied, signed), "near-links")
    tied = rejoined(tied, rest)
    found = rows.select("id", "n", "print", "tag").join(named.select("print", "node"), "print", "left").join(tied, "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "id")).cast("long")
    extra = ["tag"] if tagged else []
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"), *extra)
