"""Removes long repeated spans, by minimiser buckets in place of a compacted de Bruijn graph of words.

Nodes and their degrees are not built; the graph's terms say what the buckets stand for. Edges are the windows of WINDOW words, from their first to their last WINDOW - 1 words.
They are not listed one by one: a run of neighbouring windows with the same smallest
ANCHOR-word hash is one path, known by that hash and by a hash of all its words. Equal
windows have equal smallest hashes, so a window can repeat only inside its bucket of paths.

A join on the bucket keeps the paths of buckets that several documents have. Where all
paths of a bucket are equal the path does not branch, and stands for all its windows at
once. Where they differ the graph branches there, and the bucket's paths are split into
single edges, which are joined on the edge. Either way the smallest document (and a
position in it) is known for each repeated window; neighbours along one source are then
joined to long spans. Every span is verified: the digest of its words must equal that of
the words at its source coordinates.

A word goes if a window that covers it is also in a document with a smaller id; windows are
judged on the input. Groups of any size cost rows in proportion to their texts: no pairs of
documents are formed.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; a
row without an id keeps all its words and removes none elsewhere; rows that share an id are
judged by their own texts, and not against each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.arrays import U, prefix_sums, span_hashes, texts_of, word_hashes
from taskweave.llm.candidates import dealt, wanted_texts
from taskweave.session import stored

WINDOW = 50
ANCHOR = 12


class Words:
    """The words of a text and their hashes."""

    def __init__(self, text: str) -> None:
        self.raw = text.encode()
        self.starts, self.ends, hashes = word_hashes(np.frombuffer(self.raw, np.uint8))
        self.sums = prefix_sums(hashes)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.sums, starts, ends)

    def joined(self, start: int = 0, end: int | None = None) -> bytes:
        """The words [start, end) with single spaces."""
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist()))

    def anchors(self) -> np.ndarray:
        """The smallest hash of ANCHOR words in each window."""
        starts = np.arange(len(self) - ANCHOR + 1)
        low, width, need = self.hashes(starts, starts + ANCHOR), 1, WINDOW - ANCHOR + 1
        while width < need:
            step = min(width, need - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        return low


def tag_of(words: Words) -> tuple[str, int]:
    """The digest of all words, and a number that tells texts of one id apart."""
    digest = hashlib.sha256(words.joined())
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "big", signed=True)


def paths_of(texts: DataFrame) -> DataFrame:
    """(id, tag, n_words, sha256, paths) of every text; a path has bucket, print, first window, windows."""

    def run(batches):
        inner = pa.struct([("bucket", pa.int64()), ("print", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])
        for batch in batches:
            tags, sizes, digests, offsets, columns = [], [], [], [0], [[], [], [], []]
            for text in texts_of(batch["text"]):
                words = Words(text)
                digest, tag = tag_of(words)
                tags.append(tag)
                sizes.append(len(words))
                digests.append(digest)
                if len(words) >= WINDOW:
                    low = words.anchors()
                    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
                    after = np.append(first[1:], len(low))
                    prints = words.hashes(first, after + WINDOW - 1)
                    for column, values in zip(columns, (low[first].astype(np.int64), prints.astype(np.int64), first.astype(np.int32), (after - first).astype(np.int32))):
                        column.append(values)
                    offsets.append(offsets[-1] + len(first))
                else:
                    offsets.append(offsets[-1])
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            paths = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, inner)], fields=list(inner)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(tags, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), paths], names=["id", "tag", "n_words", "sha256", "paths"])

    return texts.mapInArrow(run, "id long, tag long, n_words long, sha256 string, paths array<struct<bucket: long, print: long, first: int, windows: int>>")


def edges_of(texts: DataFrame, branching: DataFrame) -> DataFrame:
    """(bucket, edge, id, tag, first, windows): the single windows of branching paths, hashed from the texts again.

    Neighbouring windows that are equal (one word over and over) are one row.
    """
    listed = branching.groupBy("id", "tag").agg(F.collect_list(F.struct("bucket", "first", "windows")).alias("paths"))
    listed = stored(listed, "span-branching")
    joined = wanted_texts(texts, listed.select("id").distinct()).join(listed, "id").select("id", "tag", "text", "paths")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                paths = batch["paths"][i].values
                words = Words(batch["text"][i].as_py() or "")
                tag = batch["tag"][i].as_py()
                if tag_of(words)[1] != tag:  # another text of this id
                    continue
                counts = paths.field("windows").to_numpy().astype(np.int64)
                first = paths.field("first").to_numpy().astype(np.int64)
                windows = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
                edge = words.hashes(windows, windows + WINDOW).astype(np.int64)
                bucket = np.repeat(paths.field("bucket").to_numpy(), counts)
                new = np.flatnonzero(np.concatenate([[True], (edge[1:] != edge[:-1]) | (windows[1:] != windows[:-1] + 1)]))
                size = np.diff(np.append(new, len(edge)))
                same = [pa.array(np.full(len(new), x, np.int64)) for x in (batch["id"][i].as_py(), tag)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), pa.array(edge[new]), *same, pa.array(windows[new].astype(np.int32)), pa.array(size.astype(np.int32))], names=["bucket", "edge", "id", "tag", "first", "windows"])

    return joined.mapInArrow(run, "bucket long, edge long, id long, tag long, first int, windows int")


SPANS = "id long, tag long, start int, words int, source long, source_tag long, source_start int"


def long_spans(found: DataFrame) -> DataFrame:
    """Neighbouring or overlapping windows along one source joined to long spans, a document at a time."""
    listed = found.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "windows", "source", "source_tag", "source_first", "step")).alias("found"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, tag, parts in zip(batch["id"].to_pylist(), batch["tag"].to_pylist(), batch["found"]):
                fields = [parts.values.field(k).to_numpy() for k in range(6)]
                first, windows, source, source_tag, source_first, step = (f.astype(np.int64) for f in fields)
                # Equal neighbours are so many windows at one place of the source.
                times = np.where(step == 0, windows, 1)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, source, source_tag, source_first = (np.repeat(x, times) for x in (first, source, source_tag, source_first))
                first, windows = first + at, np.repeat(np.where(step == 0, 1, windows), times)
                shift = source_first - first
                order = np.lexsort((first, shift, source_tag, source))
                first, windows, source, source_tag, shift = (x[order] for x in (first, windows, source, source_tag, shift))
                new = np.ones(len(first), bool)
                new[1:] = (np.diff(source) != 0) | (np.diff(source_tag) != 0) | (np.diff(shift) != 0) | (first[1:] > first[:-1] + windows[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(first)) - 1
                for a, b in zip(begin.tolist(), end.tolist()):
                    words = first[b] + windows[b] - first[a] + WINDOW - 1
                    rows.append((doc, tag, int(first[a]), int(words), int(source[a]), int(source_tag[a]), int(first[a] + shift[a])))
            columns = zip(*rows) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SPANS.split(", ")])

    return listed.mapInArrow(run, SPANS)


def source_digests(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, source_tag, source_start, words, digest) of the distinct source spans, from the texts."""
    asked = stored(spans.select("source", "source_tag", "source_start", "words").distinct(), "span-sources")
    joined = wanted_texts(texts, asked.select(F.col("source").alias("id")).distinct()).join(asked.withColumnRenamed("source", "id"), "id").select("id", "source_tag", "source_start", "words", "text")

    def run(batches):
        last, words, tag = None, None, None
        for batch in batches:
            keep, digests = [], []
            for own, start, n, text in zip(batch["source_tag"].to_pylist(), batch["source_start"].to_pylist(), batch["words"].to_pylist(), batch["text"]):
                if (text := text.as_py() or "") != last:
                    last, words = text, Words(text)
                    tag = tag_of(words)[1]
                keep.append(tag == own)
                digests.append(hashlib.blake2b(words.joined(start, start + n), digest_size=16).digest())
            keep = pa.array(keep, pa.bool_())
            columns = [batch[c].filter(keep) for c in ("id", "source_tag", "source_start", "words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()).filter(keep)], names=["source", "source_tag", "source_start", "words", "digest"])

    return joined.mapInArrow(run, "source long, source_tag long, source_start int, words int, digest binary").distinct()


def repeated(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """The long spans that documents of smaller id have too, with their source coordinates; not yet verified."""
    each = paths.where("id is not null").select("id", "tag", F.inline("paths"))
    buckets = each.groupBy("bucket").agg(F.min("id").alias("source"), F.max("id").alias("last"), F.min("print").alias("a"), F.max("print").alias("b"))
    shared = buckets.where("source < last").select("bucket", "source", (F.col("a") != F.col("b")).alias("branches"))
    met = stored(each.join(dealt(shared, "bucket"), "bucket").select("bucket", "id", "tag", "first", "windows", "source", "branches"), "span-paths")

    def with_source(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
        """The rows of larger ids, with the first position in the source document; a row's next window is ``step`` on there."""
        place = rows.where("id = source").groupBy(*keys).agg(F.min(F.struct("tag", "first")).alias("at"))
        found = rows.where("id > source").join(dealt(place, *keys), keys)
        return found.select("id", "tag", "first", "windows", "source", F.col("at.tag").alias("source_tag"), F.col("at.first").alias("source_first"), F.lit(step).alias("step"))

    edges = stored(edges_of(texts, met.where("branches")), "span-edges")
    keys = ["bucket", "edge"]
    twice = edges.groupBy(*keys).agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").select(*keys, "source")
    single = stored(edges.join(dealt(twice, *keys), keys), "span-twice")
    found = with_source(met.where("not branches"), ["bucket"], 1).union(with_source(single, keys, 0))
    return stored(long_spans(found), "spans")


def verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, tag, spans, text): the documents with spans, each with the digest of its source."""
    checked = spans.join(source_digests(texts, spans), ["source", "source_tag", "source_start", "words"])
    listed = stored(checked.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "words", "digest", "source", "source_start")).alias("spans")), "span-lists")
    return wanted_texts(texts, listed.select("id").distinct()).join(listed, "id").select("id", "tag", "spans", "text")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) of every row.

    ``spans`` are the verified ones: start, words, source, source_start, in words. With
    ``kept_text`` the column ``kept`` holds the words that stay, with single spaces.
    """
    texts = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    paths = stored(paths_of(texts), "span-texts")
    span = "struct<start: int, words: int, source: long, source_start: int>"

    def run(batches):
        kinds = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
        for batch in batches:
            out = []
            for doc, tag, spans, text in zip(batch["id"].to_pylist(), batch["tag"].to_pylist(), batch["spans"], batch["text"]):
                words = Words(text.as_py() or "")
                if tag_of(words)[1] != tag:
                    continue
                stay, good = np.ones(len(words), bool), []
                for s in spans.as_py():
                    a, b = s["start"], s["start"] + s["words"]
                    if hashlib.blake2b(words.joined(a, b), digest_size=16).digest() == s["digest"]:
                        stay[a:b] = False
                        good.append({k: s[k] for k in ("start", "words", "source", "source_start")})
                left = np.flatnonzero(stay)
                kept = b" ".join(words.raw[a:b] for a, b in zip(words.starts[left].tolist(), words.ends[left].tolist()))
                out.append((doc, tag, len(words) - len(left), hashlib.sha256(kept).hexdigest(), sorted(good, key=lambda s: s["start"]), kept.decode() if kept_text else None))
            columns = zip(*out) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(kinds), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "tag", "n_removed", "kept_sha256", "spans", "kept"])

    cut = verified(texts, repeated(texts, paths)).mapInArrow(run, f"id long, tag long, n_removed long, kept_sha256 string, spans array<{span}>, kept string")
    # Equal rows have equal results.
    cut = cut.dropDuplicates(["id", "tag"])
    whole = paths.select("id", "tag", "n_words", "sha256")
    out = whole.join(cut, ["id", "tag"], "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast(f"array<{span}>")).alias("spans"), "tag", "kept")
    if not kept_text:
        return out.drop("tag", "kept")
    own = stored(texts, "span-kept").mapInArrow(_joined, "own long, own_tag long, joined string").dropDuplicates(["own", "own_tag"])
    return out.join(own, F.expr(f"`{id_col}` <=> own and tag = own_tag"), "left").withColumn("kept", F.coalesce("kept", "joined")).drop("own", "own_tag", "joined", "tag")


def _joined(batches):
    """(id, tag, words with single spaces) of every text."""
    for batch in batches:
        all_words = [Words(t) for t in texts_of(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([tag_of(w)[1] for w in all_words], pa.int64()), pa.array([w.joined().decode() for w in all_words], pa.string())], names=["own", "own_tag", "joined"])
