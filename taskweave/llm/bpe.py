"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary is a byte-level BPE file (its path is a parameter). A text is cut
into pre-tokens. In a pre-token an Aho-Corasick automaton gives the longest token
that starts at each byte. The encoder takes the longest match, falls back to its
longest proper prefix that is a token when the pair with the token before does not
hold, and steps back when no prefix holds. A byte position from which nothing held
is never tried again, so the work is linear in the text. Two neighbours hold if
merging their bytes in rank order gives just these two tokens; the answers are kept
in a table. The result equals that of merging pairs by rank.

Defined cases: a null text counts as empty and gives no ids; an id that is not in
the vocabulary is an error; repeated rows give repeated results; other columns are
not read. Texts are read whole. A special token's string in a text is encoded as
that token, as the public library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskweave.llm.arrays import BASE, U, chunks, mix, parts, prefix_sums, ragged, span_hashes, texts_of

# Pre-tokens in each of two generations, and pairs, kept per task.
CACHE = 80_000
PAIRS = 200_000
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


class Codec:
    """One byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The longest of the special tokens that start at a place.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        as_bytes = {piece: bytes(to_byte[c] for c in piece) for piece in model["vocab"]}
        vocab = {as_bytes[piece]: i for piece, i in model["vocab"].items()}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes | None] = [None] * size
        for raw, i in vocab.items():
            self.token[i] = raw
        for text, i in self.special.items():
            self.token[i] = text.encode()
        # rank and result of merging two ids
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.bytes = [vocab[bytes([b])] for b in range(256)]
        # Tokens that the merges can reach; one that they cannot never occurs.
        reached = set(self.bytes) | {i for _, i in self.merge.values()}
        self.automaton = ahocorasick.Automaton()
        for raw, i in vocab.items():
            if i in reached:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.reached = {self.token[i]: i for i in reached}
        self.shorter = {i: self._prefix(self.token[i]) for i in reached}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        lengths = np.array([len(t) if t else 0 for t in self.token], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.joined = np.frombuffer(b"".join(t or b"" for t in self.token), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(d) for d in digits])])
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def _prefix(self, raw: bytes) -> int:
        """The longest proper prefix that is a token, or -1."""
        return next((self.reached[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.reached), -1)

    def merged(self, raw: bytes) -> list[int]:
        """Merges by rank, lowest first: the definition. Used on two tokens' bytes only."""
        ids = [self.bytes[b] for b in raw]
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def holds(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, by backtracking."""
        raw = piece.encode()
        longest = [-1] * len(raw)
        for last, (n, i) in self.automaton.iter(raw.decode("latin-1")):
            longest[last - n + 1] = i  # a later end means a longer token
        out: list[int] = []
        open_at = [True] * (len(raw) + 1)
        at, token = 0, longest[0]
        while at < len(raw):
            end = at + len(self.token[token])
            if open_at[end] and (not out or self.holds(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(raw) else -1
                continue
            token = self.shorter[token]
            while token < 0:  # nothing holds from here: shorten the token before
                open_at[at] = False
                before = out.pop()
                at -= len(self.token[before])
                token = self.shorter[before]
        return out

    def ids_of(self, piece: str) -> bytes:
        """Ids of a pre-token as 32-bit integers."""
        known = self.pieces.get(piece)
        if known is None:
            known = self.older.get(piece)
            if known is None:
                known = array("i", self.encode_piece(piece)).tobytes()
            if len(self.pieces) >= CACHE:  # what was not asked for in a generation goes
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = known
        return known

    def cuts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of code points; ``first`` are the starts of the texts.

        A pre-token is a run of one class with at most one blank before it, a run of
        white space less the last character if a word follows, or an English ending
        ('s 'd 'm 't 'll 've 're) that starts a pre-token.
        """
        n = len(points)
        kind = classes()[points]
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[first] = True
        last = np.ones(n, bool)  # of a text
        last[:-1] = False
        last[first[first > 0] - 1] = True
        space = kind == SPACE
        # The last blank of a run belongs to the word behind it; another kind of space stands alone.
        run_end = space.copy()
        run_end[:-1] &= ~space[1:]
        run_end &= ~last
        start |= run_end
        blank = np.flatnonzero(run_end & (points == 0x20))
        start[blank + 1] = False
        quote = points == 0x27
        quote[:-1] &= kind[1:] == LETTER
        # Only a quote that starts a pre-token, and no blank before it, can start an ending.
        for i in np.flatnonzero(quote & start & ~last):
            tail = "".join(map(chr, points[i + 1 : i + 3]))
            if tail[:1] in ("s", "d", "m", "t"):
                size = 2
            elif tail in ("ll", "ve", "re") and not last[i + 1]:
                size = 3
            else:
                continue
            start[i + 1] = False
            if size == 3:
                start[i + 2] = False
            if i + size < n:
                start[i + size] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        pieces: list[str] = []
        owner: list[int] = []
        fixed: list[int] = []  # id of a special token, or -1
        for i, text in enumerate(texts):
            for part, special in self._parts(text):
                pieces.append(part)
                owner.append(i)
                fixed.append(special)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        starts = self.cuts(points, first)
        ends = np.append(starts[1:], len(points))
        special = np.array(fixed, np.int64)
        part = np.searchsorted(first, starts, "right") - 1
        # All cuts in a special token's string but the first go.
        keep = (special[part] < 0) | (starts == first[part])
        starts, part = starts[keep], part[keep]
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(prefix_sums(mix(points.astype(U) + U(BASE))), starts, ends)
        hashes ^= (special[part] + 1).astype(U)
        _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        distinct = zip(starts[where].tolist(), ends[where].tolist(), special[part[where]].tolist())
        table = [array("i", [s]).tobytes() if s >= 0 else self.ids_of(joined[a:b]) for a, b, s in distinct]
        lengths = np.array([len(t) for t in table], np.int64) // 4
        flat = np.frombuffer(b"".join(table), np.int32).astype(np.int64)
        offsets = np.cumsum(lengths) - lengths
        counts = lengths[inverse]
        ids = flat[ragged(offsets[inverse], counts)]
        per_text = np.bincount(np.array(owner, np.int64)[part], weights=counts, minlength=len(texts)).astype(np.int64)
        return ids, per_text

    def _parts(self, text: str) -> Iterator[tuple[str, int]]:
        """The text cut at special tokens: (string, id or -1), no empty strings."""
        at = 0
        for found in self.cut.finditer(text) if self.special else ():
            if found.start() > at:
                yield text[at : found.start()], -1
            yield found.group(), self.special[found.group()]
            at = found.end()
        if at < len(text):
            yield text[at:], -1

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, copied out of the joined vocabulary by offset and length."""
        starts = self.offsets[ids]
        return self.joined[ragged(starts, self.offsets[ids + 1] - starts)].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        starts = self.digit_offsets[ids]
        return self.digits[ragged(starts, self.digit_offsets[ids + 1] - starts)].tobytes()[:-1]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text. A text whose ids do not give it back is encoded again piece by piece."""
    c = codec(path)
    for a, b in chunks([len(t) for t in texts]):
        ids, counts = c.encode(texts[a:b])
        ends = np.cumsum(counts)
        for text, start, end in zip(texts[a:b], (ends - counts).tolist(), ends.tolist()):
            own = ids[start:end]
            if c.decode(own) != text.encode():  # two pre-tokens of one hash
                own = np.concatenate([c.encode([p])[0] for p in single_pieces(c, text)])
            yield own


def single_pieces(c: Codec, text: str) -> list[str]:
    out = []
    for part, special in c._parts(text):
        if special >= 0:
            out.append(part)
            continue
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        cut = [*c.cuts(points, np.zeros(1, np.int64)).tolist(), len(part)]
        out += [part[a:b] for a, b in zip(cut, cut[1:])]
    return out


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    pairs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = pairs.select("id").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in parts(batches):
            ids = [own.astype(np.int32) for own in encoded(path, texts_of(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return pairs.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    pairs = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    out = pairs.select("id").schema.add("text", "string")

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return pairs.mapInArrow(run, out).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""
    pairs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = pairs.select("id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        c = codec(path)
        for batch in parts(batches):
            n, listed, decoded = [], [], []
            for ids in encoded(path, texts_of(batch["text"])):
                n.append(len(ids))
                listed.append(hashlib.sha256(c.listed(ids)).hexdigest())
                back = c.decode(ids).decode("utf-8", "replace").encode()
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pairs.mapInArrow(run, out).withColumnRenamed("id", id_col)
