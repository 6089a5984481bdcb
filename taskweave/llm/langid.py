"""Language identification by error-correcting output codes.

Each language gets a codeword. One binary classifier per bit, a logistic regression on
hashed character n-grams (1 to 3), predicts that bit. Decoding adds, for each codeword,
the logistic losses of its bits, weighted by how well the bit was learned for that
language, and takes the least. A text whose two nearest codewords are almost equally near
is flagged as ambiguous.

Fitting reads at most ``MAX_TRAIN`` labelled texts, dealt evenly over the languages (the
commonest of them, should there be more than texts) and chosen by a hash of their ids; their n-gram vectors are counted in Spark and the weights
fitted on the driver. The model is a table of n-gram buckets by bits, sent to the tasks.
Predictions read whole texts and nothing else.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if no
language can be learned all texts are; a single language is predicted with score 1.
Rows with a null id are predicted, and never learned from. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.llm.arrays import U, chunks, mix, texts_of

MAX_TRAIN = 2400
BUCKETS = 4096
UNKNOWN = "und"
# Least difference of the two smallest codeword losses (per unit of weight) of a clear text.
CLEAR = 0.005
# A text's room in a chunk beside its characters, for its vector.
ROOM = 4000


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows add up to 1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams of each lower-cased text; letters count, all else is one blank."""
    out = np.zeros((len(texts), buckets), np.float32)
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    if not len(points):
        return out
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = letters()[points]
    # Of a run of other characters the first stays, as a blank.
    keep = letter | np.append(True, letter[:-1])
    points, owner = np.where(letter, points, 0x20)[keep].astype(U), owner[keep]
    grams, owners = [], []
    gram = np.zeros(len(points), U)
    for n in range(3):
        tail = points[n:]
        gram = mix(gram[: len(tail)] * U(0x10FFFF + 2) + tail + U(1))
        same = owner[n:] == owner[: len(tail)]
        grams.append((gram[same] % U(buckets)).astype(np.int64))
        owners.append(owner[: len(tail)][same])
    counts = np.bincount(np.concatenate(owners) * buckets + np.concatenate(grams), minlength=len(texts) * buckets).reshape(len(texts), buckets)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def codewords(count: int) -> np.ndarray:
    """A row of -1 and 1 per language, far apart; bits that split no two languages are left out.

    All splits for up to 7 languages, else the best of some random codes of 10 log2 bits.
    """
    if count < 2:
        return np.ones((count, 1))
    if count <= 7:
        numbers = np.arange(1, 1 << (count - 1))
        bits = (numbers[None, :] >> np.arange(count)[:, None]) & 1
        return np.where(bits, 1.0, -1.0)
    rng = np.random.default_rng(count)
    best, far = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (count, int(np.ceil(10 * np.log2(count)))))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        distance = (code.shape[1] - code @ code.T) / 2 + np.diag([np.inf] * count)
        if distance.min() > far:
            best, far = code, distance.min()
    return best


def fit(rows: np.ndarray, languages: list[str], steps: int = 150, penalty: float = 1e-4) -> Model:
    """Logistic regressions of all bits at once, by accelerated gradient descent."""
    names = sorted(set(languages))
    code = codewords(len(names))
    label = np.array([names.index(x) for x in languages], np.int64)
    target = code[label].astype(np.float32)
    # Each language counts the same.
    weight = (1 / np.bincount(label, minlength=len(names)))[label].astype(np.float32)[:, None] / max(1, len(names))
    w, b = np.zeros((rows.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b = w, b
    rate = 1 / (0.5 + penalty)  # rows have length 1, so with the bias the loss curves by at most 1/2
    for step in range(steps if len(names) > 1 else 0):
        pull = -target / (1 + np.exp(target * (rows @ ahead_w + ahead_b))) * weight
        new_w, new_b = ahead_w - rate * (rows.T @ pull + penalty * ahead_w), ahead_b - rate * pull.sum(axis=0)
        push = step / (step + 3)
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    trust = np.ones(code.shape)
    if len(names) > 1:
        right = (rows @ w + b) * target > 0
        trust = np.array([right[label == k].mean(axis=0) for k in range(len(names))]) + 1e-6
    return Model(names, code, w, b, trust / trust.sum(axis=1, keepdims=True))


def decode(model: Model, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its score (0 to 1) and the distance to the next one, from the bits' outputs."""
    losses = np.stack([(np.logaddexp(0, -outputs * model.code[k]) * model.trust[k]).sum(axis=1) for k in range(len(model.languages))], axis=1)
    order = np.sort(losses, axis=1)
    gap = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
    likely = np.exp(-(losses - order[:, :1]) * model.code.shape[1])
    return losses.argmin(axis=1), 1 / likely.sum(axis=1), gap


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    live = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    for a, b in chunks([len(texts[i]) + ROOM for i in live]):
        part = live[a:b]
        best, score, gap = decode(model, vectors([texts[i] for i in part], len(model.weights)) @ model.weights + model.bias)
        for i, k, s, g in zip(part, best.tolist(), score.tolist(), gap.tolist()):
            out[i] = (model.languages[k], s, g < CLEAR)
    return out


def learn(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Fits a model on rows where ``train`` holds, with id, text and language, ``max_train`` at most."""
    usable = df.where(train & df[id_col].isNotNull() & df[lang_col].isNotNull() & df[text_col].rlike(r"\p{L}"))
    rows = usable.select(df[lang_col].alias("lang"), F.pmod(F.xxhash64(F.lit("langid"), df[id_col]), F.lit(1 << 40)).alias("draw"), df[text_col].alias("text"))
    # The commonest languages, as many as the sample has rows; rarer ones are not learned.
    per = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_train).collect()
    each = max_train // max(1, len(per))
    # So many rows of a language have a draw below its limit, but for chance; the smallest draws stay.
    limits = [(r["lang"], int((1 << 40) * min(1, (each + 4 * each**0.5) / r["count"]))) for r in per]
    drawn = rows.join(F.broadcast(df.sparkSession.createDataFrame(limits, "lang string, most long")), "lang").where("draw < most").select("lang", "draw", "text")

    def run(batches):
        for batch in batches:
            texts = texts_of(batch["text"])
            raw = [v.tobytes() for a, b in chunks([len(t) + ROOM for t in texts]) for v in vectors(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["draw"], pa.array(raw, pa.binary())], names=["lang", "draw", "x"])

    got = drawn.mapInArrow(run, "lang string, draw long, x binary").toArrow()
    taken: dict[str, list[int]] = {}
    order = sorted(range(got.num_rows), key=lambda i: (got["draw"][i].as_py(), got["lang"][i].as_py()))
    for i in order:
        own = taken.setdefault(got["lang"][i].as_py(), [])
        if len(own) < each:
            own.append(i)
    chosen = [i for own in taken.values() for i in own]
    x = np.frombuffer(b"".join(got["x"][i].as_py() for i in chosen), np.float32).reshape(-1, BUCKETS)
    return fit(x, [got["lang"][i].as_py() for i in chosen])


def language_of(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, ambiguous> of a text."""

    def run(column: pa.Array) -> pa.Array:
        found = [x for lo in range(0, len(column), 500) for x in predict_texts(model, column.slice(lo, 500).to_pylist())]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=["lang_pred", "score", "ambiguous"])

    return F.arrow_udf(run, "lang_pred string, score double, ambiguous boolean")(text)
