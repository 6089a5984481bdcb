"""Quality scores by a factorisation machine.

Features of a text are its hashed words (shares, square roots), structure statistics and
numeric metadata columns, the latter two one-hot in quantile bins. The score is the
logistic of bias + linear terms + all pairwise products under rank-``RANK`` weights,
computed in linear time as half of (square of sums less sum of squares).

Fitting reads at most ``MAX_TRAIN`` labelled rows, chosen by a hash of their ids; their
features are counted in Spark and the weights fitted on the driver. Scores read whole
texts and the metadata columns and nothing else.

Defined cases: a null text counts as empty and is scored like it; null metadata has a bin
of its own; with no labelled rows the score is 0.5, with one label it leans to that label;
of several labels of one id the smallest counts; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskweave.llm.arrays import U, chunks, texts_of, word_hashes

MAX_TRAIN = 4000
BUCKETS = 4096
RANK = 8
BINS = 10
ROOM = 4000
STATISTICS = ("words", "word_length", "longest_word", "distinct_words", "commonest_word", "upper", "digits", "marks", "symbols", "other_bytes", "lines", "line_length", "repeated_lines", "short_words", "stops")


def word_shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
MARKS = np.isin(np.arange(256), list(b"!?.,;:'\"-()"))
SYMBOLS = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of hashed words, and the structure statistics, of each text."""
    shares, stats = np.zeros((len(texts), BUCKETS), np.float32), np.zeros((len(texts), len(STATISTICS)), np.float64)
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            continue
        starts, ends, hashes = word_hashes(data)
        n, size = len(starts), len(data)
        if n:
            kinds, times = np.unique(hashes, return_counts=True)
            shares[i] = np.bincount((kinds % U(BUCKETS)).astype(np.int64), weights=times, minlength=BUCKETS)
            length = ends - starts
            lasting = data[ends - 1]
            stats[i, :5] = np.log1p(n), length.mean(), np.log1p(length.max()), len(kinds) / n, times.max() / n
            stats[i, 13] = (length <= 3).mean()
            stats[i, 14] = (lasting == ord(".")).mean()
        tally = np.bincount(data, minlength=256)
        stats[i, 5:10] = [tally[UPPER].sum() / size, tally[DIGIT].sum() / size, tally[MARKS].sum() / size, tally[SYMBOLS].sum() / size, tally[128:].sum() / size]
        lines = text.split("\n")
        stats[i, 10:13] = np.log1p(len(lines)), np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines)
    return word_shares(shares), stats


@dataclass
class Model:
    edges: list[np.ndarray]  # of the bins of each statistic and metadata column
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def binned(numbers: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One-hot bins of each column; not-a-number has the last bin."""
    out = np.zeros((len(numbers), len(edges), BINS + 1), np.float32)
    for j, cut in enumerate(edges):
        place = np.where(np.isnan(numbers[:, j]), BINS, np.searchsorted(cut, numbers[:, j], "right"))
        out[np.arange(len(numbers)), j, place] = 1
    return out.reshape(len(numbers), len(edges) * (BINS + 1)) / np.float32(np.sqrt(max(1, len(edges))))


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    sums = x @ model.factors
    pairs = 0.5 * (sums**2 - (x**2) @ (model.factors**2)).sum(axis=1)
    return model.bias + x @ model.linear + pairs


def fit(x_words: np.ndarray, numbers: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 100, rate: float = 0.02, penalty: float = 1e-4) -> Model:
    """Logistic loss by Adam over shuffled mini-batches; the seed is fixed."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.nanquantile(c, quantiles) if np.isfinite(c).any() else np.zeros(BINS - 1) for c in numbers.T]
    x = np.concatenate([x_words, binned(numbers, edges)], axis=1)
    rng = np.random.default_rng(7)
    share = (label.sum() + 1) / (len(label) + 2)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.05, (x.shape[1], RANK)).astype(np.float32))
    state = [np.zeros_like(model.linear), np.zeros_like(model.linear), np.zeros_like(model.factors), np.zeros_like(model.factors)]
    step = 0
    for _ in range(epochs if len(label) else 0):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            rows = x[part]
            pull = ((1 / (1 + np.exp(-np.clip(logits(model, rows), -30, 30))) - label[part]) / len(part)).astype(np.float32)
            sums = rows @ model.factors
            to_linear = rows.T @ pull + penalty * model.linear
            to_factors = rows.T @ (pull[:, None] * sums) - model.factors * ((rows**2).T @ pull)[:, None] + penalty * model.factors
            step += 1
            for k, (value, slope) in enumerate(((model.linear, to_linear), (model.factors, to_factors))):
                state[2 * k] *= 0.9
                state[2 * k] += 0.1 * slope
                state[2 * k + 1] *= 0.999
                state[2 * k + 1] += 0.001 * slope**2
                value -= rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-7)
            model.bias -= rate * float(pull.sum())
    return model


def scores(model: Model, texts: list[str], meta: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in chunks([len(t) + ROOM for t in texts]):
        words, stats = features(texts[a:b])
        x = np.concatenate([words, binned(np.concatenate([stats, meta[a:b]], axis=1), model.edges)], axis=1)
        out[a:b] = 1 / (1 + np.exp(-np.clip(logits(model, x), -30, 30)))
    return out


def meta_of(columns: list[pa.Array], n: int) -> np.ndarray:
    rows = [np.array([np.nan if v is None else v for v in c.to_pylist()], np.float64) for c in columns]
    return np.stack(rows, axis=1) if rows else np.zeros((n, 0))


def learn(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), max_train: int = MAX_TRAIN) -> Model:
    """Fits a model on labelled rows of ``df`` where ``train`` (over the label's id) holds, ``max_train`` at most."""
    known = labels.where(train & labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("key")).agg(F.min(labels[label_col]).cast("int").alias("y"))
    known = known.withColumn("draw", F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1 << 40)))
    count = known.count()
    # About max_train rows have a draw below the limit; the smallest draws stay.
    limit = int((1 << 40) * min(1.0, (max_train + 4 * max_train**0.5) / max(1, count)))
    few = known.where(F.col("draw") < limit)
    rows = df.select(df[id_col].alias("key"), df[text_col].alias("text"), *[df[c].cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)])
    # The drawn labels are a sample of bounded size, so they go to the texts.
    drawn = rows.join(F.broadcast(few), "key")

    def run(batches):
        for batch in batches:
            raw, stats = [], []
            texts = texts_of(batch["text"])
            meta = meta_of([batch[f"m{i}"] for i in range(len(meta_cols))], batch.num_rows)
            for a, b in chunks([len(t) + ROOM for t in texts]):
                words, own = features(texts[a:b])
                raw += [w.astype(np.float16).tobytes() for w in words]
                stats += np.concatenate([own, meta[a:b]], axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch["draw"], batch["key"].cast(pa.string()), batch["y"], pa.array(raw, pa.binary()), pa.array(stats, pa.list_(pa.float64()))], names=["draw", "key", "y", "words", "numbers"])

    got = drawn.mapInArrow(run, "draw long, key string, y int, words binary, numbers array<double>").toArrow()
    draws, keys = got["draw"].to_pylist(), got["key"].to_pylist()
    order = sorted(range(len(draws)), key=lambda i: (draws[i], keys[i]))[:max_train]
    got = got.take(pa.array(order, pa.int64()))
    words = np.frombuffer(b"".join(got["words"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    numbers = np.array(got["numbers"].to_pylist(), np.float64).reshape(len(order), len(STATISTICS) + len(meta_cols))
    return fit(words, numbers, got["y"].to_numpy().astype(np.float64))


def score_of(text: Column, model: Model, meta: list[Column]) -> Column:
    """Score of a text, 0 to 1: how likely its label is 1."""

    def run(column: pa.Array, *columns: pa.Array) -> pa.Array:
        meta = meta_of(list(columns), len(column))
        return pa.array([s for lo in range(0, len(column), 500) for s in scores(model, texts_of(column.slice(lo, 500)), meta[lo : lo + 500])], pa.float64())

    return F.arrow_udf(run, "double")(text, *[m.cast("double") for m in meta])
