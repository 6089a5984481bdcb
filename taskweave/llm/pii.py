"""Personal data: base rules, loose candidates, boosted trees, calibrated thresholds.

Base spans of each kind come from its pattern, leftmost and non-overlapping, and a check
(parts of an address, digits and Luhn sum of a card, digits of a phone number). They stay.

Generators with high recall propose further, overlapping spans: spelled-out addresses,
runs of digits with any separators, dotted numbers. A candidate's format (generator, digits,
separators, checks it passes) and context (neighbouring characters, a telling word before
it) are its features, all with few values. Its label doesn't ask whether the base pattern
knows the notation: a candidate counts as good if it passes its kind's own check (host form,
parts, Luhn sum, number of digits; spelled-out marks are read as the marks they stand for)
and either has the kind's plain shape or a telling word of its kind before it. The
combinations of values that occur in the whole corpus, and the share of good candidates in
each, make a small table; boosted trees are fitted on it, and a threshold per kind is the
least score at which the selected combinations are good by PRECISION. A combination weighs
the same however often it occurs, and the good and the other ones of a kind weigh the same
together, so one copy of a notation and thousands get the same result. The trees become CASE
expressions. What they select is added unless it overlaps a base span; of overlapping
additions the first by score, then start, then end, stays.

Main path: built-in DataFrame functions only. Positions are code points, from the lengths of
the matches and of what lies between them.

Defined cases: a null text counts as empty and has no spans; rows are independent, so
repeated rows get equal results and other columns are not read; without good candidates of a
kind in the corpus nothing of it is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and their base patterns. Repetitions are possessive,
# and runs start where no character of the run stands before (or where the last match ended),
# which matches the same spans in linear time.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
# Candidates: (generator, pattern, what a text must contain).
GENERATORS = (
    ("address", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)++", r"@|\(at\)|\[at\]"),
    ("digits", r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,22}(?![0-9])", "[0-9][^0-9]{0,2}[0-9][^0-9]{0,2}[0-9]"),
    ("dotted", r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}(?![0-9])", r"[0-9]\.[0-9]"),
)
HINTS = {"email": "mail|contact", "phone": "phone|tel|call|fax|mobile", "card": "card|visa|credit|payment", "ip": "ip|host|server|address"}
PRECISION = 0.98
LEAST = 0.9
ROUNDS, DEPTH, RATE = 30, 3, 0.3
# Least share of the table's weight on either side of a test.
LEAF = 1e-4
# Weight of the good, and of the other, combinations of a kind.
WEIGHT = 100.0
SPAN = "struct<kind:int,start:int,end:int>"


def matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<start,end,found>> of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sized = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("found"), F.length(gap).alias("skip"), F.length(m).alias("size")))
    nothing = F.array().cast("array<struct<start:int,end:int,found:string>>")
    placed = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), nothing.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["skip"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + x["size"]).alias("end"), x["found"].alias("found")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(gate), placed).otherwise(nothing)


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return (F.length(digits) > 0) & (F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0)


def small_parts(found: Column) -> Column:
    """Whether all dotted parts are at most 255, whatever zeros they begin with."""
    parts = F.transform(F.split(found, r"\.", -1), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def holds(kind: str, found: Column) -> Column:
    n = F.length(digits_of(found))
    return {"email": F.lit(True), "ip": small_parts(found), "card": n.between(13, 19) & luhn(F.substring(digits_of(found), 1, 20)), "phone": n.between(9, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """array<SPAN> of the base spans of a kind, by start."""
    number = F.lit(KINDS.index(kind))
    good = F.filter(matches(text, BASE[kind], GATES[kind]), lambda m: holds(kind, m["found"]))
    return F.transform(good, lambda m: F.struct(number.alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


# Features and the number of their values; a candidate's features are whole numbers from 0.
FEATURES = {"generator": 3, "count": 9, "plus": 2, "separators": 5, "luhn": 2, "parts": 3, "spelled": 2, "before": 4, "after": 4, "hint": 5, "sound": 2, "shape": 2}


def side(c: Column) -> Column:
    """0 edge or blank, 1 letter, 2 digit, 3 other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def sound(kind: int, found: Column) -> Column:
    """The kind's own check of a candidate, whatever its separators or spelled-out marks."""
    if kind == 0:
        name = F.regexp_replace(F.regexp_replace(F.lower(found), r"\x20?(?:@|[(\[]at[)\]])\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
        return name.rlike("^[a-z0-9_%+-]") & name.rlike("[a-z0-9_%+-]@[a-z0-9]") & name.rlike(r"\.[a-z]{2,}$") & ~name.contains("..")
    if kind == 1:
        return found.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & small_parts(found)
    return holds(KINDS[kind], found)


def plain(kind: int, found: Column) -> Column:
    """The shape that needs no telling word: no blank at a bare @, one separator throughout a card, a phone's plus."""
    return {0: ~found.rlike(r"\x20@|@\x20"), 1: F.lit(True), 2: found.rlike(r"^[0-9]++(?:([\x20./-])[0-9]++(?:\1[0-9]++)*+)?$"), 3: found.startswith("+")}[kind]


def good(c: Column) -> Column:
    """The label of a candidate."""
    return (c["sound"] == 1) & ((c["shape"] == 1) | (c["hint"] == c["kind"] + 1))


def candidates(text: Column) -> Column:
    """array<struct<kind,start,end,features...>> of all generators."""
    found = [F.transform(matches(text, pattern, gate), described(text, g)) for g, (_, pattern, gate) in enumerate(GENERATORS)]
    return F.concat(*found)


def described(text: Column, g: int):
    """The function from a match of generator ``g`` to its kind, place and features."""

    def describe(m: Column) -> Column:
        found, digits = m["found"], digits_of(m["found"])
        n = F.length(digits)
        count = F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n == 16, 6).when(n < 20, 7).otherwise(8)
        marks = F.regexp_replace(found, "[0-9+]", "")
        separators = F.when(marks == "", 0).when(marks.rlike("^ +$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4)
        parts = F.when(F.size(F.split(found, r"\.", -1)) != 4, 0).when(found.rlike(r"^[0-9.]+$") & small_parts(found), 1).otherwise(2)
        context = F.lower(F.substring(text, F.greatest(m["start"] - 24, F.lit(0)) + 1, F.least(m["start"], F.lit(24))))
        hint = F.lit(0)
        for i, kind in enumerate(KINDS):
            hint = F.when(context.rlike(rf"\b(?:{HINTS[kind]})\w*\W*$"), i + 1).otherwise(hint)
        kind = {0: F.lit(0), 1: F.when(found.startswith("+") | (n < 13) | (n > 19), 3).otherwise(2), 2: F.lit(1)}[g]
        before = F.when(m["start"] == 0, F.lit("")).otherwise(F.substring(text, m["start"], F.lit(1)))
        number = lambda test: F.when(kind == 3, test(3, found)).otherwise(test(2, found)) if g == 1 else test({0: 0, 2: 1}[g], found)
        values = {
            "generator": F.lit(g), "count": count, "plus": found.startswith("+"), "separators": F.lit(4) if g == 0 else separators, "luhn": n.between(13, 19) & luhn(digits),
            "parts": F.lit(0) if g == 0 else parts, "spelled": found.rlike(r"[(\[](at|dot)| @|@ "), "before": side(before), "after": side(F.substring(text, m["end"] + 1, F.lit(1))), "hint": hint,
            "sound": number(sound), "shape": number(plain),
        }
        return F.struct(kind.cast("int").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[values[f].cast("int").alias(f) for f in FEATURES])

    return describe


class Tree:
    """One regression tree over tests "feature = value"."""

    def __init__(self, cells: np.ndarray, total: np.ndarray, pull: np.ndarray, curve: np.ndarray, depth: int, least: float) -> None:
        self.test, self.value = None, float(pull.sum() / (curve.sum() + 1.0))
        if depth == 0 or len(cells) < 2:
            return
        whole, best = pull.sum() ** 2 / (curve.sum() + 1.0), 1e-6
        for j, size in enumerate(FEATURES.values()):
            for v in range(size):
                yes = cells[:, j] == v
                if min(total[yes].sum(), total[~yes].sum()) < least:
                    continue
                gain = sum(pull[s].sum() ** 2 / (curve[s].sum() + 1.0) for s in (yes, ~yes)) - whole
                if gain > best:
                    best, self.test = gain, (j, v)
        if self.test:
            yes = cells[:, self.test[0]] == self.test[1]
            self.yes, self.no = (Tree(cells[s], total[s], pull[s], curve[s], depth - 1, least) for s in (yes, ~yes))

    def predict(self, cells: np.ndarray) -> np.ndarray:
        if not self.test:
            return np.full(len(cells), self.value)
        yes = cells[:, self.test[0]] == self.test[1]
        return np.where(yes, self.yes.predict(cells), self.no.predict(cells))

    def column(self, c: Column) -> Column:
        if not self.test:
            return F.lit(self.value)
        return F.when(c[list(FEATURES)[self.test[0]]] == self.test[1], self.yes.column(c)).otherwise(self.no.column(c))


class Model:
    """Boosted trees on the table of feature combinations, and a threshold per kind."""

    def __init__(self, cells: np.ndarray, kinds: np.ndarray, share_good: np.ndarray) -> None:
        self.trees: list[Tree] = []
        base, other = (np.zeros(len(cells)) for _ in range(2))
        for k in range(len(KINDS)):
            for weight, part in ((base, share_good), (other, 1 - share_good)):
                own = np.where(kinds == k, part, 0)
                weight += WEIGHT * own / max(own.sum(), 1e-9)
        total = base + other
        share = (base.sum() + 1) / (total.sum() + 2)
        self.bias = float(np.log(share / (1 - share)))
        raw = np.full(len(cells), self.bias)
        for _ in range(ROUNDS if len(cells) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = Tree(cells, total, base - p * total, np.maximum(p * (1 - p) * total, 1e-9), DEPTH, LEAF * total.sum())
            self.trees.append(tree)
            raw += RATE * tree.predict(cells)
        score = 1 / (1 + np.exp(-raw))
        self.thresholds = []
        for k in range(len(KINDS)):
            # The least score from which on the selected combinations are good by PRECISION.
            own = np.flatnonzero(kinds == k)
            own = own[np.argsort(-score[own], kind="stable")]
            right = np.cumsum(share_good[own]) >= PRECISION * np.arange(1, len(own) + 1)
            # Equal scores are selected together.
            right &= np.append(score[own][1:] != score[own][:-1], True)[: len(own)]
            least = score[own][right].min() if (right & (share_good[own].cumsum() > 0)).any() else 2.0
            self.thresholds.append(max(LEAST, float(least)))

    def score(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + RATE * tree.column(c)
        return 1 / (1 + F.exp(-total))

    def selected(self, c: Column, score: Column) -> Column:
        bar = F.lit(2.0)
        for k, t in enumerate(self.thresholds):
            bar = F.when(c["kind"] == k, t).otherwise(bar)
        return score >= bar


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_text`` (null as empty) and ``_base``, the base spans by kind, then start."""
    df = df.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    own = [base_spans(F.col("_text"), kind) for kind in KINDS]
    nothing = F.array().cast(f"array<{SPAN}>")
    return df.withColumn("_base", F.when(F.col("_text").rlike("[0-9@]"), F.concat(*own)).otherwise(nothing))


def learn(df: DataFrame, text_col: str = "text") -> Model:
    """Gathers the feature combinations of all candidates, and fits the model on them.

    The collected table has at most a row per combination of feature values and kind.
    """
    rows = df.select(F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text")).where(F.col("_text").rlike(r"[0-9@]|[(\[]at[)\]]"))
    each = rows.select(F.explode(candidates(F.col("_text"))).alias("c"))
    shares = each.select("c.kind", *[f"c.{f}" for f in FEATURES], good(F.col("c")).cast("double").alias("good")).groupBy("kind", *FEATURES).agg(F.avg("good").alias("good")).collect()
    shares = sorted(shares, key=lambda r: tuple(r))
    cells = np.array([[r[f] for f in FEATURES] for r in shares], np.int64).reshape(-1, len(FEATURES))
    return Model(cells, *(np.array([r[c] for r in shares], np.float64) for c in ("kind", "good")))


def find(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: the base spans, and these and the added ones, by kind, then start.

    Both replace columns of their names.
    """
    keep = [c for c in df.columns if c not in ("base", "spans")]
    inner = df.select(F.struct(*[df[c] for c in keep]).alias("row"), df[text_col].alias("text"))
    rows = with_base(inner, F.col("text"))
    scored = F.transform(candidates(F.col("_text")), lambda c: F.struct(model.score(c).alias("score"), c.alias("c")))
    chosen = F.filter(scored, lambda s: model.selected(s["c"], s["score"]) & ~F.exists("_base", lambda b: overlap(b, s["c"])))
    first = F.array_sort(F.transform(chosen, lambda s: F.struct((-s["score"]).alias("order"), s["c"]["start"].alias("start"), s["c"]["end"].alias("end"), s["c"]["kind"].alias("kind"))))
    nothing = F.array().cast(f"array<{SPAN}>")
    added = F.aggregate(
        first,
        nothing,
        lambda acc, s: F.when(F.exists(acc, lambda a: overlap(a, s)), acc).otherwise(F.concat(acc, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))),
    )
    rows = rows.withColumn("_added", F.when(F.col("_text").rlike(r"[0-9@]|[(\[]at[)\]]"), added).otherwise(nothing))
    return rows.select("row.*", F.col("_base").alias("base"), F.array_sort(F.concat("_base", "_added")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by that of the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), names[s["kind"]])).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
