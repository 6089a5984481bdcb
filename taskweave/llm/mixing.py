"""Mixing sources to target weights by a low-discrepancy source schedule.

Sources share all words by weight; a source's target stops at ``most`` times its
size and the rest is shared again. The total is cut into equal blocks of words, one per
slot. Slot t goes to the source in whose share of the unit interval the golden ratio point
t * phi falls; with a power of two of slots the points are the integers t * odd mod slots,
each once, so every source gets its share to within one slot, in any stretch of the slots.
A source's slots, by rank, take its blocks: its documents lie one after the other in a
seeded shuffled order, again from the start when they run out, at most ``most`` times.

The schedule decides the order of the mix: a document comes where the slot of its first word
is (``copies``, and ``first_slot``). How many words of a document are taken follows from the
number of its source's slots, by arithmetic.

Sources whose target spans less than ``SPAN`` slots share the last place of the schedule; the
slots of that place are shared by a schedule of their own, and so on. So a slot is a path of
one number or a few, and there are ``SLOTS`` slots a level (or 128 per source, if that is
more), however small a source is beside the others.

Everything is DataFrame work on whole numbers. Positions come from sums per bucket of the
shuffled order, whose expected size is fixed, sums of those, and sums inside a bucket; rows
that are alike are one row with their number until the end. So a source, an id or a null id
with a third of all rows is never in one task. One row per source meets in one task.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 are never taken; rows of equal id, source and size are
interchangeable and lie one after the other; rows with a null id lie in the order of their
texts' hashes. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskweave.session import stored

WEIGHTS = (5, 2, 1)
# The least number of slots of a level, and how many a source's target spans at least on its level.
SLOTS = 1 << 16
SPAN = 64
# Slots of a source that one row lists, and that are ranked together.
CHUNK = 1 << 14
MOST = 3
BUCKET_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(seed: str, id_col: Column, text: Column) -> Column:
    """The order key of a document: the hash of seed and id, or of seed and text without an id."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size): one row per source.

    Sources with the smallest ceiling per weight stop first. Walking through them in that
    order, the level (words per unit of weight) of the others is what the stopped ones leave
    over the weight that is left; a source stops if its ceiling lies under the level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    order = W.orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("ceiling", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("ceiling") * F.col("open") <= F.col("left") * F.col("weight"))
        # The first that does not stop sets the level for all behind it.
        .withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("ceiling") / F.col("weight"), "place", "left", "open"))).over(every))
    )
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")
    target = F.when(F.col("stops") | F.col("level").isNull(), F.col("ceiling").cast("double")).otherwise(share)
    return levels.select("source", "place", "source_size", target.alias("target"))


def slots_for(sources: int) -> int:
    """The power of two of slots of a level: the largest of its sources always spans 2 * SPAN."""
    return 1 << (max(SLOTS, 2 * SPAN * sources) - 1).bit_length()


def golden(slots: int) -> int:
    """The odd number next to slots / golden ratio: t * golden mod slots runs through all slots."""
    return int(slots * (math.sqrt(5) - 1) / 4) * 2 + 1


def wide(expression: str) -> str:
    """A whole number whose products may leave 64 bits."""
    return f"cast({expression} as decimal(20,0))"


GROUP = -1


def levels(targeted: DataFrame, total: int) -> list[tuple[DataFrame, int, int]]:
    """(edges, slots, words) of each level; edges are (place, lower, upper), points that a place owns.

    A point u (0 to slots-1) belongs to the first place whose running target exceeds u / slots
    of the level's sum. The place ``GROUP``, the last, owns at least one point where there are
    small sources; the next level is theirs.
    """
    rest, words, found = targeted.where("target > 0"), total, []
    while True:
        figures = rest.agg(F.count("*").alias("n"), F.sum("target").alias("sum")).first()
        if not figures["n"]:
            return found
        slots, whole = slots_for(figures["n"]), figures["sum"]
        small = F.col("target") * slots < SPAN * whole
        upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
        upper = F.ceil(F.sum("target").over(upto) * slots / whole - F.lit(1e-6)).cast("long")
        below = rest.agg(F.count_if(small).alias("n"), F.sum(F.when(small, F.col("target"))).alias("sum")).first()
        edges = rest.where(~small).withColumn("upper", F.least(upper, F.lit(slots - bool(below["n"]))))
        edges = stored(edges.withColumn("lower", F.coalesce(F.lag("upper").over(W.orderBy("place")), F.lit(0))).select("place", "lower", "upper"), "mix-edges")
        if below["n"]:
            first = edges.agg(F.max("upper")).first()[0]
            edges = edges.union(edges.sparkSession.createDataFrame([(GROUP, first, slots)], "place long, lower long, upper long"))
        found.append((edges, slots, words))
        if not below["n"]:
            return found
        rest, words = rest.where(small), max(1, round(below["sum"]))


def ranked_slots(edges: DataFrame, slots: int) -> DataFrame:
    """(place, rank, slot): the slots of each place, in order; ``slots`` rows, made in chunks.

    Ranks come from two levels, like positions.
    """
    chunks = edges.where("upper > lower").select("place", "upper", F.explode(F.sequence("lower", F.col("upper") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
    owned = chunks.select("place", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col("upper")) - 1)).alias("point"))
    # The slot of a point, by the step's inverse.
    back = pow(golden(slots), -1, slots)
    product = f"point * {back}L" if slots <= 1 << 31 else f"{wide('point')} * {wide(f'{back}L')}"
    placed = owned.withColumn("slot", F.expr(f"cast(({product}) % {slots}L as bigint)")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    before = W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("place", "chunk").agg(F.count("*").alias("n")).select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    return placed.withColumn("inside", inside).join(offsets, ["place", "chunk"]).select("place", (F.col("offset") + F.col("inside")).cast("long").alias("rank"), "slot")


def schedule(found: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """(place, rank, slot): the path of slots of each source's ranks, over all levels."""
    out = group = None
    share = 0
    for edges, slots, _ in found:
        own = ranked_slots(edges, slots).select("place", "rank", F.array("slot").alias("path"))
        if group is not None:
            # Slots of this level share the outer slots of their place evenly, in order.
            outer = group.select(F.col("rank").alias("at"), F.col("path").alias("outer"))
            at = F.expr(f"cast({wide('path[0]')} * {share} div {slots}L as bigint)")
            own = own.withColumn("at", at).join(outer, "at").select("place", "rank", F.concat("outer", "path").alias("path"))
        own = stored(own, "mix-slots")
        group = own.where(F.col("place") == GROUP)
        share = group.count()
        mine = own.where(F.col("place") != GROUP)
        out = mine if out is None else out.union(mine)
    return out


def positions(sized: DataFrame, total_rows: int) -> DataFrame:
    """Adds ``begin``, the words before a row in its source's shuffled order.

    ``sized`` has place, key (hex), id, size and n, the number of rows that are alike.
    """
    buckets = max(1, -(-total_rows // BUCKET_ROWS))
    keyed = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")).withColumn("own", F.col("n") * F.col("size"))
    preceding = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    sums = keyed.groupBy("place", "bucket").agg(F.sum("own").alias("own")).withColumn("shelf", F.expr(f"bucket div {BUCKET_ROWS}"))
    shelves = sums.groupBy("place", "shelf").agg(F.sum("own").alias("own"))
    shelves = shelves.select("place", "shelf", F.coalesce(F.sum("own").over(preceding("place").orderBy("shelf")), F.lit(0)).alias("outer"))
    inner = F.coalesce(F.sum("own").over(preceding("place", "shelf").orderBy("bucket")), F.lit(0))
    offsets = sums.withColumn("inner", inner).join(shelves, ["place", "shelf"]).select("place", "bucket", (F.col("outer") + F.col("inner")).alias("offset"))
    inside = preceding("place", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size")
    placed = keyed.withColumn("inner", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    return placed.join(offsets, ["place", "bucket"]).withColumn("begin", F.col("offset") + F.col("inner")).drop("bucket", "inner", "offset", "own", "key")


class Plan:
    """Where the documents lie in their sources, and what the schedule takes of them.

    ``rows`` has a row per kind of document (id, source, size): place, source_size, target, n,
    begin, and ``reach``, the words that its source's slots take of its line; ``rank_of`` the
    rank of the slot that a word of the line is in.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: str) -> None:
        # The texts are read once; what follows reads ids and sizes.
        named = df.select(df[id_col].alias("id"), df[source_col].alias("source"), df[text_col].cast("string").alias("text"))
        sized = named.select("id", "source", word_count(F.col("text")).alias("size"), shuffled(seed, F.col("id"), F.col("text")).alias("key"))
        alike = stored(sized.groupBy("source", "key", "id", "size").agg(F.count("*").alias("n")), "mix-sizes")
        by_source = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
        targeted = stored(targets(by_source.select("source", "source_size"), weights, most), "mix-targets")
        rows = by_source.agg(F.sum("rows")).first()[0] or 0
        self.total = targeted.agg(F.sum("source_size")).first()[0] or 0
        self.most, self.levels = most, levels(targeted, self.total) if self.total else []
        per_source = targeted.withColumnRenamed("source", "named").join(self._reach(targeted), "place", "left")
        same = alike["source"].eqNullSafe(per_source["named"])
        self.rows = stored(positions(alike.join(per_source, same).drop("named"), rows), "mix-places")

    def _times(self, x: str, y: str) -> str:
        """A product, in decimals where it could leave 64 bits."""
        slots = max((s for _, s, _ in self.levels), default=1)
        return f"{x} * {y}" if (self.most + 1) * self.total * slots < 1 << 62 else f"{wide(x)} * {wide(y)}"

    def _reach(self, targeted: DataFrame) -> DataFrame:
        """(place, slots, words, reach) of each source that owns slots."""
        out = targeted.select("place").limit(0).selectExpr("place", "0L as slots", "0L as words", "0L as reach")
        for edges, slots, words in self.levels:
            reach = F.expr(f"cast({self._times('(upper - lower)', f'{words}L')} div {slots}L as bigint)")
            out = out.union(edges.where(F.col("place") != GROUP).select("place", F.lit(slots).cast("long"), F.lit(words).cast("long"), reach))
        return out

    def rank_of(self, word: str) -> Column:
        return F.expr(f"cast(({self._times(f'({word} + 1)', 'slots')} - 1) div words as bigint)")


def taken_of(line: Column, size: Column, reach: Column) -> Column:
    """Words from ``line`` on that lie in what is taken."""
    return F.greatest(F.least(line + size, reach) - line, F.lit(0))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """(id, source, size, source_size, target, taken, starts, first_slot) of every document.

    ``taken`` counts the words that the mix takes of it, repeats included; ``starts`` how often
    its first word is taken; ``first_slot`` is the path of the slot where it is taken first.
    """
    plan = Plan(df, id_col, text_col, source_col, weights, most, seed)
    each = plan.rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("begin", F.col("begin") + (F.col("copy") - 1) * F.col("size")).withColumn("reach", F.coalesce("reach", F.lit(0)))
    lines = [F.col("begin") + k * F.col("source_size") for k in range(most)]
    taken, starts = F.lit(0).cast("long"), F.lit(0).cast("long")
    for line in lines:
        taken = taken + taken_of(line, F.col("size"), F.col("reach"))
        starts = starts + ((F.col("size") > 0) & (line < F.col("reach"))).cast("long")
    counted = each.withColumns({"taken": taken, "starts": starts})
    columns = [F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "starts"]
    if not plan.levels:
        return counted.select(*columns, F.lit(None).cast("array<bigint>").alias("first_slot"))
    ranked = counted.withColumn("rank", F.when(F.col("starts") > 0, plan.rank_of("begin")))
    slots = schedule(plan.levels).withColumnRenamed("path", "first_slot")
    return ranked.join(slots, ["place", "rank"], "left").select(*columns, "first_slot")


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(id, source, size, slot, share): a kind of document once for each time that its first word is taken.

    ``slot`` is the path of the slot, ``share`` how far through the schedule it is; the mix in the order of slots holds the sources' words in
    the proportion of their targets from its start to any place.
    """
    plan = Plan(df, id_col, text_col, source_col, weights, most, seed)
    if not plan.levels:
        return plan.rows.limit(0).select("id", "source", "size", F.array().cast("array<bigint>").alias("slot"), F.lit(0.0).alias("share"))
    lines = plan.rows.where("size > 0").withColumn("line", F.explode(F.array(*[F.expr(f"begin + {k} * source_size") for k in range(most)]))).where("line < reach")
    return lines.withColumn("rank", plan.rank_of("line")).join(schedule(plan.levels).withColumnRenamed("path", "slot"), ["place", "rank"]).select("id", "source", "size", "slot", (F.get("slot", F.lit(0)) / plan.levels[0][1]).alias("share"))
