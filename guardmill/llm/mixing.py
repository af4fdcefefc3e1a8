"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardmill.functions.rows import exploded
from guardmill.operators.joins import BROADCAST_ROWS, lookup_join
from guardmill.operators.scratch import settled

from .columns import document_text, hash60, need_columns, shuffle_partitions, word_count
from .prefix import running_total

#: Source weights, dealt in turn over the sources in code point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and so no document, is taken more often than this.
MOST_REPEATS = 3
#: Fractional part of the golden ratio, as a share of 2^32.
GOLDEN = 2654435769
#: Words of a block of a source's line, and of a run of the schedule.
BLOCK_WORDS = 4096
_SPAN = 1 << 32
_WIDE = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   repeats: int = MOST_REPEATS) -> DataFrame:
    """Sources (skey, source, source_size) with their target number of words.

    Targets share 100 % of all words by weight. A target stops at `repeats` times its source,
    and what is over is shared again by weight among the others until none is above. That
    is a water level: with sources in the order of cap / weight, a source is full iff the
    level that the sources before it leave would lift it above its cap. One window over
    the sources, none over documents. Sources without words get 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    cap = F.col("source_size") * float(repeats)
    weighed = sizes.withColumn("weight", dealt).select(
        "*", cap.alias("cap"), F.sum("weight").over(everything).alias("all_weight"),
        F.sum("source_size").over(everything).cast("double").alias("all_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(
        Window.unboundedPreceding, -1)
    left = weighed.select(
        "*", (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .alias("left_size"),
        (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .alias("left_weight"))
    full = F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight")
    marked = left.withColumn("full", full)
    # the first source that is not full sees the final level
    level = F.max(F.when(~F.col("full"), F.struct(
        "left_weight", "left_size"))).over(everything)
    lifted = level["left_size"] / level["left_weight"] * F.col("weight")
    return marked.withColumn("level", level).select(
        "skey", "source", "source_size", "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(
            F.least(lifted, F.col("cap"))).alias("target"))


def _euclid() -> list[tuple[int, int, int]]:
    """Modulus, quotient and remainder in every step of Euclid's algorithm on the golden
    ratio and 2^32."""
    found, m, a = [], _SPAN, GOLDEN
    while True:
        found.append((m, a // m, a % m))
        if not a % m:
            return found
        m, a = a % m, m


def _floor_sum(n: int, start: Column) -> Column:
    """Sum of floor((GOLDEN * i + start) / 2^32) over the whole numbers i below n."""
    def wide(value):
        return value.cast(_WIDE)

    steps = F.array(*[F.struct(*(wide(F.lit(v)).alias(k) for k, v in zip("mqa", step,
                                                                         strict=True)))
                      for step in _euclid()])

    def one(state: Column, step: Column) -> Column:
        n, m, within = state["n"], step["m"], wide(state["b"] % step["m"])
        top = wide(wide(step["a"] * n) + within)
        pairs = wide(F.call_function("div", wide(n * (n - 1)), wide(F.lit(2))))
        lifted = wide(n * wide(F.call_function("div", state["b"], m)))
        return F.struct(wide(F.call_function("div", top, m)).alias("n"),
                        wide(top % m).alias("b"),
                        wide(state["found"] + wide(pairs * step["q"]) + lifted)
                        .alias("found"))

    first = F.struct(wide(F.lit(n)).alias("n"), wide(start).alias("b"),
                     wide(F.lit(0)).alias("found"))
    return F.aggregate(steps, first, one, lambda state: state["found"])


def _cut_shares(targets: DataFrame) -> DataFrame:
    """`targets` with `share`: the part of all targets up to and with this source."""
    by = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(by) / F.sum("target").over(Window.partitionBy())
    return targets.withColumn("share", F.least(share, F.lit(1.0)))


def source_words(targets: DataFrame, slots: int, block: int = 1,
                 repeats: int = MOST_REPEATS) -> DataFrame:
    """`targets` with `words`: how many words of a source the schedule takes.

    Slot i has the point (GOLDEN * i + 2^31) mod 2^32; it belongs to the source in whose part
    of the cumulative shares the point falls. How many of the slots that are is a difference
    of two floor sums, so this is known without the slots of `slot_runs`, whose counts are
    held against it. Every 2^32 slots meet every point once; such whole rounds are shared out
    by the targets themselves, so that shares are not rounded to 2^32nds of a larger total.
    """
    rounds, rest = divmod(slots, _SPAN)
    cut = _cut_shares(targets).withColumn(
        "until", F.least(F.ceil(F.col("share") * float(_SPAN)), F.lit(_SPAN)))
    # slots with a point below `until`, up to a constant
    below = (F.floor(F.col("share") * float(rounds * _SPAN))
             - _floor_sum(rest, F.lit(_SPAN + (1 << 31)) - F.col("until")).cast("long"))
    none = -_floor_sum(rest, F.lit(_SPAN + (1 << 31))).cast("long")
    counted = cut.withColumn("below", below)
    turns = F.col("below") - F.coalesce(
        F.lag("below").over(Window.orderBy("skey")), none)
    return counted.withColumn("words", F.least(
        turns * block, F.col("source_size") * repeats)).drop("share", "until", "below")


def slot_runs(targets: DataFrame, slots: int, length: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: skey, run, n, rank.

    Every slot is a row: its point, as in `source_words`, falls into the part of one source.
    Runs are `length` slots in a row; `n` slots of a run are the source's, and they rank
    `rank`, `rank` + 1, ... among the source's slots. Slots are counted per run and source in
    the task that makes them, and ranked by the counts of the runs before, so no slot is
    shuffled and no source's slots meet in one task. From 2^32 slots on points come again;
    every whole round then moves them by another part of their distance.
    """
    spark = targets.sparkSession
    cut = _cut_shares(targets).withColumn("until", F.col("share") * float(_SPAN))
    before = Window.orderBy("skey")
    arcs = settled(cut.select(
        "skey", F.row_number().over(before).cast("long").alias("number"), "until",
        F.coalesce(F.lag("until").over(before), F.lit(0.0)).alias("since")))
    # parts are met by cells of the points, about four per source
    shift = 32 - min(20, (4 * arcs.count()).bit_length())
    cells = arcs.filter("until > since").select("number", "since", "until", F.explode(F.sequence(
        F.shiftright(F.floor("since"), shift),
        F.shiftright(F.ceil("until") - 1, shift))).alias("cell"))
    tasks = max(1, min(slots >> 20, max(shuffle_partitions(spark), slots >> 26)))
    within = F.col("id").bitwiseAND(F.lit(_SPAN - 1))
    # a factor equal modulo 2^32, with which no product leaves 64 bits
    point = (within * F.lit(GOLDEN - _SPAN) + F.lit(1 << 31)).bitwiseAND(F.lit(_SPAN - 1))
    rounds, turn = slots >> 32, F.shiftright("id", 32)
    moved = F.when(turn < rounds, (turn + 0.5) / rounds).otherwise(0.0) if rounds else F.lit(0.0)
    made = spark.range(0, slots, 1, tasks).select(
        F.call_function("div", F.col("id"), F.lit(length)).alias("run"),
        point.alias("point"), moved.alias("moved"))
    placed = made.select("run", F.shiftright("point", shift).alias("cell"),
                         (F.col("point") + F.col("moved")).alias("place"))
    met = lookup_join(placed, cells, ["cell"], max_rows=4 * BROADCAST_ROWS).filter(
        "place >= since AND place < until")
    counted = settled(met.groupBy("number", "run").agg(F.count(F.lit(1)).alias("n")))
    step = (1 << 60) // -(-slots // length)
    ranked = running_total(counted.withColumn("at", F.col("run") * step), ["number"], "at",
                           ["run"], "n", "rank")
    return lookup_join(ranked.drop("at"), arcs.select("number", "skey"), ["number"]).drop(
        "number")


def scheduled_blocks(runs: DataFrame, sources: DataFrame, worth: int = 1,
                     repeats: int = MOST_REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """The blocks that the runs take: skey, run, turn, block, start, words.

    A source's line is cut into blocks of `block` words, the last one shorter. Slots take
    `worth` words each in the order of their ranks, over and over through the line, `repeats`
    times at most. A row is what one run takes of one block in one turn through the line:
    `words` words from the block's word `start` on.
    """
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / block)

    def div(a: Column, b: Column | int) -> Column:
        return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)

    def passed(word: Column) -> Column:
        return div(word, size) * blocks + div(word % size, block)

    ranges = lookup_join(runs, sources.select("skey", "source_size"), ["skey"]).select(
        "skey", "run", "source_size", (F.col("rank") * worth).alias("a"), F.least(
            (F.col("rank") + F.col("n")) * worth, size * repeats).alias("b")).filter("a < b")
    cut = exploded(ranges, F.sequence(passed(F.col("a")), passed(F.col("b") - 1)), "at",
                   "skey", "run", "source_size", "a", "b")
    begin = F.col("turn") * size + F.col("block") * block
    end = F.col("turn") * size + F.least((F.col("block") + 1) * block, size)
    return cut.withColumn("turn", div(F.col("at"), blocks)).withColumn(
        "block", F.col("at") % blocks).select(
        "skey", "run", "turn", "block", (F.greatest("a", begin) - begin).alias("start"),
        (F.least("b", end) - F.greatest("a", begin)).alias("words"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS,
                  repeats: int = MOST_REPEATS, slots: int | None = None, seed: str = "mix",
                  identity: str = "doc_id", source: str = "source",
                  text: str = "text") -> DataFrame:
    """One row per document: identity, text_key, size, source_size, target, taken, first_slot.

    Each source's documents are shuffled by a hash of their id and text, laid end to end and
    cut into blocks of equally many words. The schedule has a slot for every word of the input
    (`slot_runs`); slots are ranked within their source, and the source's n slots take its
    blocks in line, over and over, until n words are taken (`scheduled_blocks`). What is taken
    of a block then meets the documents that lie in it. So a source misses its target by a few
    words, however large the input and however small the source. `taken` is the number of
    words taken of the document, repeats counted. A source is never taken more than `repeats`
    times. `slots` makes the schedule coarser: so many slots at most, of equally many words,
    and a source misses by a few times as many.

    Null text: size 0. Null source: a source of its own, last in order. Null or repeated
    ids: documents of their own. Documents of no words are never taken. Empty tables give
    no rows. Other columns are not read. The result depends on the rows alone, so reruns
    agree. Only ids and counts are shuffled, never text.
    """
    need_columns(docs, identity, source, text)
    body = document_text(text)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("z"))
    docs = settled(docs.select(
        F.col(identity).alias("id"), F.col(source).alias("source"), key.alias("skey"),
        F.xxhash64(body).alias("text_key"), word_count(body).alias("size"),
        hash60(F.lit(seed), F.coalesce(F.col(identity).cast("string"), F.lit("null")),
               F.md5(body.cast("binary"))).alias("hashed")))
    sources = settled(source_targets(docs.groupBy("skey", "source").agg(
        F.sum("size").alias("source_size")), weights, repeats))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    if not total:
        return lookup_join(docs.drop("source"), sources, ["skey"]).select(
            F.col("id").alias(identity), "text_key", "size", "source_size", "target",
            F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    worth = max(1, -(-total // slots)) if slots else 1
    placed = settled(running_total(docs.drop("source"), ["skey"], "hashed", ["id", "size"],
                                   "size", "first").drop("hashed"))
    runs = slot_runs(sources, -(-total // worth), max(1, BLOCK_WORDS // worth))
    # ranks have no gaps: a block is taken some times whole and then up to some word
    takes = scheduled_blocks(runs, sources, worth, repeats).groupBy("skey", "block").agg(
        F.sum("words").alias("words"))
    spans = placed.filter("size > 0").select("skey", "first", "size", F.explode(F.sequence(
        F.floor(F.col("first") / BLOCK_WORDS),
        F.floor((F.col("first") + F.col("size") - 1) / BLOCK_WORDS))).alias("block"))
    begin = F.col("block") * BLOCK_WORDS
    start = F.greatest(F.col("first") - begin, F.lit(0)).alias("start")
    end = F.least(F.col("first") + F.col("size") - begin, F.lit(BLOCK_WORDS)).alias("end")
    held = lookup_join(spans.join(takes, ["skey", "block"]), sources.select(
        "skey", "source_size"), ["skey"])
    cut = held.select("skey", "first", "words", start, end, F.least(
        F.col("source_size") - begin, F.lit(BLOCK_WORDS)).alias("length"))
    span = F.col("end") - F.col("start")
    part = F.greatest(F.least(F.col("words") % F.col("length") - F.col("start"), span),
                      F.lit(0))
    # only documents of no words share their place with another one
    got = cut.groupBy("skey", "first").agg(F.sum(
        F.floor(F.col("words") / F.col("length")) * span + part).alias("taken"))
    counted = placed.join(got, ["skey", "first"], "left").withColumn("taken", F.when(
        F.col("size") > 0, F.col("taken")))
    return lookup_join(counted, sources, ["skey"]).select(
        F.col("id").alias(identity), "text_key", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("taken") > 0, F.col("first")).alias("first_slot"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS,
                    repeats: int = MOST_REPEATS, slots: int | None = None, seed: str = "mix",
                    identity: str = "doc_id", source: str = "source",
                    text: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their own columns.

    The mix takes a source from one end of its shuffled line, whole rounds first, so at most
    one document per source is taken in part; it counts as taken from one half on. Null and
    empty texts and texts of blanks are never taken; null ids, sources and repeated rows as in
    `mix_documents`, an empty table stays empty. Columns may have any names.
    """
    mix = mix_documents(docs, weights, repeats, slots, seed, identity, source, text)
    copies = F.round(F.sum("taken") / F.sum("size")).cast("int")
    times = (mix.filter("size > 0").groupBy(F.col(identity).alias("__id"),
                                            F.col("text_key").alias("__key"))
             .agg(copies.alias("__copies")).filter("__copies > 0"))
    # the rows travel as one struct, so none of their columns can clash with a name here
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(identity).alias("id"),
                        F.xxhash64(document_text(text)).alias("key"))
    met = keyed.join(times, (F.col("key") == F.col("__key"))
                     & F.col("id").eqNullSafe(F.col("__id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(
        "copy")).select("row.*")
