"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

The rows of a source form blocks of BLOCK rows. With weight w, its i-th block (from 0) is released at
slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the released block with the
earliest deadline, the first source by name on ties. As the weights add up to one, no deadline is
missed, so at every slot each source that still has blocks is within one block of its share. A source
that has run out leaves its slots empty, and the others go on in proportion. No row is dropped or repeated.

Weights are whole slots of PERIOD = 10^15, which is as fine as a double: as given if they have fifteen
decimals and add up to one, by largest remainders else, and a thousandth of an even share at least. The
schedule is exact for these whole numbers; against the weights before rounding, a source drifts by two blocks
in 10^15 slots at most. Where the numbers have a common divisor the schedule repeats and one turn of it is
worked out, else it is worked out to the last slot, in parallel segments. A segment takes its first slot's
place in the period (a product of 38 digits) and counts from there, in 64 bits. It needs to know which
sources are one block ahead at its first slot; it starts from a guess (those with the earliest deadlines),
and segments that began otherwise than the one before has ended are worked out again until all agree,
which is the earliest-deadline-first schedule itself. A segment has twice as many slots as there are sources, at least.

Rows are numbered within a source by the MD5 of their id. A prefix of it splits each source into
small ranges that are counted first, so no source is ever sorted by one task.

A null source is the source ''. Null ids and repeated rows each take a place of their own. Missing or
non-positive target weights count as the smallest. The default weights are the square
roots of the numbers of rows. Columns named mix_slot, mix_place and mix_block are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.common import forget, stored

BLOCK = 16
#: Slots that the weights are parts of.
PERIOD = 10**15
#: Slots of a segment of the schedule, and the most of them: with PERIOD, they stay within 64 bits.
SEGMENT = 300
MAX_SEGMENT = 4_000
#: Rows of a schedule that is broadcast.
BROADCAST_ROWS = 200_000
RANGE_ROWS = 4_000


def shares(counts: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(source, n, w): each source's slots in a period, which add up to it; one row per source of counts(source, n)."""
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))])
        raw = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    else:
        raw = F.sqrt(F.col("n").cast("double"))
    own = F.col("raw")
    one = counts.select("source", "n", F.when(raw > 0, raw).otherwise(0.0).alias("raw"))
    total = one.agg(F.sum("raw").alias("total"), F.count(F.lit(1)).alias("k")).withColumn("least", F.greatest(F.lit(1), F.floor(F.lit(period) / (1000 * F.greatest("k", F.lit(1))))).cast("long"))
    low = period * own < F.col("least") * F.col("total")
    mark = one.crossJoin(F.broadcast(total)).withColumn("low", (own <= 0) | low)  # one row is broadcast
    high = mark.agg(F.sum(F.when(~F.col("low"), own)).alias("high"), F.count_if("low").alias("lows"))
    exact = F.when(F.col("low"), F.col("least").cast("double")).otherwise(F.round((period - F.col("lows") * F.col("least")) * own / F.nullif(F.col("high"), F.lit(0.0)), 6))
    parts = mark.crossJoin(F.broadcast(high)).select("source", "n", exact.alias("exact"))  # one row is broadcast
    # what is missing goes to the largest remainders
    order = F.sort_array(F.collect_list(F.struct((F.floor("exact") - F.col("exact")).alias("rest"), "source", "n", F.floor("exact").cast("long").alias("whole"))))
    few = parts.agg(order.alias("s")).withColumn("missing", F.lit(period) - F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["whole"])).withColumn("k", F.size("s"))  # a row for each source
    more = lambda i: F.floor(F.col("missing") / F.col("k")) + F.when(i < F.col("missing") % F.col("k"), 1).otherwise(0)
    return few.select(F.inline(F.transform("s", lambda x, i: F.struct(x["source"].alias("source"), x["n"].alias("n"), (x["whole"] + more(i)).cast("long").alias("w")))))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)  # whole numbers: a double would round


def ended(starts: DataFrame, parts: DataFrame, period: int, length: int) -> DataFrame:
    """starts(segment, ahead) with the sources ahead at the segment's end and, for each of its slots, the source and its block.

    A source is a place in w of the one row of parts; ahead is the array of those that have had one block more than floor(slot * w / period).
    """
    wide = F.col("segment").cast("decimal(19,0)") * length
    product = lambda w: wide * w.cast("decimal(18,0)")
    known = starts.crossJoin(F.broadcast(parts.select("w")))  # one row is broadcast
    known = known.withColumns({"base": F.transform("w", lambda w: _div(product(w), F.lit(period).cast("decimal(18,0)")).cast("long")), "rest": F.transform("w", lambda w: (product(w) % F.lit(period)).cast("long"))})
    done = F.transform("w", lambda w, i: F.array_contains("ahead", i).cast("long"))
    state = F.struct(done.alias("done"), F.array().cast("array<struct<i:int,block:long>>").alias("out"))

    def step(acc, t):
        had = acc["done"]
        due = lambda w, i: _div((F.get(had, i) + 1) * period - F.get("rest", i) + w - 1, w)
        free = F.transform("w", lambda w, i: F.when(F.get(had, i) * period < (t + 1) * w + F.get("rest", i), F.struct(due(w, i).alias("due"), i.alias("i"))))
        one = lambda i: F.struct(i.alias("i"), (F.get("base", i) + F.get(had, i)).alias("block"))
        return F.transform(F.array(F.array_min(free)["i"]), lambda i: F.struct(F.transform(had, lambda d, j: d + F.when(i == j, 1).otherwise(0)).alias("done"), F.array_append(acc["out"], one(i)).alias("out")))[0]

    made = known.withColumn("x", F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")), state, step))
    # how far a source is at the end, against the whole blocks due by then
    over = F.transform("w", lambda w, i: F.get("x.done", i) - _div(w * length + F.get("rest", i), F.lit(period).cast("long")))
    end = F.filter(F.transform(over, lambda d, i: F.when(d > 0, i)), lambda i: i.isNotNull())
    return made.select("segment", "ahead", end.alias("end"), "x.out")


def schedule(parts: DataFrame, slots: int, period: int = PERIOD, length: int = SEGMENT) -> DataFrame:
    """(slot, source, turn) of the first slots of the earliest-deadline-first schedule of parts(source, w); turn counts a source's blocks."""
    spark = parts.sparkSession
    one = parts.agg(F.sort_array(F.collect_list(F.struct("source", "w"))).alias("s")).select(F.col("s.source").alias("source"), F.col("s.w").alias("w"))  # a row for each source
    wide = F.col("segment").cast("decimal(19,0)") * length
    rest = F.transform("w", lambda w: (wide * w.cast("decimal(18,0)") % F.lit(period)).cast("long"))
    late = F.transform("w", lambda w, i: F.when(F.get("rest", i) != 0, F.struct(_div(F.lit(period).cast("long") - F.get("rest", i) + w - 1, w).alias("due"), i.alias("i"))))
    n = _div(F.aggregate("rest", F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)")), F.lit(period).cast("decimal(18,0)")).cast("int")
    guess = spark.range(-(-slots // length)).withColumnRenamed("id", "segment").crossJoin(F.broadcast(one.select("w"))).withColumn("rest", rest)  # one row is broadcast
    first = F.when(n > 0, F.slice(F.array_sort(F.filter(late, lambda x: x.isNotNull())), F.lit(1), n)["i"]).otherwise(F.array().cast("array<int>"))
    made = stored(ended(guess.select("segment", F.array_sort(first).alias("ahead")), one, period, length), "segments")
    while True:
        before = made.select((F.col("segment") + 1).alias("segment"), F.col("end").alias("before"))
        wrong = stored(made.join(before, "segment").where(F.col("ahead") != F.col("before")).select("segment", F.col("before").alias("ahead")), "segments")
        if wrong.isEmpty():
            break
        again = stored(made.join(wrong.select("segment"), "segment", "left_anti").unionByName(ended(wrong, one, period, length)), "segments")
        forget(spark, made)
        forget(spark, wrong)
        made = again
    each = made.select("segment", F.posexplode("out").alias("at", "x")).crossJoin(F.broadcast(one.select("source")))  # one row is broadcast
    return each.select((F.col("segment") * length + F.col("at")).cast("long").alias("slot"), F.get("source", F.col("x.i")).alias("source"), F.col("x.block").alias("turn")).where(F.col("slot") < slots)


def placed(ranges: DataFrame, digits: int) -> DataFrame:
    """ranges(_source, _range, n) to (_source, _range, _before): the rows of the source in the ranges before, added up in two steps."""
    cut = ranges.withColumn("_part", F.substring("_range", 1, digits // 2))
    upto = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    parts = cut.groupBy("_source", "_part").agg(F.sum("n").alias("n")).select("_source", "_part", upto("_source", "_part").alias("_first"))
    within = cut.select("_source", "_part", "_range", upto("_source", "_part", "_range").alias("_after"))
    return within.join(parts, ["_source", "_part"]).select("_source", "_range", (F.col("_first") + F.col("_after")).alias("_before"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of df, then mix_slot, mix_place (the place within the slot's block) and mix_block (of its source), long."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = stored(df.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    while period < 8 * known.k:  # eight slots a source on average, at least
        period *= 10
    parts = stored(shares(counts, weights, period), "shares")
    blocks = F.ceil(F.col("n") / block)
    last = parts.agg(F.expr("array_agg(w)").alias("w"), F.max(F.ceil(blocks * (period / F.col("w"))) + 1).alias("slots")).first()  # a number for each source
    common = math.gcd(*(last.w or [1]))
    cycle = period // common
    slots = min(cycle, int(last.slots or 1))
    length = min(max(SEGMENT, 2 * known.k), MAX_SEGMENT)
    made = schedule(parts, slots, period, length).join(F.broadcast(parts.select("source", blocks.alias("_blocks"))), "source").where(F.col("turn") < F.col("_blocks"))  # a row for each source
    plan = stored(made.select(F.col("source").alias("_source"), F.col("turn").alias("_turn"), "slot"), "schedule")
    digits = max(1, math.ceil(math.log(max(known.n / RANGE_ROWS, 1), 16)))
    code = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keep = [c for c in df.columns if c not in ("mix_slot", "mix_place", "mix_block")]
    rows = df.select(F.struct(*keep).alias("_row"), F.col(id_col).alias("_id"), source.alias("_source"), code.alias("_code")).withColumn("_range", F.substring("_code", 1, digits))
    ranges = df.select(source.alias("_source"), F.substring(code, 1, digits).alias("_range")).groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("n"))
    before = placed(ranges, digits).join(parts.select(F.col("source").alias("_source"), F.floor(F.col("w") / common).alias("_each")), "_source")
    within = Window.partitionBy("_source", "_range").orderBy("_code", "_id")
    put = rows.withColumn("_place", F.row_number().over(within) - 1).join(before, ["_source", "_range"])
    place = F.col("_before") + F.col("_place")
    b = F.floor(place / block)
    put = put.withColumn("_turn", b % F.col("_each")).join(F.broadcast(plan) if slots <= BROADCAST_ROWS else plan, ["_source", "_turn"])  # a slot is a row at most
    slot = F.floor(b / F.col("_each")) * cycle + F.col("slot")
    return put.select(*[F.col("_row")[c].alias(c) for c in keep], slot.cast("long").alias("mix_slot"), (place % block).cast("long").alias("mix_place"), b.cast("long").alias("mix_block"))
