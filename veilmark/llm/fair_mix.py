"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are shuffled by a seeded MD5 of their ids. A document's
*virtual finish time* is the running total of its source's words up to its end,
divided by the source's target; a source short of its target goes round again,
up to ``LAPS`` times. All offers are range-sorted by finish time, their words
are added up along that order, and the order is cut where the total budget, the
words of the whole table, is used up. Up to time 1 no source has more than its
target, so the cut lies at time 1 or a little behind it, and the mix is balanced
at every prefix.

A long document across time 1 would hold up its source. Where more than ``GAP``
of the target lies between the end of the document before it and time 1, it
goes to the end of its round, and those behind it move up; this is done
``ROUNDS`` times. The largest document that fits into what then lacks at time 1
goes before the others: that offer's finish time becomes what its source has
been served with it, over the target.

Nothing is added up in one task: running totals go through ranges
(:func:`running_total`) or, inside a source, through buckets of the shuffled
order whose number follows the number of rows. Texts are read once for their
sizes, and once more by :func:`mixed_documents`.

Cases: a null source is a source of its own, last in order; a null text has
size 0. Documents without words cost nothing and are never taken. Null ids and
repeated rows are separate documents; equal ones may swap places without
effect. Equal finish times go by source, then by place in the source. An empty
table gives no rows. Further columns are carried by :func:`mixed_documents`,
whatever their names, and not read otherwise.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, text_or_empty

LAPS = 3
GAP, ROUNDS = 0.01, 2
WEIGHTS = (1, 2, 3)
#: Rows in one bucket of the shuffled order, or in one range of a running total, about.
BUCKET_ROWS = 200_000
#: Bits of the shuffled order.
TURN_BITS = 48


def word_count(text: Column) -> Column:
    """Number of runs of bytes that are not ASCII white space."""
    blanks = "\t\n\x0b\f\r "
    flat = F.btrim(text, F.lit(blanks))
    return F.when(flat == "", 0).otherwise(F.regexp_count(flat, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def running_total(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``df`` with, for each of ``values``, its sum over all rows up to this one by ``order``; ``order`` has no ties.

    Rows are dealt to ranges, ranges are added up in a table of one row each,
    and windows run inside ranges only.
    """
    kept = df.select("*", *[v.alias(f"__{n}") for n, v in values.items()])
    parts = partitions_for(df.sparkSession)
    dealt = materialize(kept.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.groupBy("__range").agg(*[F.sum(f"__{n}").alias(n) for n in values])
    # a row for each range
    first = own.select("__range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__first_{n}") for n in values])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.select("*", *[F.sum(f"__{n}").over(inside).alias(f"__inner_{n}") for n in values]).join(F.broadcast(first), "__range")
    return summed.select(*df.columns, *[(F.col(f"__first_{n}") + F.col(f"__inner_{n}")).alias(n) for n in values])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, laps: int = LAPS) -> DataFrame:
    """``(source, source_size, target)``: shares of all words by weight, none above ``laps`` times its size.

    ``sizes`` has one row a source; what a capped source leaves is dealt out
    again by weight. Water-filling in closed form: sources are ranked by size
    over weight, and the first whose cap lies above the level that the rest
    can reach sets it.
    """
    by_name = F.col("source").asc_nulls_last()
    placed = running_total(sizes, [by_name], place=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = placed.withColumn("weight", weight.cast("long")).withColumn("cap", laps * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = materialize(running_total(w, [F.col("ratio"), by_name], caps=F.col("cap"), weights=F.col("weight"), rank=F.lit(1)), "targets")
    whole = ranked.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))  # one row
    rest = F.col("all_words") - (F.col("caps") - F.col("cap"))
    level = rest / (F.col("all_weights") - (F.col("weights") - F.col("weight")))
    levels = ranked.crossJoin(F.broadcast(whole)).select("rank", "ratio", level.alias("level"))
    first = levels.where("ratio >= level").agg(F.min(F.struct("rank", "level"))["level"].alias("level"))  # one row
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return ranked.crossJoin(F.broadcast(first)).select("source", "source_size", target.alias("target"))


def _narrow(df: DataFrame, id_column: str, text_column: str, source_column: str, seed: int) -> DataFrame:
    """``id, source, size, turn, tie`` of every row: its words, its place in the shuffled order, and a hash of its text."""
    text, key = text_or_empty(text_column), F.col(id_column)
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, TURN_BITS // 4), 16, 10).cast("long")
    return df.select(key.alias("id"), F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"), turn.alias("turn"), F.xxhash64(text).alias("tie"))


def _same(left: str, right: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def queue(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 1) -> DataFrame:
    """One row a document: ``id, source, size, tie, source_size, target, end, late, early``.

    ``end`` is the running total of its source's words, ``late`` the same in
    the round in which the source meets its target, ``early`` the finish time
    of the one offer that goes before a longer document, if it is its.
    """
    narrow = materialize(_narrow(df, id_column, text_column, source_column, seed), "mix")
    bits = min(max(7, ceil(log2(max(narrow.count(), 1) / BUCKET_ROWS))), TURN_BITS)
    docs = narrow.withColumn("bucket", F.shiftright("turn", TURN_BITS - bits))
    parts = materialize(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix")
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    plan = materialize(starts.alias("s").join(goal.alias("g"), _same("s", "g", "source")).select("s.*", "g.source_size", "g.target"), "mix")

    inside = Window.partitionBy("source", "bucket").orderBy("turn", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = docs.withColumn("own", F.sum("size").over(inside)).alias("d")
    placed = own.join(plan.alias("p"), _same("d", "p", "source", "bucket"))
    placed = placed.select("d.id", "d.source", "d.bucket", "d.size", "d.tie", "p.source_size", "p.target", (F.col("p.start") + F.col("d.own")).alias("end"))
    placed = materialize(placed.withColumn("late", F.col("end")), "mix")

    for _ in range(ROUNDS):
        placed = _passed_over(placed, plan)
    placed = materialize(placed, "mix")

    served = placed.where("size > 0").withColumn("copies", sum(((_finish(k) <= 1).cast("int") for k in range(LAPS)), F.lit(0)))
    got = served.groupBy("source", "bucket").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).groupBy("source").agg(F.sum("got").alias("got"))
    # joined by source and bucket: a source's rows are spread over tasks
    lacks = plan.alias("p").join(got.alias("g"), _same("p", "g", "source")).select("p.source", "p.bucket", F.col("g.got").alias("got"))
    fits = served.alias("d").join(lacks.alias("l"), _same("d", "l", "source", "bucket")).select("d.*", "l.got").where(f"copies < {LAPS} and got + size <= target")
    best = F.max(F.struct("size", "end", "got", "target")).alias("best")
    early = fits.groupBy("source", "bucket").agg(best).groupBy("source").agg(F.max("best").alias("best"))
    early = early.select("source", F.col("best.end").alias("end"), ((F.col("best.got") + F.col("best.size")) / F.col("best.target")).alias("early"))
    # ends of documents with words are distinct within a source
    found = placed.alias("d").join(materialize(early, "mix").alias("e"), _same("d", "e", "source", "end") & (F.col("d.size") > 0), "left")
    return found.select("d.id", "d.source", "d.size", "d.tie", "d.source_size", "d.target", "d.end", "d.late", "e.early")


def _passed_over(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """The document across time 1 goes to the end of its source's last round, if it leaves more than ``GAP`` of the target."""
    rest = F.col("target") - _last() * F.col("source_size")
    across = placed.where("size > 0").where(F.col("late") > rest)
    first = F.min(F.struct("late", "size", (rest - (F.col("late") - F.col("size")) > GAP * F.col("target")).alias("move"))).alias("first")
    first = across.groupBy("source", "bucket").agg(first).groupBy("source").agg(F.min("first").alias("first")).where("first.move")
    moves = plan.alias("p").join(first.alias("f"), _same("p", "f", "source")).select("p.source", "p.bucket", F.col("first.late").alias("at"), F.col("first.size").alias("by"))
    both = placed.alias("d").join(materialize(moves, "mix").alias("m"), _same("d", "m", "source", "bucket"), "left")
    late = F.when((F.col("d.late") == F.col("at")) & (F.col("d.size") > 0), F.col("d.source_size")).when(F.col("d.late") > F.col("at"), F.col("d.late") - F.col("by"))
    return both.select("d.*", late.alias("moved")).withColumn("late", F.coalesce("moved", "late")).drop("moved")


def _last() -> Column:
    """The round in which a source meets its target."""
    return F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def _finish(lap: int) -> Column:
    at = F.when(_last() == lap, F.col("late")).otherwise(F.col("end"))
    return (F.lit(lap) * F.col("source_size") + at) / F.col("target")


def _times() -> Column:
    """Finish times of a document's offers. The early one takes the place of its first offer behind time 1."""
    behind = lambda k: (_finish(k) > 1) if k == 0 else ((_finish(k) > 1) & (_finish(k - 1) <= 1))
    return F.array(*[F.when(F.col("early").isNotNull() & behind(k), F.col("early")).otherwise(_finish(k)) for k in range(LAPS)])


def offers(queued: DataFrame) -> DataFrame:
    """All offers of :func:`queue` by finish time: ``finish, source, end, lap, size`` and ``used``, the words up to each."""
    each = queued.where("size > 0").select("source", "end", "size", F.posexplode(_times()).alias("lap", "finish"))
    return running_total(each, [F.col("finish"), F.col("source").asc_nulls_last(), F.col("end"), F.col("lap")], used=F.col("size"))


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 1) -> DataFrame:
    """:func:`queue` with ``copies``, how often the mix takes a document, and ``places``, what the mix has used up to each copy.

    The cut is the last offer, in global order, that ends within the budget.
    """
    queued = materialize(queue(df, id_column, text_column, source_column, seed), "mix")
    whole = queued.agg(F.sum("size").alias("budget"))  # one row
    taken = offers(queued).crossJoin(F.broadcast(whole)).where("used <= budget")
    by_document = taken.groupBy("source", "end").agg(F.sort_array(F.collect_list("used")).alias("places"))  # LAPS places at most
    both = queued.alias("q").join(by_document.alias("t"), _same("q", "t", "source", "end") & (F.col("q.size") > 0), "left")
    return both.select("q.*", F.coalesce(F.size("t.places"), F.lit(0)).alias("copies"), "t.places")


def mix_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)``, one row a document."""
    m = mix(df, id_column, text_column, source_column)
    return m.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.greatest("copies", F.lit(0)) * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them, range-sorted by finish time.

    The order is made on narrow rows; the columns of ``df`` join it once. Rows
    that agree in id, source and text share their copies out in turn.
    """
    names = df.columns
    m = materialize(mix(df, id_column, text_column, source_column).where("copies > 0"), "mix")
    copies = m.groupBy("id", "source", "tie").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    row = F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)]).alias("row")
    full = df.select(row, F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), F.xxhash64(text_or_empty(text_column)).alias("tie"))
    both = full.alias("d").join(copies.alias("c"), _same("d", "c", "id", "source", "tie")).select("d.*", "c.places")
    equal = Window.partitionBy("id", "source", "tie")
    numbered = both.withColumn("nth", F.row_number().over(equal.orderBy("id")) - 1).withColumn("n", F.count("*").over(equal))
    again = numbered.select("row", F.explode(F.filter("places", lambda _, i: F.pmod(i, F.col("n")) == F.col("nth"))).alias("place"))
    budget = m.agg(F.max(F.array_max("places"))).first()[0] or 1
    parts = partitions_for(df.sparkSession)
    ordered = again.repartitionById(parts, F.least(F.floor(F.col("place") * parts / budget), F.lit(parts - 1)).cast("int")).sortWithinPartitions("place")
    return ordered.select(*[F.col(f"row.k{i}").alias(n) for i, n in enumerate(names)])
