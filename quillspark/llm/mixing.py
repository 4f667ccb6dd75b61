"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame terms.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share``
of all words; a target stops at ``most`` times its source's words and what it leaves is
shared again by weight among the rest, until no source is above.

A document of a source then owes target / source words copies, on average. The whole
part is certain. The fractional parts are rounded together: two open documents are
paired and words of probability pass from one to the other, in a direction drawn so
that each keeps its expectation, until one of them is at 0 or 1 and settled. The pair's
expected words stay the same, so a source's taken words stray from its target by the
last open document only. Pairs form inside chunks of about ``CHUNK`` documents; what
stays open of each chunk goes up to the next level of chunks, as a reduction tree.

Draws are hashes of the two documents, the level and a seed: reruns agree.

Rows with equal id, source and text are one unit: of n of them whole copies are settled
at once (n times the fraction, rounded down, are taken once more), and only the remainder
is a document's fraction that is rounded with the others.

Defined results: null text has size 0; documents of size 0 are taken 0 words; of equal
rows any may be those that are taken, reruns choosing alike wherever rows differ; null
ids and null sources are values like any other; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, quoted, save

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 128
RUN = 4096
BROADCAST_ROWS = 500_000  # longer plans are joined by shuffling
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_sources(totals: DataFrame) -> DataFrame:
    """totals (one row per source) with ``pos`` from 0 in code-point order, null last,
    numbered inside ranges and shifted by the rows of the ranges before."""
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = save(ranged, "sources")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    parts = ranged.groupBy("part").count()  # one row per range
    shift = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("part", shift.alias("shift"))
    return ranged.withColumn("inside", inside).join(shifts, "part").withColumn("pos", F.col("inside") - 1 + F.col("shift")).drop("part", "inside", "shift")


def targets(units: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, units, target. The level at which caps bind rises until it
    stands; each round is one aggregate of which one row comes back."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    ranked = rank_sources(totals)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("pos") % len(WEIGHTS) + 1).cast("int"))
    ranked = save(ranked.select("source", "source_size", "units", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "weights")
    total, weights = ranked.agg(F.sum("source_size") * share, F.sum("weight")).first()
    level = (total or 0.0) / weights if weights else 0.0
    while True:
        capped = F.col("cap") < level * F.col("weight")
        held, open_weight = ranked.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight or (raised := (total - (held or 0.0)) / open_weight) <= level:
            break
        level = raised
    return ranked.select("source", "source_size", "units", F.when(F.col("cap") < level * F.col("weight"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


UNIT = "struct<id:{0},size:bigint,h:bigint,w:double,p:double>"


def _let(value: Column, f) -> Column:
    """Bind a value once for use in an expression inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pair(kind: str, seed: int, level: int):
    """(state, unit) -> state. state: the open unit (or null) and the settled ones."""

    def settled(u: Column, take: int) -> Column:
        return F.struct(*(u[c].alias(c) for c in ("id", "size", "h")), F.lit(take).alias("take"))

    def still(u: Column, p: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in ("id", "size", "h", "w")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(state: Column, x: Column) -> Column:
        c = state["open"]
        up = F.least(c["w"] * (1 - c["p"]), x["w"] * x["p"])  # words that may go to c
        down = F.least(c["w"] * c["p"], x["w"] * (1 - x["p"]))  # words that may go to x
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), c["id"], c["size"], c["h"], x["id"], x["size"], x["h"]), 11) / F.lit(float(1 << 53))

        def moved(m: Column) -> Column:
            a, b = m["up"], m["down"]
            to_c = m["draw"] < F.coalesce(F.try_divide(b, a + b), F.lit(1.0))
            c_full = c["w"] * (1 - c["p"]) <= x["w"] * x["p"]
            c_empty = c["w"] * c["p"] <= x["w"] * (1 - x["p"])
            return (
                F.when(to_c & c_full, F.struct(still(x, x["p"] - a / x["w"]).alias("open"), settled(c, 1).alias("last")))
                .when(to_c, F.struct(still(c, c["p"] + a / c["w"]).alias("open"), settled(x, 0).alias("last")))
                .when(c_empty, F.struct(still(x, x["p"] + b / x["w"]).alias("open"), settled(c, 0).alias("last")))
                .otherwise(F.struct(still(c, c["p"] - b / c["w"]).alias("open"), settled(x, 1).alias("last")))
            )

        paired = _let(F.struct(up.alias("up"), down.alias("down"), draw.alias("draw")), moved)
        return F.when(c.isNull(), F.struct(still(x, x["p"]).alias("open"), state["done"].alias("done"))).otherwise(
            _let(paired, lambda r: F.struct(r["open"].alias("open"), F.concat(state["done"], F.array(r["last"])).alias("done")))
        )

    return step


def round_together(units: DataFrame, most_units: int, seed: int = 7) -> DataFrame:
    """units: source, units (how many its source has), id, size, w (words), p, and h, a hash
    of what else tells them apart (0 if there is none). Returns source, id, size, h, take (0
    or 1) of each. most_units: of the largest source."""
    if "h" not in units.columns:
        units = units.withColumn("h", F.lit(0).cast("long"))
    kind = dict(units.dtypes)["id"]
    unit, done = UNIT.format(kind), f"array<struct<id:{kind},size:bigint,h:bigint,take:int>>"
    level, reach, parts = 0, 1, []
    while True:
        reach *= CHUNK
        chunks = F.ceil(F.col("units") / F.lit(float(reach)))
        dealt = units.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "h", F.lit(level)), chunks))
        items = F.array_sort(F.collect_list(F.struct(F.xxhash64("id", "size", "h").alias("place"), *(F.col(c) for c in ("id", "size", "h", "w", "p")))))
        grouped = dealt.groupBy("source", "units", "chunk").agg(items.alias("items"))
        empty = F.struct(F.lit(None).cast(unit).alias("open"), F.lit(None).cast(done).alias("done"))
        empty = F.struct(empty["open"].alias("open"), F.coalesce(empty["done"], F.array().cast(done)).alias("done"))
        folded = save(grouped.select("source", "units", F.aggregate("items", empty, _pair(kind, seed, level)).alias("s")), f"fold{level}")
        parts.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.*"))
        units = folded.select("source", "units", "s.open.*")
        level += 1
        if reach >= most_units:  # one unit per source is open
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), "id", "size", "h"), 11) / F.lit(float(1 << 53))
            parts.append(units.select("source", "id", "size", "h", (draw < F.col("p")).cast("int").alias("take")))
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per distinct document: id, source, size, h (a hash of the text), n (its equal
    rows), source_size, target, whole (copies that each of them has), extra (how many of
    them have one more)."""
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))
    units = save(rows.groupBy("id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "units")
    goals = save(targets(units, share, most), "targets")
    biggest = goals.agg(F.max("units")).first()[0] or 1
    with_goal = units.join(goals, units["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    owed = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    with_goal = with_goal.withColumn("owed", owed).withColumn("whole", F.floor("owed"))
    # of n equal rows so many have one more for certain; at most one is left to the draw
    due = F.when(F.col("size") > 0, (F.col("owed") - F.col("whole")) * F.col("n")).otherwise(F.lit(0.0))
    with_goal = with_goal.withColumn("due", due).withColumn("sure", F.least(F.floor("due"), F.col("n"))).withColumn("p", F.least(F.lit(1.0), F.col("due") - F.col("sure")))
    open_ = with_goal.where("p > 0 and sure < n").select("source", "units", "id", "size", "h", F.col("size").cast("double").alias("w"), "p")
    taken = round_together(open_, biggest)
    a, b = with_goal.alias("a"), taken.alias("b")
    same = F.lit(True)
    for c in ("id", "source", "size", "h"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    extra = F.col("a.sure") + F.coalesce("b.take", F.lit(0))
    return a.join(b, same, "left").select(*(F.col(f"a.{c}") for c in ("id", "source", "size", "h", "n", "source_size", "target", "whole")), extra.alias("extra"))


def _each(n: Column) -> Column:
    """1 to n in runs of ``RUN``, as (first, last): a unit of very many rows is dealt out
    before it is spread."""
    runs = F.sequence(F.lit(1).cast("long"), F.ceil(n / F.lit(float(RUN))).cast("long"))
    return F.transform(runs, lambda i: F.struct(((i - 1) * RUN + 1).alias("first"), F.least(i * RUN, n).alias("last")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies."""
    plan = save(planned(docs, id_col, text_col, source_col, share, most), "plan")
    once = plan.where("n = 1").withColumn("i", F.lit(1).cast("long"))
    runs = plan.where("n > 1").withColumn("run", F.explode(_each(F.col("n"))))
    many = runs.repartition(F.xxhash64("id", "source", "h", "run")).withColumn("i", F.explode(F.sequence("run.first", "run.last"))).select(*once.columns)
    times = F.col("whole") + (F.col("i") <= F.col("extra")).cast("long")
    return once.unionByName(many).select("id", "source", "size", "source_size", "target", times.cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes."""
    return copies(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix: each row as often as it is taken. Documents without
    words weigh nothing and stay once."""
    plan = save(planned(docs, id_col, text_col, source_col, share, most), "plan")
    sized = lambda p: F.broadcast(p) if p.count() <= BROADCAST_ROWS else p.hint("merge")
    keys = ("p_id", "p_source", "p_size", "p_hash", "p_whole", "p_extra", "number", "part", "row", "copy")
    n = dict(zip(keys, fresh(docs, *keys)))
    text = F.col(quoted(text_col))
    known = docs.withColumns({n["p_size"]: word_count(text), n["p_hash"]: F.xxhash64(text)})

    def met(p: DataFrame, more: list[Column]) -> DataFrame:
        p = sized(p.select(F.col("id").alias(n["p_id"]), F.col("source").alias(n["p_source"]), F.col("size").alias("s"), F.col("h").alias("t"), F.col("whole").alias(n["p_whole"]), F.col("extra").alias(n["p_extra"])))
        same = F.col(quoted(id_col)).eqNullSafe(p[n["p_id"]]) & F.col(quoted(source_col)).eqNullSafe(p[n["p_source"]]) & (known[n["p_size"]] == p["s"]) & (known[n["p_hash"]] == p["t"])
        return known.join(p, same).select(*(known[quoted(c)] for c in known.columns), n["p_whole"], n["p_extra"], *more)

    def taken(rows: DataFrame, number: Column) -> DataFrame:
        times = F.when(F.col(n["p_size"]) == 0, F.lit(1)).otherwise(F.col(n["p_whole"]) + (number <= F.col(n["p_extra"])).cast("long"))
        rows = rows.withColumn(n["copy"], times.cast("long")).where(F.col(n["copy"]) > 0)
        return rows.withColumn(n["row"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(n["copy"])))).select(*columns_of(docs))

    single = taken(met(plan.where("n = 1 or extra = 0 or extra = n"), []), F.lit(1))
    some = plan.where("n > 1 and extra > 0 and extra < n")
    if some.isEmpty():
        return single
    # equal documents of which some are taken once more: numbered by a hash of the whole row,
    # inside parts of a bounded number, and then over the parts
    numbered = save(met(some, [F.struct(F.pmod(F.xxhash64(*columns_of(docs)), F.lit(64)).alias("a"), F.spark_partition_id().alias("b")).alias(n["part"])]), "equal")
    unit = [F.xxhash64(F.col(quoted(id_col)), F.col(quoted(source_col))), F.col(n["p_size"]), F.col(n["p_hash"])]
    inside = F.row_number().over(Window.partitionBy(*unit, n["part"]).orderBy(F.xxhash64(*columns_of(docs))))
    counts = numbered.groupBy(*(u.alias(f"u{i}") for i, u in enumerate(unit)), F.col(n["part"]).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("u0", "u1", "u2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("u0", "u1", "u2", F.col("part").alias("of"), before.alias("shift"))
    shift, place = fresh(numbered, "shift", "place")
    shifts = shifts.withColumnRenamed("shift", shift)
    rows = numbered.withColumn(place, inside)
    rows = rows.join(shifts, (unit[0] == shifts["u0"]) & (unit[1] == shifts["u1"]) & (unit[2] == shifts["u2"]) & (F.col(n["part"]) == shifts["of"]))
    return single.unionByName(taken(rows, F.col(place) + F.col(shift)))
