"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order, null last, carry the weights in turn; all of them share `share` times the
corpus; no source goes above `limit` times its own size, and what that cuts off is shared again by weight.

Rates: per source, the document rates closest in relative entropy to one copy each that meet the token
constraint are r = min(limit, exp(lambda * size / largest size)). The convex dual is solved by safeguarded
Newton steps on log(sum r * size) = log(target), all sources at once: each step is one aggregate over the exact
histogram of (source, size), and the multipliers stay in a table, so nothing that grows with the number of
sources or documents reaches the driver.

Copies: floor(r), and one more for the documents first in order of u / fraction(r), u a hash of the document and
of its place among equal rows, until the source's missing words are met; the cut-off is found from a histogram of
1024 cells a source, and only rows of the cell that holds it are ordered; last, the left-out document whose size
comes closest to the words still missing is taken.

Defined results: null text has size 0; documents of size 0 take no words; a source of size 0 has target 0; a
null source is a source of its own, last in order; rows of one source, doc_id (null too) and size are drawn each for itself
by their place among each other; an empty table gives an empty result. Other columns are ignored by mix() and kept by
mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder, stored, table

WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 1024


def _sized(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *more)


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, sid (its place), source_size, largest, target; from rows of (source, size).

    The water-filling orders all sources in one window: they are a list of origins, hundreds or thousands, not data."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    placed = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    # Water-filling: in order of most / weight, sources are full as long as the level of the rest reaches them.
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") < F.col("most") / F.col("weight"), F.col("level"))).over(whole)
    return levels.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("weight") * water, F.col("most")))).select("source", "sid", "source_size", "largest", "target")


def _rate(limit: float):
    """Rate of a row that has lam, size, largest and full."""
    return F.when(F.col("full"), F.lit(limit)).when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(limit), F.exp(F.least(F.col("lam") * F.col("size") / F.col("largest"), F.lit(50.0)))))


def _trials():
    """The Newton point and, on the scale of asinh, 23 points inside the bracket."""
    low, high = F.asinh("low"), F.asinh("high")
    return F.array(F.col("newton"), *[F.sinh(low + (high - low) * (i / 24)) for i in range(1, 24)])


def multipliers(histogram: DataFrame, aims: DataFrame, folder: str, limit: float = 2.0, tolerance: float = 1e-7, steps: int = 60, n_sources: int | None = None) -> DataFrame:
    """The dual's solution: sid, source_size, largest, target, lam, full. histogram: sid, size, n."""
    spark = histogram.sparkSession
    smallest = histogram.where("size > 0").groupBy("sid").agg(F.min("size").alias("smallest"))
    full = F.col("target") >= F.col("source_size") * (limit * (1 - 1e-12))
    state = aims.drop("source").join(smallest, "sid", "left").select(
        "sid", "source_size", "largest", "target", full.alias("full"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"),
        F.coalesce(F.log(F.lit(limit)) * F.col("largest") / F.col("smallest"), F.lit(0.0)).alias("high"), F.lit(1e9).alias("gap"), F.lit(0.0).alias("newton"))
    state = stored(spark, state, folder, "states/0", n_sources)
    for step in range(1, steps + 1):
        # Each step tries the Newton point and points that cut the bracket geometrically; the aggregate serves them all.
        tries = state.where("not full and source_size > 0").withColumn("lam", F.explode(F.array_distinct(F.filter(_trials(), lambda x: (x > F.col("low")) & (x < F.col("high"))))))
        at = histogram.join(tries, "sid")
        rate = _rate(limit)
        words = F.col("n") * F.col("size")
        sums = at.groupBy("sid", "lam").agg(F.max("target").alias("target"), F.sum(words * rate).alias("got"), F.sum(F.when(rate < limit, words * rate * F.col("size") / F.col("largest")).otherwise(0.0)).alias("slope"))
        gap = F.log(F.greatest(F.col("got"), F.lit(1e-300)) / F.col("target"))
        best = sums.withColumn("gap", gap).groupBy("sid").agg(
            F.min_by(F.struct("lam", "gap", "got", "slope"), F.abs("gap")).alias("best"), F.max(F.when(F.col("gap") <= 0, F.col("lam"))).alias("above"), F.min(F.when(F.col("gap") >= 0, F.col("lam"))).alias("below"))
        after = state.join(best, "sid", "left")
        better = F.abs("best.gap") < F.col("gap")
        after = after.select(
            "sid", "source_size", "largest", "target", "full", F.when(better, F.col("best.lam")).otherwise(F.col("lam")).alias("lam"),
            F.when(better, F.abs("best.gap")).otherwise(F.col("gap")).alias("gap"), F.coalesce(F.greatest("low", "above"), F.col("low")).alias("low"), F.coalesce(F.least("high", "below"), F.col("high")).alias("high"),
            F.when(better, F.col("best.lam") - F.col("best.gap") * F.col("best.got") / F.col("best.slope")).otherwise(F.col("newton")).alias("newton"))
        state = stored(spark, after, folder, f"states/{step}", n_sources)
        if not state.where(f"not full and source_size > 0 and gap > {tolerance}").limit(1).count():
            break
    return state.select("sid", "source_size", "largest", "target", "lam", "full")


#: Equal rows that one task counts out, and equal rows of whole documents that are ordered together.
TOGETHER = 4096
BROADCAST_ROWS = 1_000_000


def _drawn(units: DataFrame, solution: DataFrame, limit: float) -> DataFrame:
    """Rows (sid, doc_id, size, place among equals) with rate, copies before the last, and the point p in the draw for one more."""
    keyed = units.join(solution, "sid").withColumn("rate", _rate(limit)).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "size", "place", F.lit(17)), 11) + 0.5) / float(1 << 53)
    return keyed.withColumn("p", F.when((F.col("part") > 0) & (F.col("size") > 0), u / F.col("part"))).withColumn("cell", F.floor(CELLS * F.col("p") / (1 + F.col("p"))))


def _places(groups: DataFrame) -> DataFrame:
    """One row per document: its group's columns and its place among the group's rows. Large groups are counted out by many tasks."""
    once = groups.where("rows = 1").withColumn("place", F.lit(0).cast("long"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / TOGETHER)))
    more = groups.where("rows > 1").withColumn("block", block).repartition("sid", "doc_id", "size", "block")
    last = F.least(F.col("rows"), (F.col("block") + 1) * TOGETHER) - 1
    return once.unionByName(more.withColumn("place", F.explode(F.sequence(F.col("block") * TOGETHER, last))).drop("block")).drop("rows")


def _extra() -> Column:
    """1 for what lies before the cut-off of its source; all of a source whose drawn documents together stay below it."""
    before = (F.col("cell") < F.col("cut")) | ((F.col("cell") == F.col("cut")) & (F.col("p") <= F.coalesce(F.col("upto"), F.lit(-1.0))))
    return F.when(F.col("p").isNull(), 0).when(F.col("cut").isNull() | before, 1).otherwise(0)


def _cut_offs(drawn: DataFrame, folder: str, n_sources: int) -> DataFrame:
    """sid, cut (the cell that reaches the missing words; null where none does), upto (the last p of that cell that still fits)."""
    cells = drawn.groupBy("sid", "cell").agg(F.sum("size").alias("words"), F.sum(F.col("base") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    by_cell = Window.partitionBy("sid").orderBy(F.col("cell").asc_nulls_last())
    missing = F.col("target") - F.sum("sure").over(Window.partitionBy("sid"))
    reach = cells.withColumn("missing", missing).withColumn("words", F.when(F.col("cell").isNull(), 0).otherwise(F.col("words"))).withColumn("sofar", F.sum("words").over(by_cell)).withColumn("before", F.col("sofar") - F.col("words"))
    reaches = F.when((F.col("sofar") >= F.col("missing")) & F.col("cell").isNotNull(), F.col("cell"))
    cuts = reach.groupBy("sid").agg(F.max("missing").alias("missing"), F.min(reaches).alias("cut"), F.min_by("before", reaches).alias("passed"))
    cuts = stored(drawn.sparkSession, cuts, folder, "cuts", n_sources)
    order = Window.partitionBy("sid").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    edge = drawn.join(cuts, "sid").where("cell = cut").withColumn("fits", F.col("passed") + F.sum("size").over(order) <= F.col("missing"))
    upto = edge.where("fits").groupBy("sid").agg(F.max("p").alias("upto"))
    return stored(drawn.sparkSession, cuts.join(upto, "sid", "left"), folder, "cut-offs", n_sources)


def _assign(docs: DataFrame, weights, share, limit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row of docs as (sid, doc_id, size, place) with its copies; the sources; the sources' multipliers with cut-offs and filler."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    sized = stored(spark, _sized(docs), folder, "sized")
    aims = stored(spark, targets(sized, weights, share, limit).coalesce(1), folder, "targets")
    n_sources = aims.count()
    sid = aims.select(F.col("source").alias("__source"), "sid")
    groups = stored(spark, sized.join(sid, F.col("source").eqNullSafe(F.col("__source"))).groupBy("sid", "doc_id", "size").agg(F.count("*").alias("rows")), folder, "groups")
    histogram = stored(spark, groups.groupBy("sid", "size").agg(F.sum("rows").alias("n")), folder, "histogram")
    solution = stored(spark, multipliers(histogram, aims, folder, limit, n_sources=n_sources), folder, "solution", n_sources)
    drawn = _drawn(_places(groups), solution, limit)
    cuts = _cut_offs(drawn, folder, n_sources)
    decided = stored(spark, drawn.join(cuts.select("sid", "cut", "upto", "missing"), "sid").withColumn("extra", _extra()), folder, "decided")
    # Per source the document left out whose size comes closest to the words still missing, if taking it comes nearer.
    rest = decided.groupBy("sid").agg((F.max("missing") - F.sum(F.col("extra") * F.col("size"))).alias("rest"))
    left_out = decided.where("extra = 0 and p is not null").join(rest, "sid").where("abs(rest - size) < abs(rest)")
    nearest = F.struct(F.abs(F.col("rest") - F.col("size")), "p", "doc_id", "size", "place")
    fill = stored(spark, left_out.groupBy("sid").agg(F.min_by(F.struct("doc_id", "size", "place"), nearest).alias("fill")), folder, "fill", n_sources)
    for old in ("sized", "histogram", "states", "cuts"):
        remove_folder(spark, f"{folder}/{old}")
    known = stored(spark, solution.join(cuts.select("sid", "cut", "upto"), "sid").join(fill, "sid", "left"), folder, "known", n_sources)
    rows = _filled(decided.drop("cut", "upto", "missing").join(fill, "sid", "left"))
    return rows, aims, known


def _filled(rows: DataFrame) -> DataFrame:
    """copies, from base and extra, with one more for the row that fills its source's rest."""
    fills = F.col("doc_id").eqNullSafe(F.col("fill.doc_id")) & (F.col("size") == F.col("fill.size")) & (F.col("place") == F.col("fill.place"))
    extra = F.when(F.col("fill").isNotNull() & (F.col("extra") == 0) & F.coalesce(fills, F.lit(False)), 1).otherwise(F.col("extra"))
    return rows.withColumn("copies", (F.col("base") + extra).cast("int")).drop("fill")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate."""
    return _assign(docs, weights, share, limit)[0].select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixture(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The documents themselves, each as often as its copies say, with their own columns.

    Rows that are alone with their source, doc_id and size are decided where they lie. The copies of equal ones are dealt out
    evenly over them in the order of a digest of the whole row, so files and partitions decide nothing, about TOGETHER rows
    at a time (their sum is exact up to that many rows, and beyond within one a block)."""
    rows, aims, known = _assign(docs, weights, share, limit)
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mine = _sized(docs, whole).join(aims.select(F.col("source").alias("__source"), "sid"), F.col("source").eqNullSafe(F.col("__source")))
    mine = mine.select("__row", "sid", "doc_id", "size", F.lit(0).cast("long").alias("place"))
    again = rows.where("place > 0").select("sid", "doc_id", "size").distinct()
    again = stored(spark, rows.join(again.withColumnsRenamed({"sid": "i", "doc_id": "d", "size": "n"}), _same("i", "d", "n"), "left_semi").groupBy("sid", "doc_id", "size").agg(F.count("*").alias("m"), F.sum("copies").alias("all")).withColumnsRenamed({"sid": "i", "doc_id": "d", "size": "n"}), shared_folder(spark), "again")
    n_again = again.count()
    if n_again:
        mine = mine.join(F.broadcast(again) if n_again <= BROADCAST_ROWS else again, _same("i", "d", "n"), "left")
        # Rows that agree in everything are one with a count; the others are ordered by a digest of all that they hold.
        digest = F.sha2(F.to_json("__row"), 256)
        folded = mine.where("m is not null").withColumn("key", digest).groupBy("sid", "doc_id", "size", "m", "all", "key").agg(F.first("__row").alias("__row"), F.count("*").alias("same"))
        folded = folded.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / TOGETHER)))
        order = Window.partitionBy("sid", "doc_id", "size", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        upto = lambda r: F.floor(r.cast("decimal(20,0)") * F.col("all") / F.col("m"))
        dealt = folded.withColumn("turn", F.sum("same").over(order)).withColumn("copies", upto(F.col("turn")) - upto(F.col("turn") - F.col("same")))
        # Copies are counted out by many tasks, at most TOGETHER in one.
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TOGETHER).cast("long")))
        few = dealt.where((F.col("copies") > 0) & (F.col("copies") <= TOGETHER)).withColumn("part", F.lit(0).cast("long"))
        several = few.unionByName(dealt.where(F.col("copies") > TOGETHER).withColumn("part", part).repartition("key", "part")).select("__row", F.least(F.lit(TOGETHER).cast("long"), F.col("copies") - F.col("part") * TOGETHER).cast("int").alias("copies"))
        mine = mine.where("m is null").drop("i", "d", "n", "m", "all")
    alone = _filled(_drawn(mine, known, limit).withColumn("extra", _extra())).select("__row", "copies")
    both = (alone.unionByName(several) if n_again else alone).where("copies > 0")
    return both.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")


def _same(sid: str, doc_id: str, size: str) -> Column:
    return (F.col("sid") == F.col(sid)) & F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("size") == F.col(size))


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
