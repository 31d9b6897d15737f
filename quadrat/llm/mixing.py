"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.runtime import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "quadrat-mix"
#: Slices of a source, by hash, that are summed and cut apart.
SLICES = 4096
#: Where a source misses its target by a larger share, more of its documents are tried.
NEAR = 0.01
WORD = "[^\\x20\\x09-\\x0D]+"


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words, and h: 60 seeded bits that order a source's documents."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    )


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of totals (source, source_size), one row for each source.

    Sources in code-point order, null last, weigh by the repeating weights. The level at which
    targets = min(max_epochs * source_size, level * weight) sum to share of all sizes is what
    resharing the excess by weight ends at: sources by cap for each weight, those below the
    level are capped. Without any words all targets are zero.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(max_epochs))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below = filled.rowsBetween(Window.unboundedPreceding, -1)
    above = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weighed = weighed.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    # The first source that its level leaves uncapped sets the level of all after it.
    weighed = weighed.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    return weighed.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _nearest(row: DataFrame) -> DataFrame:
    """s, target, missing, least, pick, miss of each source with documents that aren't taken.

    least is the smallest of them, pick the one that best fills what is missing, miss what is off then.
    """
    missing = row.groupBy("source").agg((F.first("part") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("missing"))
    missing = missing.select(F.col("source").alias("s"), "missing")
    off = F.abs(F.col("size") - F.col("missing"))
    rest = row.filter("not fits and size > 0 and part > 0").join(missing, row.source.eqNullSafe(missing.s))
    pick = F.min(F.when(off < F.col("missing"), F.struct(off.alias("off"), "h", "doc_id", "size", "nth")))
    rest = rest.groupBy("s").agg(F.first("target").alias("target"), F.first("missing").alias("missing"), F.min("size").alias("least"), pick.alias("pick"))
    return materialize(rest.withColumn("miss", F.coalesce("pick.off", "missing")), "mix-nearest")


def _filled(row: DataFrame, short: DataFrame) -> DataFrame:
    """row after one more pass, in hash order, over the documents no larger than what is missing."""
    short = short.select("s", "missing")
    rest = row.filter("not fits and size > 0 and part > 0").join(short, row.source.eqNullSafe(short.s)).filter("size <= missing")
    # At most SLICES rows of a source.
    upto = rest.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    upto = upto.select(F.col("source").alias("t"), F.col("slice").alias("b"), (F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")).alias("before"))
    inside = Window.partitionBy("source", "slice").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.join(upto, rest.source.eqNullSafe(upto.t) & (rest.slice == upto.b)).withColumn("until", F.col("before") + F.sum("size").over(inside))
    more = rest.filter("until <= missing").select(F.col("source").alias("ms"), F.col("h").alias("mh"), F.col("nth").alias("mn"))
    both = row.join(more, row.source.eqNullSafe(more.ms) & (row.h == more.mh) & (row.nth == more.mn), "left")
    return both.withColumn("fits", F.col("fits") | F.col("mh").isNotNull()).select(*row.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, repeats, taken of every row of docs.

    docs needs doc_id, text and source; other columns are ignored. A source is repeated whole
    as often as its target holds it; the rest is a fractional repetition: its documents in
    seeded hash order as long as they fit, and then the one whose size is nearest to what is
    still missing, if that brings the sum nearer. Where this misses the target by more than
    NEAR of it, the documents that are no larger than what is missing come first, in the same
    way, as often as there are any: a long document doesn't end a source. taken is repeats * size, so it is at most
    max_epochs * size. A null text has size 0. Repeated rows count each; rows equal in doc_id
    and size are exchangeable. A null source is a source of its own. An empty table gives an
    empty result. The same rows give the same mix in any order or partitioning.
    """
    sized = materialize(_sizes(docs, seed).withColumn("slice", F.shiftright("h", 48).cast("int")), "mix-sizes")
    slices = materialize(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, max_epochs), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = targets.withColumn("whole", F.floor(ratio).cast("int")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    # At most SLICES rows of a source.
    upto = slices.withColumn("before", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")).select(F.col("source").alias("s"), F.col("slice").alias("b"), "before")
    w = whole.withColumnRenamed("source", "t")
    upto = upto.join(w, upto.s.eqNullSafe(w.t)).drop("t")
    row = sized.join(upto, sized.source.eqNullSafe(upto.s) & (sized.slice == upto.b))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size")
    row = row.withColumn("nth", F.row_number().over(inside)).withColumn("until", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    row = row.withColumn("fits", (F.col("until") <= F.col("part")) & (F.col("part") > 0))
    row = materialize(row.select("doc_id", "source", "size", "source_size", "target", "whole", "part", "slice", "h", "nth", "fits"), "mix-rows")
    near = _nearest(row)
    while not (short := near.filter(f"miss > {NEAR} * target and least <= missing")).isEmpty():
        row = materialize(_filled(row, short), "mix-rows")
        near = _nearest(row)
    near = near.filter("pick is not null").select("s", "pick.h", "pick.nth")
    near = near.select(F.col("s").alias("ps"), F.col("h").alias("ph"), F.col("nth").alias("pn"))
    done = row.join(near, row.source.eqNullSafe(near.ps) & (row.h == near.ph) & (row.nth == near.pn), "left")
    repeats = F.col("whole") + (F.col("fits") | F.col("ph").isNotNull()).cast("int")
    return done.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"), "source", "h", "nth")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix repeats it (also not at all)."""
    plan = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("rows")).filter("repeats > 0")
    plan = materialize(plan.select(F.col("doc_id").alias("pd"), F.col("source").alias("ps"), F.col("size").alias("pz"), "repeats", "rows"), "mix-plan")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("z"))
    same = F.col("d.doc_id").eqNullSafe(F.col("pd")) & F.col("d.source").eqNullSafe(F.col("ps")) & (F.col("z") == F.col("pz"))
    # Exchangeable rows share their repeats: the first of them get one more where they don't
    # divide. Where there are none, that branch would shuffle all texts for nothing.
    many = plan.filter("rows > 1")
    single = sized.join(plan.filter("rows = 1"), same).select("d", "repeats")
    if not many.isEmpty():
        turn = F.row_number().over(Window.partitionBy("pd", "ps", "pz").orderBy(F.col("d.text")))
        each = F.floor(F.col("repeats") / F.col("rows")) + (F.col("turn") <= F.col("repeats") % F.col("rows")).cast("int")
        single = single.unionByName(sized.join(many, same).withColumn("turn", turn).select("d", each.alias("repeats")))
    return single.filter("repeats > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("nth")).select(*[F.col(f"d.`{c}`") for c in docs.columns])


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 15) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight,
         source_size * CAST({MAX_EPOCHS} AS DOUBLE) AS cap FROM totals),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) * CAST({SHARE} AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM weighed),
level AS (SELECT own AS level FROM leveled WHERE own * weight <= cap ORDER BY cap / weight, own LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM leveled),
parts AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole,
         target - CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) * source_size AS part FROM targets),
running AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.part,
         row_number() OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS nth,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS until
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
fitted AS (SELECT *, until <= part AND part > 0 AS fits FROM running),
missing AS (SELECT source, any_value(part) - sum(CASE WHEN fits THEN size ELSE 0 END) AS missing FROM fitted GROUP BY source),
pick AS (
  SELECT f.source, f.nth, row_number() OVER (PARTITION BY f.source ORDER BY abs(size - missing), h, doc_id, size, nth) AS place
  FROM fitted f JOIN missing m ON f.source IS NOT DISTINCT FROM m.source
  WHERE NOT fits AND size > 0 AND part > 0 AND abs(size - missing) < missing)
SELECT f.doc_id, f.size, f.source_size, f.target,
       CAST((f.whole + CASE WHEN f.fits OR p.nth IS NOT NULL THEN 1 ELSE 0 END) * f.size AS BIGINT) AS taken
FROM fitted f LEFT JOIN pick p ON p.place = 1 AND f.source IS NOT DISTINCT FROM p.source AND f.nth = p.nth
"""
