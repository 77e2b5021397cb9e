"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

A source's share of the mix is its target: water-filling of the weights under a limit of repeats. Over training time t in
[0, 1] the source is demanded at the rate target * (1 + tilt * (2t - 1)), whose integral is its cumulative demand; the
place of a document in its source's cumulative tokens, put through the inverse of that demand, is its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, drop, sheltered, table

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so a document, is taken so often at most.
REPEATS = 3
#: Slopes of the weight schedules by source, repeating: the first weighs more and more, the last less and less.
TILTS = (0.5, 0.0, -0.5)
#: Documents of a source are dealt to 2**BUCKET_BITS ranges of their hash, so that running sums split within a source.
BUCKET_BITS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target, place): sums of the budget by weight, none above repeats times its size.

    The budget is the sum of all sizes. A source is full when the level, budget words per unit of weight, reaches its
    limit over its weight; sources fill in the order of that ratio. In this order source k is full if the rest of the
    budget, shared by the weights from k on, gives it its limit: running sums over one row per source, no rounds. Only
    sources with words take a share; if all are empty every target is 0.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", w).withColumn("most", (F.col("source_size") * repeats).cast("double"))
    by = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = named.withColumn("level", left / F.sum("weight").over(onward)).withColumn("full", F.col("weight") * F.col("level") >= F.col("most"))
    # full sources come first in this order; the level of the first that is not full holds for the rest
    final = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(every)["level"]
    return level.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * final)).select("source", "source_size", "target", "place")


def inverse_demand(share: Column, tilt: Column) -> Column:
    """t with (1 - tilt) t + tilt t^2 = share: the inverse of the integral of 1 + tilt * (2t - 1), for |tilt| < 1."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(F.abs((root - (1 - tilt)) / (2 * tilt)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, tilts: tuple[float, ...] = TILTS, key: list[Column] | None = None) -> DataFrame:
    """docs(doc_id, size, source, ...) with source_size, target, copies, taken and positions, the training time of each copy.

    A source's documents stand in the order of a hash of doc_id and size, its running words filling it epoch by epoch:
    with e whole epochs in the target, every document is taken e times, and once more if the middle of its words lies
    within the words still lacking. The words taken differ from the target by half of one document at most. Copy j of a
    document at the running word c has the cumulative demand j * source_size + c, and its position is the inverse of the
    source's demand there. Null sources form one source; documents of size 0 have no copies; rows of equal order share
    a bucket and are put in order by their other columns; no row is lost. Running sums are taken within ranges of the
    hash and shifted by the sums of the ranges before, so a source of any size splits over 2**BUCKET_BITS tasks.
    """
    # null-safe keys
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))
    keyed = docs.withColumn("_order", h).withColumn("_bucket", F.conv(F.substring("_order", 1, BUCKET_BITS // 4), 16, 10).cast("int")).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sums = cut(keyed.groupBy("_source", "source", "_bucket").agg(F.sum("size").cast("long").alias("words")), "sums")
    shares = targets(sums.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, repeats)
    shares = cut(shares.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "shares")
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).cast("long").alias("_start"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", *(key or [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long")).join(starts, ["_source", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_start"))
    tilt = F.element_at(F.array(*(F.lit(float(x)) for x in tilts)), (F.pmod("place", F.lit(len(tilts))) + 1).cast("int"))
    full = placed.join(shares.select("_source", "source_size", "target", "place"), "_source")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    lack = F.col("target") - F.col("_whole") * F.col("source_size")
    full = full.withColumn("_whole", whole).withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + F.when(F.col("_at") + F.col("size") / 2 < lack, 1).otherwise(0)).otherwise(F.lit(0)).cast("int"))
    share = lambda j: F.least(F.lit(1.0), (j * F.col("source_size") + F.col("_at")) / F.col("target"))
    spots = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda j: inverse_demand(share(j), tilt))).otherwise(F.array().cast("array<double>"))
    return full.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).withColumn("positions", spots).drop("_order", "_bucket", "_source", "_before", "_start", "_at", "_whole", "place")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of them, range-sorted by their first training position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("size"), "source")
    out = mix(cut(docs, "sizes"))
    position = F.get("positions", F.lit(0))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(position, 9).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as it is taken; columns as they came."""
    # the text joins again by row, so that no window or sort of the mix moves it
    plain, names = sheltered(docs, "doc_id", "text", "source")
    rows = plain.withColumn("_row", F.monotonically_increasing_id())
    sizes = cut(rows.select("_row", "doc_id", words(F.col("text")).alias("size"), "source"), "sizes")
    order = mix(sizes, key=[F.col("_row")]).select("_row", F.explode("positions").alias("_position"))
    return rows.join(order, "_row").orderBy("_position", "_row").select(*(F.col(names[c]).alias(c) for c in docs.columns))


OP10_SQL = r"""
with recursive d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(concat_ws('|', coalesce(cast(doc_id as varchar), 'null'), cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as varchar))) as h
  from documents),
s as (select source, sum(size) as n, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select source, cast(n as bigint) as n, place, 3.0 * n as most, case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as weight from s),
o as (select *, row_number() over (order by most / weight, place) as k from w),
l as (select a.*, (select sum(n) from w) - coalesce((select sum(b.most) from o b where b.k < a.k), 0) as rest, (select sum(b.weight) from o b where b.k >= a.k) as weights from o a),
f as (select *, weight * rest / weights >= most as whole from l),
t as (select source, n, place, case when whole then cast(most as double) else cast(weight as double) * (select cast(rest as double) / cast(weights as double) from f where not whole order by k limit 1) end as target from f),
x as (select d.*, t.n, t.place, t.target, coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0) as ofs
      from d join t on d.source is not distinct from t.source),
c as (select *, case when size = 0 then 0 else floor(target / n) + case when ofs + size / 2.0 < target - floor(target / n) * n then 1 else 0 end end as copies,
             case place % 3 when 0 then 0.5 when 1 then 0.0 else -0.5 end as tilt, least(1.0, cast(ofs as double) / target) as share from x)
select doc_id, size, n as source_size, round(target, 6) as target, cast(size * copies as bigint) as taken,
       case when copies >= 1 then round(case when tilt = 0 then share else abs((sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt)) end, 9) end as position
from c
"""
