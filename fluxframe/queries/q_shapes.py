"""Columns chosen by name or content, band stacks, tiles, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe import schema, vocab
from fluxframe.functions import arrays, text
from fluxframe.operators import spatial
from fluxframe.plans.ingest import RasterFrame, build_dataset
from fluxframe.queries.registry import ON_THE_MAP, customers_on_the_map, query
from fluxframe.sources.tables import latest_checkpoint, table


@query("""
select l_orderkey, l_linenumber, l_extendedprice as pred_NEE, l_quantity as pred_LE from lineitem""")
def target_selection(spark, folder):
    scored = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("pred_LE"), F.col("l_discount").alias("pred_H"),
        F.col("l_extendedprice").alias("pred_NEE"))
    return scored.select("l_orderkey", "l_linenumber", *text.pick_targets(scored.columns, ["NEE,pred_LE", "NEE"]))


@query("""
select o_orderkey, case when o_orderkey % 5 = 0 then o_totalprice end as some from orders""")
def empty_columns(spark, folder):
    sparse = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice")).alias("some"),
        F.when(F.col("o_orderkey") < 0, 1.0).alias("none"))
    return schema.drop_empty(sparse, ["some", "none"])


@query("""
select 0 as place, 'o_totalprice' as name, count(o_totalprice) as present from orders
union all select 1, 'o_custkey', count(o_custkey) from orders
union all select 2, 'o_orderkey', count(o_orderkey) from orders
union all select 3, 'o_orderstatus', count(o_orderstatus) from orders""")
def preferred_columns(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    names = text.preferred_first(orders.columns, ["o_totalprice", "absent", "o_custkey"])
    rows = [F.struct(F.lit(n).alias("place"), F.lit(c).alias("name"), F.count(c).alias("present"))
            for n, c in enumerate(names)]
    return orders.agg(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("""
with e as (select vec_id, [cast(round(cast(x as double) * 40000) as bigint) for x in embedding] as a from embeddings),
c as (select vec_id,
  list_sum([cast(cast(case when x < 0 or x > 30000 then -1 else least(x, 10000) / 10000.0e0 end as float) as double) for x in a]) as refl,
  list_sum([case when x <= 1 then x else -1 end for x in [floor(y / 1000) for y in a]]) as snow,
  list_sum([case when x between 0 and 7 then [1, 0, 0, 1, 1, 1, 1, 1][cast(x as int) + 1] else 1 end for x in [floor(y / 1000) for y in a]]) as water
  from e)
select vec_id, 576 as pixels, round(7 * refl + snow + water, 3) as total, round(refl, 4) as seventh, cast(water as double) as last from c""")
def band_stack(spark, folder):
    """Seven reflectance bands, snow and water become one tensor."""
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 40000).cast("long"))
    coarse = F.transform(whole, lambda x: F.floor(x / 1000))
    stack = table(spark, folder, "embeddings").select(
        "vec_id", arrays.image_tensor(F.array_repeat(whole, 7), F.array(coarse, coarse)).alias("t"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stack.select("vec_id", F.size("t").alias("pixels"), F.round(total(F.col("t")), 3).alias("total"),
                        F.round(total(arrays.channel(F.col("t"), 6)), 4).alias("seventh"),
                        total(arrays.channel(F.col("t"), 8)).alias("last"))


@query("""
select vec_id, c as cell, embedding[c * 4 + 1] as first_pixel, embedding[48 + c * 4 + 4] as last_pixel,
  round(list_sum([cast(embedding[(j // 4) * 16 + c * 4 + j % 4 + 1] as double) for j in range(16)]), 5) as total
from embeddings, (select unnest([0, 1, 2, 3]) as c)""")
def strip_cells(spark, folder):
    """A strip of four tiles, four pixels wide and high, cut into the tiles."""
    tiles = arrays.cells_of_strip(F.col("embedding"), rows=4, width=4, columns=4)
    cells = table(spark, folder, "embeddings").select("vec_id", F.posexplode(tiles).alias("cell", "p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return cells.select("vec_id", "cell", F.col("p")[0].alias("first_pixel"), F.col("p")[15].alias("last_pixel"),
                        F.round(total, 5).alias("total"))


@query(f"""
with loc as {ON_THE_MAP},
points as (select coord_id as feature, 0 as ring, p as position, round(lon, 2) + p as lon, round(lat, 2) - p as lat
  from loc, (select unnest([0, 1, 2]) as p) where c_mktsegment <> 'BUILDING'
  union all select coord_id, 1, 0, round(lat, 2) + 0.0e0, round(lon, 2) + 0.0e0 from loc where c_mktsegment = 'MACHINERY')
select * from points""")
def outline_points(spark, folder):
    """Outlines of polygons and, for one segment, of several polygons each."""
    at = customers_on_the_map(spark, folder).withColumns({"x": F.round("lon", 2), "y": F.round("lat", 2)})
    ring = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(
        F.lit("["), (F.col("x") + p).cast("string"), F.lit(","), (F.col("y") - p).cast("string"), F.lit("]"))
        for p in range(3)]), F.lit("]"))
    second = F.concat(F.lit("[["), F.col("y").cast("string"), F.lit(","), F.col("x").cast("string"), F.lit("]]"))
    several = F.col("c_mktsegment") == "MACHINERY"
    features = at.select(
        F.col("coord_id").alias("feature"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Antarctica").alias("name"),
        F.when(several, "MultiPolygon").otherwise("Polygon").alias("kind"),
        F.when(several, F.concat(F.lit("[["), ring, F.lit("],["), second, F.lit("]]")))
        .otherwise(F.concat(F.lit("["), ring, F.lit("]"))).alias("coordinates"))
    return spatial.outline_rings(features)


@query("""
select case when count(*) filter (where event_type = 'error') > 0 then 'run/last.pth' end as path from events""")
def best_checkpoint_last(spark, folder):
    leaf = F.when(F.col("event_type") == "error", F.lit("last.pth")).otherwise(
        F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string"), F.lit(".pth")))
    return latest_checkpoint(table(spark, folder, "events").select(F.concat(F.lit("run/"), leaf).alias("path")))


_INGEST_CLASSES = ", ".join(f"({k}, '{v}')" for k, v in vocab.CLASS_OF_CODE.items() if k not in vocab.CODES_EMPTY_AT_INGEST)


@query(f"""
with raw as (select cast(c_custkey % 9 as double) as lat, cast(c_custkey // 9 % 19 as double) as lon, c_nationkey as hour from customer),
mask as (select p_partkey % 20 as gx, p_partkey // 20 % 10 as gy, avg(p_size) > 25 as land from part group by all),
places as (select lat, lon, min(hour) as first, count(*) as facts from raw group by all),
flagged as (select p.*, land from places p join mask on gx = lon and gy = lat),
kept as (select * from flagged f where land or exists (
  select 1 from flagged g where g.land and abs(g.lat - f.lat) <= 1 and abs(g.lon - f.lon) <= 1))
select row_number() over (order by first, lat, lon) as coord_id, lat, lon, label as igbp, facts
from kept left join (values {_INGEST_CLASSES}) c(code, label) on code = cast((8 - lat) * 5 + lon * 3 as int) % 17""")
def land_and_coast_dataset(spark, folder):
    """Customers as hourly rows of places, parts as land mask and land cover."""
    key = F.col("c_custkey")
    raw = table(spark, folder, "customer").select(
        (key % 9).cast("double").alias("lat"), (F.floor(key / 9) % 19).cast("double").alias("lon"),
        F.lit(0.0).alias("elev"), F.timestamp_add("HOUR", F.col("c_nationkey"), F.lit("2017-02-01").cast("timestamp_ntz"))
        .alias("timestamp"), F.col("c_acctbal").alias("TA"))
    part = table(spark, folder, "part")
    mask = part.groupBy((F.col("p_partkey") % 20).alias("gx"), (F.floor(F.col("p_partkey") / 20) % 10).alias("gy")).agg(
        F.when(F.avg("p_size") > 25, 1.0).otherwise(0.0).alias("lsm"))
    cover = part.select((F.col("p_partkey") % 9).cast("int").alias("row"),
                        (F.floor(F.col("p_partkey") / 9) % 19).cast("int").alias("col")).distinct()
    cover = cover.withColumn("code", ((F.col("row") * 5 + F.col("col") * 3) % 17).cast("int"))
    facts, dim = build_dataset(raw, mask, cover, RasterFrame(-0.5, 8.5, 1.0, 9, 19), (0.0, 0.0), (1.0, 1.0), (20, 10))
    counted = facts.groupBy("coord_id").agg(F.count("*").alias("facts"))
    return dim.join(counted, "coord_id").select("coord_id", "lat", "lon", "igbp", "facts")
