"""Grid, map and network queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluxframe import vocab
from fluxframe.functions import geo
from fluxframe.functions.scalars import date_number, timestamp_to_int
from fluxframe.operators import mapping, nearest, network, samples, spatial
from fluxframe.queries.registry import ON_THE_MAP, customers_on_the_map, events, query, rounded
from fluxframe.sources.tables import table


@query("""
select event_id, round(x + 180 - 360 * floor((x + 180) / 360) - 180, 6) as lon from (
  select event_id, value * 3 - 200 as x from events)""")
def lon_wrap(spark, folder):
    return events(spark, folder).select(
        "event_id", F.round(geo.wrap_longitude(F.col("value") * 3 - 200), 6).alias("lon"))


@query("""
select o_orderkey, 90 - r * 0.25e0 - 0.25e0 as lat_min, 90 - r * 0.25e0 as lat_max, -180 + c * 0.25e0 as lon_min,
  -180 + c * 0.25e0 + 0.25e0 as lon_max, cast(round_even((90 - r * 0.25e0 - 0.25e0) * 4, 0) as integer) as lat_key from (
  select o_orderkey, o_orderkey % 720 as r, o_custkey % 1440 as c from orders)""")
def cell_bounds(spark, folder):
    edges = geo.cell_bounds(F.col("o_orderkey") % 720, F.col("o_custkey") % 1440)
    return table(spark, folder, "orders").select(
        "o_orderkey", *[v.alias(k) for k, v in edges.items()], geo.cell_key(edges["lat_min"]).alias("lat_key"))


_RX = "[" + ", ".join(f"{v}e0" for v in vocab.ROBINSON_X) + "]"
_RY = "[" + ", ".join(f"{v}e0" for v in vocab.ROBINSON_Y) + "]"
_ROBINSON = f"""(select coord_id, c_mktsegment, lon, lat,
  0.8487e0 * ({_RX}[b + 1] + f * ({_RX}[b + 2] - {_RX}[b + 1])) * radians(lon) as x,
  1.3523e0 * ({_RY}[b + 1] + f * ({_RY}[b + 2] - {_RY}[b + 1])) * sign(lat) as y from (
  select *, (abs(lat) - b * 5.0e0) / 5.0e0 as f from (
    select *, cast(least(floor(abs(lat) / 5), 17) as int) as b from {ON_THE_MAP})))"""


@query(f"select coord_id, round(x, 6) as x, round(y, 6) as y from {_ROBINSON}")
def robinson_xy(spark, folder):
    x, y = geo.robinson(F.col("lon"), F.col("lat"))
    return customers_on_the_map(spark, folder).select(
        "coord_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_W, _H = 2 * 0.8487 * math.pi, 2 * 1.3523
_S = min(1703 / _W, 910 / _H)


@query(f"""
select cast(round_even({72 + (1703 - _W * _S) / 2!r} + (x + {_W / 2!r}) * {_S!r}, 0) as integer) as px,
  cast(round_even({20 + (910 - _H * _S) / 2!r} + (1.3523e0 - y) * {_S!r}, 0) as integer) as py,
  c_mktsegment as label, count(*) as n from {_ROBINSON} group by all""")
def pixel_bins(spark, folder):
    frame = geo.MapFrame.fit("robinson", 72.0, 20.0, 1775.0, 930.0)
    return spatial.pixel_bins(customers_on_the_map(spark, folder), frame, label="c_mktsegment")


@query(f"""
with tiles as (select * from (select unnest(range(-180, 180, 30)) as west), (select unnest(range(-90, 90, 30)) as south)),
hits as (select cast(-180 + 30 * floor((lon + 180) / 30) as integer) as west,
           cast(-90 + 30 * floor((lat + 90) / 30) as integer) as south, count(*) as n from {ON_THE_MAP} group by all)
select cast(t.west as integer) as west, cast(t.south as integer) as south, cast(t.west + 30 as integer) as east,
  cast(t.south + 30 as integer) as north, coalesce(n, 0) as n from tiles t left join hits h on h.west = t.west and h.south = t.south""")
def tile_grid(spark, folder):
    places = customers_on_the_map(spark, folder)
    hits = places.groupBy(geo.tile_origin(F.col("lon"), -180, 30).alias("west"),
                          geo.tile_origin(F.col("lat"), -90, 30).alias("south")).agg(F.count("*").alias("n"))
    joined = spatial.tile_grid(spark, 30).join(hits, ["west", "south"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


_CELLS = """(select p_size as lat, cast(replace(p_brand, 'Brand#', '') as integer) as lon, min(p_partkey % 10) / 10.0e0 as lsm
  from part group by all)"""


def _cells(spark, folder):
    return table(spark, folder, "part").groupBy(
        F.col("p_size").alias("lat"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("lon")).agg(
        (F.min(F.col("p_partkey") % 10) / 10.0).alias("lsm"))


@query(f"""
with cells as {_CELLS},
placed as (select *, dense_rank() over (order by lat) as i, dense_rank() over (order by lon) as j from cells),
offsets as (select a, b from (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b) where a != 0 or b != 0),
votes as (select i + a as i, j + b as j, count(*) as n from placed, offsets where lsm > 0.5 group by all),
counted as (select p.*, coalesce(v.n, 0) as neighbours from placed p left join votes v on v.i = p.i and v.j = p.j)
select lat, lon, lsm, lsm > 0.5 as land, neighbours from counted where lsm > 0.5 or neighbours > 0""")
def stencil_neighbours(spark, folder):
    return spatial.land_or_coast(_cells(spark, folder)).select("lat", "lon", "lsm", "land", "neighbours")


@query(f"""
with r as (select n_nationkey // 5 as row, n_nationkey % 5 as col, n_regionkey as code from nation),
p as (select coord_id, lat, lon,
  cast(least(greatest(floor((90 - lat) / 36), 0), 4) as int) as r1, cast(least(greatest(floor((lon + 180) / 36), 0), 4) as int) as c1,
  cast(least(greatest(floor((90 - lat - 18) / 36 + 0.5), 0), 4) as int) as r2,
  cast(least(greatest(floor((lon + 180 - 18) / 36 + 0.5), 0), 4) as int) as c2 from {ON_THE_MAP})
select coord_id, a.code as inside, b.code as nearest from p join r a on a.row = r1 and a.col = c1 join r b on b.row = r2 and b.col = c2""")
def nearest_cell(spark, folder):
    key = F.col("n_nationkey")
    raster = table(spark, folder, "nation").select(
        F.floor(key / 5).cast("int").alias("row"), (key % 5).alias("col"), F.col("n_regionkey").alias("code"))
    places = customers_on_the_map(spark, folder).select("coord_id", "lat", "lon")
    frame = (-180.0, 90.0, 36.0, 5, 5)
    inside = spatial.sample_raster(places, raster, "lat", "lon", *frame).withColumnRenamed("code", "inside")
    both = spatial.sample_raster(inside, raster, "lat", "lon", *frame, nearest_centre=True)
    return both.select("coord_id", "inside", F.col("code").alias("nearest"))


@query(f"""
select lat, cast(lon as varchar) as lon, lsm from {_CELLS} where lon between 1 and 25""")
def matrix_and_back(spark, folder):
    wide = spatial.to_matrix(_cells(spark, folder), "lat", "lon", "lsm", range(1, 26))
    return spatial.from_matrix(wide, "lat", "lon", "lsm")


_MASK = """(select p_size - 1 as gx, cast(replace(p_brand, 'Brand#', '') as integer) - 1 as gy,
  avg(p_retailprice) as v from part group by all)"""


@query(f"""
with g as {_MASK},
p as (select c_custkey, 1 + c_nationkey * 2 + abs(c_acctbal) / 10000 as x, 1 + abs(c_acctbal) / 9998 * 25 as y from customer),
f as (select *, x - 1 as fx, (y - 1) / 1 as fy from p),
q as (select *, cast(least(floor(fx), 48) as int) as ix, cast(least(floor(fy), 23) as int) as iy from f
      where fx between 0 and 49 and fy between 0 and 24),
w as (select q.c_custkey, sum(case when a = 0 then 1 - (fx - ix) else fx - ix end * case when b = 0 then 1 - (fy - iy) else fy - iy end * g.v) as s,
        count(g.v) as n from q, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b), g
      where g.gx = q.ix + a and g.gy = q.iy + b group by q.c_custkey)
select p.c_custkey, round(case when n = 4 then s end, 4) as value from p left join w on w.c_custkey = p.c_custkey""")
def bilinear_resample(spark, folder):
    grid = table(spark, folder, "part").groupBy(
        (F.col("p_size") - 1).alias("gx"), (F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1).alias("gy")).agg(
        F.avg("p_retailprice").alias("v"))
    size = F.abs("c_acctbal")
    points = table(spark, folder, "customer").select(
        "c_custkey", (1 + F.col("c_nationkey") * 2 + size / 10000).alias("x"), (1 + size / 9998 * 25).alias("y"))
    found = spatial.bilinear(points, grid, "x", "y", "v", (1.0, 1.0), (1.0, 1.0), (50, 25), ["c_custkey"], "value")
    return rounded(found.select("c_custkey", "value"), 4, "value")


@query(f"""
with named as (select case when c_nationkey % 4 = 0 then 'NULL' when c_nationkey % 4 = 1 then 'CRO' when c_nationkey % 4 = 2
  then 'GRA' else 'ENF' end as label from customer)
select label, count(*) as n, case label when 'NULL' then '#8F9693' when 'GRA' then '#FDBF6F' else '#006837' end as colour,
  case label when 'NULL' then 'Changed region' when 'GRA' then 'Grasslands' else 'Evergreen needleleaf forest' end as name
from named where label != 'CRO' group by label""")
def map_legend(spark, folder):
    kind = F.col("c_nationkey") % 4
    label = F.when(kind == 1, "CRO").when(kind == 2, "GRA").when(kind == 3, "ENF")
    return spatial.legend(customers_on_the_map(spark, folder).withColumn("igbp", label))


@query(None)
def score_network(spark, folder):
    """Windows of events with an image per day, scored by the network. The
    forward pass has no SQL form; tests compare it with a plain computation."""
    facts = events(spark, folder).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("coord_id"),
        F.col("ts").alias("timestamp"), (F.col("value") / 500 - 0.5).alias("TA"),
        F.when(F.col("event_type") != "error", F.dayofyear("ts") / 183.0 - 1).alias("DOY"))
    dim = customers_on_the_map(spark, folder).select(
        "coord_id", "lat", "lon", F.lit(100.0).alias("elev"), F.lit("GRA").alias("igbp"))
    days = events(spark, folder).where("event_type = 'purchase'").select(
        F.col("user_id").alias("coord_id"), date_number(F.col("ts")).alias("modis_date"),
        (F.col("event_id") % 500).alias("vec_id")).groupBy("coord_id", "modis_date").agg(F.min("vec_id").alias("vec_id"))
    tiles = table(spark, folder, "embeddings").select(
        "vec_id", F.flatten(F.array_repeat("embedding", vocab.CHANNELS)).alias("data"))
    images = days.join(tiles, "vec_id").drop("vec_id")
    cfg = network.NetConfig(predictors=("DOY", "TA"), targets=("NEE", "GPP_DT"), length=16, width=32,
                            frequencies=6, embedding=8, heads=4, layers="wcs")
    built = samples.grid_samples(facts, dim, cfg.length, cfg.predictors, images)
    built = built.withColumn("timestamp", timestamp_to_int(F.col("timestamp")))
    return network.score(built, network.init_weights(cfg), cfg, ["id", "coord_id", "timestamp"])


#: Parts as sites without any grid: a few crowded stretches, many sites of one place.
_SITES = """(select p_partkey, p_type, p_size * 7.0e0 - 170.0e0 + (p_partkey % 97) * 0.01e0 as lon,
  (p_retailprice - 100.0e0 * floor(p_retailprice / 100.0e0)) * 1.7e0 - 85.0e0 as lat from part)"""


def _sites(spark, folder):
    price = F.col("p_retailprice").cast("double")
    return table(spark, folder, "part").select(
        "p_partkey", "p_type", (F.col("p_size") * 7.0 - 170.0 + (F.col("p_partkey") % 97) * 0.01).alias("lon"),
        ((price - 100.0 * F.floor(price / 100.0)) * 1.7 - 85.0).alias("lat"))


@query(f"""
select coord_id, p_partkey as nearest, round(sqrt(d2), 6) as distance from (
  select coord_id, p_partkey, d2, row_number() over (partition by coord_id order by d2, p_partkey) as rank from (
    select c.coord_id, s.p_partkey, (s.lon - c.lon) * (s.lon - c.lon) + (s.lat - c.lat) * (s.lat - c.lat) as d2
    from {ON_THE_MAP} c cross join {_SITES} s))
where rank = 1""")
def nearest_point(spark, folder):
    found = nearest.nearest_site(customers_on_the_map(spark, folder), _sites(spark, folder), "p_partkey")
    return rounded(found.select("coord_id", "nearest", "distance"), 6, "distance")


@query(f"""
select p_type, count(*) as n, round(max(distance), 6) as furthest from (
  select e.event_id, min_by(s.p_type, struct_pack(d := (s.lon - e.lon) * (s.lon - e.lon) + (s.lat - e.lat) * (s.lat - e.lat), k := p_partkey)) as p_type,
    sqrt(min((s.lon - e.lon) * (s.lon - e.lon) + (s.lat - e.lat) * (s.lat - e.lat))) as distance
  from (select event_id, value * 3.0e0 - 180.0e0 as lon, value - 60.0e0 as lat from events) e cross join {_SITES} s
  group by e.event_id) group by p_type""")
def class_of_nearest(spark, folder):
    """Events take the class of the nearest site, as places take that of the nearest irregular raster centre."""
    places = events(spark, folder).select("event_id", (F.col("value") * 3.0 - 180.0).alias("lon"), (F.col("value") - 60.0).alias("lat"))
    sites = _sites(spark, folder)
    found = nearest.nearest_site(places, sites, "p_partkey")
    classed = found.join(sites.select(F.col("p_partkey").alias("nearest"), "p_type"), "nearest")
    return rounded(classed.groupBy("p_type").agg(F.count("*").alias("n"), F.max("distance").alias("furthest")), 6, "furthest")


_VIEW = (300.0, 200.0, 1200.0, 500.0)
_PLATE = geo.MapFrame.fit("plate", 0.0, 0.0, 1440.0, 720.0)


@query(f"""
with placed as (
  select c_nationkey, coord_id, lon * 4.0e0 + 720.0e0 as x1, 360.0e0 - lat * 4.0e0 as y1 from {ON_THE_MAP}),
pairs as (
  select *, lag(x1) over w as x0, lag(y1) over w as y0 from placed window w as (partition by c_nationkey order by coord_id)),
cut as (
  select *, x1 - x0 as dx, y1 - y0 as dy,
    greatest(0, case when x0 > x1 then (1200.0e0 - x0) / (x1 - x0) when x1 > x0 then (300.0e0 - x0) / (x1 - x0) when x0 < 300 or x0 > 1200 then 2.0e0 else 0.0e0 end,
                case when y0 > y1 then (500.0e0 - y0) / (y1 - y0) when y1 > y0 then (200.0e0 - y0) / (y1 - y0) when y0 < 200 or y0 > 500 then 2.0e0 else 0.0e0 end) as a,
    least(1, case when x0 > x1 then (300.0e0 - x0) / (x1 - x0) when x1 > x0 then (1200.0e0 - x0) / (x1 - x0) else 1.0e0 end,
             case when y0 > y1 then (200.0e0 - y0) / (y1 - y0) when y1 > y0 then (500.0e0 - y0) / (y1 - y0) else 1.0e0 end) as b
  from pairs where x0 is not null),
steps as (
  select *, cast(greatest(ceil(greatest(abs(dx), abs(dy)) * (b - a)), 1) as int) as n from cut where a <= b),
walked as (
  select *, a + (b - a) * k / n as t from (select *, unnest(range(0, n + 1)) as k from steps))
select distinct cast(round_even(x0 + dx * t, 0) as int) as px, cast(round_even(y0 + dy * t, 0) as int) as py from walked""")
def map_lines(spark, folder):
    """Lines through the customers of each nation, clipped to a part of the map."""
    return mapping.line_pixels(customers_on_the_map(spark, folder), _PLATE, _VIEW, ["c_nationkey"], ["coord_id"])


@query(f"""
with points as (
  select cast(round_even(lon * 4.0e0 + 720.0e0, 0) as int) as px, cast(round_even(360.0e0 - lat * 4.0e0, 0) as int) as py,
    case c_nationkey % 5 when 0 then 'ENF' when 1 then 'EBF' when 2 then 'XYZ' when 3 then 'CRO' end as label from {ON_THE_MAP}),
ranked as (
  select px + a as px, py + b as py, coalesce(label, 'NULL') as label,
    case label when 'ENF' then 1 when 'EBF' then 2 when 'XYZ' then 3 else 4 end as rank
  from (select * from points where label is distinct from 'CRO') cross join (select unnest(range(-1, 2)) as a) cross join (select unnest(range(-1, 2)) as b))
select px, py, arg_max(label, rank) as label from ranked group by px, py""")
def map_points(spark, folder):
    """Square points of three pixels, the class drawn last on top; a hidden class is not drawn."""
    label = F.element_at(F.array(*[F.lit(c) for c in ("ENF", "EBF", "XYZ", "CRO", None)]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return mapping.point_pixels(customers_on_the_map(spark, folder).withColumn("igbp", label), _PLATE, mapping.square(3))
