"""Joins, keys, upserts, duplicates, unions, sets, cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe.functions import text
from fluxframe.functions.geo import cell_key
from fluxframe.operators import dims, merge, spatial
from fluxframe.operators.ordering import dense_order
from fluxframe.queries.registry import ON_THE_MAP, customers_on_the_map, events, query, rounded
from fluxframe.session import settle
from fluxframe.sources.rasters import pair_files
from fluxframe.sources.tables import latest_checkpoint, table

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem(spark, folder):
    return table(spark, folder, "lineitem")


@query("""
with attrs as (select c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') as segment from customer),
keys as (select row_number() over (order by min(c_custkey)) as coord_id, c_nationkey, segment
         from attrs group by c_nationkey, segment)
select a.c_custkey, k.coord_id, a.segment
from attrs a join keys k on a.c_nationkey = k.c_nationkey and a.segment is not distinct from k.segment""")
def nullsafe_attach(spark, folder):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey", segment)
    keys = dims.surrogate_keys(rows, ["c_nationkey", "segment"], "c_custkey")
    return dims.attach_keys(rows, keys, ["c_nationkey", "segment"]).select("c_custkey", "coord_id", "segment")


@query("""
with named as (select '/raw/' || strftime(ts, '%Y%m%d%H%M') ||
    case event_type when 'click' then 'A4.tiff' when 'purchase' then 'A2.tiff' else '.txt' end as path from events),
stamped as (select path, regexp_extract(path, '(\\d{12})A[24]\\.tiff$', 1) as stamp from named)
select stamp as timestamp, min(path) filter (path like '%A4.tiff') as a4_path,
       min(path) filter (path like '%A2.tiff') as a2_path
from stamped where stamp != '' group by stamp
having count(*) filter (path like '%A4.tiff') > 0 and count(*) filter (path like '%A2.tiff') > 0""")
def pair_by_key_pivot(spark, folder):
    ending = (F.when(F.col("event_type") == "click", "A4.tiff")
              .when(F.col("event_type") == "purchase", "A2.tiff").otherwise(".txt"))
    files = events(spark, folder).select(
        F.concat(F.lit("/raw/"), F.date_format("ts", "yyyyMMddHHmm"), ending).alias("path"))
    return pair_files(files)


_OLD_NEW = """
with old as (select user_id as coord_id, cast(strftime(ts, '%Y%m%d') as integer) as modis_date, max(value) as data
             from events where event_type = 'purchase' group by all),
new as (select user_id as coord_id, cast(strftime(ts, '%Y%m%d') as integer) as modis_date, min(value) as data
        from events where event_type = 'click' group by all)
"""


def _old_and_new(spark, folder):
    facts = events(spark, folder).select(
        F.col("user_id").alias("coord_id"), F.date_format("ts", "yyyyMMdd").cast("int").alias("modis_date"),
        "event_type", F.col("value").alias("data"))
    keys = ["coord_id", "modis_date"]
    old = dims.newest_per_key(facts.where("event_type = 'purchase'"), keys, ["data"], last=True)
    new = dims.newest_per_key(facts.where("event_type = 'click'"), keys, ["data"], last=False)
    return old.drop("event_type"), new.drop("event_type")


@query(_OLD_NEW + """
select * from old union all
select new.* from new anti join old using (coord_id, modis_date)""")
def upsert_ignore(spark, folder):
    return dims.upsert(*_old_and_new(spark, folder), ["coord_id", "modis_date"], overwrite=False)


@query(_OLD_NEW + """
select * from new union all
select old.* from old anti join new using (coord_id, modis_date)""")
def upsert_update(spark, folder):
    return dims.upsert(*_old_and_new(spark, folder), ["coord_id", "modis_date"], overwrite=True)


@query(_OLD_NEW + """
select new.modis_date, count(*) as matched, count(*) filter (old.coord_id is null) as written
from new left join old using (coord_id, modis_date) group by all""")
def image_write_counts(spark, folder):
    old, new = _old_and_new(spark, folder)
    return dims.write_counts(new, new, old, overwrite=False)


_CODES = """(select n_nationkey // 5 as row, n_nationkey % 5 as col, (n_nationkey * 7) % 17 as code from nation)"""
_CLASS = """case code when 0 then 'WAT' when 1 then 'ENF' when 2 then 'EBF' when 3 then 'DNF' when 4 then 'DBF'
  when 5 then 'MF' when 6 then 'CSH' when 7 then 'OSH' when 8 then 'WSA' when 9 then 'SAV' when 10 then 'GRA'
  when 11 then 'WET' when 12 then 'CRO' when 13 then 'URB' when 14 then 'CVM' when 15 then 'SNO' when 16 then 'BSV' end"""
_PLAN = f"""
with loc as {ON_THE_MAP},
dim as (select coord_id, case when c_mktsegment != 'FURNITURE' then lat end as lat, lon,
          case c_nationkey % 3 when 0 then 'WAT' when 1 then 'CRO' end as igbp from loc),
placed as (select *, cast(greatest(least(floor((90 - lat) / 36), 4), 0) as bigint) as row,
             cast(greatest(least(floor((lon + 180) / 72), 4), 0) as bigint) as col from dim),
plan as (select p.coord_id, p.igbp, p.lat, {_CLASS.replace('case code', 'case c.code')} as fresh
         from placed p left join {_CODES} c on c.row = p.row and c.col = p.col)
"""


def _land_cover(spark, folder):
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.floor(key / 5).cast("int").alias("row"), (key % 5).alias("col"), (key * 7 % 17).alias("code"))


def _plan(spark, folder, only_missing=False):
    dim = customers_on_the_map(spark, folder)
    dim = dim.select("coord_id", F.when(F.col("c_mktsegment") != "FURNITURE", F.col("lat")).alias("lat"), "lon",
                     F.when(F.col("c_nationkey") % 3 == 0, "WAT").when(F.col("c_nationkey") % 3 == 1, "CRO")
                     .alias("igbp"))
    # the raster has 5 x 5 pixels of 36 degrees; longitudes are halved to fit
    halved = dim.withColumns({"lon": F.col("lon") / 2})
    return dims.relabel(halved, _land_cover(spark, folder), -90.0, 90.0, 36.0, 5, 5, only_missing)


@query(_PLAN + """
select coord_id, igbp as old_label, case when lat is null then igbp else fresh end as new_label,
  lat is not null and igbp is distinct from fresh as changed from plan""")
def relabel_plan(spark, folder):
    return _plan(spark, folder).select("coord_id", F.col("igbp").alias("old_label"), "new_label", "changed")


@query(_PLAN + """
select coord_id, case when igbp is null and lat is not null then fresh else igbp end as igbp from plan""")
def relabel_apply(spark, folder):
    return dims.apply_labels(_plan(spark, folder, only_missing=True)).select("coord_id", "igbp")


@query(_PLAN + """
, named as (select coalesce(igbp, 'NULL') as old_label,
              coalesce(case when lat is null then igbp else fresh end, 'NULL') as new_label from plan)
select 'old' as which, old_label as label, count(*) as n from named group by all
union all select 'new', new_label, count(*) from named group by all""")
def label_histograms(spark, folder):
    return dims.label_counts(_plan(spark, folder))


@query("""
with pairs as (select o_orderstatus as old_label, case when o_totalprice > 250000 then 'F' else o_orderstatus end as new_label
               from orders),
top as (select old_label, new_label, count(*) as n from pairs group by all
        order by n desc, old_label, new_label limit 4)
select * from top where old_label != new_label""")
def label_transitions_top(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("before"),
        F.when(F.col("o_totalprice") > 250000, "F").otherwise(F.col("o_orderstatus")).alias("after"))
    return dims.top_transitions(orders, "before", "after", 4)


@query("""
select c.c_custkey, c.c_acctbal, case when n.name is not null then n.name else c.c_name end as c_name
from customer c left join (select o_custkey, max(o_orderpriority) as name from orders where o_orderstatus = 'F'
  group by o_custkey) n on n.o_custkey = c.c_custkey""")
def batch_update(spark, folder):
    dim = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_name")
    changes = (table(spark, folder, "orders").where("o_orderstatus = 'F'")
               .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name")))
    return dims.update_by_key(dim, changes, "c_custkey", "c_name")


_LINE = ", ".join([*LINE_KEY, *LINE_ORDER])
_ASC = ", ".join(LINE_ORDER)
_DESC = ", ".join(f"{c} desc" for c in LINE_ORDER)


@query(f"""
select {_LINE} from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by {_ASC}) = 1""")
def dedup_first(spark, folder):
    return merge.resolve_duplicates(lineitem(spark, folder), LINE_KEY, "first", LINE_ORDER)


@query(f"""
select {_LINE} from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by {_DESC}) = 1""")
def dedup_last(spark, folder):
    return merge.resolve_duplicates(lineitem(spark, folder), LINE_KEY, "last", LINE_ORDER)


@query("""
select l_orderkey, l_linenumber, round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice,
  arg_min(l_returnflag, (l_partkey, l_suppkey, l_shipdate)) filter (l_returnflag is not null) as l_returnflag
from (select * replace (nullif(l_returnflag, 'A') as l_returnflag) from lineitem) group by all""")
def dedup_mean(spark, folder):
    rows = lineitem(spark, folder).select(
        *LINE_KEY, "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("l_returnflag"))
    merged = merge.resolve_duplicates(rows, LINE_KEY, "mean", ["l_partkey", "l_suppkey", "l_shipdate"])
    return rounded(rounded(merged, 6, "l_quantity"), 4, "l_extendedprice")


@query("""
select cast(coalesce(sum(n), 0) as bigint) as duplicate_rows, count(*) as duplicate_groups from (
  select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def dedup_error_report(spark, folder):
    return merge.duplicate_report(lineitem(spark, folder), LINE_KEY)


@query("""
select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
qualify count(*) over (partition by l_orderkey, l_linenumber) > 1""")
def duplicate_members(spark, folder):
    found = merge.duplicate_rows(lineitem(spark, folder), LINE_KEY)
    return found.select(*LINE_KEY, "l_partkey", "l_extendedprice")


@query("""
select l_orderkey, l_linenumber, count(*) as count from lineitem group by all having count(*) > 1""")
def duplicate_key_probe(spark, folder):
    return dims.duplicate_keys(lineitem(spark, folder), LINE_KEY)


@query("""
select count(*) filter (nullif(l_returnflag, 'R') is null) as null_keys from lineitem""")
def null_key_count(spark, folder):
    flags = lineitem(spark, folder).select(F.nullif(F.col("l_returnflag"), F.lit("R")).alias("flag"))
    return dims.null_key_count(flags, "flag")


@query("select distinct l_suppkey from lineitem")
def distinct_sites(spark, folder):
    return lineitem(spark, folder).select("l_suppkey").distinct()


@query("""
select bool_and(n <= 1) as is_static, count(*) as cells from (
  select count(distinct coalesce(o_orderpriority, '')) as n from orders group by o_custkey)""")
def static_attribute_check(spark, folder):
    return merge.is_static(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority")


def _shards(spark, folder):
    orders = table(spark, folder, "orders")
    return [orders.where(F.col("o_orderkey") % 4 == n) for n in range(4)]


@query("""
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""")
def shard_union(spark, folder):
    return merge.union_shards(_shards(spark, folder))


@query("""
select o_orderkey, o_totalprice, case when o_orderkey % 4 != 2 then o_orderstatus end as o_orderstatus from orders""")
def shard_union_by_name(spark, folder):
    parts = [s.select("o_orderkey", "o_totalprice", "o_orderstatus") for s in _shards(spark, folder)]
    parts[1] = parts[1].select("o_orderstatus", "o_orderkey", "o_totalprice")
    parts[2] = parts[2].drop("o_orderstatus")
    return merge.union_shards(parts, strict=False)


@query("""
select lat, lon, igbp, timestamp, pred_NEE from (
  select o_custkey % 50 as lat, o_orderkey % 90 as lon, o_orderstatus as igbp,
    cast(strftime(o_orderdate, '%Y%m%d') as bigint) as timestamp, o_totalprice as pred_NEE, o_orderkey as ord from orders)
qualify row_number() over (partition by timestamp, lat, lon order by ord) = 1""")
def merge_shards_first(spark, folder):
    def shaped(shard):
        return shard.select(
            F.col("o_orderkey").alias("__sample_order"), (F.col("o_custkey") % 50).alias("lat"),
            (F.col("o_orderkey") % 90).alias("lon"), F.col("o_orderstatus").alias("igbp"),
            F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("timestamp"),
            F.col("o_totalprice").alias("pred_NEE"), F.lit(1.0).alias("pred_LE"))
    return merge.merge_shards([shaped(s) for s in _shards(spark, folder)], ["NEE"], policy="first", sort=False)


_POSITIONED = """(select o_orderkey % 3 as shard, o_orderkey as line, cast(o_custkey % 20 as double) as lat,
  cast(o_orderkey % 9 as double) as lon, cast(strftime(o_orderdate, '%Y%m01') as bigint) as timestamp,
  o_orderstatus as igbp, o_totalprice as pred_NEE from orders)"""


def _positioned(spark, folder):
    """Predictions with the place they had in their shards, but without a sample order."""
    return table(spark, folder, "orders").select(
        F.format_string("%08d", F.col("o_orderkey") % 3).alias("__shard"), F.lit(0).cast("long").alias("__block"),
        F.col("o_orderkey").alias("__line"), (F.col("o_custkey") % 20).cast("double").alias("lat"),
        (F.col("o_orderkey") % 9).cast("double").alias("lon"), F.col("o_orderstatus").alias("igbp"),
        F.date_format("o_orderdate", "yyyyMM'01'").cast("long").alias("timestamp"),
        F.col("o_totalprice").alias("pred_NEE"))


@query(f"""
select lat, lon, igbp, timestamp, pred_NEE from {_POSITIONED}
qualify row_number() over (partition by timestamp, lat, lon order by shard, line) = 1""")
def merge_positions_first(spark, folder):
    return merge.merge_shards([_positioned(spark, folder)], ["NEE"], policy="first", sort=False)


@query(f"""
select lat, lon, igbp, timestamp, pred_NEE from {_POSITIONED}
qualify row_number() over (partition by timestamp, lat, lon order by shard desc, line desc) = 1""")
def merge_positions_last(spark, folder):
    return merge.merge_shards([_positioned(spark, folder)], ["NEE"], policy="last", sort=False)


@query(f"""
select lat, lon, arg_min(igbp, shard * 1000000000 + line) as igbp, timestamp, round(avg(pred_NEE), 4) as pred_NEE
from {_POSITIONED} group by lat, lon, timestamp""")
def merge_positions_mean(spark, folder):
    merged = merge.merge_shards([_positioned(spark, folder)], ["NEE"], policy="mean", sort=False)
    return merged.withColumn("pred_NEE", F.round("pred_NEE", 4))


_GRID_ROWS = """(select cast(strftime(o_orderdate, '%Y%m01') as bigint) as timestamp,
  cast(substr(o_orderpriority, 1, 1) as double) as lat, cast(o_custkey % 40 as double) as lon,
  avg(o_totalprice) as price, count(*) + 0.0e0 as n from orders
  where not (o_orderpriority like '3%' and month(o_orderdate) = 2) group by all)"""


def _grid_rows(spark, folder):
    # the axes and the cells are read from it separately
    # some grid lines are empty
    kept = table(spark, folder, "orders").where("not (o_orderpriority like '3%' and month(o_orderdate) = 2)")
    return settle(kept.groupBy(
        F.date_format("o_orderdate", "yyyyMM'01'").cast("long").alias("timestamp"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("lat"),
        (F.col("o_custkey") % 40).cast("double").alias("lon")).agg(
        F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n")))


@query(f"""
with g as {_GRID_ROWS}
select dense_rank() over (order by timestamp) - 1 as time_index, timestamp,
  dense_rank() over (order by lat desc) - 1 as lat_index, lat, count(n) as n_cells,
  (select count(distinct lon) from g) as n_lons, coalesce(sum(n), 0) + 0.0e0 as sum_n
from (select distinct timestamp from g) cross join (select distinct lat from g) left join g using (timestamp, lat)
group by timestamp, lat""")
def cube_lines(spark, folder):
    cube = merge.dense_cube(_grid_rows(spark, folder), ["price", "n"])
    filled = F.filter("n", lambda v: ~F.isnan(v))
    return cube.select("time_index", "timestamp", "lat_index", "lat",
                       F.size(filled).cast("long").alias("n_cells"), F.size("price").cast("long").alias("n_lons"),
                       F.aggregate(filled, F.lit(0.0), lambda a, v: a + v).alias("sum_n"))


@query(f"""
select timestamp, lat, lon, round(cast(cast(price as float) as double), 2) as price,
  cast(n as double) as n from {_GRID_ROWS}""")
def cube_long_roundtrip(spark, folder):
    long = _grid_rows(spark, folder)
    axes = merge.cube_axes(long)
    back = merge.long_from_cube(merge.dense_cube(long, ["price", "n"], axes), ["price", "n"], axes["lon"])
    return back.select("timestamp", "lat", "lon", F.round(F.col("price").cast("double"), 2).alias("price"),
                       F.col("n").cast("double").alias("n"))


@query("""
select l_shipdate as day, dense_rank() over (order by l_shipdate desc) - 1 as position
from (select distinct l_shipdate from lineitem)""")
def axis_positions(spark, folder):
    found = spatial.axis_positions(lineitem(spark, folder), "l_shipdate", "position", descending=True)
    return found.select(F.col("l_shipdate").alias("day"), "position")


@query(f"""
with loc as {ON_THE_MAP},
dim as (select coord_id, floor(lat * 4) / 4 as lat, floor(lon * 4) / 4 as lon from loc),
cells as (select o.o_orderkey, cast(o.o_totalprice as float) as v, cast(strftime(o.o_orderdate, '%Y%m%d') as integer) as modis_date,
            d.lat as lat_min, d.lon as lon_min from orders o join dim d on d.coord_id = o.o_custkey),
owners as (select max(coord_id) as coord_id, cast(round_even(lat * 4, 0) as int) as a,
             cast(round_even(lon * 4, 0) as int) as b from dim group by a, b)
select w.coord_id, c.modis_date, round(cast(c.v as double), 2) as v from cells c
join owners w on w.a = cast(round_even(c.lat_min * 4, 0) as int) and w.b = cast(round_even(c.lon_min * 4, 0) as int)""")
def cell_key_join(spark, folder):
    edge = {c: F.floor(F.col(c) * 4) / 4 for c in ("lat", "lon")}
    dim = customers_on_the_map(spark, folder).select("coord_id", edge["lat"].alias("lat"), edge["lon"].alias("lon"))
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("coord_id"), F.array(F.col("o_totalprice").cast("float")).alias("data"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("modis_date"))
    cells = orders.join(dim, "coord_id").select(
        ((89.75 - F.col("lat")) * 4).cast("int").alias("grid_row"), ((F.col("lon") + 180) * 4).cast("int").alias("grid_col"),
        "modis_date", "data")
    images = dims.cells_to_images(cells, dim)
    return images.select("coord_id", "modis_date", F.round(F.col("data")[0].cast("double"), 2).alias("v"))


@query(f"""
with loc as {ON_THE_MAP}
select cast(round_even(lat * 4, 0) as int) as lat_key, cast(round_even(lon * 4, 0) as int) as lon_key,
  count(*) as n from loc group by all""")
def grid_keys(spark, folder):
    places = customers_on_the_map(spark, folder)
    return places.groupBy(cell_key(F.col("lat")).alias("lat_key"), cell_key(F.col("lon")).alias("lon_key")).agg(
        F.count("*").alias("n"))


@query("""
select 'customer without event' as what, count(*) as n from customer anti join events on user_id = c_custkey
union all select 'either', count(*) from (select user_id from events union select o_custkey from orders)
union all select 'both', count(*) from (select user_id from events intersect select o_custkey from orders)
union all select 'event but no order', count(*) from (select user_id from events except select o_custkey from orders)""")
def validate_sets(spark, folder):
    custs = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    seen = events(spark, folder).select(F.col("user_id").alias("k"))
    buying = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))

    def counted(df, what):
        return df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return (counted(custs.join(seen, "k", "left_anti"), "customer without event")
            .union(counted(seen.union(buying).distinct(), "either"))
            .union(counted(seen.intersect(buying), "both"))
            .union(counted(seen.subtract(buying), "event but no order")))


@query("""
select p_size as code from part where p_size > 16 group by p_size""")
def unknown_codes(spark, folder):
    return dims.unknown_codes(table(spark, folder, "part").withColumnRenamed("p_size", "code"))


@query("""
select arg_max(path, n) as path from (
  select path, try_cast(regexp_extract(path, 'checkpoint-(\\d+)\\.pth$', 1) as bigint) as n from (
    select 'run/checkpoint-' || case when event_type = 'view' then 'x' else '' end || event_id || '.pth' as path
    from events)) where n is not null""")
def best_checkpoint(spark, folder):
    tag = F.when(F.col("event_type") == "view", "x").otherwise("")
    paths = events(spark, folder).select(
        F.concat(F.lit("run/checkpoint-"), tag, F.col("event_id").cast("string"), F.lit(".pth")).alias("path"))
    return latest_checkpoint(paths)


@query("""
select c_custkey, c.label as igbp, row_number() over (order by c.pos, c.label, c_custkey) as place from customer join (
  values ('ENF', 1), ('URB', 13), ('ZZZ', 99), ('MF', 5), ('AAA', 99)) c(label, pos)
  on c.label = case c_nationkey % 5 when 0 then 'ENF' when 1 then 'URB' when 2 then 'ZZZ' when 3 then 'MF' else 'AAA' end""")
def category_order(spark, folder):
    key = F.col("c_nationkey") % 5
    label = (F.when(key == 0, "ENF").when(key == 1, "URB").when(key == 2, "ZZZ").when(key == 3, "MF").otherwise("AAA"))
    named = table(spark, folder, "customer").select("c_custkey", label.alias("igbp"))
    placed = named.withColumn("pos", text.legend_position(F.col("igbp")))
    return dense_order(placed, ["pos", "igbp", "c_custkey"], "place", start=1).drop("pos")


@query("""
select c_mktsegment as label, count(*) as n from customer group by all order by n desc, label limit 3""")
def top_k(spark, folder):
    counted = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "label").limit(3)


@query("""
select gx, gy, arg_min(p_partkey, p_partkey) as first_part, arg_min(p_retailprice, p_partkey) as price
from (select p_size as gx, cast(replace(p_brand, 'Brand#', '') as int) as gy, * from part) group by all""")
def mosaic_first(spark, folder):
    tiles = table(spark, folder, "part").select(
        F.col("p_size").alias("row"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("col"),
        F.col("p_partkey").alias("tile"), F.col("p_partkey").alias("first_part"), F.col("p_retailprice").alias("price"))
    return spatial.mosaic(tiles).withColumnsRenamed({"row": "gx", "col": "gy"})
