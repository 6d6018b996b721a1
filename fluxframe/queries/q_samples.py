"""Sample indexes, windows, as-of lookups, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe.functions.scalars import date_number, int_to_date, timestamp_to_int
from fluxframe.operators import asof, layout, meters, ordering, samples, spatial
from fluxframe.queries.registry import ON_THE_MAP, customers_on_the_map, events, moment, query, rounded
from fluxframe.sources import footers
from fluxframe.sources.tables import quarters, table

L = 16


@query(f"""
select event_id, user_id, ts from (
  select *, row_number() over (partition by user_id order by ts, event_id) as n
  from events where ts <= timestamp '2024-01-25 00:00:00')
where n >= {L} and ts >= timestamp '2024-01-10 00:00:00'""")
def sample_index_grid(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "ts")
    return samples.grid_sample_index(facts, L, moment("2024-01-10 00:00:00"), moment("2024-01-25 00:00:00"),
                                     key="user_id", time="ts", row_id="event_id")


@query(f"""
select event_id, user_id, ts from (
  select e.*, row_number() over (partition by user_id order by ts, event_id) as n
  from events e where not exists (
    select 1 from customer c where c.c_custkey = e.user_id
      and c.c_mktsegment in ('BUILDING', 'MACHINERY')))
where n >= {L}""")
def sample_index_excluded(spark, folder):
    dim = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"),
                                                  F.col("c_mktsegment").alias("igbp"))
    facts = events(spark, folder).select("event_id", "user_id", "ts")
    kept = samples.without_classes(facts, dim, [" building", "Machinery"], key="user_id")
    return samples.grid_sample_index(kept, L, key="user_id", time="ts", row_id="event_id")


@query("""
select event_id, user_id from (
  select *, row_number() over (partition by user_id order by event_id) as n
  from events where value > 20 or event_type = 'purchase')
where n > 7""")
def sample_index_site(spark, folder):
    facts = events(spark, folder).select(
        "event_id", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("t1"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("t2"))
    index = samples.site_sample_index(facts, ["t1", "t2"], 8, key="user_id", row_id="event_id")
    return index.select("event_id", "user_id")


@query(f"""
select event_id, user_id, count(*) over w as n_rows, round(avg(value) over w, 6) as mean_value,
       first_value(event_id) over w as first_id, round(sum(value) over w, 4) as sum_value
from events
window w as (partition by user_id order by ts, event_id rows between {L - 1} preceding and current row)""")
def trailing_rows_stats(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "ts", "value")
    framed = ordering.over_last_rows(facts, ["user_id"], ["ts", "event_id"], L, {
        "n_rows": F.count("*"), "mean_value": F.avg("value"), "first_id": F.first("event_id"),
        "sum_value": F.sum("value")})
    return rounded(rounded(framed, 6, "mean_value"), 4, "sum_value").drop("ts", "value")


@query("""
select user_id, day, count(*) over w as n_rows, sum(day % 7) over w as total, first_value(day) over w as first_day
from (select user_id, cast(strftime(ts, '%d') as bigint) as day from events)
window w as (partition by user_id order by day rows between 4 preceding and current row)""")
def trailing_ties(spark, folder):
    """Many rows tie in the order; tied rows are equal, so every order of theirs gives the same."""
    facts = events(spark, folder).select("user_id", F.dayofmonth("ts").cast("long").alias("day"))
    return ordering.over_last_rows(facts, ["user_id"], ["day"], 5, {
        "n_rows": F.count("*"), "total": F.sum(F.col("day") % 7), "first_day": F.first("day")})


@query(f"""
select event_id, user_id, first_value(ts) over w as first_ts, round(last_value(value) over w, 6) as last_value,
       round(max(value) over w, 6) as max_value
from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)
window w as (partition by user_id order by ts, event_id rows between 7 preceding and current row)
qualify n >= 8""")
def trailing_frames(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "ts", "value")
    framed = samples.trailing_frames(facts, "user_id", ["ts", "event_id"], 8, ["value"])
    return framed.select("event_id", "user_id", F.col("frame")[0]["ts"].alias("first_ts"),
                         F.round(F.element_at("frame", -1)["value"], 6).alias("last_value"),
                         F.round(F.array_max("frame.value"), 6).alias("max_value"))


@query("""
select event_id, user_id, count(*) over w as n_rows, round(sum(value) over w, 4) as sum_value,
       min(event_id) over w as first_id
from events
window w as (partition by user_id order by event_id range between 999 preceding and current row)""")
def trailing_id_range_stats(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "value")
    framed = samples.over_id_range(facts, "user_id", "event_id", 1000, {
        "n_rows": F.count("*"), "sum_value": F.sum("value"), "first_id": F.min("event_id")})
    return rounded(framed, 4, "sum_value").drop("value")


@query("""
select c.event_id, c.user_id, c.ts, p.event_id as purchase_id, round(p.value, 6) as purchase_value
from (select * from events where event_type = 'click') c
asof left join (select * from events where event_type = 'purchase') p
  on c.user_id = p.user_id and c.ts >= p.ts""")
def asof_latest(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "ts", "value", "event_type")
    clicks = facts.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = facts.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    found = asof.asof_backward(clicks, buys, ["user_id"], "ts", "ts",
                               {"purchase_id": "event_id", "purchase_value": "value"})
    return rounded(found, 6, "purchase_value")


@query("""
with images as (select distinct user_id, cast(strftime(ts, '%Y%m%d') as integer) as day
                from events where event_type = 'purchase'),
dated as (select event_id, user_id, ts, cast(strftime(ts, '%Y%m%d') as integer) as day from events),
matched as (select d.event_id, d.user_id, d.ts, i.day as image
            from dated d asof left join images i on d.user_id = i.user_id and d.day >= i.day)
select event_id, user_id, count(distinct image) over w as n_images, min(image) over w as first_image,
       max(image) over w as last_image
from matched
window w as (partition by user_id order by ts, event_id rows between 7 preceding and current row)""")
def asof_distinct_images(spark, folder):
    day = int_to_date(timestamp_to_int(F.col("ts")))
    facts = events(spark, folder).select("event_id", "user_id", "ts", "event_type", day.alias("day"))
    images = facts.where("event_type = 'purchase'").select("user_id", F.col("day").alias("image_day")).distinct()
    found = asof.distinct_images(facts.drop("event_type"), images, "user_id", "day", "image_day",
                                 ["ts", "event_id"], 8)
    return found.select("event_id", "user_id", F.size("image_dates").cast("long").alias("n_images"),
                        F.array_min("image_dates").alias("first_image"),
                        F.array_max("image_dates").alias("last_image"))


@query("""
select event_id, user_id, round(first_value(image ignore nulls) over (
    partition by user_id order by event_id range between 300 preceding and current row), 6) as first_image
from (select *, case when event_type = 'purchase' then value end as image from events)""")
def first_image_in_window(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "event_type", "value")
    images = facts.where("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "value")
    found = samples.first_image_in_window(facts.select("event_id", "user_id"), images, "user_id", "event_id",
                                          "row_id", "value", 301, out="first_image")
    return rounded(found, 6, "first_image")


@query("""
select event_id, user_id, round(first_value(image ignore nulls) over (
    partition by user_id order by event_id range between 300 preceding and current row), 6) as first_image
from (select *, case when event_type = 'purchase' then value + 1 end as image from events)""")
def first_of_several_images(spark, folder):
    """Two images on a row: the facts stay single and the first by order counts."""
    facts = events(spark, folder).select("event_id", "user_id", "event_type", "value")
    two = F.explode(F.array(F.struct(F.lit(1).alias("n"), (F.col("value") + 1).alias("image")),
                            F.struct(F.lit(2).alias("n"), F.col("value").alias("image"))))
    images = facts.where("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), two.alias("i")).select(
        "row_id", "i.*")
    found = samples.first_image_in_window(facts.select("event_id", "user_id"), images, "user_id", "event_id",
                                          "row_id", "image", 301, out="first_image", order=["n"])
    return rounded(found, 6, "first_image")


@query("""
select c_custkey, c_mktsegment from customer c
where exists (select 1 from events e where e.user_id = c.c_custkey)""")
def active_entities_semi(spark, folder):
    dim = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    active = events(spark, folder).select(F.col("user_id").alias("c_custkey"))
    return samples.of_entities(dim, active, "c_custkey")


@query("""
select event_id, c_custkey, c_mktsegment, c_acctbal from events join customer on user_id = c_custkey""")
def dim_lookup_strict(spark, folder):
    facts = events(spark, folder).select("event_id", F.col("user_id").alias("c_custkey"))
    dim = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return samples.dim_lookup(facts, dim, "c_custkey")


@query(f"""
with loc as {ON_THE_MAP},
images as (select distinct user_id, cast(strftime(ts, '%Y%m%d') as integer) as day
           from events where event_type = 'purchase'),
kept as (select e.* from events e where not exists
           (select 1 from customer c where c.c_custkey = e.user_id and c.c_mktsegment = 'BUILDING')
         and ts <= timestamp '2024-01-26 23:59:59'),
framed as (select event_id, user_id, ts, cast(strftime(ts, '%Y%m%d') as integer) as day,
             row_number() over w0 as n, round(sum(value) over w, 4) as sum_value,
             first_value(event_id) over w as first_id
           from kept window w0 as (partition by user_id order by ts, event_id),
             w as (partition by user_id order by ts, event_id rows between {L - 1} preceding and current row))
select f.event_id as id, f.user_id as coord_id, f.first_id, f.sum_value, i.day as image_date,
       round(cast(cast(loc.lat / 180.0e0 as float) as double), 6) as lat,
       round(cast(cast(loc.lon / 180.0e0 as float) as double), 6) as lon, loc.c_mktsegment as igbp
from framed f asof left join images i on f.user_id = i.user_id and f.day >= i.day
join loc on loc.coord_id = f.user_id
where f.n >= {L} and f.ts >= timestamp '2024-01-05 00:00:00'""")
def grid_samples_full(spark, folder):
    facts = events(spark, folder).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("coord_id"), "event_type",
        F.col("ts").alias("timestamp"), "value")
    dim = customers_on_the_map(spark, folder).select(
        "coord_id", "lat", "lon", F.lit(0.0).alias("elev"), F.col("c_mktsegment").alias("igbp"))
    images = facts.where("event_type = 'purchase'").select(
        "coord_id", date_number(F.col("timestamp")).alias("modis_date")).distinct()
    images = images.withColumn("data", F.array(F.lit(1.0).cast("float")))
    built = samples.grid_samples(facts.drop("event_type"), dim, L, ["value"], images,
                                 moment("2024-01-05 00:00:00"), moment("2024-01-26 23:59:59"), ["building"])
    total = F.aggregate("frame.value", F.lit(0.0), lambda a, v: a + v)
    return built.select("id", "coord_id", F.col("frame")[0]["id"].alias("first_id"),
                        F.round(total, 4).alias("sum_value"), "image_date",
                        F.round(F.col("lat").cast("double"), 6).alias("lat"),
                        F.round(F.col("lon").cast("double"), 6).alias("lon"), "igbp")


@query(f"""
with images as (select distinct user_id, cast(strftime(ts, '%Y%m%d') as integer) as day
           from events where event_type = 'purchase'),
dated as (select event_id, user_id, ts, cast(strftime(ts, '%Y%m%d') as integer) as day from events),
matched as (select d.*, i.day as image from dated d asof left join images i on d.user_id = i.user_id and d.day >= i.day),
framed as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n,
             list(distinct image) over w as dates
           from matched window w as (partition by user_id order by ts, event_id rows between {L - 1} preceding and current row))
select event_id as id, user_id as coord_id, len([x for x in dates if x is not null]) as n_images,
  coalesce(list_sum([x for x in dates if x is not null]), 0) + 0.0e0 as tensor_sum
from framed where n >= {L} and user_id in (select c_custkey from customer)""")
def grid_samples_images(spark, folder):
    facts = events(spark, folder).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("coord_id"), "event_type",
        F.col("ts").alias("timestamp"), "value")
    dim = customers_on_the_map(spark, folder).select(
        "coord_id", "lat", "lon", F.lit(0.0).alias("elev"), F.col("c_mktsegment").alias("igbp"))
    images = facts.where("event_type = 'purchase'").select(
        "coord_id", date_number(F.col("timestamp")).alias("modis_date")).distinct()
    images = images.withColumn("data", F.array(F.col("modis_date").cast("double")))
    built = samples.grid_samples(facts.drop("event_type"), dim, L, ["value"], images, single_image=False)
    total = F.aggregate(F.flatten("images"), F.lit(0.0), lambda a, v: a + v)
    return built.select("id", "coord_id", F.size("images").cast("long").alias("n_images"), total.alias("tensor_sum"))


@query("""
with usable as (select event_id, user_id, row_number() over (partition by user_id order by event_id) as n
                from events where event_type in ('click', 'view')),
framed as (select event_id, user_id, count(*) over w as n_rows, count(t) over w as n_targets,
             first_value(img ignore nulls) over w as image_row
           from (select *, case when event_type in ('click', 'view') and abs(value) <= 100 then value end as t,
                   case when event_type = 'purchase' then event_id end as img from events)
           window w as (partition by user_id order by event_id range between 11 preceding and current row))
select f.event_id as id, cast(f.user_id as varchar) as site, f.n_rows, f.n_targets, f.image_row,
       c.c_mktsegment as igbp
from framed f join usable u on u.event_id = f.event_id join customer c on c.c_custkey = f.user_id
where u.n >= 12""")
def site_samples_full(spark, folder):
    raw = events(spark, folder)
    facts = raw.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("site"),
                       timestamp_to_int(F.col("ts")).alias("timestamp"), "value",
                       F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("NEE"))
    images = raw.where("event_type = 'purchase'").select(F.col("event_id").alias("row_id"),
                                                        F.col("event_id").alias("data"))
    dim = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("site"), F.col("c_acctbal").alias("lat"),
        F.col("c_acctbal").alias("lon"), F.col("c_acctbal").alias("elev"), F.col("c_mktsegment").alias("igbp"))
    built = samples.site_samples(facts, dim, 12, ["value"], ["NEE"], images=images)
    present = F.filter("frame.NEE", lambda v: v.isNotNull())
    return built.select("id", "site", F.size("frame").cast("long").alias("n_rows"),
                        F.size(present).cast("long").alias("n_targets"),
                        F.try_element_at("images", F.lit(1)).alias("image_row"), "igbp")


@query("""
select event_id, row_number() over (order by user_id, ts, event_id) - 1 as sample_order from events""")
def global_order(spark, folder):
    index = events(spark, folder).select("event_id", "user_id", "ts")
    return samples.ordered_samples(index, "user_id", "ts", "event_id", "sample_order").drop("user_id", "ts")


@query("""
select event_id, sample_order from (
  select event_id, row_number() over (order by user_id, ts, event_id) - 1 as sample_order from events)
where sample_order >= 100 and sample_order < 700""")
def order_slice(spark, folder):
    index = events(spark, folder).select("event_id", "user_id", "ts")
    numbered = samples.ordered_samples(index, "user_id", "ts", "event_id", "sample_order")
    return samples.order_slice(numbered, 100, 700, "sample_order").select("event_id", "sample_order")


@query("""
select event_id, ntile(7) over (order by user_id, ts, event_id) - 1 as shard from events""")
def balanced_split(spark, folder):
    index = events(spark, folder).select("event_id", "user_id", "ts")
    return ordering.balanced_shards(index, ["user_id", "ts", "event_id"], 7).select("event_id", "shard")


@query("""
select row_number() over (order by user_id, ts, event_id) as event_id, user_id, ts, value from events""")
def rebuild_ids(spark, folder):
    facts = events(spark, folder).select("event_id", "user_id", "ts", "value")
    return layout.rebuild_ids(facts, "user_id", "ts", "event_id")


@query("""
select row_number() over (order by user_id, ts) as id, user_id, ts from events""")
def rebuild_ids_new(spark, folder):
    """Facts that have no ids yet get them."""
    return layout.rebuild_ids(events(spark, folder).select("user_id", "ts"), "user_id", "ts")


@query("""
select count(*) as row_count, max(event_id) as max_id from events""")
def row_estimate(spark, folder):
    return footers.footer_estimate(spark, f"{folder}/events.parquet", "event_id")


@query("""
with rolled as (
  select event_id, event_type, value,
    list_sort(list(value) over w) as l, avg(value) over w as a, stddev_samp(value) over w as s, max(value) over w as m
  from events window w as (partition by event_type order by event_id rows between 19 preceding and current row))
select event_id, event_type, round(value, 6) as value, round(l[(len(l) + 1) // 2], 6) as median, round(a, 6) as avg,
  round(s, 5) as std, round(m, 6) as max,
  round(avg(value) over (partition by event_type), 6) as global_avg
from rolled""")
def rolling_meter(spark, folder):
    series = events(spark, folder).select("event_id", "event_type", "value")
    smooth = meters.smoothed(series, "event_type", "event_id", "value")
    return rounded(rounded(smooth, 6, "value", "median", "avg", "max", "global_avg"), 5, "std")


@query("""
select event_type, count(*) as steps, cast(floor(avg(value) * greatest(100000 - count(*), 0)) as bigint) as eta_seconds
from events group by event_type""")
def meter_eta(spark, folder):
    left = meters.remaining_time(events(spark, folder), "event_type", "value", 100000)
    return left.select("event_type", "steps", "eta_seconds")


@query("""
with stepped as (
  select event_id, user_id, ts, value, lag(value) over (partition by user_id order by ts, event_id) as before from events),
cut as (
  select event_id, user_id, value, sum(case when abs(value - before) > 60 then 1 else 0 end) over (
    partition by user_id order by ts, event_id rows unbounded preceding) as segment from stepped)
select event_id, user_id, cast(segment as bigint) as segment from (
  select *, count(*) over (partition by user_id, segment) as n from cut) where n >= 2""")
def segment_split(spark, folder):
    lines = events(spark, folder).select("event_id", "user_id", "ts", "value")
    pieces = spatial.split_at_dateline(lines, ["user_id"], ["ts", "event_id"], lon="value", jump=60.0)
    return pieces.select("event_id", "user_id", "segment")


@query("""
select event_id, user_id, value from events order by md5(concat('3:', event_id)), event_id limit 25""")
def reservoir_sample(spark, folder):
    return samples.reservoir(events(spark, folder).select("event_id", "user_id", "value"), "event_id", 25, seed=3)


@query("""
select event_id, row_number() over (order by md5(concat('5:2:', event_id)), event_id) - 1 as position from events""")
def epoch_shuffle(spark, folder):
    return samples.epoch_order(events(spark, folder).select("event_id"), "event_id", seed=5, epoch=2)


@query("""
select event_id, user_id, value from events order by ts, event_id limit 40""")
def sample_prefix(spark, folder):
    ordered = events(spark, folder).orderBy("ts", "event_id").limit(40)
    return ordered.select("event_id", "user_id", "value")


@query("""
select l_linenumber, case when l_returnflag = 'A' then 'train' when l_returnflag = 'N' then 'val' else 'test' end as split,
  count(*) as n from lineitem group by all""")
def site_split(spark, folder):
    labelled = samples.with_split(table(spark, folder, "lineitem"),
                                  {"train": ["A"], "val": ["N"], "test": ["R"]}, "l_returnflag")
    return labelled.groupBy("l_linenumber", "split").agg(F.count("*").alias("n"))


@query("""
select year(o_orderdate) as year, quarter(o_orderdate) as quarter, count(*) as n from orders group by all""")
def quarter_chunks(spark, folder):
    split = quarters(table(spark, folder, "orders"), "o_orderdate").groupBy("year", "quarter").agg(F.count("*").alias("n"))
    return split.select(F.col("year").cast("long"), F.col("quarter").cast("long"), "n")
