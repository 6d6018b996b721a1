"""Scalar, array and text expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe import vocab
from fluxframe.functions import arrays, scalars, text
from fluxframe.queries.registry import customers_on_the_map, events, query, rounded
from fluxframe.sources.tables import table


@query("""
select event_id,
  round(case when value between 0 and 100 then (value - 50) / 100 end, 9) as rh,
  round(case when value between -80 and 80 then value / 160 end, 9) as ta,
  round(case when value between 0 and 360 then (value - 180) / 180 end, 9) as wd,
  round(case when value between 0 and 750 then (value - 375) / 750 end, 9) as co2 from events""")
def minmax_norm(spark, folder):
    v = F.col("value")
    return events(spark, folder).select("event_id", *[
        F.round(scalars.normalise(n, v), 9).alias(n.lower()) for n in ("RH", "TA", "WD", "CO2")])


@query("""
select event_id, cast(case when value between 100 and 0 then 0 end as double) as swc_strict,
  round(case when value between 0 and 100 then (value - 50) / -100 end, 6) as swc_ordered,
  round(case when value / 100 between -3 and 3 then value / 100 / -6 end, 6) as wtd_ordered from events""")
def minmax_norm_inverted(spark, folder):
    v = F.col("value")
    return events(spark, folder).select(
        "event_id", F.round(scalars.normalise("SWC_1", v), 6).alias("swc_strict"),
        F.round(scalars.normalise("SWC_1", v, strict_bounds=False), 6).alias("swc_ordered"),
        F.round(scalars.normalise("WTD", v / 100, strict_bounds=False), 6).alias("wtd_ordered"))


@query("""
select event_id, cast(dayofyear(ts) as integer) as doy, cast(hour(ts) + 1 as integer) as tod,
  cast(strftime(ts, '%Y%m%d%H%M%S') as bigint) as ts_int, cast(strftime(ts, '%Y%m%d') as integer) as day_int from events""")
def calendar_fields(spark, folder):
    number = scalars.timestamp_to_int(F.col("ts"))
    return events(spark, folder).select(
        "event_id", scalars.day_of_year(F.col("ts")).alias("doy"), scalars.time_of_day(F.col("ts")).alias("tod"),
        number.alias("ts_int"), scalars.int_to_date(number).alias("day_int"))


@query("""
with shaped as (select event_id, ts, event_id % 7 as shape,
  case event_id % 7 when 0 then strftime(ts, ' %Y-%m-%d ') when 1 then strftime(ts, '%Y%m%d')
    when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 3 then strftime(ts, '%Y%m%d%H%M%S')
    when 4 then strftime(ts, '%Y-%m-%d %H:%M') when 5 then strftime(ts, '%Y%m%d%H%M') else event_type end as t from events)
select event_id,
  cast(case when shape in (0, 1) then strftime(ts, '%Y%m%d') || '000000' when shape in (2, 3) then strftime(ts, '%Y%m%d%H%M%S')
    when shape in (4, 5) then strftime(ts, '%Y%m%d%H%M') || '00' end as bigint) as low,
  cast(case when shape in (0, 1) then strftime(ts, '%Y%m%d') || '235959' when shape in (2, 3) then strftime(ts, '%Y%m%d%H%M%S')
    when shape in (4, 5) then strftime(ts, '%Y%m%d%H%M') || '00' end as bigint) as high from shaped""")
def parse_dates(spark, folder):
    formats = [" yyyy-MM-dd ", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm"]
    shape = F.col("event_id") % 7
    written = F.col("event_type")
    for n, pattern in enumerate(formats):
        written = F.when(shape == n, F.date_format("ts", pattern)).otherwise(written)
    return events(spark, folder).select("event_id", written.alias("t")).select(
        "event_id", scalars.parse_bound_column(F.col("t"), False).alias("low"),
        scalars.parse_bound_column(F.col("t"), True).alias("high"))


@query("""
select event_id, cast(try_strptime(name, '%Y-%m-%d') as date) as day from (
  select event_id, replace(case when event_type = 'view' then 'bad_name' else strftime(ts, '%Y_%m_%d') end, '_', '-') as name
  from events)""")
def asset_dates(spark, folder):
    name = F.when(F.col("event_type") == "view", "MODIS/bad_name").otherwise(
        F.concat(F.lit("MODIS/061/"), F.date_format("ts", "yyyy_MM_dd")))
    return events(spark, folder).select("event_id", scalars.asset_date(name).alias("day"))


@query("""
select o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') as day from orders""")
def int_to_timestamp(spark, folder):
    days = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("day"))
    return scalars.whole_column_timestamp(days, "day")


@query("""
select event_id, cast(case when event_type = 'view' then strftime(ts, '%Y%m%d') else strftime(ts, '%Y%m%d%H%M%S') end as bigint) as t
from events""")
def int_to_timestamp_mixed(spark, folder):
    mixed = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyyMMdd")).otherwise(
        F.date_format("ts", "yyyyMMddHHmmss")).cast("long")
    return scalars.whole_column_timestamp(events(spark, folder).select("event_id", mixed.alias("t")), "t")


@query("""
select l_orderkey, l_partkey, l_linenumber, round(case when abs(v) <= 100 and l_linenumber < 5 then v end, 6) as target from (
  select *, (l_extendedprice - 50000) / 500 as v from lineitem)""")
def clean_targets(spark, folder):
    v = (F.col("l_extendedprice") - 50000) / 500
    odd = (F.when(F.col("l_linenumber") == 5, F.lit(float("nan"))).when(F.col("l_linenumber") == 6, F.lit(float("-inf")))
           .when(F.col("l_linenumber") > 6, F.lit(float("inf"))).otherwise(v))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(scalars.clean_target(odd), 6).alias("target"))


@query("""
select event_id, try_cast(case when event_type = 'error' then 'n/a' when event_type = 'view' then 'nan'
  else cast(event_id as varchar) || '.5' end as double) as number from (select * replace (case when event_type = 'view'
  then 'error' else event_type end as event_type) from events)""")
def numeric_coerce(spark, folder):
    written = (F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "nan")
               .otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5"))))
    return events(spark, folder).select("event_id", scalars.to_number(written).alias("number"))


_INTS = "[cast(round(cast(x as double) * 40000) as bigint) for x in embedding]"


@query(f"""
with e as (select vec_id, {_INTS} as a from embeddings),
c as (select vec_id, a,
  [cast(case when x < 0 or x > 30000 then -1 else least(x, 10000) / 10000.0e0 end as float) for x in a] as refl,
  [case when x <= 1 then x else -1 end for x in [floor(y / 1000) for y in a]] as snow,
  [case when x between 0 and 7 then [1, 0, 0, 1, 1, 1, 1, 1][cast(x as int) + 1] else 1 end for x in [floor(y / 1000) for y in a]] as water
  from e)
select vec_id, round(list_sum([cast(x as double) for x in refl]), 4) as refl, cast(list_sum(snow) as double) as snow,
  cast(list_sum(water) as double) as water, len([x for x in refl if x < 0]) / 64 as negative,
  len([x for x in refl if x < 0]) / 64 > 0.3 as masked from c""")
def raster_clean(spark, folder):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 40000).cast("long"))
    coarse = F.transform(whole, lambda x: F.floor(x / 1000))
    df = table(spark, folder, "embeddings").select("vec_id", whole.alias("a"), coarse.alias("b"))
    df = df.select("vec_id", arrays.clean_reflectance(F.col("a")).alias("refl"),
                   arrays.clean_snow(F.col("b")).alias("snow"), arrays.clean_water(F.col("b")).alias("water"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("vec_id", F.round(total("refl"), 4).alias("refl"), total("snow").alias("snow"),
                     total("water").alias("water"), arrays.negative_share(F.col("refl")).alias("negative"),
                     arrays.channel_is_masked(F.col("refl")).alias("masked"))


_WAVES = ", ".join(f"round({f}(pi() * {2 ** k} * value / 100), 6) as {f}{k}" for f in ("sin", "cos") for k in range(4))


@query(f"select event_id, {_WAVES} from events")
def fourier_features(spark, folder):
    waves = events(spark, folder).select("event_id", arrays.fourier(F.col("value") / 100, 4).alias("w"))
    return waves.select("event_id", *[F.round(F.col("w")[n], 6).alias(f"{f}{k}")
                                      for n, (f, k) in enumerate((f, k) for f in ("sin", "cos") for k in range(4))])


_WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(vocab.PIXELS)]


@query(f"""
select vec_id, round(list_sum([cast(x[1] as double) * x[2] for x in list_zip(embedding, {_WEIGHTS}::double[])]), 5) as projected
from embeddings""")
def channel_projection(spark, folder):
    weights = F.array(*[F.lit(w) for w in _WEIGHTS])
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(arrays.dot(F.col("embedding"), weights), 5).alias("projected"))


@query("""
select vec_id, round(sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])), 5) as l2,
  round(cast(list_max([abs(x) for x in embedding]) as double), 6) as linf from embeddings""")
def gradient_norms(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(arrays.norm_l2(F.col("embedding")), 5).alias("l2"),
        F.round(arrays.norm_max(F.col("embedding")).cast("double"), 6).alias("linf"))


@query("""
select event_id, round(case when v < 0.0e0 then 0.0e0 else value end, 6) as pred_GPP_DT, value as pred_NEE,
  v < 0.0e0 as low_light from (select *, case when event_type != 'error' then (value - 50) / 3000 end as v from events)""")
def low_signal_override(spark, folder):
    light = F.when(F.col("event_type") != "error", (F.col("value") - 50) / 3000)
    scored = events(spark, folder).select("event_id", light.alias("sw"), F.col("value").alias("pred_GPP_DT"),
                                          F.col("value").alias("pred_NEE"))
    threshold = scalars.normalise_value("SW_IN", 0.0)
    changed = scalars.override_low_light(["pred_GPP_DT", "pred_NEE"], F.col("sw"), threshold)
    result = scored.withColumn("low_light", F.col("sw") < threshold).withColumns(changed).drop("sw")
    return rounded(result, 6, "pred_GPP_DT")


@query("""
select count(*) filter (event_type != 'error' and value < 50) as overridden, count(*) as n from events""")
def override_count(spark, folder):
    marked = low_signal_override(spark, folder)
    return marked.agg(F.count_if("low_light").alias("overridden"), F.count("*").alias("n"))


@query("""
select event_id, round(case when event_id / 1000.0e0 < 2 then 0.004 * (event_id / 1000.0e0) / 2
  else 0.00001 + (0.004 - 0.00001) * 0.5 * (1 + cos(pi() * (event_id / 1000.0e0 - 2) / 98)) end, 8) as lr from events""")
def lr_schedule(spark, folder):
    epoch = F.col("event_id") / 1000.0
    peak = scalars.scaled_peak(0.001, 512, 1, 2)
    return events(spark, folder).select(
        "event_id", F.round(scalars.learning_rate(epoch, peak, 0.00001, 2, 100), 8).alias("lr"))


@query("""
select event_id, round(greatest(x, 0), 6) as relu, round(least(greatest(x, 0), 6), 6) as relu6,
  round(1 / (1 + exp(-x)), 6) as sigmoid, round(tanh(x), 6) as tanh from (select event_id, (value - 50) / 10 as x from events)""")
def activations(spark, folder):
    x = (F.col("value") - 50) / 10
    return events(spark, folder).select("event_id", *[
        F.round(scalars.activation(n, x), 6).alias(n) for n in ("relu", "relu6", "sigmoid", "tanh")])


@query("""
select p_partkey, case when p_size % 20 not in (13, 16) then label end as at_ingest, label as relabelled,
  cast([1, 0, 0, 1, 1, 1, 1, 1][case when p_size % 12 <= 7 then p_size % 12 else 0 end + 1] as integer) as water from (
  select *, case p_size % 20 when 0 then 'WAT' when 1 then 'ENF' when 2 then 'EBF' when 3 then 'DNF' when 4 then 'DBF'
    when 5 then 'MF' when 6 then 'CSH' when 7 then 'OSH' when 8 then 'WSA' when 9 then 'SAV' when 10 then 'GRA'
    when 11 then 'WET' when 12 then 'CRO' when 13 then 'URB' when 14 then 'CVM' when 15 then 'SNO' when 16 then 'BSV' end as label
  from part)""")
def code_lookup(spark, folder):
    code = F.col("p_size") % 20
    water = arrays.clean_water(F.array(F.col("p_size") % 12))
    return table(spark, folder, "part").select(
        "p_partkey", text.class_of_code(code, True).alias("at_ingest"),
        text.class_of_code(code, False).alias("relabelled"), water[0].cast("int").alias("water"))


@query("""
select event_id, printf('%.4f', value) as pred_NEE, case when event_type = 'error' then 'nan' else printf('%.4f', value * 3) end as gt_NEE,
  printf('%.2f', value) as short from events""")
def format_predictions(spark, folder):
    truth = F.when(F.col("event_type") != "error", F.col("value") * 3)
    return events(spark, folder).select(
        "event_id", text.fixed(F.col("value"), 4).alias("pred_NEE"), text.fixed(truth, 4, "nan").alias("gt_NEE"),
        text.fixed(F.col("value"), 2).alias("short"))


@query("""
select p_partkey, upper(replace(regexp_replace(regexp_replace(name, '^(rmse_|nse_)', ''), '_?dt$', '', 'i'), '_', '')) as label,
  regexp_replace(name, '^rmse_', 'nse_') as partner, replace(name, '_', '\\_') as escaped, '"' || name || '"' as quoted from (
  select p_partkey, case p_size % 3 when 0 then 'rmse_' when 1 then 'nse_' else '' end || replace(p_name, ' ', '_')
    || case p_size % 4 when 0 then '_DT' when 1 then '_NT' when 2 then 'dt' else '' end as name from part)""")
def clean_metric_names(spark, folder):
    size = F.col("p_size")
    front = F.when(size % 3 == 0, "rmse_").when(size % 3 == 1, "nse_").otherwise("")
    back = F.when(size % 4 == 0, "_DT").when(size % 4 == 1, "_NT").when(size % 4 == 2, "dt").otherwise("")
    name = F.concat(front, F.regexp_replace("p_name", " ", "_"), back)
    return table(spark, folder, "part").select("p_partkey", name.alias("name")).select(
        "p_partkey", text.metric_label(F.col("name")).alias("label"), text.partner_metric(F.col("name")).alias("partner"),
        text.escape_underscores(F.col("name")).alias("escaped"), text.quote_identifier(F.col("name")).alias("quoted"))


@query("""
with f as (select page_id, string_split(url || ',' || page_id || '_IR_1.jpg,' || replace(url, 'page', '_IR_'), ',') as parts from pages)
select page_id, len([p for p in parts if contains(p, '_IR_')]) as n_ir, len([p for p in parts if not contains(p, '_IR_')]) as n_rgb,
  [p for p in parts if contains(p, '_IR_')][1] as first_ir, [p for p in parts if not contains(p, '_IR_')][1] as first_rgb from f""")
def split_file_lists(spark, folder):
    pages = table(spark, folder, "pages")
    files = F.concat(F.col("url"), F.lit(","), F.col("page_id").cast("string"), F.lit("_IR_1.jpg,"),
                     F.replace("url", F.lit("page"), F.lit("_IR_")))
    split = pages.select("page_id", text.infrared_files(files).alias("ir"), text.colour_files(files).alias("rgb"))
    return split.select(
        "page_id", F.size("ir").cast("long").alias("n_ir"), F.size("rgb").cast("long").alias("n_rgb"),
        F.try_element_at(arrays.first_or_empty(F.col("ir")), F.lit(1)).alias("first_ir"),
        F.try_element_at(arrays.first_or_empty(F.col("rgb")), F.lit(1)).alias("first_rgb"))


@query("""
with v as (select o_orderkey, cast(round(o_totalprice * power(10, o_orderkey % 9)) as bigint) as b, cast(round(o_totalprice / 40) as bigint) as s from orders)
select o_orderkey, case when b < 1024 then printf('%d B', b) when b < 1048576 then printf('%.1f KiB', b / 1024.0e0)
    when b < 1073741824 then printf('%.1f MiB', b / 1048576.0e0) when b < 1099511627776 then printf('%.1f GiB', b / 1073741824.0e0)
    else printf('%.1f TiB', b / 1099511627776.0e0) end as size,
  case when s >= 3600 then printf('%dh%02dm%02ds', s // 3600, s // 60 % 60, s % 60)
    when s >= 60 then printf('%dm%02ds', s // 60, s % 60) else printf('%ds', s) end as duration,
  format('{:,}', b) as grouped from v""")
def humanize(spark, folder):
    # powers of ten as a lookup: exact in both engines
    powers = F.array(*[F.lit(float(10 ** n)) for n in range(9)])
    size = F.round(F.col("o_totalprice") * F.element_at(powers, (F.col("o_orderkey") % 9 + 1).cast("int"))).cast("long")
    seconds = F.round(F.col("o_totalprice") / 40).cast("long")
    return table(spark, folder, "orders").select(
        "o_orderkey", text.human_bytes(size).alias("size"), text.human_duration(seconds).alias("duration"),
        text.thousands(size).alias("grouped"))


@query("""
with t as (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as flat from documents)
select doc_id, case when length(flat) > 40 then substr(flat, 1, 37) || '...' else flat end as short, md5(flat) as whole from t""")
def compact_text(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", text.compact(F.col("text"), 40).alias("short"),
                       F.md5(text.compact(F.col("text"), 0)).alias("whole"))


@query("""
select coord_id, case when a = 0 then '0°' when abs(a) = 180 then '180°' when a < 0 then abs(a) || '°W' else a || '°E' end as lon_label,
  case when b = 0 then '0°' when b < 0 then abs(b) || '°S' else b || '°N' end as lat_label from (
  select c_custkey as coord_id, cast(c_custkey * 7 % 361 - 180 as bigint) as a, cast(c_custkey * 5 % 181 - 90 as bigint) as b from customer)""")
def degree_labels(spark, folder):
    key = F.col("coord_id")
    return customers_on_the_map(spark, folder).select(
        "coord_id", text.degree_label(key * 7 % 361 - 180, True).alias("lon_label"),
        text.degree_label(key * 5 % 181 - 90, False).alias("lat_label"))


@query("""
select c_custkey, printf('rank_%05d.csv', c_custkey) as shard, strftime(date '2017-06-01' + cast(c_custkey % 900 as integer), '%Y%m%d')
  || '1200A4.tiff' as raster, len(list_distinct(['BUILDING', upper(trim(c_mktsegment)), 'MACHINERY'])) as names from customer""")
def file_names(spark, folder):
    day = F.date_add(F.lit("2017-06-01").cast("date"), (F.col("c_custkey") % 900).cast("int"))
    names = text.upper_unique(F.array(F.lit("Building"), F.col("c_mktsegment"), F.lit(" machinery ")))
    return table(spark, folder, "customer").select(
        "c_custkey", text.shard_name(F.col("c_custkey")).alias("shard"),
        text.raster_name(day, F.lit("A4")).alias("raster"), F.size(names).cast("long").alias("names"))


_LEGEND = ", ".join(f"('{c}', '{colour}', '{name}')" for c, colour, name in vocab.LEGEND)


@query(f"""
with named as (select c_custkey, coalesce(case when c_nationkey < 17 then l.label end, 'X' || c_nationkey) as label from customer
  left join (values {', '.join(f"({k}, '{v}')" for k, v in vocab.CLASS_OF_CODE.items())}) l(code, label) on l.code = c_nationkey)
select c_custkey, n.label, coalesce(g.colour, {list(vocab.FALLBACK_COLOURS)}[c_custkey % 8 + 1]) as colour, coalesce(g.name, n.label) as name
from named n left join (values {_LEGEND}) g(label, colour, name) on g.label = n.label""")
def class_colours(spark, folder):
    label = F.coalesce(text.class_of_code(F.col("c_nationkey"), False),
                       F.concat(F.lit("X"), F.col("c_nationkey").cast("string")))
    return table(spark, folder, "customer").select("c_custkey", label.alias("label")).withColumns({
        "colour": text.class_colour(F.col("label"), F.col("c_custkey")), "name": text.class_name(F.col("label"))})


@query(" union all ".join(
    f"select '{name}' as name, '{kind}' as type, count({name}) as present, cast(min({name}) as varchar) as low, "
    f"cast(max({name}) as varchar) as high from customer" for name, kind in (
        ("c_acctbal", "double"), ("c_custkey", "bigint"), ("c_mktsegment", "string"), ("c_name", "string"),
        ("c_nationkey", "int"))))
def describe_table(spark, folder):
    from fluxframe.sources.tables import describe

    return describe(table(spark, folder, "customer"))
