"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe import vocab
from fluxframe.functions import scalars, text
from fluxframe.operators import metrics, ordering, samples
from fluxframe.plans import evaluation
from fluxframe.queries.registry import events, query, rounded
from fluxframe.sources.tables import table

#: lineitem as scored samples: some truths are missing, two targets.
_SCORED = """(select cast(l_suppkey as varchar) as site, 'class ' || (l_suppkey % 5) as igbp,
  case when l_discount > 0.02e0 then l_extendedprice / 1000.0e0 end as y, l_quantity * 1.1e0 as p,
  l_tax * 100.0e0 as y2, l_discount * 90.0e0 as p2 from lineitem)"""


def scored_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("site"),
        F.concat(F.lit("class "), (F.col("l_suppkey") % 5).cast("string")).alias("igbp"),
        F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice") / 1000.0).alias("gt_NEE"),
        (F.col("l_quantity") * 1.1).alias("pred_NEE"), (F.col("l_tax") * 100.0).alias("gt_LE"),
        (F.col("l_discount") * 90.0).alias("pred_LE"))


@query(f"""
select site, round(sum((p - y) * (p - y)), 3) as sse_NEE, count(y) as n_NEE, round(sum(y), 5) as sy_NEE,
  round(sum(y * y), 3) as syy_NEE from {_SCORED} where true group by site""")
def partial_sums_site(spark, folder):
    sums = metrics.partial_sums(scored_lines(spark, folder), ["site"], ["NEE"])
    return rounded(rounded(sums, 3, "sse_NEE", "syy_NEE"), 5, "sy_NEE")


def _closed(p: str, y: str) -> str:
    return f"""round_even(sqrt(sum(({p} - {y}) * ({p} - {y})) / nullif(count({y}), 0)), 4) as rmse,
  case when count({y}) > 1 and sum({y} * {y}) - sum({y}) * sum({y}) / count({y}) > 0 then
    round_even(1 - sum(({p} - {y}) * ({p} - {y})) / (sum({y} * {y}) - sum({y}) * sum({y}) / count({y})), 4) end as nse"""


@query(f"""
with s as {_SCORED},
g as (select site, min(igbp) as igbp, count(*) as num_samples, round_even(avg(coalesce((p - y) * (p - y), 0)), 4) as avg_loss,
  {_closed('p', 'y').replace('as rmse', 'as rmse_NEE').replace('as nse', 'as nse_NEE')},
  {_closed('p2', 'y2').replace('as rmse', 'as rmse_LE').replace('as nse', 'as nse_LE')}
  from s group by grouping sets ((site), ())),
b as (select sum(ceil(n / 512.0)) as total from (select count(*) as n from s group by site))
select coalesce(site, 'TOTAL') as site, case when site is not null then igbp end as igbp,
  cast(case when site is not null then ceil(num_samples / 512.0) else b.total end as bigint) as num_batches, num_samples,
  avg_loss, rmse_NEE, rmse_LE, nse_NEE, nse_LE from g, b""")
def rmse_nse_site_total(spark, folder):
    scored = scored_lines(spark, folder)
    loss = F.coalesce(F.pow(F.col("pred_NEE") - F.col("gt_NEE"), 2), F.lit(0.0))
    return metrics.evaluate_sites(scored.withColumn("loss", loss), ["NEE", "LE"], loss="loss", batch=512)


@query(f"""
with per as (select site, min(igbp) as igbp, sqrt(sum((p - y) * (p - y)) / count(y)) as rmse_NEE from {_SCORED} group by site)
select igbp, round(avg(rmse_NEE), 5) as rmse_NEE from per group by igbp""")
def class_macro_mean(spark, folder):
    per_site = metrics.evaluate_sites(scored_lines(spark, folder), ["NEE"], digits=None)
    return rounded(metrics.class_means(per_site, ["rmse_NEE"]), 5, "rmse_NEE")


@query(f"""
select round(coalesce(avg(pow(p - y, 2)), 0), 4) as mse_NEE, round(coalesce(avg(pow(p2 - y2, 2)), 0), 4) as mse_LE,
  round(coalesce(avg(pow(p - y, 2)), 0) + coalesce(avg(pow(p2 - y2, 2)), 0), 4) as loss from {_SCORED}""")
def masked_mse(spark, folder):
    return rounded(metrics.masked_mse(scored_lines(spark, folder), ["NEE", "LE"]), 4, "mse_NEE", "mse_LE", "loss")


@query("""
with b as (select user_id as site, event_id, value as p, case when event_type != 'error' then value * 0.8e0 + 3.0e0 end as y,
  (row_number() over (partition by user_id order by event_id) - 1) // 32 as batch from events),
l as (select site, batch, coalesce(avg(pow(p - y, 2)), 0) as loss, count(*) as n from b group by all)
select site, count(*) as num_batches, cast(sum(n) as bigint) as num_samples, round(sum(loss * n), 3) as total_loss
from l group by site""")
def batch_losses(spark, folder):
    scored = events(spark, folder).select(
        F.col("user_id").alias("site"), F.col("event_id").alias("id"), F.col("value").alias("pred_NEE"),
        F.when(F.col("event_type") != "error", F.col("value") * 0.8 + 3.0).alias("gt_NEE"))
    return rounded(evaluation.batch_losses(scored, ["NEE"], 32), 3, "total_loss")


@query("""
with b as (select user_id as site, event_id, value as p, case when event_type != 'error' then value * 0.8e0 + 3.0e0 end as y,
  (row_number() over (partition by user_id order by event_id) - 1) // 32 as batch from events),
l as (select site, batch, coalesce(avg(pow(p - y, 2)), 0) as loss, count(*) as n from b group by all),
t as (select site, count(*) as num_batches, round_even(sum(loss * n) / sum(n), 4) as avg_loss from l group by grouping sets ((site), ())),
m as (select b.site, count(*) as num_samples, round_even(sqrt(sum((p - y) * (p - y)) / count(y)), 4) as rmse_NEE
      from b group by grouping sets ((b.site), ()))
select coalesce(cast(m.site as varchar), 'TOTAL') as site, t.num_batches, m.num_samples, t.avg_loss, m.rmse_NEE
from m join t on t.site is not distinct from m.site""")
def site_evaluation(spark, folder):
    scored = events(spark, folder).select(
        F.col("user_id").cast("string").alias("site"), F.lit("X").alias("igbp"), F.col("event_id").alias("id"),
        F.col("value").alias("pred_NEE"), F.when(F.col("event_type") != "error", F.col("value") * 0.8 + 3.0).alias("gt_NEE"))
    return evaluation.evaluate(scored, ["NEE"], 32).drop("igbp", "nse_NEE")


@query("""
select l_suppkey as site, coalesce(min(flag), 'unknown') as igbp, greatest(count(distinct flag), 1) as classes
from (select l_suppkey, case when l_suppkey % 3 > 0 then l_returnflag end as flag from lineitem) group by all""")
def site_class_check(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_returnflag")).alias("igbp"))
    return metrics.site_classes(lines)


@query("""
select round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as avg_loss from lineitem""")
def weighted_loss(spark, folder):
    return rounded(metrics.weighted_loss(table(spark, folder, "lineitem"), "l_discount", "l_quantity"), 6, "avg_loss")


@query("""
select l_returnflag, round(avg(0.5 * ln(2 * pi() * pow(greatest(l_tax * 50, 1e-6), 2))
  + 0.5 * pow(l_quantity - l_discount * 500, 2) / pow(greatest(l_tax * 50, 1e-6), 2)) filter (l_tax > 0), 5) as nll
from lineitem group by all""")
def gaussian_nll(spark, folder):
    lines = table(spark, folder, "lineitem")
    nll = scalars.gaussian_nll(F.col("l_quantity"), F.col("l_discount") * 500, F.col("l_tax") * 50)
    return rounded(lines.groupBy("l_returnflag").agg(
        F.avg(F.when(F.col("l_tax") > 0, nll)).alias("nll")), 5, "nll")


@query(f"""
with t as (select sqrt(sum((p - y) * (p - y)) / count(y)) as rmse, 1 - sum((p - y) * (p - y)) /
    (sum(y * y) - sum(y) * sum(y) / count(y)) as nse, 'NEE' as target from {_SCORED}
  union all select sqrt(sum((p2 - y2) * (p2 - y2)) / count(y2)), 1 - sum((p2 - y2) * (p2 - y2)) /
    (sum(y2 * y2) - sum(y2) * sum(y2) / count(y2)), 'LE' from {_SCORED})
select target as "Target", round_even(rmse, 4) as "RMSE", round_even(nse, 4) as "NSE" from t""")
def overall_table(spark, folder):
    return metrics.overall_table(metrics.evaluate_sites(scored_lines(spark, folder), ["NEE", "LE"]))


_CLASS_OF = "case (c_nationkey + 3) " + " ".join(
    f"when {k} then '{v}'" for k, v in vocab.CLASS_OF_CODE.items()) + " end"
_EARLIER = "(values " + ", ".join(
    f"('{c}', {na}, {ra}, {nb}, {rb})" for c, na, ra, nb, rb in vocab.EARLIER_SCORES) + ") e(igbp, nse_a, rmse_a, nse_b, rmse_b)"
_CURRENT = f"""(select igbp, round_even(avg(r), 4) as rmse_c, round_even(avg(n), 4) as nse_c from (
  select {_CLASS_OF} as igbp, case when c_acctbal > 0 then c_acctbal / 2000.0e0 end as r, c_acctbal / 10000.0e0 as n from customer)
  where igbp is not null group by igbp)"""


def _current(spark, folder):
    as_sites = table(spark, folder, "customer").select(
        text.class_of_code(F.col("c_nationkey") + 3, at_ingest=False).alias("igbp"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 2000.0).alias("rmse_c"),
        (F.col("c_acctbal") / 10000.0).alias("nse_c"))
    means = metrics.class_means(as_sites, ["rmse_c", "nse_c"])
    return means.withColumns({c: F.bround(c, 4) for c in ("rmse_c", "nse_c")})


@query(f"""
select coalesce(c.igbp, e.igbp) as igbp, rmse_a, rmse_b, rmse_c, nse_a, nse_b, nse_c,
  least(rmse_a, rmse_b, rmse_c) as best_rmse, greatest(nse_a, nse_b, nse_c) as best_nse
from {_CURRENT} c full join (select igbp, cast(nse_a as double) as nse_a, cast(rmse_a as double) as rmse_a,
  cast(nse_b as double) as nse_b, cast(rmse_b as double) as rmse_b from {_EARLIER}) e on c.igbp = e.igbp""")
def full_outer_compare(spark, folder):
    compared = metrics.compare_models(_current(spark, folder), metrics.earlier_scores(spark))
    return compared.select("igbp", "rmse_a", "rmse_b", "rmse_c", "nse_a", "nse_b", "nse_c", "best_rmse", "best_nse")


def _marked(metric: str, model: str, best: str) -> str:
    v = f"{metric}_{model}"
    shown = f"printf('%.4f', cast({v} as double))"
    return (f"case when {v} is null then '--' when {v} = {best}({metric}_a, {metric}_b, {metric}_c) "
            f"then '\\textbf{{' || {shown} || '}}' else {shown} end as {v}")


@query(f"""
with j as (select coalesce(c.igbp, e.igbp) as igbp, cast(rmse_a as double) as rmse_a, cast(rmse_b as double) as rmse_b, rmse_c,
    cast(nse_a as double) as nse_a, cast(nse_b as double) as nse_b, nse_c
  from {_CURRENT} c full join {_EARLIER} on c.igbp = e.igbp)
select igbp, {', '.join(_marked('rmse', m, 'least') for m in 'abc')},
  {', '.join(_marked('nse', m, 'greatest') for m in 'abc')} from j""")
def mark_winners(spark, folder):
    return metrics.mark_winners(metrics.compare_models(_current(spark, folder), metrics.earlier_scores(spark)))


@query("""
with kept as (select e.event_id, e.user_id, e.ts, e.value / 100.0e0 - 0.5e0 as v from events e
  where not exists (select 1 from customer c where c.c_custkey = e.user_id and c.c_mktsegment = 'MACHINERY')),
cleaned as (select event_id, user_id, ts, case when v between -0.5 and 0.5 then v end as v from kept),
framed as (select event_id, user_id, ts, v as y, avg(v) over w as p, row_number() over (
    partition by user_id order by ts, event_id) as n
  from cleaned window w as (partition by user_id order by ts, event_id rows between 7 preceding and current row)),
m as (select f.user_id, min(c.c_mktsegment) as igbp, count(*) as num_samples,
    sum((p - y) * (p - y)) as sse, count((p - y)) as k, sum(case when p is not null then y end) as sy,
    sum(case when p is not null then y * y end) as syy
  from framed f join customer c on c.c_custkey = f.user_id where n >= 8 group by grouping sets ((f.user_id), ()))
select case when user_id is null then 'TOTAL' else cast(user_id as varchar) end as site,
  case when user_id is not null then igbp end as igbp, num_samples,
  round_even(sqrt(sse / nullif(k, 0)), 4) as rmse_value,
  case when k > 1 and syy - sy * sy / k > 0 then round_even(1 - sse / (syy - sy * sy / k), 4) end as nse_value from m""")
def flagship(spark, folder):
    """Exclude a class, normalise, predict each value by the mean of its window,
    and score that per user and in total."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("igbp"))
    facts = events(spark, folder).select("event_id", "user_id", "ts", scalars.normalise("RH", F.col("value")).alias("v"))
    kept = samples.without_classes(facts, customers, ["MACHINERY"], key="user_id")
    framed = ordering.over_last_rows(kept, ["user_id"], ["ts", "event_id"], 8,
                                     {"pred_value": F.avg("v"), "n": F.count("*")})
    scored = samples.dim_lookup(framed.where("n = 8").withColumnRenamed("v", "gt_value"), customers, "user_id")
    results = metrics.evaluate_sites(scored.withColumn("site", F.col("user_id").cast("string")), ["value"])
    return results.select("site", "igbp", "num_samples", "rmse_value", "nse_value")
