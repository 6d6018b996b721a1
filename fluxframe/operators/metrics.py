"""Evaluation: mergeable partial sums, RMSE and NSE, class means, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxframe import schema, vocab
from fluxframe.functions import text

PARTIALS = ("sse", "n", "sy", "syy")


def partial_sums(scored: DataFrame, keys: Sequence[str], targets: Sequence[str], truth: str = "gt_",
                 predicted: str = "pred_", extra: Sequence[Column] = ()) -> DataFrame:
    """Per key and target: squared error, count, sum and sum of squares of truth.

    Only pairs in which both numbers are finite count. The sums add up, so
    Spark combines them in the map tasks and a hot key costs nothing extra.
    """
    sums = []
    for t in targets:
        y, p = F.col(truth + t).cast("double"), F.col(predicted + t).cast("double")
        usable = schema.finite(y) & schema.finite(p)
        sums += [F.sum(F.when(usable, (p - y) * (p - y))).alias(f"sse_{t}"),
                 F.count(F.when(usable, True)).alias(f"n_{t}"),
                 F.sum(F.when(usable, y)).alias(f"sy_{t}"),
                 F.sum(F.when(usable, y * y)).alias(f"syy_{t}")]
    return scored.groupBy(*keys).agg(*sums, *extra)


def site_classes(scored: DataFrame, site: str = "site", label: str = "igbp") -> DataFrame:
    """The class of each site and how many it has; more than one is suspicious.

    A site without any class is of the class ``unknown``.
    """
    pairs = scored.select(site, label).distinct()
    return pairs.groupBy(site).agg(F.coalesce(F.min(label), F.lit(vocab.UNKNOWN_CLASS)).alias(label),
                                   F.greatest(F.count(label), F.lit(1)).alias("classes"))


def rmse(t: str) -> Column:
    return F.sqrt(F.try_divide(F.col(f"sse_{t}"), F.col(f"n_{t}")))


def nse(t: str) -> Column:
    """1 - SSE / spread of the truth; needs two values and a positive spread."""
    spread = F.col(f"syy_{t}") - F.try_divide(F.col(f"sy_{t}") * F.col(f"sy_{t}"), F.col(f"n_{t}"))
    return F.when((F.col(f"n_{t}") > 1) & (spread > 0), 1.0 - F.try_divide(F.col(f"sse_{t}"), spread))


def evaluate_sites(scored: DataFrame, targets: Sequence[str], site: str = "site", label: str = "igbp",
                   loss: str | None = None, batch: int | None = None, digits: int | None = 4) -> DataFrame:
    """One row per site and a TOTAL row pooled over all of them.

    The data is summed per site and class, by hash since all sums are numbers;
    sites and the total are then rolled up from that small table. ``loss`` is a
    per-sample loss to average.
    """
    extra = [F.count("*").alias("__rows"),
             (F.sum(loss) if loss else F.lit(None).cast("double")).alias("__loss")]
    small = partial_sums(scored, [site, label], targets, extra=extra)
    names = [f"{p}_{t}" for t in targets for p in PARTIALS] + ["__rows", "__loss"]
    per_site = small.groupBy(site).agg(F.min(label).alias(label), *[F.sum(n).alias(n) for n in names])
    batches = F.ceil(F.col("__rows") / batch) if batch else F.lit(None)
    per_site = per_site.withColumn("num_batches", batches.cast("long"))
    both = per_site.rollup(site).agg(
        F.grouping(site).alias("__total"), F.min(label).alias(label),
        *[F.sum(n).alias(n) for n in [*names, "num_batches"]]).withColumnRenamed("__rows", "num_samples")

    def shown(value: Column) -> Column:
        return value if digits is None else F.bround(value, digits)

    is_total = F.col("__total") == 1
    return both.select(
        F.when(is_total, F.lit("TOTAL")).otherwise(F.col(site).cast("string")).alias(site),
        F.when(~is_total, F.coalesce(label, F.lit(vocab.UNKNOWN_CLASS))).alias(label),
        "num_batches", "num_samples",
        shown(F.try_divide(F.col("__loss"), F.col("num_samples"))).alias("avg_loss"),
        *[shown(rmse(t)).alias(f"rmse_{t}") for t in targets],
        *[shown(nse(t)).alias(f"nse_{t}") for t in targets])


def class_means(metrics: DataFrame, columns: Sequence[str], label: str = "igbp") -> DataFrame:
    """Mean of per-site metrics by class: every site weighs the same.

    Rows without a class, hence also the TOTAL row, are left out.
    """
    present = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]
    return metrics.where(F.col(label).isNotNull()).groupBy(label).agg(*present)


def class_table(metrics: DataFrame, prefix: str, label: str = "igbp") -> DataFrame:
    columns = schema.with_prefix(metrics, prefix + "_")
    if not columns:
        raise ValueError(f"no {prefix}_* columns")
    means = class_means(metrics, columns, label)
    return means.select(F.col(label).alias("IGBP"),
                        *[F.col(c).alias(text.metric_label_of(c)) for c in columns]).orderBy("IGBP")


def overall_table(metrics: DataFrame, site: str = "site") -> DataFrame:
    """(Target, RMSE, NSE) of the TOTAL row, or of one row where there is none."""
    names = schema.with_prefix(metrics, "rmse_")
    if not names:
        raise ValueError("no rmse_* columns")
    if site in metrics.columns:
        metrics = metrics.orderBy(F.when(F.lower(site) == "total", 0).otherwise(1))
    rows = []
    for position, c in enumerate(names):
        partner = c.replace("rmse_", "nse_", 1)
        other = F.col(partner) if partner in metrics.columns else F.lit(None)
        rows.append(F.struct(F.lit(position).alias("__n"), F.lit(text.metric_label_of(c)).alias("Target"),
                             F.col(c).cast("double").alias("RMSE"), other.cast("double").alias("NSE")))
    return (metrics.limit(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .orderBy("__n").drop("__n"))


def earlier_scores(spark) -> DataFrame:
    """The two earlier models' published scores, one row per class."""
    return spark.createDataFrame(list(vocab.EARLIER_SCORES),
                                 "igbp string, nse_a double, rmse_a double, nse_b double, rmse_b double")


def compare_models(current: DataFrame, earlier: DataFrame, label: str = "igbp") -> DataFrame:
    """Current class means beside earlier scores; classes of either side are kept.

    ``current`` has ``rmse_c`` and ``nse_c``. Adds the best value of each metric.
    """
    joined = current.join(earlier, label, "full_outer")
    return joined.withColumns({
        "best_rmse": F.least("rmse_a", "rmse_b", "rmse_c"),
        "best_nse": F.greatest("nse_a", "nse_b", "nse_c")})


def mark_winners(compared: DataFrame, digits: int = 4, missing: str = "--", label: str = "igbp") -> DataFrame:
    """Text cells with every best value in bold."""
    cells = {}
    for metric in ("rmse", "nse"):
        for model in ("a", "b", "c"):
            c = f"{metric}_{model}"
            shown = text.fixed(F.col(c), digits, missing)
            cells[c] = F.when(F.col(c) == F.col(f"best_{metric}"), text.bold(shown)).otherwise(shown)
    return compared.select(label, *[v.alias(k) for k, v in cells.items()]).orderBy(label)


def masked_mse(scored: DataFrame, targets: Sequence[str], truth: str = "gt_", predicted: str = "pred_",
               keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Mean squared error per target over present truths (0 if none), and their sum."""
    per = [F.coalesce(F.avg(F.when(~F.isnan(truth + t), F.pow(F.col(predicted + t) - F.col(truth + t), 2))),
                      F.lit(0.0)).alias(f"mse_{t}") for t in targets]
    table = scored.groupBy(*keys).agg(*per, *extra)
    return table.withColumn("loss", sum((F.col(f"mse_{t}") for t in targets), F.lit(0.0)))


def weighted_loss(batches: DataFrame, loss: str, samples: str) -> DataFrame:
    return batches.agg(F.try_divide(F.sum(F.col(loss) * F.col(samples)), F.sum(samples)).alias("avg_loss"))
