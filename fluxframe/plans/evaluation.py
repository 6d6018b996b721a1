"""Site evaluation and its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluxframe.operators import metrics
from fluxframe.operators.ordering import keyed_join, running_count
from fluxframe.sources import writers


def batch_losses(scored: DataFrame, targets: Sequence[str], batch: int, site: str = "site",
                 order: Sequence[str] = ("id",)) -> DataFrame:
    """Per site: batches, samples, and the mean batch loss weighted by samples.

    Batches are consecutive samples of a site, the last one may be short.
    """
    counted = running_count(scored, [site], order, "__rn")
    batched = counted.withColumn("__batch", F.floor((F.col("__rn") - 1) / batch))
    losses = metrics.masked_mse(batched, targets, keys=[site, "__batch"], extra=[F.count("*").alias("__n")])
    return losses.groupBy(site).agg(
        F.count("*").alias("num_batches"), F.sum("__n").alias("num_samples"),
        F.sum(F.col("loss") * F.col("__n")).alias("total_loss"))


def evaluate(scored: DataFrame, targets: Sequence[str], batch: int = 2048, site: str = "site",
             order: Sequence[str] = ("id",), digits: int = 4) -> DataFrame:
    """Per-site metrics and TOTAL with the loss as a training run reports it:
    the mean over batches of the summed per-target errors, weighted by samples.

    ``scored`` is read more than once, so it should be a stored table and not
    the network's output as it comes.
    """
    results = metrics.evaluate_sites(scored, targets, site, digits=digits).drop("avg_loss", "num_batches")
    losses = batch_losses(scored, targets, batch, site, order)
    # both sides have one row per site
    summed = losses.rollup(site).agg(
        F.grouping(site).alias("__total"), F.sum("num_batches").alias("num_batches"),
        F.bround(F.try_divide(F.sum("total_loss"), F.sum("num_samples")), digits).alias("avg_loss"))
    named = summed.select(F.when(F.col("__total") == 1, "TOTAL").otherwise(F.col(site).cast("string")).alias(site),
                          "num_batches", "avg_loss")
    joined = keyed_join(results, named, [site], "inner")
    return joined.select(site, "igbp", "num_batches", "num_samples", "avg_loss",
                         *[c for c in results.columns if c.startswith(("rmse_", "nse_"))])


def report(results: DataFrame, earlier: DataFrame, digits: int = 4, missing: str = "--",
           names: Sequence[str] = ("Model A", "Model B", "Current")) -> dict[str, str]:
    """The LaTeX tables: overall, RMSE by class, NSE by class, comparison."""
    current = metrics.class_means(results, ["rmse_NEE", "nse_NEE"])
    current = current.select("igbp", F.bround("rmse_NEE", digits).alias("rmse_c"),
                             F.bround("nse_NEE", digits).alias("nse_c"))
    marked = metrics.mark_winners(metrics.compare_models(current, earlier), digits, missing)
    shown = marked.select(F.col("igbp").alias("IGBP"),
                          *[F.col(f"{m}_{k}").alias(f"{m.upper()} {k}") for k in "abc" for m in ("rmse", "nse")])
    return {
        "overall": writers.latex_table(metrics.overall_table(results), "Overall results.", "tab:overall",
                                       digits, missing),
        "rmse": writers.latex_table(metrics.class_table(results, "rmse"), "RMSE by class.", "tab:rmse",
                                    digits, missing),
        "nse": writers.latex_table(metrics.class_table(results, "nse"), "NSE by class.", "tab:nse",
                                   digits, missing),
        "comparison": writers.latex_table(shown, "Comparison by class.", "tab:comparison", digits, missing,
                                          groups=[("", 1)] + [(n, 2) for n in names]),
    }
