"""Command line: ``python -m fluxframe <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from fluxframe.functions import scalars
from fluxframe.operators import dims, layout, merge, metrics, network, spatial
from fluxframe.plans import enrichment, evaluation, image_store, ingest, scoring
from fluxframe.session import build_session, settle
from fluxframe.sources import colocated, footers, rankfiles, shards, tables, writers


def _weights(path: str) -> dict:
    import numpy as np

    with np.load(path) as stored:
        return {k.replace("__", "/"): stored[k] for k in stored.files}


def score(spark, a) -> None:
    config = tables.load_config(a.config)
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in config.items()
             if k in network.NetConfig.__dataclass_fields__}
    cfg = network.NetConfig(**known)
    images = spark.read.parquet(f"{a.data}/modis_data.parquet") if a.images else None
    scored = scoring.score_grid(
        tables.clean_table(spark, f"{a.data}/ec_data.parquet"), spark.read.parquet(f"{a.data}/coord_data.parquet"),
        images, _weights(a.weights), cfg, a.start_date, a.end_date, a.exclude_igbp or (), a.prediction_targets,
        a.gpp_solar_threshold, a.max_samples, numbered=a.sample_order or a.num_shards is not None)
    targets = [c.removeprefix("pred_") for c in scored.columns if c.startswith("pred_")]
    if a.num_shards is not None:
        rankfiles.write_rank_files(writers.formatted_predictions(settle(scored), targets), a.output, a.num_shards)
        return
    ordered = scored.orderBy(*scoring.ORDER)
    writers.write_csv(writers.formatted_predictions(ordered, targets), a.output)


def ingest_grid(spark, a) -> None:
    raw, mask, cover = (spark.read.parquet(p) for p in (a.raw, a.mask, a.cover))
    facts, dim = ingest.build_dataset(raw, mask, cover, _frame(a), tuple(a.mask_origin), tuple(a.mask_step),
                                      tuple(int(n) for n in a.mask_size), strict_bounds=not a.plain_bounds)
    facts = settle(facts)
    writers.write_tables(facts, dims.require_key(dim, "coord_id"), a.output)


def images(spark, a) -> None:
    path = f"{a.data}/modis_data.parquet"
    dim = spark.read.parquet(f"{a.data}/coord_data.parquet")
    facts = spark.read.parquet(f"{a.data}/ec_data.parquet") if a.active_only else None
    image_store.create_store(spark, path)
    counts = image_store.store_images(spark, path, ingest.image_cells(spark.read.parquet(a.cells), dim, facts), a.overwrite)
    print(f"matched {counts['matched']}, written {counts['written']}")


def enrich(spark, a) -> None:
    done = enrichment.enrich(
        spark.read.parquet(f"{a.data}/ec_data.parquet"), spark.read.parquet(f"{a.data}/coord_data.parquet"),
        spark.read.parquet(a.cover), _frame(a), spark.read.parquet(a.cells), a.data, a.steps, a.overwrite,
        a.active_only, a.dry_run)
    print("\n".join(done))


def _frame(a) -> ingest.RasterFrame:
    west, north, step, rows, cols = a.frame
    return ingest.RasterFrame(west, north, step, int(rows), int(cols))


def evaluate(spark, a) -> None:
    scored = spark.read.parquet(a.scored)
    targets = [c.removeprefix("gt_") for c in scored.columns if c.startswith("gt_")]
    results = evaluation.evaluate(scored, targets, a.batch_size, order=a.order)
    # one row per site
    writers.write_csv(results.orderBy(F.col("site") == "TOTAL", "site"), a.output, single_file=True)


def report(spark, a) -> None:
    results = shards.read_metrics(spark, a.metrics)
    made = evaluation.report(results, metrics.earlier_scores(spark), a.decimals, a.nan_token)
    for name, content in made.items():
        writers.write_text(content, "-" if a.output == "-" else f"{a.output}/{name}.tex")


def merge_shards(spark, a) -> None:
    rows = shards.read_shards(spark, shards.shard_paths(spark, a.shards, a.num_shards), strict=a.format == "csv")
    columns = merge.output_columns(rows.drop(*shards.POSITION), a.prediction_targets)
    if a.format == "csv":
        kept = merge.in_output_order(rows) if a.sort else rows
        writers.write_csv(kept.select(*columns), a.output)
        return
    numbers = merge.require_coordinates(merge.numeric_output(rows))
    unique, counts = merge.settle_unique(numbers, a.duplicates, shards.POSITION)
    variables = [c for c in columns if c.startswith(("pred_", "gt_"))]
    attributes = merge.cube_attributes(counts, len(set(rows.inputFiles())), a.duplicates)
    labels = [c for c in ("igbp",) if c in unique.columns]
    writers.write_cube(merge.dense_cube(unique, variables, labels=labels), attributes, a.output)


def relabel(spark, a) -> None:
    west, north, step, rows, cols = a.frame
    plan = dims.relabel(spark.read.parquet(a.dim), spark.read.parquet(a.cover), west, north, step, int(rows), int(cols),
                        a.only_null)
    dims.top_transitions(plan.where("sampled"), "igbp", "new_label").show(20, False)
    if a.write:
        writers.replace_table(dims.apply_labels(plan), a.write)


def cluster(spark, a) -> None:
    facts = spark.read.parquet(a.facts)
    facts = layout.rebuild_ids(facts) if a.rebuild_ids else facts
    if a.dim:
        colocated.colocate(facts, spark.read.parquet(a.dim), a.output, a.buckets)
        return
    writers.replace_table(layout.clustered(facts), a.output)


def bins(spark, a) -> None:
    from fluxframe.functions.geo import MapFrame

    frame = MapFrame.fit(a.projection, 72.0, 20.0, float(a.width - 25), float(a.height - 70))
    writers.replace_table(spatial.pixel_bins(spark.read.parquet(a.dim), frame), a.output)


def describe(spark, a) -> None:
    df = spark.read.parquet(a.path)
    print(tables.dataset_layout(df))
    if "id" in df.columns:
        print(footers.footer_estimate(spark, a.path).first().asDict())
    columns = tables.describe(df)
    columns.show(columns.count(), False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fluxframe")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *needed):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        return c

    def frame_of(c):
        c.add_argument("--frame", nargs=5, type=float, required=True, metavar=("WEST", "NORTH", "STEP", "ROWS", "COLS"))

    # Option names that users know.
    c = command("score", score, "data", "config", "weights", "output")
    c.add_argument("--images", action="store_true")
    for n in ("start-date", "end-date"):
        c.add_argument(f"--{n}")
    c.add_argument("--exclude-igbp", nargs="*")
    c.add_argument("--prediction-targets", nargs="*")
    c.add_argument("--gpp-solar-threshold", type=float)
    c.add_argument("--max-samples", type=int)
    c.add_argument("--sample-order", action="store_true", help="write the position of every sample")
    c.add_argument("--num-shards", type=int, help="write as many files, each a stretch of the sample order")
    c = command("ingest", ingest_grid, "raw", "mask", "cover", "output")
    frame_of(c)
    c.add_argument("--mask-origin", nargs=2, type=float, required=True, metavar=("LON", "LAT"))
    c.add_argument("--mask-step", nargs=2, type=float, required=True, metavar=("LON", "LAT"))
    c.add_argument("--mask-size", nargs=2, type=float, required=True, metavar=("COLS", "ROWS"))
    c.add_argument("--plain-bounds", action="store_true", help="take inverted bounds in their right order")
    c = command("images", images, "data", "cells")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--active-only", action="store_true")
    c = command("enrich", enrich, "data", "cover", "cells")
    frame_of(c)
    c.add_argument("--steps", nargs="+", choices=enrichment.STEPS, default=list(enrichment.STEPS))
    for n in ("overwrite", "active-only", "dry-run"):
        c.add_argument(f"--{n}", action="store_true")
    c = command("evaluate", evaluate, "scored", "output")
    c.add_argument("--batch-size", type=int, default=2048)
    c.add_argument("--order", nargs="+", default=["id"], help="columns that order the samples of a site")
    c = command("report", report, "metrics", "output")
    c.add_argument("--decimals", type=int, default=4)
    c.add_argument("--nan-token", default="--")
    c = command("merge", merge_shards, "shards", "output")
    c.add_argument("--format", choices=("csv", "cube"), default="csv")
    c.add_argument("--num-shards", type=int)
    c.add_argument("--prediction-targets", nargs="*")
    c.add_argument("--sort", action="store_true")
    c.add_argument("--duplicates", choices=("error", "first", "last", "mean"), default="error")
    c = command("relabel", relabel, "dim", "cover")
    frame_of(c)
    c.add_argument("--only-null", action="store_true")
    c.add_argument("--write")
    c = command("cluster", cluster, "facts", "output")
    c.add_argument("--rebuild-ids", action="store_true")
    c.add_argument("--dim", help="save facts and this dimension in the same buckets below the output folder")
    c.add_argument("--buckets", type=int)
    c = command("bins", bins, "dim", "output")
    c.add_argument("--projection", choices=("robinson", "plate"), default="robinson")
    c.add_argument("--width", type=int, default=1800)
    c.add_argument("--height", type=int, default=1000)
    command("describe", describe, "path")
    for c in commands.choices.values():
        c.add_argument("--master", help="for trials; on a cluster the submit command decides")
    return top


def main(argv=None) -> None:
    a = parser().parse_args(argv)
    for bound in ("start_date", "end_date"):
        if getattr(a, bound, None):
            scalars.parse_bound(getattr(a, bound), bound == "end_date")
    a.run(build_session("fluxframe", a.master), a)


if __name__ == "__main__":
    main()
