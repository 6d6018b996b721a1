"""Enrich a stored dataset: new land-cover labels, clustered facts, images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fluxframe.operators import dims, layout
from fluxframe.plans import image_store, ingest
from fluxframe.sources import writers

STEPS = ("relabel", "cluster", "images")


def relabel_dimension(dim: DataFrame, cover: DataFrame, frame: ingest.RasterFrame,
                      only_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new dimension, largest transitions)."""
    plan = dims.relabel(dim, cover, frame.west, frame.north, frame.step, frame.rows, frame.cols, only_missing)
    return dims.apply_labels(plan), dims.top_transitions(plan.where("sampled"), "igbp", "new_label")


def enrich(facts: DataFrame, dim: DataFrame, cover: DataFrame, frame: ingest.RasterFrame, cells: DataFrame,
           folder: str, steps: Sequence[str] = STEPS, overwrite: bool = False, active_only: bool = False,
           dry_run: bool = False) -> list[str]:
    """Run the chosen steps in their order, writing below ``folder``; returns them.

    The inputs may be the tables of that folder: every new table takes its
    place only when it is complete, and the next step reads it from there. A dry
    run only tells what would be done.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    chosen = [s for s in STEPS if s in steps]
    if dry_run:
        return chosen
    spark = facts.sparkSession
    if "relabel" in chosen:
        writers.replace_table(relabel_dimension(dim, cover, frame)[0], f"{folder}/coord_data.parquet")
        dim = spark.read.parquet(f"{folder}/coord_data.parquet")
    if "cluster" in chosen:
        writers.replace_table(layout.clustered(facts), f"{folder}/ec_data.parquet")
        facts = spark.read.parquet(f"{folder}/ec_data.parquet")
    if "images" in chosen:
        path = f"{folder}/modis_data.parquet"
        image_store.create_store(spark, path)
        image_store.store_images(spark, path, ingest.image_cells(cells, dim, facts if active_only else None), overwrite)
    return chosen
