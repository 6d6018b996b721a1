"""Dimension tables: surrogate keys, relabelling, upserts, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fluxframe import vocab
from fluxframe.functions import text
from fluxframe.functions.geo import cell_bounds, cell_key, floor_pixel
from fluxframe.operators.ordering import dense_order, keyed_join


def surrogate_keys(facts: DataFrame, attributes: Sequence[str], first_seen: str,
                   out: str = "coord_id") -> DataFrame:
    """Distinct attribute combinations numbered from 1 by first appearance.

    ``first_seen`` is a number that grows with the input order; combinations
    that appear together are numbered in the order of their attributes.
    """
    appeared = facts.groupBy(*attributes).agg(F.min(first_seen).alias("__first"))
    return dense_order(appeared, ["__first", *attributes], out, start=1).select(out, *attributes)


def attach_keys(facts: DataFrame, dim: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Attach surrogate keys; missing attributes match missing attributes."""
    return keyed_join(facts, dim, attributes)


def relabel(dim: DataFrame, raster: DataFrame, west: float, north: float, step: float,
            rows: int, cols: int, only_missing: bool = False, lat: str = "lat", lon: str = "lon",
            label: str = "igbp") -> DataFrame:
    """Plan new land-cover labels from the raster pixel each location falls in.

    Adds ``new_label`` (the old one where the location has no coordinates),
    ``in_scope``, ``sampled`` (in scope and with coordinates) and ``changed``.
    """
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    # the raster runs southwards, so rows count down from its north edge
    placed = dim.withColumns({
        "row": F.when(known, floor_pixel(-F.col(lat), -north, step, rows)),
        "col": F.when(known, floor_pixel(F.col(lon), west, step, cols))})
    coded = placed.join(raster.select("row", "col", "code"), ["row", "col"], "left")
    in_scope = F.col(label).isNull() if only_missing else F.lit(True)
    fresh = F.when(known, text.class_of_code(F.col("code"), at_ingest=False)).otherwise(F.col(label))
    return (coded.withColumns({"in_scope": in_scope, "sampled": in_scope & known, "new_label": fresh})
            .withColumn("changed", F.col("sampled") & ~F.col(label).eqNullSafe(F.col("new_label")))
            .drop("row", "col", "code"))


def apply_labels(plan: DataFrame, label: str = "igbp") -> DataFrame:
    updated = F.when(F.col("changed"), F.col("new_label")).otherwise(F.col(label))
    return plan.withColumn(label, updated).drop("in_scope", "sampled", "new_label", "changed")


def label_counts(plan: DataFrame, label: str = "igbp", new: str = "new_label") -> DataFrame:
    """(which, label, n): histograms of the labels before and after."""
    both = F.explode(F.array(
        F.struct(F.lit("old").alias("which"), F.coalesce(label, F.lit(vocab.MISSING_CLASS)).alias("label")),
        F.struct(F.lit("new").alias("which"), F.coalesce(new, F.lit(vocab.MISSING_CLASS)).alias("label"))))
    # count the pairs first: the explode then runs on a handful of rows
    pairs = plan.groupBy(label, new).count()
    return pairs.select(both.alias("r"), "count").groupBy("r.which", "r.label").agg(F.sum("count").alias("n"))


def top_transitions(plan: DataFrame, old: str, new: str, k: int = 20) -> DataFrame:
    """The k largest (old, new) pairs, then without those that did not change.

    Pairs that did not change do count among the k.
    """
    counted = (plan.groupBy(F.coalesce(old, F.lit(vocab.MISSING_CLASS)).alias("old_label"),
                            F.coalesce(new, F.lit(vocab.MISSING_CLASS)).alias("new_label"))
               .agg(F.count("*").alias("n")))
    top = counted.orderBy(F.desc("n"), "old_label", "new_label").limit(k)
    return top.where(F.col("old_label") != F.col("new_label"))


def update_by_key(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``changes`` has the key."""
    fresh = changes.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    joined = table.join(fresh, key, "left")
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*table.columns)


def newest_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key; the group limit runs in the map tasks, so copies of one
    key never meet in bulk."""
    direction = [F.desc(o) for o in order] if last else [F.asc(o) for o in order]
    w = Window.partitionBy(*keys).orderBy(*direction)
    return batch.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], overwrite: bool) -> DataFrame:
    """Rows after an insert that ignores, or on ``overwrite`` replaces, known keys.

    Both inputs must be unique on the keys.
    """
    if overwrite:
        return incoming.unionByName(keyed_join(existing, incoming.select(*keys), keys, "left_anti"))
    return existing.unionByName(keyed_join(incoming, existing.select(*keys), keys, "left_anti"))


def cells_to_images(cells: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach coord_id to image cells by the cell's lower edges.

    ``cells`` has grid_row, grid_col, modis_date, data. The last of several
    locations in one cell wins; cells without a location are dropped.
    """
    edges = cell_bounds(F.col("grid_row"), F.col("grid_col"))
    keyed = cells.withColumns({"lat_key": cell_key(edges["lat_min"]), "lon_key": cell_key(edges["lon_min"])})
    owners = (dim.groupBy(cell_key(F.col("lat")).alias("lat_key"), cell_key(F.col("lon")).alias("lon_key"))
              .agg(F.max("coord_id").alias("coord_id")))
    return keyed.join(owners, ["lat_key", "lon_key"]).select("coord_id", "modis_date", "data")


def write_counts(cells: DataFrame, images: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """Per date: cells that found a location, and rows that get written."""
    known = existing.select("coord_id", "modis_date", F.lit(True).alias("__known"))
    written = F.lit(True) if overwrite else F.col("__known").isNull()
    matched = images.join(known, ["coord_id", "modis_date"], "left")
    return matched.groupBy("modis_date").agg(F.count("*").alias("matched"),
                                             F.count(F.when(written, True)).alias("written"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def null_key_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"))


def require_key(dim: DataFrame, key: str) -> DataFrame:
    """The dimension key must be present and unique."""
    nulls = null_key_count(dim, key).first()[0]
    if nulls:
        raise ValueError(f"{nulls} rows have no {key}")
    repeated = duplicate_keys(dim, [key]).limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][0]} occurs {repeated[0]['count']} times")
    return dim


def unknown_codes(raster: DataFrame, code: str = "code") -> DataFrame:
    """Raster codes without a class."""
    return raster.select(code).distinct().where(~F.col(code).isin(*vocab.CLASS_OF_CODE))
