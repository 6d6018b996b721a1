"""Sinks: prediction and metric files, merged files, LaTeX tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from fluxframe.functions.scalars import unscale_degrees
from fluxframe.functions.text import fixed
from fluxframe.operators.ordering import dense_order


def formatted_predictions(scored: DataFrame, targets: Sequence[str], lat: str = "lat", lon: str = "lon",
                          time: str = "timestamp", scaled: bool = True) -> DataFrame:
    """Text rows of a prediction file: place to 2 decimals, values to 4.

    Places are stored scaled in single precision and turned back here. Truth
    columns are added where present.
    """
    def degrees(c):
        return fixed(unscale_degrees(F.col(c)) if scaled else F.col(c), 2, "nan")
    values = [c for prefix in ("pred_", "gt_") for t in targets if (c := prefix + t) in scored.columns]
    order = [c for c in ("__sample_order",) if c in scored.columns]
    return scored.select(*order, degrees(lat).alias("lat"), degrees(lon).alias("lon"), "igbp",
                         F.col(time).alias("timestamp"),
                         *[fixed(F.col(c), 4, "nan").alias(c) for c in values])


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Part files with headers. One file only for results known to be small."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Contiguous, ordered part files: file k precedes file k+1."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite") \
        .option("header", True).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as ``path``, also where ``df`` reads that path.

    The new files go beside it and take its place by renaming when they are
    complete; a failure before that leaves the old table as it was.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(fresh)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    place = jpath(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    had_one = files.exists(place)
    if had_one and not files.rename(place, jpath(old)):
        raise OSError(f"{path} cannot be put aside; the new table is {fresh}")
    if not files.rename(jpath(fresh), place):
        raise OSError(f"{fresh} cannot be renamed to {path}; the old table is {old}")
    if had_one:
        files.delete(jpath(old), True)
    spark.catalog.refreshByPath(path)


def write_tables(facts: DataFrame, dim: DataFrame, folder: str) -> None:
    """Append facts, replace the dimension.

    Facts bring ids of their own, see ``layout.rebuild_ids``; ids of several
    appended batches are made unique by rebuilding them.
    """
    facts.write.mode("append").parquet(f"{folder}/ec_data.parquet")
    replace_table(dim, f"{folder}/coord_data.parquet")


def write_cube(cube: DataFrame, attributes: dict[str, object], path: str) -> None:
    """A dense cube as one ordered parquet table, its attributes beside it."""
    cube.repartitionByRange("time_index", "lat_index").sortWithinPartitions("time_index", "lat_index") \
        .write.mode("overwrite").parquet(f"{path}/cells")
    texts = [(k, str(v)) for k, v in attributes.items()]
    cube.sparkSession.createDataFrame(texts, "name string, value string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/attributes")


def number_images(images: DataFrame) -> DataFrame:
    """Surrogate modis_id over (coord_id, modis_date)."""
    return dense_order(images, ["coord_id", "modis_date"], "modis_id", start=1)


def latex_table(df: DataFrame, caption: str, label: str, digits: int = 4, missing: str = "--",
                groups: Sequence[tuple[str, int]] | None = None) -> str:
    """A LaTeX table of a small result such as one row per class.

    ``groups`` puts a line of spanning titles above the header.
    """
    rows = df.collect()

    def cell(v):
        if v is None or v != v:
            return missing
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}",
             f"\\begin{{tabular}}{{l{'c' * (len(df.columns) - 1)}}}", "\\toprule"]
    if groups:
        lines.append(" & ".join(title if n == 1 else f"\\multicolumn{{{n}}}{{c}}{{{title}}}"
                                for title, n in groups) + " \\\\")
        first, rules = 1, []
        for title, n in groups:
            if title:
                rules.append(f"\\cmidrule(lr){{{first}-{first + n - 1}}}")
            first += n
        lines.append("".join(rules))
    lines += [" & ".join(df.columns) + " \\\\", "\\midrule"]
    lines += [" & ".join(cell(v) for v in row) + " \\\\" for row in rows]
    lines += ["\\bottomrule", "\\end{tabular}", "\\end{table}", ""]
    return "\n".join(lines)


def write_text(content: str, path: str) -> None:
    if path == "-":
        print(content)
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content)
