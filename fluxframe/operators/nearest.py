"""Nearest of irregularly placed sites, by descent through the boxes of a grid.

The extent of the sites is cut into 4 x 4 cells, crowded cells again, and so on.
A cell knows the smallest box around its sites, so the distance from a point to
its nearest site lies between that to the box's nearest and farthest corner. A
point begins with the whole extent and goes down into cells that may still hold
a nearer site than the best bound it has; the rest falls away, however far the
point lies from all sites and however unevenly they lie. Points are joined with
cells by equality, and only the last cells are looked through site by site.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxframe.session import settle

#: Levels of cells, each cut into 2**BITS a side.
BITS, DEEPEST = 2, 24
#: Cells of more sites are cut, down to the deepest level.
CROWDED = 32
BOX = ("x0", "x1", "y0", "y1")


def _real(c: str) -> Column:
    """A coordinate as a double; missing ones and NaN are none. 0.0 is added so that -0.0 is 0.0."""
    value = F.col(c).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value + 0.0)


def _placed(df: DataFrame, x: str, y: str, *more: Column) -> DataFrame:
    return df.select(_real(x).alias("x"), _real(y).alias("y"), *more).where("x is not null and y is not null")


def build_cells(places: DataFrame, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, int]:
    """Cells (level, cx, cy, box and whether they are cut), the sites with their last cell, and the number of levels.

    ``places`` has x, y and site, one row per place. Cells of several levels are
    counted in one pass, combined in the map tasks; only sites in cells that are
    still crowded below those take another one.
    """
    # one row: the extent
    count, low_x, high_x, low_y, high_y = places.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(high_x - low_x, high_y - low_y) or 1.0
    most = 1 << (BITS * DEEPEST)

    def deep(c: str, low: float) -> Column:
        return F.least(F.floor((F.col(c) - low) / side * most), F.lit(most - 1)).cast("long")
    rest = places.withColumns({"__dx": deep("x", low_x), "__dy": deep("y", low_y)})
    all_cells, all_sites, first = None, None, 0
    last = 2 + math.ceil(math.log(max(count / crowded, 1), 4 ** BITS))
    while True:
        last = min(last, DEEPEST)

        def at(level: int) -> Column:
            shift = BITS * (DEEPEST - level)
            return F.struct(F.lit(level).alias("level"), F.shiftright("__dx", shift).alias("cx"), F.shiftright("__dy", shift).alias("cy"))
        exploded = rest.withColumn("at", F.explode(F.array(*[at(n) for n in range(first, last + 1)])))
        counted = exploded.groupBy("at").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.count(F.lit(1)).alias("held")).select("at.*", *BOX, "held")
        # a cell is there if the one above it was cut
        above = counted.where(F.col("held") > crowded).select(
            (F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        inner = counted.where(F.col("level") > first).withColumns({"px": F.shiftright("cx", BITS), "py": F.shiftright("cy", BITS)})
        there = counted.where(F.col("level") == first).unionByName(
            inner.join(above, ["level", "px", "py"], "left_semi").drop("px", "py"))
        cells = settle(there.withColumn("cut", (F.col("held") > crowded) & (F.col("level") < DEEPEST)).drop("held"))
        ends = cells.where(F.lit(True) if last == DEEPEST else F.col("level") == last).where("cut").select("level", "cx", "cy")
        placed = rest.withColumn("at", F.explode(F.array(*[at(n) for n in range(first, last + 1)]))).select(
            "x", "y", "site", "at.*", "__dx", "__dy")
        found = placed.join(cells.where("not cut").select("level", "cx", "cy"), ["level", "cx", "cy"]).drop("__dx", "__dy")
        all_cells = cells if all_cells is None else all_cells.unionByName(cells)
        all_sites = found if all_sites is None else all_sites.unionByName(found)
        if last == DEEPEST or ends.isEmpty():
            return all_cells, all_sites, last + 1
        rest = settle(placed.join(ends, ["level", "cx", "cy"], "left_semi").select("x", "y", "site", "__dx", "__dy"))
        first, last = last + 1, last + 4


def _squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _least(box) -> Column:
    """Squared distance to the box, never more than that to anything in it, rounding included."""
    def off(c, low, high):
        return F.greatest(low - F.col(c), F.col(c) - high, F.lit(0.0))
    return _squared(off("x", box["x0"], box["x1"]), off("y", box["y0"], box["y1"]))


def _most(box) -> Column:
    """Squared distance to the box's farthest corner."""
    def off(c, low, high):
        return F.greatest(F.abs(low - F.col(c)), F.abs(F.col(c) - high))
    return _squared(off("x", box["x0"], box["x1"]), off("y", box["y0"], box["y1"]))


def nearest_places(points: DataFrame, places: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """x, y, site and squared distance d2 of the nearest site of every row of ``points`` (x, y); ties by the smallest site.

    A point is on one row for each cell that may hold its nearest site. In every
    round a row goes down into such cells, or stays if its cell is not cut, and
    the best bound of the point's rows decides which remain.
    """
    cells, sites, levels = build_cells(places, crowded)
    # 16 cells below one at most; written, so that their size is known to the joins
    below = settle(cells.where("level > 0").groupBy(
        (F.col("level") - 1).alias("level"), F.shiftright("cx", BITS).alias("cx"), F.shiftright("cy", BITS).alias("cy"))
        .agg(F.collect_list(F.struct("level", "cx", "cy", "cut", *BOX)).alias("below")))
    top = cells.where("level = 0").first()
    box = {c: F.lit(top[c]) for c in BOX}
    front = points.select("x", "y", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"),
                          F.lit(top["cut"]).alias("cut"), _least(box).alias("least"), _most(box).alias("bound"))
    for _ in range(levels - 1):
        met = front.join(below, ["level", "cx", "cy"], "left")
        seen = F.transform("below", lambda c: F.struct(
            c["level"].alias("level"), c["cx"].alias("cx"), c["cy"].alias("cy"), c["cut"].alias("cut"),
            _least(c).alias("least"), _most(c).alias("most")))
        stays = F.array(F.struct("level", "cx", "cy", "cut", "least", F.col("bound").alias("most")))
        met = met.select("x", "y", "bound", F.when(F.col("below").isNull(), stays).otherwise(seen).alias("seen"))
        met = met.withColumn("bound", F.least("bound", F.array_min(F.transform("seen", lambda c: c["most"]))))
        met = met.select("x", "y", "bound", F.inline(F.filter("seen", lambda c: c["least"] <= F.col("bound")))).drop("most")
        front = met.withColumn("bound", F.min("bound").over(Window.partitionBy("x", "y"))).where("least <= bound")
    looked = front.join(sites.withColumnsRenamed({"x": "sx", "y": "sy"}), ["level", "cx", "cy"])
    d2 = _squared(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    best = F.min(F.struct(d2.alias("d2"), "site"))
    return looked.groupBy("x", "y").agg(best.alias("best")).select("x", "y", "best.site", "best.d2")


def nearest_site(points: DataFrame, sites: DataFrame, site_id: str, x: str = "lon", y: str = "lat",
                 out: str = "nearest", distance: str = "distance", crowded: int = CROWDED) -> DataFrame:
    """Attach the id of the nearest site and the plain distance to it, both NULL for a point without coordinates.

    Both tables have ``x`` and ``y``. Of sites equally near the one of the
    smallest id is taken. Points of one place are looked up once, whatever their
    number; sites of one place count once.
    """
    if clash := {out, distance} & set(points.columns):
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")
    places = settle(_placed(sites, x, y, F.col(site_id).alias("site")).where("site is not null")
                    .groupBy("x", "y").agg(F.min("site").alias("site")))
    asked = _placed(points, x, y).distinct()
    keyed = points.withColumns({"__x": _real(x), "__y": _real(y)})
    if places.isEmpty():
        site = F.lit(None).cast(sites.schema[site_id].dataType)
        return points.withColumns({out: site, distance: F.lit(None).cast("double")})
    found = nearest_places(asked, places, crowded).select(
        F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("site").alias(out), F.sqrt("d2").alias(distance))
    return keyed.join(found, ["__x", "__y"], "left").select(*points.columns, out, distance)
