"""Map pixels: lines by generated steps, points as stamps with a drawing order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxframe import vocab
from fluxframe.functions import geo, text
from fluxframe.operators.ordering import Limit, previous

#: The visible part of a map, in pixels: left, top, right, bottom, all included.
Window = tuple[float, float, float, float]


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, view: Window) -> tuple[Column, Column]:
    """Where along a segment, from 0 to 1, the view is entered and left; entered after left if it is missed."""
    left, top, right, bottom = view
    dx, dy = x1 - x0, y1 - y0
    begins, ends = [F.lit(0.0)], [F.lit(1.0)]
    # each edge lets pass what keeps step * t <= room
    for step, room in ((-dx, x0 - left), (dx, right - x0), (-dy, y0 - top), (dy, bottom - y0)):
        t = F.when(step != 0, room / step)
        begins.append(F.when(step < 0, t).when((step == 0) & (room < 0), F.lit(2.0)).otherwise(F.lit(0.0)))
        ends.append(F.when(step > 0, t).otherwise(F.lit(1.0)))
    return F.greatest(*begins), F.least(*ends)


def line_pixels(points: DataFrame, frame: geo.MapFrame, view: Window, keys: Sequence[str], order: Sequence[str],
                lat: str = "lat", lon: str = "lon", limit: Limit = None) -> DataFrame:
    """Distinct pixels (px, py) of lines through the points of each key in order.

    Lines are cut before at the date line, see ``spatial.split_at_dateline``.
    Segments are clipped to the view before any pixel is made, so none makes
    more than the view is long or high. A segment takes one step for each pixel
    of its longer side, from end to end, and each step is rounded to a pixel.
    A point without a place ends a line; a single point makes no pixel.
    """
    x, y = frame.place(F.col(lon), F.col(lat))
    placed = points.select(*keys, *[c for c in order if c not in keys], x.alias("__x1"), y.alias("__y1"))
    pairs = previous(placed, keys, order, {"__x0": "__x1", "__y0": "__y1"}, limit=limit)
    pairs = pairs.where("__x0 is not null and __y0 is not null and __x1 is not null and __y1 is not null")
    begin, end = clipped(*(F.col(c) for c in ("__x0", "__y0", "__x1", "__y1")), view)
    seen = pairs.withColumns({"__a": begin, "__b": end}).where("__a <= __b")
    dx, dy = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    longer = F.greatest(F.abs(dx), F.abs(dy)) * (F.col("__b") - F.col("__a"))
    steps = F.greatest(F.ceil(longer), F.lit(1)).cast("int")
    walked = seen.select("__x0", "__y0", dx.alias("__dx"), dy.alias("__dy"), "__a", "__b", steps.alias("__n"),
                         F.explode(F.sequence(F.lit(0), steps)).alias("__k"))
    t = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__k") / F.col("__n")
    return walked.select(F.rint(F.col("__x0") + F.col("__dx") * t).cast("int").alias("px"),
                         F.rint(F.col("__y0") + F.col("__dy") * t).cast("int").alias("py")).distinct()


def square(size: int) -> list[tuple[int, int]]:
    """Offsets of the pixels of a square point; a size of one or less is the pixel itself."""
    half = size // 2
    reach = range(-half, size - half) if size > 1 else range(1)
    return [(a, b) for a in reach for b in reach]


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the pixels of a disc."""
    reach = range(-radius, radius + 1)
    return [(a, b) for a in reach for b in reach if a * a + b * b <= radius * radius]


def drawing_rank(label: Column) -> Column:
    """When a class is drawn: in legend order, other classes after it, missing ones last."""
    return F.when(label.isNull(), F.lit(1_000_000)).otherwise(text.legend_position(label))


def point_pixels(points: DataFrame, frame: geo.MapFrame, stamp: Sequence[tuple[int, int]], view: Window | None = None,
                 lat: str = "lat", lon: str = "lon", label: str = "igbp") -> DataFrame:
    """px, py and label: each point drawn as ``stamp``, one class per pixel, that which is drawn last.

    Of classes drawn at the same time the last in the alphabet is on top. Points
    of one pixel are reduced before stamps are made, so that work follows the
    pixels of the map. Points without a place and classes hidden in the legend
    are left out; a missing class is 'NULL'.
    """
    hidden = [c for c in vocab.LEGEND_HIDDEN if c != "NULL"]
    px, py = frame.pixels(F.col(lon), F.col(lat))
    shown = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()
                         & F.coalesce(~F.col(label).isin(*hidden), F.lit(True)))
    top = F.max(F.struct("rank", "label"))
    centres = (shown.select(px.alias("px"), py.alias("py"), drawing_rank(F.col(label)).alias("rank"),
                            F.coalesce(label, F.lit("NULL")).alias("label"))
               .groupBy("px", "py").agg(top.alias("top")).select("px", "py", "top.*"))
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in stamp]))
    stamped = centres.select("px", "py", "rank", "label", offsets.alias("s")).select(
        (F.col("px") + F.col("s.a")).alias("px"), (F.col("py") + F.col("s.b")).alias("py"), "rank", "label")
    if view is not None:
        stamped = stamped.where(F.col("px").between(view[0], view[2]) & F.col("py").between(view[1], view[3]))
    return stamped.groupBy("px", "py").agg(top.alias("top")).select("px", "py", F.col("top.label").alias("label"))
