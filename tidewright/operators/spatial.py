"""Nearest cell and area selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, haversine_km
from ..session import cut_lineage
from .joins import null_safe_join

_RING = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def _spread(grid: DataFrame, width: float) -> DataFrame:
    """Each cell in its own bucket and the eight around it."""
    by, bx = F.floor(F.col("g_lat") / width), F.floor(F.col("g_lon") / width)
    around = F.array(*[F.struct((by + i).alias("by"), (bx + j).alias("bx")) for i, j in _RING])
    return grid.withColumn("__o", F.explode(around)).select("*", "__o.by", "__o.bx").drop("__o")


def _prepare(grid: DataFrame, lat: str, lon: str, cell: Sequence[str], mask: Column | None) -> DataFrame:
    """One cell per coordinate pair (first in cell order), so equal coordinates cannot multiply candidates."""
    g = grid if mask is None else grid.where(mask)
    return (
        g.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(F.col(lat).cast("double").alias("g_lat"), F.col(lon).cast("double").alias("g_lon"))
        .agg(F.min(F.struct(*cell)).alias("cell"))
    )


def nearest_cell_in_box(points: DataFrame, grid: DataFrame, *, lat: str, lon: str, glat: str, glon: str,
                        cell: Sequence[str], dx: float, mask: Column | None = None) -> DataFrame:
    """Nearest usable cell by great-circle distance inside an open box of half-width ``dx`` degrees.

    Points are reduced to distinct coordinates, matched through lat/lon buckets of width ``dx`` and joined
    back; points without a cell in the box keep NULL.
    """
    p = points.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")).distinct()
    p = p.withColumns({"by": F.floor(F.col("p_lat") / dx), "bx": F.floor(F.col("p_lon") / dx)})
    c = p.join(_spread(_prepare(grid, glat, glon, cell, mask), dx), ["by", "bx"])
    c = c.where((F.abs(F.col("g_lat") - F.col("p_lat")) < dx) & (F.abs(F.col("g_lon") - F.col("p_lon")) < dx))
    dist = haversine_km(F.col("p_lon"), F.col("p_lat"), F.col("g_lon"), F.col("g_lat"))
    best = c.groupBy("p_lat", "p_lon").agg(F.min(F.struct(dist.alias("d"), "cell")).alias("m"))
    best = best.select(F.col("p_lat").alias(lat), F.col("p_lon").alias(lon), "m.cell.*", F.col("m.d").alias("dist_km"))
    return null_safe_join(points, best, [lat, lon], "left")


#: Boxes along one side of the next wider box, and the ends of a box: coordinates of a cell that lies on each of its sides.
FAN, ENDS = 8, ("south", "north", "west", "east")


def _pyramid(g: DataFrame, width: float, levels: int) -> DataFrame:
    """Occupied boxes of every level with the boxes of the level below as ``kids`` (the cells themselves at level 0).

    Levels differ by a factor of FAN, so a box has at most FAN * FAN kids; at level 0 it has the cells of one ``width``.
    """
    here, there = F.struct(F.col("g_lat").alias("y"), F.col("g_lon").alias("x")), F.struct(F.col("g_lon").alias("x"), F.col("g_lat").alias("y"))
    wide = F.get(F.array(*[F.lit(width * FAN**i) for i in range(levels)]), F.col("lv"))
    at = g.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at = at.withColumns({"by": F.floor(F.col("g_lat") / wide), "bx": F.floor(F.col("g_lon") / wide)})
    boxes = at.groupBy("lv", "by", "bx").agg(F.min(here).alias("south"), F.max(here).alias("north"), F.min(there).alias("west"), F.max(there).alias("east"))
    above = boxes.where(F.col("lv") < levels - 1).select(
        (F.col("lv") + 1).alias("lv"), F.floor(F.col("by") / FAN).alias("by"), F.floor(F.col("bx") / FAN).alias("bx"),
        F.struct(*ENDS, F.col("by"), F.col("bx"), F.lit(None).cast(g.schema["cell"].dataType).alias("cell")).alias("kid"))
    cells = at.where("lv = 0").select("lv", "by", "bx", F.struct(
        here.alias("south"), here.alias("north"), there.alias("west"), there.alias("east"), "by", "bx", "cell").alias("kid"))
    return cells.unionByName(above).groupBy("lv", "by", "bx").agg(F.collect_list("kid").alias("kids"))


def _descend(p: DataFrame, g: DataFrame, width: float, watch: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """(p_lat, p_lon, m) with the nearest cell of every point, by a descent through a pyramid of boxes.

    On each level a point keeps the boxes that may hold its nearest cell: those whose least possible distance is no more
    than the least distance to a cell on the side of any box. A box has a cell on each of its sides, so for a far point that
    bound exceeds the true distance by little more than a box's width squared over the distance, and a handful of boxes stay,
    however many cells lie at nearly the same distance. ``watch`` is given the kept (point, box) rows of every level but the last.
    """
    levels = 1
    while width * FAN ** (levels - 1) < 180.0:
        levels += 1
    pyramid = cut_lineage(_pyramid(g, width, levels))

    # SQL text: the same few expressions on every level are built faster from text than from column objects.
    def away(end: str) -> str:
        return f"sqrt(pow({end}.y - p_lat, 2) + pow(({end}.x - p_lon) * k, 2))"

    bound = f"least({', '.join(away(f'b.{end}') for end in ENDS)}) AS hi"
    least = ("sqrt(pow(greatest(b.south.y - p_lat, p_lat - b.north.y, 0D), 2) "
             "+ pow(greatest(b.west.x - p_lon, p_lon - b.east.x, 0D) * k, 2)) AS lo")
    point, slack = ["p_lat", "p_lon", "k"], "(1 + 1e-12D)"
    top = "explode(array({})) AS b".format(", ".join(f"named_struct('by', {y}L, 'bx', {x}L)" for y in (-1, 0) for x in (-2, -1, 0, 1)))
    at = p.selectExpr(*point, "1e300D AS ub", top).select(*point, "ub", "b.*")
    for level in range(levels - 1, 0, -1):
        # The bound of the level above thins the kids before they are grouped.
        near = at.join(pyramid.where(f"lv = {level}").select("by", "bx", "kids"), ["by", "bx"]).selectExpr(*point, "ub", "explode(kids) AS b")
        near = near.selectExpr(*point, "ub", bound, least, "b.by", "b.bx").where(f"lo <= ub * {slack}")
        near = near.groupBy(*point).agg(F.min("hi").alias("ub"), F.collect_list(F.struct("lo", "by", "bx")).alias("b"))
        at = near.selectExpr(*point, "ub", "inline(b)").where(f"lo <= ub * {slack}").select(*point, "ub", "by", "bx")
        if watch:
            watch(at)
    cells = at.join(pyramid.where("lv = 0").select("by", "bx", "kids"), ["by", "bx"]).selectExpr(*point, "explode(kids) AS b")
    return cells.groupBy("p_lat", "p_lon").agg(F.expr(f"min(struct({away('b.south')} AS d, b.cell AS cell)) AS m"))


def nearest_cell_planar(points: DataFrame, grid: DataFrame, *, lat: str, lon: str, glat: str, glon: str,
                        cell: Sequence[str], lon_scale: float | None = 1.0, max_km: float | None = None,
                        first_width: float = 0.01, mask: Column | None = None) -> DataFrame:
    """Nearest cell by scaled degree distance; ``lon_scale=None`` uses the cosine of the point's latitude.

    With ``max_km`` one bucket pass is enough; longitude buckets widen with the latitude, so no match is lost near the poles.
    Without it a descent through a pyramid of boxes finds the cell, see :func:`_descend`; a far point meets a bounded number
    of boxes too. Coordinates are planar: latitudes within 90, longitudes within 360 degrees of zero, no wrap at 180.
    Equal distances go to the least ``cell``.
    """
    g = _prepare(grid, glat, glon, cell, mask)
    p = points.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")).distinct().where(
        "p_lat IS NOT NULL AND p_lon IS NOT NULL"
    )
    k = F.cos(F.radians("p_lat")) if lon_scale is None else F.lit(float(lon_scale))
    p = p.withColumn("k", k)
    dist = F.sqrt(F.pow(F.col("g_lat") - F.col("p_lat"), 2) + F.pow((F.col("g_lon") - F.col("p_lon")) * F.col("k"), 2))

    if max_km is not None:
        limit = max_km / KM_PER_DEGREE

        def lon_width(by: Column) -> Column:
            """Longitudes within reach of any point of a latitude bucket: limit over the least factor in it."""
            edge = F.least(F.greatest(F.abs(by * limit), F.abs((by + 1) * limit)), F.lit(90.0))
            least = F.cos(F.radians(edge)) if lon_scale is None else F.lit(min(float(lon_scale), 1.0))
            return F.lit(limit * (1 + 1e-9)) / F.greatest(least, F.lit(1e-12))

        b = p.withColumn("by", F.floor(F.col("p_lat") / limit))
        b = b.withColumn("bx", F.floor(F.col("p_lon") / lon_width(F.col("by"))))
        c = g.withColumn("by", F.explode(F.array(*[F.floor(F.col("g_lat") / limit) + i for i in (-1, 0, 1)])))
        at = F.floor(F.col("g_lon") / lon_width(F.col("by")))
        c = b.join(c.withColumn("bx", F.explode(F.array(at - 1, at, at + 1))), ["by", "bx"])
        best = c.groupBy("p_lat", "p_lon").agg(F.min(F.struct(dist.alias("d"), "cell")).alias("m")).where(F.col("m.d") <= limit)
    else:
        best = _descend(p, g, first_width)
    best = best.select(F.col("p_lat").alias(lat), F.col("p_lon").alias(lon), "m.cell.*", F.col("m.d").alias("dist_deg"))
    return null_safe_join(points, best, [lat, lon], "left")


def box_cells(grid: DataFrame, *, lat: str | None = None, lon: str | None = None,
              lat_range: tuple[float, float] | None = None, lon_range: tuple[float, float] | None = None,
              row_range: tuple[int, int] | None = None, col_range: tuple[int, int] | None = None,
              stride: int = 1, wet: Column | None = None) -> DataFrame:
    """Distinct cells of a coordinate box and/or an inclusive index box with a stride."""
    g = grid if wet is None else grid.where(wet)
    if lat_range:
        g = g.where(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range))
    if row_range:
        g = g.where(F.col("row").between(*row_range) & ((F.col("row") - row_range[0]) % stride == 0))
    if col_range:
        g = g.where(F.col("col").between(*col_range) & ((F.col("col") - col_range[0]) % stride == 0))
    return g.dropDuplicates(["row", "col"])


def regrid(values: DataFrame, weights: DataFrame, *, src: Sequence[str], target: Sequence[str], weight: str,
           value: str, keep: Sequence[str], decimals: int | None = 1) -> DataFrame:
    """Weighted sum of source cells per target cell; negative results and sentinels become 0."""
    j = values.join(weights, list(src))
    out = j.groupBy(*keep, *target).agg(F.sum(F.col(weight) * F.col(value)).alias(value))
    v = F.when(F.col(value) < 0, F.lit(0.0)).otherwise(F.col(value))
    return out.withColumn(value, v if decimals is None else F.round(v, decimals))


def bilinear_weights(targets: DataFrame, *, y: str = "y", x: str = "x", key: Sequence[str]) -> DataFrame:
    """Four source cells and weights for targets at fractional source indices (y, x)."""
    y0, x0 = F.floor(y), F.floor(x)
    fy, fx = F.col(y) - y0, F.col(x) - x0
    four = F.array(
        F.struct(y0.alias("sy"), x0.alias("sx"), ((1 - fy) * (1 - fx)).alias("w")),
        F.struct(y0.alias("sy"), (x0 + 1).alias("sx"), ((1 - fy) * fx).alias("w")),
        F.struct((y0 + 1).alias("sy"), x0.alias("sx"), (fy * (1 - fx)).alias("w")),
        F.struct((y0 + 1).alias("sy"), (x0 + 1).alias("sx"), (fy * fx).alias("w")),
    )
    return targets.withColumn("__s", F.explode(four)).select(*key, "__s.sy", "__s.sx", "__s.w")
