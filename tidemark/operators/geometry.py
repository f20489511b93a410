"""Points against polygons, their outlines and each other, as equi-joins on cells."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import EARTH_RADIUS_M, haversine_m
from tidemark.operators.aggregates import exact_quantiles
from tidemark.storage import discard, written


def polygon_edges(polygons: DataFrame, id_col: str, rings: str) -> DataFrame:
    """Edges (id, x1, y1, x2, y2) of polygons given as arrays of closed rings of (x, y) structs; holes are just more rings."""
    ring = polygons.select(id_col, F.explode(rings).alias("r"))
    edge = F.explode(F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))))
    return ring.where("size(r) > 1").select(id_col, edge.alias("e")).select(id_col, "e.*")


#: Where a cell's reference point lies in it, in shares of its sides: off the round numbers that outlines like.
REFERENCE = 0.381966011250105
METRES_PER_DEGREE = math.radians(EARTH_RADIUS_M)


def touched_cells(edges: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """edges (x1, y1, x2, y2, ...) with (cx, cy) of every cell that each touches, or comes near to by a margin.

    Columns are listed first and then, of each, the rows that the edge spans in it, so that a long
    edge lists cells along it and not those of its box.
    """
    slack = margin + 1e-9 * cell
    west, east, column = F.least("x1", "x2"), F.greatest("x1", "x2"), F.col("cx") * cell
    e = edges.withColumn("cx", F.explode(F.sequence(F.floor((west - slack) / cell), F.floor((east + slack) / cell))))
    height = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (x - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    a, b = height(F.least(F.greatest(column - slack, west), east)), height(F.greatest(F.least(column + cell + slack, east), west))
    low, high = F.least(F.coalesce(a, "y1"), F.coalesce(b, "y2")) - slack, F.greatest(F.coalesce(a, "y1"), F.coalesce(b, "y2")) + slack
    return e.withColumn("cy", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))


def tiles(edges: DataFrame, polygon_id: str, cell: float, margin: float = 0.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Polygons cut to cells: (polygon, cx, cy, inside, edges).

    A cell has the edges that touch it (or come near by a margin), none if it is full, and whether
    its reference point is inside the polygon: even-odd, from the places where the polygon's edges
    cross the row of reference points. Only cells of `box` (south, west, north, east) are made; a
    cell's edges are as many as the outline has there, so cells have to be small where it is fine.
    """
    e = edges.select(F.col(polygon_id).alias("polygon"), "x1", "y1", "x2", "y2")
    (south, north), (west, east) = ((None, None), (None, None)) if box is None else (tuple(math.floor(v / cell) for v in pair) for pair in ((box[0], box[2]), (box[1], box[3])))
    kept = F.lit(True) if box is None else F.col("cx").between(west, east) & F.col("cy").between(south, north)
    border = touched_cells(e, cell, margin).where(kept).groupBy("polygon", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    low, high = F.floor(F.least("y1", "y2") / cell) - 1, F.floor(F.greatest("y1", "y2") / cell) + 1
    rows = (low, high) if box is None else (F.greatest(low, F.lit(south)), F.least(high, F.lit(north)))
    spanned = e.withColumn("cy", F.explode(F.when(rows[0] <= rows[1], F.sequence(*rows))))
    y = (F.col("cy") + REFERENCE) * cell
    crossed = spanned.where((F.col("y1") > y) != (F.col("y2") > y)).select("polygon", "cy", ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    along = Window.partitionBy("polygon", "cy").orderBy("x")
    runs = crossed.withColumns({"n": F.row_number().over(along), "until": F.lead("x").over(along)}).where("n % 2 = 1")
    low, high = F.floor(F.col("x") / cell) - 1, F.floor(F.col("until") / cell) + 1
    run = (low, high) if box is None else (F.greatest(low, F.lit(west)), F.least(high, F.lit(east)))
    at = (F.col("cx") + REFERENCE) * cell
    filled = runs.withColumn("cx", F.explode(F.when(run[0] <= run[1], F.sequence(*run)))).where((at >= F.col("x")) & (at < F.col("until"))).select("polygon", "cx", "cy", F.lit(True).alias("inside"))
    both = border.join(filled, ["polygon", "cx", "cy"], "full")
    return both.select("polygon", "cx", "cy", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("edges", F.array().cast(border.schema["edges"].dataType)).alias("edges"))


def points_in_tiles(points: DataFrame, tiled: DataFrame, point_id: str, x: str, y: str, polygon_id: str, cell: float, margin: float = 0.0) -> DataFrame:
    """(point, polygon) for every polygon that holds a point, and holds it more than a margin away from its edges.

    The way from a cell's reference point to the point, first along the row and then up or down,
    stays in the cell; each of the cell's edges that it crosses changes sides. Points on a lower or
    left border are inside, on an upper or right border outside; points without a place are nowhere.
    """
    px, py = F.col("px"), F.col("py")
    p = points.select(F.col(point_id).alias("point"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where(~F.isnan("px") & ~F.isnan("py"))
    met = p.withColumns({"cx": F.floor(px / cell), "cy": F.floor(py / cell)}).join(tiled, ["cx", "cy"])
    rx, ry = (F.col("cx") + REFERENCE) * cell, (F.col("cy") + REFERENCE) * cell

    def crossings(n, e):
        across = (e.x2 - e.x1) * (ry - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1
        up = (e.y2 - e.y1) * (px - e.x1) / F.nullif(e.x2 - e.x1, F.lit(0.0)) + e.y1
        rising = (e.y2 > e.y1) == (e.x2 > e.x1)
        above = lambda h: (up > h) | ((up == h) & rising & (e.y1 != e.y2))
        row = ((e.y1 > ry) != (e.y2 > ry)) & ((across > px) != (across > rx))
        column = ((e.x1 > px) != (e.x2 > px)) & (above(py) != above(ry))
        return n + row.cast("int") + column.cast("int")

    found = met.where(F.aggregate("edges", F.col("inside").cast("int"), crossings) % 2 == 1)
    if margin:

        def away(e):
            dx, dy = e.x2 - e.x1, e.y2 - e.y1
            along = ((px - e.x1) * dx + (py - e.y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
            t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
            return F.hypot(px - e.x1 - t * dx, py - e.y1 - t * dy)

        found = found.where(~F.exists("edges", lambda e: away(e) <= margin))
    return found.select(F.col("point").alias(point_id), F.col("polygon").alias(polygon_id))


def places_of(points: DataFrame, x: str, y: str) -> DataFrame:
    """The different places (x, y) of points, as doubles, each once; NaN and null are no places."""
    return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~F.isnan("x") & ~F.isnan("y")).distinct()


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, x: str, y: str, polygon_id: str, cell: float) -> DataFrame:
    """(point, polygon) for every polygon that holds a point, by the even-odd rule, over cells of a size.

    Points of one place and polygons of one outline are tested once, and listed after.
    """
    names = ("x1", "y1", "x2", "y2")
    outlines = edges.groupBy(F.col(polygon_id).alias("polygon")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("edges"))  # one polygon's
    outlines = written(outlines.withColumn("outline", F.sha2(F.to_json("edges"), 256)), "outlines")
    each = outlines.groupBy("outline").agg(F.first("edges").alias("edges")).select("outline", F.explode("edges").alias("e")).select("outline", "e.*")
    places = places_of(points, x, y).withColumn("place", F.struct("x", "y"))
    held = written(points_in_tiles(places, tiles(each, "outline", cell), "place", "x", "y", "outline", cell), "held")
    at = points.select(F.col(point_id).alias("point"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("place"))
    # the pairs are the result: only places and outlines, each once, are small enough to be sent anywhere
    found = held.join(outlines.select("outline", "polygon"), "outline").join(at.hint("merge"), "place")
    return found.select(F.col("point").alias(point_id), F.col("polygon").alias(polygon_id))


def outlines_once(polygons: DataFrame, polygon_id: str, rings: str) -> DataFrame:
    """polygons with those of one outline as one, of the smallest id."""
    return polygons.groupBy(rings).agg(F.min(polygon_id).alias(polygon_id))


def places_held(places: DataFrame, edges: DataFrame, polygon_id: str, cell: float, margin: float = 0.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The places (x, y) that any polygon holds, more than a margin away from its edges, each once.

    A cell that any polygon fills holds all its places, whatever else lies there; the places of other
    cells meet the polygons that end in theirs.
    """
    tiled = written(tiles(edges, polygon_id, cell, margin, box), "tiles")
    at = places.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    full = written(tiled.where(F.col("inside") & (F.size("edges") == 0)).select("cx", "cy").distinct(), "full")
    rest = at.join(full, ["cx", "cy"], "left_anti").withColumn("place", F.struct("x", "y"))
    ends = tiled.where(F.size("edges") > 0).join(full, ["cx", "cy"], "left_anti")
    met = points_in_tiles(rest, ends, "place", "x", "y", polygon_id, cell, margin).select("place.x", "place.y").distinct()
    return at.join(full, ["cx", "cy"], "left_semi").select("x", "y").unionByName(met)


def fitting_cell(edges: DataFrame, cell: float, most: int = 8, halvings: int = 8) -> float:
    """A cell size, at most the one given and halved as often as needed, at which a cell is touched by `most` edges on average."""
    for _ in range(halvings):
        n = touched_cells(edges, cell).groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.avg("n").alias("n")).first().n
        if n is None or n <= most:
            break
        cell /= 2
    return cell


def nearest_outline(points: DataFrame, edges: DataFrame, point_id: str, lat: str, lon: str, cell: float, reach_m: float) -> DataFrame:
    """(point, distance_m): from each point to the nearest segment of any outline; null beyond the reach.

    Segments (x1, y1, x2, y2) are straight in longitude and latitude; the nearest place on one is
    that on a plane with the point's scale, and its distance is taken on the sphere. Points look at
    the cells around their own; who finds nothing as near as a cell is high looks again over cells
    twice the size. So a point meets only what lies about as far away as its nearest segment, and an
    open sea costs a round for each doubling up to the reach. Cells start smaller where outlines lie
    close, and places and edges that repeat are looked at once. Points repeat as they are given, those
    without a place have no distance; latitudes beyond 88 degrees, and outlines across the
    antimeridian, aren't wrapped.
    """
    e = written(edges.select("x1", "y1", "x2", "y2").distinct(), "different")
    every = points.select(F.col(point_id).alias("point"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    open_ = written(places_of(every, "x", "y"), "open")
    size, found = fitting_cell(e, cell), []
    while True:
        near_m, wide = size * METRES_PER_DEGREE, F.ceil(1 / F.cos(F.radians(F.least(F.abs("y") + size, F.lit(89.0))))).cast("long")
        spread = open_.withColumn("dx", F.explode(F.sequence(-wide, wide))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
        cells = spread.select("x", "y", (F.floor(F.col("x") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("y") / size) + F.col("dy")).alias("cy"))
        scale = F.cos(F.radians("y"))
        dx, dy, ax, ay = (F.col("x2") - F.col("x1")) * scale, F.col("y2") - F.col("y1"), (F.col("x") - F.col("x1")) * scale, F.col("y") - F.col("y1")
        t = F.least(F.greatest(F.coalesce((ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        metres = haversine_m(F.col("y"), F.col("x"), F.col("y1") + t * (F.col("y2") - F.col("y1")), F.col("x1") + t * (F.col("x2") - F.col("x1")))
        # listed cells are more than Spark's estimate lets it see: no side may be sent to all tasks
        near = cells.join(touched_cells(e, size).hint("merge"), ["cx", "cy"]).groupBy("x", "y").agg(F.min(metres).alias("distance_m"))
        measured = written(open_.join(near, ["x", "y"], "left"), "measured")
        found.append(measured.where(F.col("distance_m") <= min(near_m, reach_m)))
        discard(open_)
        if near_m >= reach_m:
            break
        open_ = written(measured.where(F.col("distance_m").isNull() | (F.col("distance_m") > near_m)).select("x", "y"), "open")
        if open_.isEmpty():
            discard(open_)
            break
        size *= 2
    near = functools.reduce(DataFrame.unionByName, found)
    return every.join(near, ["x", "y"], "left").select(F.col("point").alias(point_id), "distance_m")


def distance_to_land(points: DataFrame, land: DataFrame, point_id: str, lat: str, lon: str, reach_m: float, polygon_id: str = "polygon", rings: str = "rings", cell: float = 0.1) -> DataFrame:
    """(point, on_land, distance_m): 0 on land, else to the nearest outline, null beyond the reach. A row for each point id."""
    edges = written(polygon_edges(outlines_once(land, polygon_id, rings), polygon_id, rings), "edges")
    inside = places_held(places_of(points, lon, lat), edges, polygon_id, cell)
    every = points.select(F.col(point_id).alias("point"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    held = written(every.join(inside, ["x", "y"], "left_semi").select("point").distinct(), "held")
    sea = nearest_outline(every.join(held, "point", "left_anti"), edges, "point", "y", "x", cell, reach_m)
    least = sea.groupBy("point").agg(F.min("distance_m").alias("distance_m")).select(F.col("point").alias(point_id), F.lit(False).alias("on_land"), "distance_m")
    return least.unionByName(held.select(F.col("point").alias(point_id), F.lit(True).alias("on_land"), F.lit(0.0).alias("distance_m")))


def land_distance_grid(land: DataFrame, box: tuple[float, float, float, float], step: float, cap_km: float = 50.0, polygon_id: str = "polygon", rings: str = "rings", cell: float = 0.1) -> DataFrame:
    """(lat_i, lon_i, on_land, dist_land_km) of every cell of a grid over box (south, west, north, east): its centre's distance to land, 0 on it and at most the cap."""
    south, west, north, east = box
    rows, columns = round((north - south) / step), round((east - west) / step)
    centres = land.sparkSession.range(rows * columns).select("id", (south + (F.floor(F.col("id") / columns) + 0.5) * step).alias("lat"), (west + (F.col("id") % columns + 0.5) * step).alias("lon"))
    far = distance_to_land(centres, land, "id", "lat", "lon", cap_km * 1000, polygon_id, rings, cell)
    return far.select(F.floor(F.col("id") / columns).alias("lat_i"), (F.col("id") % columns).alias("lon_i"), "on_land", F.least(F.coalesce(F.col("distance_m") / 1000, F.lit(cap_km)), F.lit(cap_km)).alias("dist_land_km"))


def nearest_within(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, lat: str, lon: str, radius_m: float, columns: Sequence[str] = ()) -> DataFrame:
    """Each point's nearest target within a radius, ties to the smaller id; points without one are left out.

    Places and targets that repeat are looked at once. Rings grow: a place looks no further than a
    radius at which a cell has about one target, and who finds none there looks twice as far, up to
    the radius asked for. Cells are four such radii high, so that a place lists one or two each way,
    further east and west where meridians lie close.
    """
    degrees = radius_m / 110_000.0
    spots = written(targets.groupBy(F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).agg(F.min(target_id).alias("__t")).where(~F.isnan("__lat") & ~F.isnan("__lon")), "targets")
    per_cell = spots.groupBy(F.floor(F.col("__lat") / degrees), F.floor(F.col("__lon") / degrees)).agg(F.count("*").alias("n")).agg(F.avg("n").alias("n")).first().n or 1.0
    rounds = min(max(math.ceil(math.log(per_cell, 4)), 0), 12)
    open_, found = written(places_of(points, lon, lat), "open"), []
    for k in range(rounds, -1, -1):
        size, reach = degrees / 2**k, radius_m / 2**k
        cell = lambda c: F.floor(c / (4 * size))  # noqa: B023, E731
        wide = size / F.greatest(F.cos(F.radians(F.least(F.abs("y") + size, F.lit(89.0)))), F.lit(0.02))
        listed = open_.withColumn("__x", F.explode(F.sequence(cell(F.col("x") - wide), cell(F.col("x") + wide)))).withColumn("__y", F.explode(F.sequence(cell(F.col("y") - size), cell(F.col("y") + size))))
        t = spots.select("*", cell(F.col("__lat")).alias("__y"), cell(F.col("__lon")).alias("__x"))
        d = haversine_m(F.col("y"), F.col("x"), F.col("__lat"), F.col("__lon"))
        # listed cells are more than Spark's estimate lets it see: they may not be sent to all tasks
        near = listed.hint("merge").join(t, ["__y", "__x"]).withColumn("distance_m", d).where(F.col("distance_m") <= reach)
        best = written(near.groupBy("x", "y").agg(F.min(F.struct("distance_m", "__t")).alias("b")), "nearest")
        found.append(best)
        if k:
            later = written(open_.join(best, ["x", "y"], "left_anti"), "open")
            discard(open_)
            open_ = later
    nearest = functools.reduce(DataFrame.unionByName, found)
    at = points.select(point_id, *columns, F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    each = at.join(nearest, ["x", "y"]).groupBy(point_id, *columns).agg(F.min("b").alias("b"))
    return each.select(point_id, *columns, F.col("b.__t").alias(target_id), F.col("b.distance_m").alias("distance_m"))


def two_way_coverage(left: DataFrame, right: DataFrame, left_id: str, right_id: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """How many of each side have one of the other within a radius; one row."""
    a = nearest_within(left, right, left_id, right_id, lat, lon, radius_m).agg(F.count("*").alias("left_near"))
    b = nearest_within(right, left, right_id, left_id, lat, lon, radius_m).agg(F.count("*").alias("right_near"))
    return left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right"))).crossJoin(a).crossJoin(b)


def tail_box(df: DataFrame, lat: str, lon: str, tail: float = 0.001, margin: float = 0.5) -> tuple[float, float, float, float] | None:
    """(south, west, north, east) of all but the tails of both coordinates, widened by a margin; corrupt positions don't stretch it."""
    (south, north), (west, east) = (exact_quantiles(df, c, (tail, 1 - tail)) for c in (lat, lon))
    return None if south is None or west is None else (south - margin, west - margin, north + margin, east + margin)


def on_land(positions: DataFrame, land: DataFrame, point_id: str, lat: str, lon: str, polygon_id: str = "polygon", rings: str = "rings", erosion: float = 0.01, band: float = 0.1) -> DataFrame:
    """Positions solidly inside land, once each: inside a polygon by more than `erosion` degrees, and not among the corrupt ones.

    What lies outside the positions' own box without its tails is ignored, however far land reaches.
    """
    box = tail_box(positions, lat, lon)
    if box is None:
        return positions.select(point_id).limit(0)
    south, west, north, east = box
    kept = positions.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))
    edges = polygon_edges(outlines_once(land, polygon_id, rings), polygon_id, rings)
    inside = places_held(places_of(kept, lon, lat), edges, polygon_id, band, erosion, box)
    at = kept.select(point_id, F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    return at.join(inside, ["x", "y"], "left_semi").select(point_id).distinct()


def fingerprint(df: DataFrame, key: str, ts: str, lat: str, lon: str, tail: float = 0.001) -> DataFrame:
    """One row that tells a table again: rows, keys, first and last time, and its box without the tails, to two places."""
    box = tail_box(df, lat, lon, tail, 0.0) or (None,) * 4
    names = ("south", "west", "north", "east")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")).withColumns({n: F.round(F.lit(v).cast("double"), 2) for n, v in zip(names, box)})
