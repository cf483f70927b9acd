"""Spatial joins as bucketed equi-joins with an exact test.

Every join here has an equality key: latitude/longitude buckets for distances,
index cells for point in polygon, grid columns for areas, unit-wide bins for
axis overlaps. Spark may broadcast a side only where its measured size allows;
a crowded bucket is dealt in as many parts as its measured count asks for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import EARTH_RADIUS_KM, RADIAL_EARTH_RADIUS_KM
from dayspell.functions import geo


@dataclass(frozen=True)
class Grid:
    """A regular grid by first centre, step and size along both axes."""

    lat0: float
    dlat: float
    nlat: int
    lon0: float
    dlon: float
    nlon: int

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, ilat, ilon, lat, lon), cell = ilat * nlon + ilon."""
        ids = spark.range(self.nlat * self.nlon).select(F.col("id").alias("cell"))
        ilat = F.floor(F.col("cell") / self.nlon).cast("int")
        ilon = (F.col("cell") % self.nlon).cast("int")
        return ids.select(
            "cell", ilat.alias("ilat"), ilon.alias("ilon"),
            (F.lit(self.lat0) + ilat * self.dlat).alias("lat"),
            (F.lit(self.lon0) + ilon * self.dlon).alias("lon"))

    def snap(self, points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Add the cell of every point; points outside drop, duplicates stay.

        Nearest index with halves to even. Two stations in one cell keep two
        rows: that is the density weighting the network imposes.
        """
        ilat = F.rint((F.col(lat) - self.lat0) / self.dlat).cast("int")
        ilon = F.rint((F.col(lon) - self.lon0) / self.dlon).cast("int")
        return (
            points.withColumn("_i", ilat).withColumn("_j", ilon)
            .filter(F.col("_i").between(0, self.nlat - 1) & F.col("_j").between(0, self.nlon - 1))
            .withColumn("cell", F.col("_i").cast("bigint") * self.nlon + F.col("_j"))
            .drop("_i", "_j")
        )

    def bin(self, points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Add the cell by truncation from the outer edge, clipped to the grid."""

        def index(coordinate: str, first: float, step: float, size: int) -> Column:
            raw = ((F.col(coordinate) - (first - step / 2)) / step).cast("int")
            return F.least(F.greatest(raw, F.lit(0)), F.lit(size - 1))

        i = index(lat, self.lat0, self.dlat, self.nlat)
        j = index(lon, self.lon0, self.dlon, self.nlon)
        return points.withColumn("cell", i.cast("bigint") * self.nlon + j)


def half_degree_grid() -> Grid:
    """Centres 25.25 .. 49.75 N, 124.25 .. 66.75 W."""
    return Grid(25.25, 0.5, 50, -124.25, 0.5, 116)


def two_degree_band() -> Grid:
    """Two-degree cells of 24-50 N at all longitudes."""
    return Grid(25.0, 2.0, 13, -179.0, 2.0, 180)


# ---- distances ------------------------------------------------------------

_LAT_BIN, _LON_BIN = 3.0, 5.0
_LON_BINS = int(360 / _LON_BIN)


def _covering_buckets(lat: Column, lon: Column, angle: float) -> Column:
    """Buckets that the cap of `angle` radians round a point can touch."""
    reach = math.degrees(angle)
    south, north = lat - reach, lat + reach
    # widest longitude of a spherical cap; all of it once the cap holds a pole
    ratio = F.try_divide(F.lit(math.sin(min(angle, math.pi / 2))), F.cos(F.radians(lat)))
    polar = (north >= 90.0) | (south <= -90.0) | F.isnull(ratio) | (ratio >= 1.0)
    wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    rows = F.sequence(F.floor(south / _LAT_BIN).cast("int"), F.floor(north / _LAT_BIN).cast("int"))
    base = geo.wrap_lon(lon)
    first = F.floor((base - wide) / _LON_BIN).cast("int")
    last = F.least(F.floor((base + wide) / _LON_BIN).cast("int"), first + (_LON_BINS - 1))
    cols = F.sequence(first, last)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(
        r.alias("_bi"), F.pmod(c, F.lit(_LON_BINS)).alias("_bj")))))


def _candidates(cells: DataFrame, stations: DataFrame, angle: float, per_task: int) -> DataFrame:
    """Cell-station pairs that share a bucket; each pair once.

    A station lies in one bucket; a cell is repeated per bucket its cap touches that holds a station. Stations are
    counted first, and a bucket with more than `per_task` of them is dealt in as many
    parts as that takes, each with its own copy of the bucket's cells: a crowded region spreads over tasks, an
    empty one costs nothing.
    """
    lon = geo.wrap_lon(F.col("lon"))
    s = stations.select(
        "unit", F.col("lat").alias("slat"), F.col("lon").alias("slon"),
        F.floor(F.col("lat") / _LAT_BIN).cast("int").alias("_bi"),
        F.pmod(F.floor(lon / _LON_BIN).cast("int"), F.lit(_LON_BINS)).alias("_bj"))
    parts = s.groupBy("_bi", "_bj").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_parts"))
    c = cells.select(
        "cell", F.col("lat").alias("clat"), F.col("lon").alias("clon"),
        F.inline(_covering_buckets(F.col("lat"), F.col("lon"), angle)))
    c = c.join(parts, ["_bi", "_bj"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    s = s.join(parts, ["_bi", "_bj"]).withColumn("_part", F.pmod(F.xxhash64("unit"), F.col("_parts")).cast("int")).drop("_parts")
    return c.join(s, ["_bi", "_bj", "_part"], "inner")


def near_pairs(cells: DataFrame, stations: DataFrame, radius_km: float,
               earth_km: float = EARTH_RADIUS_KM, per_task: int = 1000) -> DataFrame:
    """(cell, unit, km) for stations nearer than `radius_km` by great circle."""
    limit = geo.chord_limit(radius_km, earth_km)
    pairs = _candidates(cells, stations, radius_km / earth_km, per_task)
    c = geo.chord(F.col("clat"), F.col("clon"), F.col("slat"), F.col("slon"))
    return (
        pairs.withColumn("_c", c).filter(F.col("_c") < limit)
        .select("cell", "unit", geo.chord_to_km(F.col("_c"), earth_km).alias("km"))
    )


def radial_pairs(cells: DataFrame, stations: DataFrame, radius_km: float, per_task: int = 1000) -> DataFrame:
    """(cell, unit, km) for 0 <= km < radius by the count-gridding distance.

    The search radius is 5% wider than the target after the earth-radius
    correction, as the method prescribes; the distance then decides.
    """
    slack_km = radius_km * 1.05 * EARTH_RADIUS_KM / RADIAL_EARTH_RADIUS_KM
    limit = geo.chord_limit(slack_km)
    pairs = _candidates(cells, stations, slack_km / EARTH_RADIUS_KM, per_task)
    places = [F.col(n) for n in ("clat", "clon", "slat", "slon")]
    return (
        pairs.filter(geo.chord(*places) <= limit)
        .withColumn("km", geo.radial_km(*places))
        .filter((F.col("km") >= 0) & (F.col("km") < radius_km))
        .select("cell", "unit", "km")
    )


# ---- polygons ---------------------------------------------------------------

def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edges (poly, turn, x1, y1, x2, y2) of vertex rows (poly, ring, seq, lon, lat[, hole]).

    Rings close themselves. `turn` orients each ring, whichever way it was drawn:
    +1 or -1 so that a shell's signed area counts and a hole's is taken away. A
    `hole` column says which rings are holes; without it those that run against
    their polygon's largest ring are.
    """
    w = Window.partitionBy("poly", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def following(name: str) -> Column:
        return F.coalesce(F.lead(name).over(w), F.first(name).over(whole))

    hole = F.col("hole") if "hole" in vertices.columns else F.lit(None).cast("boolean")
    edges = vertices.select(
        "poly", "ring", hole.alias("_hole"), F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        following("lon").alias("x2"), following("lat").alias("y2"))
    doubled = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    edges = edges.withColumn("_area", doubled.over(Window.partitionBy("poly", "ring")))
    shell = F.max_by("_area", F.abs("_area")).over(Window.partitionBy("poly"))
    own = F.signum("_area")
    turn = F.when(F.col("_hole").isNull(), F.signum(shell)).when(F.col("_hole"), -own).otherwise(own)
    return edges.withColumn("turn", turn.cast("int")).select("poly", "turn", "x1", "y1", "x2", "y2")


def polygon_index(edges: DataFrame, size: float = 0.25) -> DataFrame:
    """(row, col, poly, whole): the cells of `size` degrees that a polygon touches. `whole` cells lie inside it; through
    the others an edge runs. Cells outside are not listed."""
    row_edges = _rows_of_edges(edges, size)
    # the stretch of the row that an edge passes over; a little wider, so that rounding loses no cell
    south, north = F.col("row") * size, (F.col("row") + 1) * size
    low = F.greatest(F.least("y1", "y2"), south)
    high = F.least(F.greatest("y1", "y2"), north)
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col(x)).otherwise(_x_at(y)) for x, y in (("x1", low), ("x2", high))]
    cols = F.sequence(*[F.floor((f(*ends) + pad) / size).cast("int") for f, pad in ((F.least, -1e-9), (F.greatest, 1e-9))])
    edge_cells = row_edges.select("poly", "row", F.explode(cols).alias("col")).distinct()
    # where the row's middle line enters and leaves the polygon
    middle = (F.col("row") + 0.5) * size
    crossing = F.when((F.col("y1") > middle) != (F.col("y2") > middle), _x_at(middle))
    lines = row_edges.groupBy("poly", "row").agg(F.sort_array(F.collect_list(crossing)).alias("_x"))
    pieces = lines.filter(F.size("_x") > 1).select("poly", "row", "_x", F.explode(F.sequence(
        F.lit(0), F.size("_x") - 2, F.lit(2))).alias("_k"))
    first = F.ceil(F.get("_x", F.col("_k")) / size - 0.5).cast("int")
    last = F.floor(F.get("_x", F.col("_k") + 1) / size - 0.5).cast("int")
    between = pieces.filter(first <= last).select("poly", "row", F.explode(F.sequence(first, last)).alias("col"))
    whole = between.join(edge_cells, ["poly", "row", "col"], "left_anti")
    return whole.withColumn("whole", F.lit(True)).unionByName(edge_cells.withColumn("whole", F.lit(False)))


def _rows_of_edges(edges: DataFrame, size: float) -> DataFrame:
    """Edges repeated per row of cells that they reach."""
    return edges.select("poly", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / size).cast("int"), F.floor(F.greatest("y1", "y2") / size).cast("int"))).alias("row"))


def _x_at(y: Column) -> Column:
    """Where an edge, or the line through it, has the latitude `y`."""
    return F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))


def edge_candidates(points: DataFrame, edges: DataFrame, key: Sequence[str] = ("unit",), size: float = 0.25,
                    level: bool = False) -> DataFrame:
    """Points in cells that an edge runs through, beside that polygon's edges of the same row; horizontal ones only
    if `level`."""
    return _in_cells(points, edges, key, size).filter(~F.col("whole")).join(
        _rows_of_edges(edges if level else edges.filter(F.col("y1") != F.col("y2")), size), ["poly", "row"], "inner")


def _in_cells(points: DataFrame, edges: DataFrame, key: Sequence[str], size: float) -> DataFrame:
    p = points.select(*key, F.col("lat"), geo.wrap_lon(F.col("lon")).alias("_x")).withColumn(
        "row", F.floor(F.col("lat") / size).cast("int")).withColumn("col", F.floor(F.col("_x") / size).cast("int"))
    return p.join(polygon_index(edges, size), ["row", "col"], "inner")


def points_inside(points: DataFrame, edges: DataFrame, key: Sequence[str] = ("unit",), size: float = 0.25,
                  closed: bool = False) -> DataFrame:
    """Points with `inside`: whether, for any polygon, a ray to the east crosses its edges an odd
    number of times; polygons may overlap.

    A cell index decides most points by an equi-join: those in a cell that lies whole inside a polygon, or in none
    that one touches. Only points in a cell through which an edge runs meet edges, and only those of their own row of cells.
    Crossings are summed map-side before the shuffle. Rays use half-open edges, so a vertex
    counts once and a horizontal edge never. So points on a northern edge lie outside and those on a southern one inside;
    `closed` takes in both: points on a horizontal edge, from its western end up to, but without, its eastern one.
    """
    sure = _in_cells(points, edges, key, size).filter("whole").select(*key)
    y = F.col("lat")
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    crossing = F.when(spans & (F.col("_x") < _x_at(y)), 1).otherwise(0)
    on_edge = (F.col("y1") == y) & (F.col("y2") == y) & (F.least("x1", "x2") <= F.col("_x")) & (F.col("_x") < F.greatest("x1", "x2"))
    odd = edge_candidates(points, edges, key, size, level=closed).groupBy(*key, "poly").agg(
        (F.sum(crossing) % 2).alias("_odd"), F.max(on_edge).alias("_on"))
    odd = odd.filter((F.col("_odd") == 1) | (F.lit(closed) & F.col("_on"))).select(*key)
    found = sure.unionByName(odd).distinct().withColumn("_in", F.lit(True))
    return points.join(found, list(key), "left").withColumn(
        "inside", F.coalesce(F.col("_in"), F.lit(False))).drop("_in")


def _area_below(y1: Column, y2: Column, dx: Column, south: Column, north: Column) -> Column:
    """Integral of clamp(y, south, north) - south along an edge piece, signed by dx."""
    height = north - south

    def primitive(y: Column) -> Column:
        up = y - south
        return (F.when(up <= 0, F.lit(0.0)).when(up >= height, height * height / 2 + (up - height) * height)
                .otherwise(up * up / 2))

    rise = y2 - y1
    flat = F.least(F.greatest((y1 + y2) / 2 - south, F.lit(0.0)), height)
    sloped = F.try_divide(primitive(y2) - primitive(y1), rise)
    return dx * F.when(F.abs(rise) < 1e-9, flat).otherwise(sloped)


def cell_fractions(edges: DataFrame, grid: Grid, keep: Sequence[str] = ("cell", "lat", "lon")) -> DataFrame:
    """Share of each grid cell inside the polygons (planar area), cells with any overlap.

    The area of a polygon inside a cell is the signed sum over its edges of the
    area under the edge, with the height clamped to the cell. That needs no
    clipping, so it stays in built-in expressions for any simple polygon with
    holes: an edge goes to the grid columns it spans and is summed per cell and
    polygon. Polygons are taken not to overlap each other; their shares add up.
    """
    spark = edges.sparkSession
    west = F.col("lon") - grid.dlon / 2
    cells = grid.cells(spark).select(
        *keep, F.col("ilon").alias("_col"), west.alias("_w"), (west + grid.dlon).alias("_e"),
        (F.col("lat") - grid.dlat / 2).alias("_s"), (F.col("lat") + grid.dlat / 2).alias("_n"))

    def column_of(x: Column) -> Column:
        return F.floor((x - (grid.lon0 - grid.dlon / 2)) / grid.dlon).cast("int")

    lo = F.greatest(column_of(F.least("x1", "x2")), F.lit(0))
    hi = F.least(column_of(F.greatest("x1", "x2")), F.lit(grid.nlon - 1))
    pieces = edges.filter(F.col("x1") != F.col("x2")).withColumn("_lo", lo).withColumn("_hi", hi)
    pieces = pieces.filter(F.col("_lo") <= F.col("_hi")).withColumn(
        "_col", F.explode(F.sequence("_lo", "_hi")))

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.col("_w")), F.col("_e"))

    def height_at(x: Column) -> Column:
        return F.col("y1") + F.try_divide((x - F.col("x1")) * (F.col("y2") - F.col("y1")),
                                          F.col("x2") - F.col("x1"))

    a, b = clip(F.col("x1")), clip(F.col("x2"))
    part = _area_below(height_at(a), height_at(b), b - a, F.col("_s"), F.col("_n"))
    area = F.abs(F.sum(F.col("turn") * part)) / F.lit(grid.dlat * grid.dlon)
    return (
        cells.join(pieces.select("_col", "poly", "turn", "x1", "y1", "x2", "y2"), "_col", "inner")
        .groupBy(*keep, "poly").agg(area.alias("_share"))
        .groupBy(*keep).agg(F.least(F.sum("_share"), F.lit(1.0)).alias("fraction"))
        .filter(F.col("fraction") > 1e-12)
    )


def subtract_fractions(land: DataFrame, taken: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """`land` fractions less those of `taken`, a set of areas inside it (lakes); emptied cells drop."""
    less = taken.select(*keys, F.col("fraction").alias("_taken"))
    rest = F.col("fraction") - F.coalesce(F.col("_taken"), F.lit(0.0))
    return land.join(less, list(keys), "left").withColumn("fraction", rest).drop("_taken").filter(
        F.col("fraction") > 1e-12)


def cell_weights(fractions: DataFrame, dlat: float) -> DataFrame:
    """weight = share inside the polygon x width of the latitude band on the sphere."""
    band = geo.band_weight(F.col("lat") - dlat / 2, F.col("lat") + dlat / 2)
    return fractions.withColumn("weight", F.col("fraction") * band)


# ---- axes -------------------------------------------------------------------

def axis_edges(axes: DataFrame) -> DataFrame:
    """Cell edges halfway between the centres of each axis: (axis, idx, centre, lo, hi).

    Input rows (axis, centre); windows run per axis, whose length is a grid's side.
    """
    w = Window.partitionBy("axis").orderBy("centre")
    before, after = F.lag("centre").over(w), F.lead("centre").over(w)
    c = F.col("centre")
    lo = F.when(before.isNull(), c - (after - c) / 2).otherwise(before + (c - before) / 2)
    hi = F.when(after.isNull(), c + (c - before) / 2).otherwise(c + (after - c) / 2)
    return axes.select("axis", "centre").distinct().select(
        "axis", (F.row_number().over(w) - 1).alias("idx"), "centre", lo.alias("lo"), hi.alias("hi"))


def axis_nearest(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Nearest source centre of every target centre per axis: (axis, target, source).

    Both inputs are (axis, centre). The two axes are merged in order, and each
    target compares the last source at or below it with the first above it; a
    tie goes to the lower one.
    """
    both = (
        targets.select("axis", "centre").distinct().withColumn("_src", F.lit(None).cast("double"))
        .unionByName(sources.select("axis", "centre").distinct().withColumn("_src", F.col("centre")))
    )
    # both frames end at the current row, so each grows by one row per step
    upward = Window.partitionBy("axis").orderBy("centre")
    downward = Window.partitionBy("axis").orderBy(F.desc("centre"))
    below = F.last("_src", ignorenulls=True).over(
        upward.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.last("_src", ignorenulls=True).over(
        downward.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    c = F.col("centre")
    pick = F.when(F.col("_a").isNull() | (c - F.col("_b") <= F.col("_a") - c), F.col("_b")).otherwise(
        F.col("_a"))
    return (
        both.withColumn("_b", below).withColumn("_a", above)
        .filter(F.col("_src").isNull())
        .select("axis", c.alias("target"), F.coalesce(pick, F.col("_a")).alias("source"))
    )


def carry_mask_nearest(target_cells: DataFrame, source_cells: DataFrame, mask: str = "land") -> DataFrame:
    """Give every target cell the mask of the source cell with the nearest centre."""

    def axes(cells: DataFrame) -> DataFrame:
        return cells.select(F.inline(F.array(
            F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("centre")),
            F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("centre")))))

    near = axis_nearest(axes(target_cells), axes(source_cells))

    def side(axis: str) -> DataFrame:
        return near.filter(F.col("axis") == axis).select(
            F.col("target").alias(axis), F.col("source").alias(f"_{axis}"))

    source = source_cells.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), mask)
    return (
        target_cells.join(side("lat"), "lat").join(side("lon"), "lon")
        .join(source, ["_lat", "_lon"], "left").drop("_lat", "_lon")
    )


def axis_overlap(targets: DataFrame, sources: DataFrame, period: float | None = None) -> DataFrame:
    """Share of each target interval covered by each source interval: (target, source, share).

    Inputs are (centre, lo, hi). Intervals are spread over whole-degree bins and a
    pair is kept in the bin where its overlap starts, so it appears once per turn.
    """
    turns = [0.0] if period is None else [-period, 0.0, period]
    s = sources.select(F.col("centre").alias("source"), "lo", "hi").withColumn(
        "_t", F.explode(F.array(*[F.lit(t) for t in turns])))
    s = s.select("source", (F.col("lo") + F.col("_t")).alias("slo"), (F.col("hi") + F.col("_t")).alias("shi"))

    def bins(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(
            F.floor(lo).cast("int"), F.floor(hi).cast("int"))))

    t = targets.select(F.col("centre").alias("target"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    start = F.greatest("tlo", "slo")
    width = F.least("thi", "shi") - start
    return (
        bins(t, "tlo", "thi").join(bins(s, "slo", "shi"), "_bin")
        .filter((width > 0) & (F.floor(start) == F.col("_bin")))
        .groupBy("target", "source").agg((F.sum(width / (F.col("thi") - F.col("tlo")))).alias("share"))
    )


def land_fraction(target_cells: DataFrame, source_cells: DataFrame, land: str = "land") -> DataFrame:
    """Area share of every target cell that coarser or finer source cells call land.

    Target and source hold (lat, lon) centres of full rectangular grids; the
    share is the product of the two axis overlaps, divided by what is covered.
    """

    def axis(cells: DataFrame, name: str) -> DataFrame:
        # a centre at or past the seam moves to [-180, 180) first
        c = geo.wrap_lon(F.col(name)) if name == "lon" else F.col(name)
        return axis_edges(cells.select(F.lit(name).alias("axis"), c.alias("centre")))

    wy = axis_overlap(axis(target_cells, "lat"), axis(source_cells, "lat")).select(
        F.col("target").alias("lat"), F.col("source").alias("slat"), F.col("share").alias("wy"))
    wx = axis_overlap(axis(target_cells, "lon"), axis(source_cells, "lon"), 360.0).select(
        F.col("target").alias("lon"), F.col("source").alias("slon"), F.col("share").alias("wx"))
    source = source_cells.select(F.col("lat").alias("slat"), geo.wrap_lon(F.col("lon")).alias("slon"),
                                 F.col(land).cast("double").alias("_land"))
    covered = source.join(wy, "slat").join(wx, "slon").groupBy("lat", "lon").agg(
        F.try_divide(F.sum(F.col("wy") * F.col("wx") * F.col("_land")),
                     F.sum(F.col("wy") * F.col("wx"))).alias("land_fraction"))
    cells = target_cells.withColumn("lon", geo.wrap_lon(F.col("lon")))
    return cells.join(covered, ["lat", "lon"], "left").na.fill(0.0, ["land_fraction"])
