"""Ingest manifest, digests before rows, cell index of polygons."""

import pathlib
import time

import numpy as np
import pytest
from conftest import plan_text, rows
from pyspark.sql import functions as F

from dayspell.operators import joins, spatial
from dayspell.sinks import ingest


def _year_file(folder, year, value, name=None):
    path = pathlib.Path(folder) / (name or f"{year}.csv")
    path.write_text("".join(f"u{i},{year}0601,{value}\n" for i in range(3)))


def test_only_changed_years_are_rewritten(spark, tmp_path):
    source, out, manifest = tmp_path / "by_year", str(tmp_path / "out"), str(tmp_path / "manifest")
    source.mkdir()
    for y in (2000, 2001, 2002):
        _year_file(source, y, 1)
    read_files = []

    def read(paths):
        read_files.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        raw = spark.read.schema("unit string, date string, value int").csv(paths)
        return raw.select("unit", "value", F.substring("date", 1, 4).cast("int").alias("year"))

    def refresh():
        return ingest.refresh_years(spark, str(source), out, manifest, read)

    def stamps():
        return {f.parent.name: f.stat().st_mtime_ns for f in pathlib.Path(out).glob("year=*/*.parquet")}

    def values():
        return {r["year"]: r["value"] for r in rows(spark.read.parquet(out).groupBy("year").agg(F.max("value").alias("value")))}

    assert refresh() == [2000, 2001, 2002] and values() == {2000: 1, 2001: 1, 2002: 1}
    before = stamps()
    assert refresh() == [] and stamps() == before and len(read_files) == 1
    time.sleep(0.05)
    _year_file(source, 2001, 7)  # the same size, another time
    _year_file(source, 2003, 5)
    _year_file(source, 2002, 9, "b-2002.csv")  # one more file of a year
    assert refresh() == [2001, 2002, 2003]
    assert read_files[-1] == ["2001.csv", "2002.csv", "2003.csv", "b-2002.csv"]
    assert values() == {2000: 1, 2001: 7, 2002: 9, 2003: 5} and stamps()["year=2000"] == before["year=2000"]
    (source / "b-2002.csv").rename(tmp_path / "away.csv")
    assert refresh() == [2002] and values()[2002] == 1
    (source / "2003.csv").rename(tmp_path / "away3.csv")
    with pytest.raises(ValueError, match="2003"):
        refresh()
    (source / "notes.csv").write_text("x\n")
    with pytest.raises(ValueError, match="no year"):
        refresh()


def _panel(spark, n=400):
    return spark.range(n).select((F.col("id") % 10).alias("unit"), (F.col("id") % 4 + 2000).cast("int").alias("year"), F.col("id").alias("day"),
                                 (F.col("id") * 0.5).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") * 2.0).alias("y"))


def _plain(old, new, keys, values):
    a, b = ({tuple(r[k] for k in keys): r for r in rows(df)} for df in (old, new))
    out = {}
    for v in values:
        pairs = [(a[k][v] if k in a else None, b[k][v] if k in b else None) for k in a.keys() | b.keys()]
        gaps = [abs(o - n) for o, n in pairs if o is not None and n is not None]
        out[v] = (sum(o is not None for o, _ in pairs), sum(n is not None for _, n in pairs), sum(o is not None and n is None for o, n in pairs),
                  sum(o is None and n is not None for o, n in pairs), max(gaps, default=0.0))
    return out


@pytest.mark.parametrize("change", [
    "x", "case when unit = 3 and day = 23 then x + 0.25 else x end", "case when unit = 3 then null else x end", "x + 1e-9"])
def test_digests_give_the_rows_of_a_full_join(spark, change):
    old, keys = _panel(spark), ["unit", "year", "day"]
    new = old.withColumn("x", F.expr(change)).filter("not (day = 57)" if change != "x" else "true")
    new = new if change == "x" else new.unionByName(old.filter("day = 58").withColumn("day", F.lit(9999).cast("long")))
    got = {r["name"]: r for r in rows(joins.differences(old, new, keys, ["x", "y"]))}
    for name, want in _plain(old, new, keys, ["x", "y"]).items():
        r = got[name]
        assert (r["n_old"], r["n_new"], r["only_old"], r["only_new"]) == want[:4] and r["max_abs_diff"] == pytest.approx(want[4])
        assert r["same"] == (want[2] == want[3] == 0 and want[4] < 1e-4)


def test_equal_builds_shuffle_digests_only(spark, tmp_path):
    for name in ("a", "b"):
        _panel(spark, 20000).write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("a", "b"))
    out = joins.differences(old, new, ["unit", "year", "day"], ["x", "y"])
    assert all(r["same"] and r["n_old"] == (20000 if r["name"] == "x" else 16000) for r in rows(out))
    final = plan_text(out)
    sides = final.split("Initial Plan")[0]
    assert "isFinalPlan=true" in sides and "FullOuter" in final
    # rows of equal groups never reach the join: both sides are cut to the unequal groups first
    assert final.count("LeftSemi") >= 2 or "EmptyRelation" in sides or "LocalTableScan <empty>" in sides


def _ring(n, radius, lon=-100.0, lat=40.0, ring=0, poly=0, wobble=0.3):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = radius * (1 + wobble * np.sin(5 * t))
    return [(poly, ring, i, float(lon + x), float(lat + y)) for i, (x, y) in enumerate(zip(r * np.cos(t), r * np.sin(t)))]


def _odd(x, y, polys):
    for rings in polys:
        crossings = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    crossings += 1
        if crossings % 2:
            return True
    return False


def test_a_cell_index_spares_the_edges(spark):
    shapes = [_ring(400, 4.0) + _ring(60, 1.0, ring=1), _ring(200, 2.5, lon=-97.0, lat=42.0, poly=1),
              [(2, 0, i, x, y) for i, (x, y) in enumerate([(-95.0, 38.0), (-94.0, 38.0), (-94.0, 38.5), (-95.0, 38.5)])]]
    polys = [[[(v[3], v[4]) for v in s if v[1] == r] for r in sorted({v[1] for v in s})] for s in shapes]
    edges = spatial.polygon_edges(spark.createDataFrame([v for s in shapes for v in s], "poly int, ring int, seq int, lon double, lat double"))
    rng = np.random.default_rng(4)
    places = [(float(x), float(y)) for x, y in zip(rng.uniform(-106, -92, 1500), rng.uniform(34, 46, 1500))]
    places += [(-95.0, 38.0), (-94.5, 38.0), (-94.0, 38.25), (-94.5, 38.25), (-95.0, 38.25), (-94.5, 38.5)] + [(v[3], v[4]) for v in shapes[0][::40]]
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(places)] + [(9999, None, None)], "unit int, lat double, lon double")
    for size in (0.25, 1.0):
        got = {r["unit"]: r["inside"] for r in rows(spatial.points_inside(points, edges, size=size))}
        assert len(got) == len(places) + 1 and got[9999] is False
        assert [got[i] for i in range(len(places))] == [_odd(x, y, polys) for x, y in places]
    by_degree = points.withColumn("b", F.floor("lat")).join(edges.filter("y1 <> y2").withColumn("b", F.explode(F.sequence(
        F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))))), "b").count()
    assert spatial.edge_candidates(points, edges).count() * 20 < by_degree
    index = spatial.polygon_index(edges)
    assert index.filter("whole").count() > 300 and index.groupBy("poly", "row", "col").count().filter("count > 1").isEmpty()


def test_crowded_buckets_are_dealt_in_parts(spark):
    """Two thirds of all stations in one bucket: no part of it holds more than twice the median of all parts."""
    rng = np.random.default_rng(8)
    crowd = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(36.1, 38.9, 4000), rng.uniform(-99.9, -95.1, 4000)))]
    spread = [(10_000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(30, 48, 2000), rng.uniform(-119.9, -80.1, 2000)))]
    stations = spark.createDataFrame(crowd + spread, "unit long, lat double, lon double")
    cells = spatial.Grid(31.0, 2.0, 8, -118.0, 2.0, 18).cells(spark).select("cell", "lat", "lon")
    got = spatial.near_pairs(cells, stations, 150.0, per_task=50)
    want = spatial.near_pairs(cells, stations, 150.0, per_task=1_000_000)
    assert got.count() == want.count() > 5_000 and got.exceptAll(want).isEmpty()
    angle = 150.0 / 6371.0
    dealt = spatial._candidates(cells, stations, angle, 50).groupBy("_bi", "_bj", "_part").agg(F.countDistinct("unit").alias("n")).toPandas()["n"]
    assert dealt.max() <= 2 * dealt.median() and (dealt > 150).sum() == 0


def test_points_on_horizontal_edges(spark):
    """Half-open: a northern edge is outside; closed: both horizontal edges are inside, the eastern end is not."""
    ring = [(1, 0, i, x, y) for i, (x, y) in enumerate([(-110.0, 30.0), (-100.0, 30.0), (-100.0, 40.0), (-110.0, 40.0)])]
    edges = spatial.polygon_edges(spark.createDataFrame(ring, "poly int, ring int, seq int, lon double, lat double"))
    places = [(-110.0, 40.0), (-105.0, 40.0), (-100.0, 40.0), (-105.0, 30.0), (-100.0, 30.0), (-99.9, 40.0), (-105.0, 40.1), (-105.0, 35.0)]
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(places)], "unit int, lat double, lon double")
    half_open = [r["inside"] for r in rows(spatial.points_inside(points, edges), "unit")]
    closed = [r["inside"] for r in rows(spatial.points_inside(points, edges, closed=True), "unit")]
    assert half_open == [False, False, False, True, False, False, False, True]
    assert closed == [True, True, False, True, False, False, False, True]
