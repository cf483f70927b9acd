"""The master build with shared tables: one scan per field, resumed builds, refusals, versions."""

import datetime as dt

import pytest
from conftest import plan_text, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_master import COARSE, GRID, RULES, YEARS, _cells, _field
from test_master import inputs as _lazy_inputs  # noqa: F401  (the fixture)

from dayspell.operators import guards
from dayspell.plans import master, master_facts
from dayspell.plans.inputs import Inputs
from dayspell.plans.master_builders import builders, update
from dayspell.plans.store import Store
from dayspell.sources import tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Prepared tables on disk, as a run has them."""
    home = tmp_path_factory.mktemp("inputs")

    def put(df, name):
        df.write.parquet(str(home / name))
        return spark.read.parquet(str(home / name))

    daily = {("berkeley", "tmax"): put(_field(spark, GRID), "b_tmax"), ("berkeley", "tmin"): put(_field(spark, GRID, -9.0), "b_tmin"),
             ("20cr", "tmax"): put(_field(spark, COARSE), "r_tmax")}
    cells = {"berkeley": put(_cells(spark, GRID), "b_cells"), "20cr": put(_cells(spark, COARSE), "r_cells")}
    st = put(spark.createDataFrame([(f"s{i}", 35.0 + i % 3, -100.0 + i % 4) for i in range(6)], "unit string, lat double, lon double"), "stations")
    days = GRID.snap(st).select("unit", "cell").join(daily["berkeley", "tmax"], "cell").filter(F.month("day").between(5, 9))
    pair = put(days.select("unit", "day", F.round("value", 1).alias("raw"), F.round(F.col("value") + 0.3, 1).alias("adj")), "pair")
    return Inputs(daily=daily, cells=cells, pair_days=pair, pair_stations=st, berkeley_grid=GRID)


def test_stored_columns_equal_the_lazy_ones(spark, stored, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    lazy, shared = builders(stored, RULES), builders(stored, RULES, store)
    assert set(lazy) == set(shared) and len(lazy) >= 14
    for name in lazy:
        a, b = ({r["year"]: r["value"] for r in rows(x[name]())} for x in (lazy, shared))
        assert a.keys() == b.keys(), name
        for year in a:
            assert (a[year] is None) == (b[year] is None), name
            assert a[year] is None or a[year] == pytest.approx(b[year], abs=1e-9), name
    fields = [n for n in store.built if n.startswith("cell_years")]
    assert sorted(fields) == ["cell_years__20cr__tmax", "cell_years__berkeley__tmax", "cell_years__berkeley__tmin"]
    assert store.built.count("pair_years") == 1


def test_a_field_is_scanned_once(spark, stored):
    facts = master_facts.Facts(stored, RULES)
    field, cells = stored.daily["berkeley", "tmax"], stored.cells["berkeley"]
    text = plan_text(facts._field_years(field, cells))
    assert text.count("FileScan parquet") == 2  # the field and its cell table
    assert text.count("Exchange hashpartitioning(cell") == 1
    assert plan_text(facts.pair_years).count("FileScan parquet") == 1


def test_columns_of_a_second_domain_read_no_field(spark, stored, tmp_path):
    made = builders(stored, RULES, Store(spark, str(tmp_path / "s")))
    made["conus_hw_days__berkeley"]()
    for name in ("band_hw_days__berkeley", "conus_records__berkeley", "band_jja_tmax_anom__berkeley", "conus_records__berkeley_at_ushcn"):
        read = made[name]().inputFiles()
        assert not any("/b_tmax/" in f for f in read) and any("/cell_years__berkeley__tmax-" in f for f in read)


def test_interrupted_builds_resume(spark, stored, tmp_path):
    folder = str(tmp_path / "master")
    broken = Inputs(**{**stored.__dict__, "daily": {**stored.daily, ("20cr", "tmax"): stored.daily["20cr", "tmax"].withColumn("value", F.lit(300.0))}})
    with pytest.raises(guards.RefusedInput, match="degC"):
        update(spark, folder, broken, RULES, sections=[2], datasets=["berkeley", "20cr"], years=YEARS)
    assert tables.committed_master(spark, folder) is None
    assert set(Store(spark, f"{folder}/shared").listed) == {"cell_years__berkeley__tmax"}
    watch = []
    original = Store.write
    Store.write = lambda self, name, *a, **k: watch.append(name) or original(self, name, *a, **k)
    try:
        done = update(spark, folder, stored, RULES, sections=[2], datasets=["berkeley", "20cr"], years=YEARS)
        assert done == ["conus_records__berkeley", "conus_records__20cr"] and watch == ["cell_years__20cr__tmax"]
        assert update(spark, folder, stored, RULES, sections=[2], datasets=["berkeley", "20cr"], years=YEARS) == []
        more = update(spark, folder, stored, RULES, sections=[5], datasets=["berkeley"], years=YEARS)
    finally:
        Store.write = original
    assert more == ["conus_hw_days__berkeley", "band_hw_days__berkeley"] and len(watch) == 1
    table, catalogue = tables.committed_master(spark, folder)
    assert table.columns == ["year", *[c for c in master.all_columns() if c in {*done, *more}]]
    listed = {r["series"]: int(r["n_years"]) for r in rows(catalogue)}
    assert set(listed) == {*done, *more} and min(listed.values()) == YEARS[1] - YEARS[0] + 1


def test_an_unfinished_version_is_not_read(spark, stored, tmp_path):
    folder = str(tmp_path / "m")
    update(spark, folder, stored, RULES, sections=[5], datasets=["berkeley"], years=YEARS)
    before = tables.committed_version(spark, folder)
    spark.range(1).write.csv(f"{folder}/version-stopped/table")  # a run that was lost while writing
    assert tables.committed_version(spark, folder) == before
    assert rows(tables.committed_master(spark, folder)[0].groupBy().count()) == [{"count": 8}]


def _pair_with(stored, expression):
    return Inputs(**{**stored.__dict__, "pair_days": stored.pair_days.withColumn("adj", F.expr(expression))})


def test_builds_refuse_and_can_be_told_not_to(spark, stored, tmp_path):
    one_leg = _pair_with(stored, "case when day > '2003-07-01' then adj end")
    with pytest.raises(PySparkException, match="same days"):
        rows(builders(one_leg, RULES)["conus_records__ushcn"]())
    assert rows(builders(one_leg, RULES, check=False)["conus_records__ushcn"]())
    lost = Inputs(**{**stored.__dict__, "pair_stations": stored.pair_stations.filter("unit <> 's1'")})
    with pytest.raises(PySparkException, match="position table"):
        rows(builders(lost, RULES)["conus_records__berkeley_at_ushcn"]())
    assert rows(builders(lost, RULES, check=False)["conus_records__berkeley_at_ushcn"]())
    gap = Inputs(**{**stored.__dict__, "pair_days": stored.pair_days.filter("date_format(day, 'MMdd') <> '0704'")})
    with pytest.raises(PySparkException, match="sum to 153"):
        rows(builders(gap, RULES)["conus_records__ushcn"]())
    assert rows(builders(gap, RULES, check=False)["conus_records__ushcn"]())
    hole = Inputs(**{**stored.__dict__, "daily": {**stored.daily, ("berkeley", "tmax"): stored.daily["berkeley", "tmax"].filter("day <> '2003-07-04'")}})
    with pytest.raises(guards.RefusedInput, match="2003.*not consecutive"):
        builders(hole, RULES, Store(spark, str(tmp_path / "a")))["band_hw_days__berkeley"]()
    assert rows(builders(hole, RULES, Store(spark, str(tmp_path / "b")), check=False)["band_hw_days__berkeley"]())


def test_observed_facts_of_a_field(spark):
    days = spark.sql("select explode(sequence(date'1999-12-30', date'2001-01-02')) as day").withColumn("value", F.lit(10.0))
    df = days.filter("day not in ('2000-06-15', '2000-03-03')").withColumn("value", F.when(F.col("day") != "2000-07-01", F.col("value")))
    facts = guards.FieldFacts.of(rows(df.agg(*guards.field_metrics()))[0])
    assert facts.days[0] == dt.date(1999, 12, 30) and len(facts.days) == 368 and facts.last_full_year == 2000
    assert facts.n_missing == 1 and facts.n_nan == 0 and facts.mean == 10.0
    assert facts.missing_months((2000, 2001), (1, 2)) == [(2001, 2)] and facts.broken_years((5, 6)) == [2000]
    assert facts.short_years((1,)) == [2001] and facts.broken_years((1,)) == []
    refusals = {"not consecutive": {}, "months missing": dict(months=(1, 2), years=(2000, 2001)),
                "lack season days": dict(months=(1,), whole_years=True), "inside the season": dict(months=(7,), values=True)}
    for message, rule in refusals.items():
        with pytest.raises(guards.RefusedInput, match=message):
            guards.judge_field(facts, "f", **rule)
    guards.judge_field(facts, "f", months=(7,))
    for broken, message in ((df.withColumn("value", F.lit(float("nan"))), "NaN"), (df.withColumn("value", F.lit(280.0)), "degC"),
                            (df.filter("1 = 0"), "no rows"), (df.withColumn("day", F.lit(None).cast("date")), "no date")):
        with pytest.raises(guards.RefusedInput, match=message):
            guards.judge_field(guards.FieldFacts.of(rows(broken.agg(*guards.field_metrics()))[0]), "f", months=(7,))
