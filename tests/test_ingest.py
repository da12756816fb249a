"""CSV ingest over fixtures in the shape of the brew logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from steepgrid.plans import ingest_queries
from steepgrid.plans.ingest import ingest, merge_logs
from steepgrid.schemas import BEANS, RECIPE
from steepgrid.sources import logs
from steepgrid.sources.seed import SERIES, seed_if_empty, seed_recipes, starter_tables
from steepgrid.sources.tables import append_rows

HEADER = "Day,Weather,days_passed,mesh,gram,extraction_time\n"
TAGS = {"2031_03": ("Sidamo Blue", "Aki"), "2031_04": ("Sidamo Blue", "Aki")}
DEFAULT = ("Huila Red", "Aki")


def measures(k):
    """Made-up measures of the k-th brew: each column is a line in k."""
    return f"{3 + 2 * k},{20 + k / 4},{11 + k / 8},{41 + 3 * k}"


def log(*rows):
    return HEADER + "\n".join(f"{day},{weather},{measures(k)}" for day, weather, k in rows)


@pytest.fixture
def folder(tmp_path):
    march = [("2031年3月4日", "雨", 0), ("2031年3月9日", "晴", 1), ("2031年3月9日", "くもり/晴", 2), ("2031年3月30日", "くもり/雨", 3)]
    (tmp_path / "2031_03.csv").write_text(log(*march), encoding="utf-8")
    (tmp_path / "2031_04.csv").write_text(log(("2031年4月1日", "", 4), ("2031年4月17日", "雪", 5)), encoding="utf-8")
    (tmp_path / "weather.csv").write_text(
        "date,temperature,humidity\n2031-03-04,11.5,40.0\n2031-03-09,-7.5,41.4\n2031-04-01,-0.25,71.6\n2031-04-17,3.0,52.5\n"
    )
    return tmp_path


@pytest.fixture
def beans(spark):
    return spark.createDataFrame(
        [(7, 1, "Sidamo Blue", "Ethiopia"), (3, 2, "Sidamo Blue", "Ethiopia"), (9, 1, "Kona", "Hawaii")], BEANS
    )


def merged(spark, folder):
    return merge_logs(spark, f"{folder}/20*.csv", f"{folder}/weather.csv", TAGS, DEFAULT)


def test_merge_gives_the_expected_rows(spark, folder):
    rows, bad = merged(spark, folder)
    assert bad.count() == 0
    got = [tuple(r) for r in rows.orderBy(*logs.FILE_ORDER).drop(*logs.FILE_ORDER).collect()]
    days = [
        (3, 4, 1, "雨", 11.5, 40.0), (3, 9, 6, "晴れ", -7.5, 41.4), (3, 9, 6, "晴れ", -7.5, 41.4), (3, 30, 6, "雨", 20.0, 60.0),
        (4, 1, 1, "晴れ", -0.25, 71.6), (4, 17, 3, "雪", 3.0, 52.5),
    ]
    assert got == [
        (dt.date(2031, month, day), 2031, month, day, weekday, weather, 3.0 + 2 * k, 20 + k / 4, 11 + k / 8, 41 + 3 * k,
         "Sidamo Blue", "Aki", temperature, humidity)
        for k, (month, day, weekday, weather, temperature, humidity) in enumerate(days)
    ]


def test_unlisted_month_takes_the_default_names(spark, folder):
    (folder / "2032_01.csv").write_text(log(("2032年1月3日", "晴", 9)), encoding="utf-8")
    rows, _ = merged(spark, folder)
    assert [r.bean_name for r in rows.where("year = 2032").collect()] == ["Huila Red"]


def test_a_month_may_be_named_by_its_folder(spark, tmp_path):
    (tmp_path / "2031_03").mkdir()
    (tmp_path / "2031_03" / "part-0.csv").write_text(log(("2031年3月4日", "雨", 0)), encoding="utf-8")
    tagged = logs.with_file_tags(logs.read_monthly(spark, f"{tmp_path}/20*/*.csv"), TAGS, DEFAULT)
    assert [(r.year_month, r.bean_name) for r in tagged.collect()] == [("2031_03", "Sidamo Blue")]


def test_a_bad_day_sets_its_whole_file_aside(spark, folder):
    (folder / "2032_01.csv").write_text(log(("2032年1月3日", "晴", 8), ("not a day", "晴", 9)), encoding="utf-8")
    rows, bad = merged(spark, folder)
    assert rows.count() == 6
    assert [(r.file_path.rsplit("/", 1)[1], r.bad_rows) for r in bad.collect()] == [("2032_01.csv", 1)]


BROKEN = {
    "day": ("2032年13月3日,晴,7,21,12,50", ["day"]),
    "no day": (",晴,7,21,12,50", ["day"]),
    "days_passed": ("2032年1月3日,晴,week,21,12,50", ["row"]),
    "mesh": ("2032年1月3日,晴,7,fine,12,50", ["row"]),
    "gram": ("2032年1月3日,晴,7,21,12g,50", ["row"]),
    "extraction_time": ("2032年1月3日,晴,7,21,12,50s", ["row"]),
    "no mesh": ("2032年1月3日,晴,7,,12,50", ["mesh"]),
    "no gram": ("2032年1月3日,晴,7,21,,50", ["gram"]),
    "no time": ("2032年1月3日,晴,7,21,12,", ["extraction_time"]),
    "short": ("2032年1月3日,晴,7,21", ["row"]),
    "long": ("2032年1月3日,晴,7,21,12,50,1", ["row"]),
}


@pytest.mark.parametrize("case", BROKEN)
def test_every_broken_column_sets_its_file_aside(spark, folder, case):
    row, reasons = BROKEN[case]
    (folder / "2032_01.csv").write_text(log(("2032年1月2日", "晴", 8)) + "\n" + row, encoding="utf-8")
    rows, bad = merged(spark, folder)
    assert rows.count() == 6
    assert [(r.file_path.rsplit("/", 1)[1], r.bad_rows, r.reasons) for r in bad.collect()] == [("2032_01.csv", 1, reasons)]


def test_a_row_may_leave_out_weather_and_days(spark, folder):
    (folder / "2032_01.csv").write_text(HEADER + "2032年1月3日,,,21,12,50", encoding="utf-8")
    rows, bad = merged(spark, folder)
    assert bad.count() == 0 and [(r.weather, r.days_passed) for r in rows.where("year = 2032").collect()] == [("晴れ", None)]


def test_no_readable_file_is_an_error(spark, tmp_path):
    (tmp_path / "2032_01.csv").write_text(log(("never", "晴", 1)), encoding="utf-8")
    with pytest.raises(ValueError):
        merge_logs(spark, f"{tmp_path}/20*.csv", f"{tmp_path}/weather.csv", TAGS, DEFAULT)


def test_csv_logs_with_a_bad_row_in_every_month_has_no_rows(spark, tmp_path):
    rows = [(1499 * i, 8 * i, "F", 10.5, dt.datetime(1995, i, 3), "5-LOW") for i in (1, 2)]
    rows += [(key, 8, "O", 11.5, dt.datetime(1995, 1, 4), "1-URGENT") for key in (1, 2)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    found = ingest_queries.csv_logs(spark, str(tmp_path))
    assert found.count() == 0 and "extraction_time" in found.columns
    assert ingest_queries.csv_quarantine(spark, str(tmp_path)).count() == 2


def test_missing_weather_file_fills_the_defaults(spark, folder):
    rows, _ = merge_logs(spark, f"{folder}/20*.csv", f"{folder}/absent.csv", TAGS, DEFAULT)
    assert {(r.temperature, r.humidity) for r in rows.collect()} == {(20.0, 60.0)}
    with pytest.raises(Exception):
        logs.read_weather(spark, f"{folder}/absent.csv")


def test_merged_csv_round_trip(spark, folder, tmp_path):
    rows, _ = merged(spark, folder)
    logs.write_merged(rows.drop(*logs.FILE_ORDER), f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns[:3] == ["date", "year", "month"] and back.count() == 6


@pytest.mark.parametrize("partition", [None, "date"])
def test_ingest_twice_is_ingest_once(spark, folder, beans, partition):
    path = f"{folder}/recipe"
    stored = spark.createDataFrame([(41, 3, dt.date(2031, 3, 4), "雨", 11.5, 40, 11.0, 20.0, 41.0, 3.0)], RECIPE)
    append_rows(stored, path, partition)
    (folder / "2031_04.csv").write_text(
        log(("2031年4月1日", "", 4), ("2031年4月1日", "晴", 4), ("2031年4月17日", "雪", 5)).replace("晴,11,21.0", "晴,11,29.0"),
        encoding="utf-8",
    )
    first = ingest(spark, merged(spark, folder)[0], beans, path, partition=partition)
    assert [tuple(r) for r in first.report.collect()] == [(5, 2)]
    assert [tuple(r)[:2] for r in first.duplicates.collect()] == [(1, 7)]
    stored = spark.read.schema(RECIPE).parquet(path)
    assert sorted(r.id for r in stored.collect()) == [41, 42, 43, 44, 45, 46]
    # The smallest id stands for a shared name, the first row of a key wins, humidity is rounded.
    row = stored.where("date = '2031-04-01'").collect()
    assert len(row) == 1 and row[0].bean_id == 3 and row[0].mesh == 21.0 and row[0].humidity == 72

    again = ingest(spark, merged(spark, folder)[0], beans, path, partition=partition)
    assert [tuple(r) for r in again.report.collect()] == [(0, 7)]
    assert spark.read.parquet(path).count() == 6


def test_unknown_bean_names_are_reported(spark, folder, beans):
    (folder / "2032_01.csv").write_text(log(("2032年1月3日", "晴", 9)), encoding="utf-8")
    path = f"{folder}/recipe"
    spark.createDataFrame([], RECIPE).write.parquet(path)
    result = ingest(spark, merged(spark, folder)[0], beans, path)
    assert [r.bean_name for r in result.unknown_names.collect()] == ["Huila Red"]
    assert spark.read.parquet(path).count() == 6
    assert result.summary.first().bean_names == 2


def test_names_of_another_spelling_are_resolved_by_collation(spark, folder, beans):
    path = f"{folder}/recipe"
    spark.createDataFrame([], RECIPE).write.parquet(path)
    spelt = {month: ("SIDAMO blue ", user) for month, (_, user) in TAGS.items()}
    rows, _ = merge_logs(spark, f"{folder}/20*.csv", f"{folder}/weather.csv", spelt, DEFAULT)
    assert ingest(spark, rows, beans, path).inserted.count() == 0
    result = ingest(spark, rows, beans, path, collation="UNICODE_CI_AI_RTRIM")
    assert result.inserted.count() == 6 and result.unknown_names.count() == 0
    assert [tuple(r) for r in result.report.collect()] == [(6, 0)]


def test_seed_rows(spark):
    rows = seed_recipes(spark, 20, "2025-07-01", SERIES[0])
    assert rows.count() == 20
    first = rows.orderBy(F.desc("date")).first()
    assert (first.date, first.weather, first.humidity) == (dt.date(2025, 6, 10), "曇り", 46)
    assert first.gram == pytest.approx(2.2) and first.mesh == pytest.approx(17.0)
    empty = spark.createDataFrame([], RECIPE)
    assert seed_if_empty([empty, empty], rows).count() == 20
    assert seed_if_empty([empty, rows], rows).count() == 0


def test_starter_tables(spark):
    users, beans, recipes = starter_tables(spark, "2031-05-01")
    assert (users.count(), beans.count(), recipes.count()) == (3, 8, 47)
    assert users.columns == ["id", "name", "email", "role"] and recipes.select("id").distinct().count() == 47
    assert recipes.join(beans, recipes.bean_id == beans.id, "left_anti").count() == 0
    assert beans.join(users, beans.user_id == users.id, "left_anti").count() == 0
    per_bean = {r.bean_id: r["count"] for r in recipes.groupBy("bean_id").count().collect()}
    assert per_bean == {2: 20, 3: 20, 4: 2, 5: 1, 6: 2, 7: 1, 8: 1}
    latest = recipes.orderBy(F.desc("date"), "id").first()
    assert latest.date == dt.date(2031, 4, 30) and latest.bean_id == 4 and recipes.dtypes == spark.createDataFrame([], RECIPE).dtypes
