"""Reads and change sets on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from steepgrid.operators import changes, partitions, reads
from steepgrid.sources.tables import append_rows, latest_version, read_latest, read_table, write_version


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "Aki"), (2, "Bo"), (3, "Cy")], "user_id int, user_name string")


@pytest.fixture
def beans(spark):
    return spark.createDataFrame(
        [(10, 1, "Kona"), (11, 1, "kona "), (12, 2, "Kona"), (13, 3, "Sumatra")], "bean_id int, owner int, bean_name string"
    )


@pytest.fixture
def recipe(spark):
    d = dt.date
    return spark.createDataFrame(
        [
            (1, 10, d(2024, 2, 28), "晴れ", None, 30.0), (2, 10, d(2024, 3, 1), "雨", 5.0, 31.0),
            (3, 12, d(2025, 1, 1), "晴れ", -2.0, 32.0), (4, 13, d(2025, 2, 28), "曇り", 9.0, 33.0),
        ],
        "id int, bean_id int, date date, weather string, temperature double, extraction_time double",
    )


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_names_compare_binary_or_by_collation(beans):
    assert sorted(ids(reads.by_key(beans, "bean_name", "Kona"), "bean_id")) == [10, 12]
    assert sorted(ids(reads.by_key(beans, "bean_name", "KONA", "UNICODE_CI_AI_RTRIM"), "bean_id")) == [10, 11, 12]


def test_same_named_beans_are_pooled(recipe, beans):
    assert sorted(ids(reads.facts_by_dim_name(recipe, beans, "bean_id", "bean_id", "bean_name", "Kona"))) == [1, 2, 3]


def test_trailing_year_ends(recipe):
    assert ids(reads.by_date(reads.trailing_year(recipe, "2025-03-01"), descending=False)) == [2, 3, 4]
    assert ids(reads.by_date(reads.trailing_year(recipe, "2025-02-28"), descending=False)) == [1, 2, 3, 4]


def test_anonymous_and_unknown_users_see_all(beans, users):
    call = lambda name: ids(reads.owned_or_all(beans, users, name, "owner", "user_id", "user_name"), "bean_id")
    assert sorted(call("Aki")) == [10, 11]
    assert sorted(call("nobody")) == sorted(call(None)) == [10, 11, 12, 13]


def test_sort_modes(recipe, beans):
    rows = reads.facts_by_dim_name(recipe, beans, "bean_id", "bean_id", "bean_name")
    assert ids(reads.sort_list(rows, "date")) == [4, 3, 2, 1]
    assert ids(reads.sort_list(rows, "temperature")) == [4, 2, 1, 3]
    assert ids(reads.sort_list(rows, "bean", ties=["id"])) == [1, 2, 3, 4]
    assert sorted(ids(reads.sort_list(rows, "whatever"))) == [1, 2, 3, 4]


def test_history_reads_null_as_zero(recipe, beans):
    rows = reads.dim_history(
        recipe, beans, "bean_id", "bean_id", "bean_name", ["id", "temperature"], "2024-12-31", "Kona", numeric=["temperature"]
    )
    assert [tuple(r) for r in rows.collect()] == [(1, 0.0), (2, 5.0), (3, -2.0)]


def test_owned_lookup_and_flags(recipe, beans, users):
    mine = reads.facts_by_owner(recipe, beans, users.where("user_name = 'Aki'"), "bean_id", "bean_id", "owner", "user_id")
    assert ids(mine) == [2, 1]
    assert reads.lookup(beans, "bean_name", "Kona", ["bean_id"]).first().bean_id == 10
    flags = reads.exists_flag(users, beans, [("user_id", "owner")]).orderBy("user_id")
    assert [r.found for r in flags.collect()] == [True, True, True]


KEYS = ["k"]


def batch(spark, existing, total):
    rows = spark.range(total).select(F.col("id").alias("k"), F.lit("b").alias("name"))
    return rows, rows.where(F.col("k") < existing)


@pytest.mark.parametrize("existing,total,inserted", [(0, 10, 10), (800, 1000, 200), (801, 1000, 0), (10, 10, 0), (0, 0, 0)])
def test_gate_limits(spark, existing, total, inserted):
    rows, stored = batch(spark, existing, total)
    assert changes.gate(rows, stored, KEYS).count() == inserted


def test_append_takes_the_first_of_a_key(spark):
    rows = spark.createDataFrame(
        [("b", 1, 2, "second"), ("b", 1, 1, "first"), ("b", 2, 3, "stored"), ("x", 5, 4, "unknown"), ("b", None, 5, "null")],
        "name string, k int, line int, note string",
    )
    dims = spark.createDataFrame([("b", 4), ("b", 3)], "dim string, dim_id int")
    stored = spark.createDataFrame([(3, 2)], "bean_id int, k int")
    new = changes.append_new(rows, stored, dims, ["bean_id", "k"], ["line"], "name", "dim", "dim_id")
    assert [(r.bean_id, r.note) for r in new.collect()] == [(3, "first")]


def test_validation_keeps_the_first_accepted_row(spark):
    rows = spark.createDataFrame([(1, " ", 1), (2, "a", 1), (3, "a", 1), (4, "a", 2), (5, "old", 1)], "id int, name string, owner int")
    stored = spark.createDataFrame([("old", 1)], "name string, owner int")
    rules = {"blank": F.length(F.trim("name")) == 0}
    checked = changes.validate_insert(rows, rules, stored, ["name", "owner"], ["id"]).orderBy("id")
    assert [r.reason for r in checked.collect()] == ["blank", None, "repeated_in_batch", None, "already_exists"]
    assert sorted(ids(changes.accepted(checked))) == [2, 4] and changes.rejected(checked).count() == 3


def test_update_upsert_delete(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    news = spark.createDataFrame([(1, None, 9.0, 1), (1, "z", 8.0, 2), (3, "c", 3.0, 1)], "id int, name string, v double, seq int")
    updated = changes.update_rows(table, news, "id", ["name"], ["seq"]).orderBy("id")
    assert [tuple(r) for r in updated.collect()] == [(1, "z", 1.0), (2, "b", 2.0)]
    merged = changes.upsert(table, news.where("seq = 1"), "id").orderBy("id")
    assert [tuple(r) for r in merged.collect()] == [(1, None, 9.0), (2, "b", 2.0), (3, "c", 3.0)]
    assert ids(changes.delete_rows(table, news, "id")) == [2]


def test_delete_asks_for_the_owner(recipe, beans, spark):
    wishes = spark.createDataFrame([(1, 1), (3, 1)], "id int, actor int")
    left = changes.delete_owned(recipe, wishes, beans, "id", "bean_id", "bean_id", "owner", "actor")
    assert sorted(ids(left)) == [2, 3, 4]


def test_cascade(users, beans, recipe):
    u, b, r = changes.cascade_delete(users, beans, recipe, users.where("user_id = 1"), "user_id", "owner", "bean_id", "bean_id")
    assert sorted(ids(u, "user_id")) == [2, 3] and sorted(ids(b, "bean_id")) == [12, 13] and sorted(ids(r)) == [3, 4]


def test_versions_and_appends(spark, tmp_path):
    base = f"{tmp_path}/t"
    assert latest_version(spark, base) is None
    write_version(spark.range(3), base)
    write_version(read_latest(spark, base).where("id > 0"), base)
    assert latest_version(spark, base) == 2 and read_latest(spark, base).count() == 2
    append_rows(spark.range(2), f"{tmp_path}/a.parquet")
    append_rows(spark.range(2), f"{tmp_path}/a.parquet")
    assert read_table(spark, "a", str(tmp_path)).count() == 4


COLLATION = "UNICODE_CI_AI_RTRIM"


def test_names_meet_by_collation_in_joins(spark):
    dims = spark.createDataFrame([(4, "A", "x"), (2, "a ", "w"), (5, "カ", "y"), (6, "É", "z")], "id int, name string, origin string")
    rows = spark.createDataFrame([(1, "a "), (2, "か"), (3, "e"), (4, "q"), (5, None)], "k int, bean string")
    known, unknown = changes.resolve_dim(rows, dims, "bean", "name", "id", collation=COLLATION)
    assert sorted((r.k, r.bean, r.bean_id) for r in known.collect()) == [(1, "a ", 2), (2, "か", 5), (3, "e", 6)]
    assert sorted(ids(unknown, "k")) == [4, 5]
    known, unknown = changes.resolve_dim(rows, dims, "bean", "name", "id")
    assert sorted((r.k, r.bean_id) for r in known.collect()) == [(1, 2)] and unknown.count() == 4
    origins = reads.with_origin(rows, dims, "bean", "name", "origin", default="?", collation=COLLATION)
    assert sorted((r.k, r.origin) for r in origins.collect()) == [(1, "w"), (2, "y"), (3, "z"), (4, "?"), (5, "?")]
    firsts = reads.lookup_first(dims, "name", "id", COLLATION)
    assert sorted(ids(firsts)) == [2, 5, 6]


def files(path):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in path.glob("*/*.parquet")}


def months(spark, path, rows):
    df = spark.createDataFrame(rows, "id int, month string, v int")
    partitions.store_partitioned(df, str(path), "month")
    return lambda: sorted(tuple(r) for r in spark.read.parquet(str(path)).select("id", "month", "v").collect())


MONTHS = [(i, f"2031-{1 + i % 4:02d}", i * 10) for i in range(12)]


def test_changes_rewrite_touched_folders_only(spark, tmp_path):
    path = tmp_path / "t"
    read = months(spark, path, MONTHS)
    before = files(path)
    change = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (5, None, 1), (99, 3, 1)], "id int, v int, at int")
    assert partitions.update_partitions(spark, str(path), "month", change, "id", ["v"], ["at"]) == ["2031-02"]
    want = {i: (i, m, v) for i, m, v in MONTHS} | {1: (1, "2031-02", 8), 5: (5, "2031-02", None)}
    assert read() == sorted(want.values())
    after = files(path)
    assert {m for m in before if before[m] != after[m]} == {"month=2031-02"}

    new = spark.createDataFrame([(2, "2031-03", -1), (50, "2031-07", 5), (0, "2031-04", 0)], "id int, month string, v int")
    assert partitions.upsert_partitions(spark, str(path), "month", new, "id") == ["2031-01", "2031-03", "2031-04", "2031-07"]
    want |= {2: (2, "2031-03", -1), 50: (50, "2031-07", 5), 0: (0, "2031-04", 0)}
    assert read() == sorted(want.values()) and files(path)["month=2031-02"] == after["month=2031-02"]

    gone = spark.createDataFrame([(i,) for i in (50, 3, 3, 1000)], "id int")
    assert partitions.delete_partitions(spark, str(path), "month", gone, "id") == ["2031-04", "2031-07"]
    del want[50], want[3]
    assert read() == sorted(want.values()) and files(path)["month=2031-02"] == after["month=2031-02"]
    assert partitions.delete_partitions(spark, str(path), "month", gone, "id") == []


def test_a_changed_partition_value_moves_the_row(spark, tmp_path):
    path = tmp_path / "t"
    read = months(spark, path, MONTHS)
    moves = spark.createDataFrame([(0, "2031-02"), (77, "2031-03")], "id int, month string")
    assert partitions.update_partitions(spark, str(path), "month", moves, "id", ["month"]) == ["2031-01", "2031-02"]
    assert read() == sorted((i, "2031-02" if i == 0 else m, v) for i, m, v in MONTHS)


def test_appends_read_the_partitions_of_the_batch(spark, tmp_path):
    stored = spark.range(4000).select(
        (F.col("id") % 50).cast("int").alias("bean_id"), F.date_add(F.lit(dt.date(2031, 1, 1)), (F.col("id") % 200).cast("int")).alias("date"),
        (F.col("id") % 7).alias("extraction_time"))
    append_rows(stored.repartition("date"), f"{tmp_path}/recipe", "date")
    table = spark.read.parquet(f"{tmp_path}/recipe")
    names = spark.createDataFrame([(i, f"b{i}") for i in range(50)], "id int, name string")
    batch = spark.createDataFrame([(1, "b1", dt.date(2031, 1, 2), 99), (2, "b7", dt.date(2031, 1, 8), 0), (3, "b7", dt.date(2031, 3, 1), 98)],
                                  "line int, bean string, date date, extraction_time long")
    keys = ["bean_id", "date", "extraction_time"]
    slice_ = changes.table_slice(table, batch, "date")
    text = slice_._jdf.queryExecution().toString()
    assert "dynamicpruning" in text.lower() and slice_.select("date").distinct().count() == 3
    args = (batch, table, names, keys, ["line"], "bean", "name", "id")
    pruned = changes.append_new(*args, partition="date")
    assert sorted(ids(pruned, "line")) == sorted(ids(changes.append_new(*args), "line")) == [1, 3]
    assert changes.append_new(batch.limit(0), *args[1:], partition="date").count() == 0


def test_a_version_is_committed_once(spark, tmp_path):
    base = f"{tmp_path}/t"
    assert latest_version(spark, base) is None
    assert write_version(spark.range(3), base) == 1
    assert write_version(spark.range(4), base, after=1) == 2
    with pytest.raises(FileExistsError):
        write_version(spark.range(9), base, after=1)
    assert read_latest(spark, base).count() == 4 and latest_version(spark, base) == 2
    spark.range(7).write.parquet(f"{base}/data-unfinished")
    assert read_latest(spark, base).count() == 4
