"""Numbering, splits, metrics, forests and their evaluation against brute force and known properties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steepgrid.operators import features, forest, metrics, ranks, registry, splits
from steepgrid.plans import evaluation
from steepgrid.schemas import REQUEST, TARGETS


# --- numbering and splits -------------------------------------------------------------------------


def test_numbering_of_a_hot_group_ties_and_nulls(spark):
    # Group a holds most rows, and one order value most of group a.
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 10 == 8, "b").alias("g"),
        F.when(F.col("id") % 10 < 6, F.lit(5)).when(F.col("id") % 97 == 0, None).otherwise(F.col("id")).alias("o"),
        "id",
    )
    got = ranks.number_rows(rows.repartition(7), ["g"], ["o"]).toPandas()
    assert len(got) == 4000
    got["g"] = got["g"].fillna("none")
    got["o"] = got["o"].fillna(-1)
    for _, part in got.groupby("g"):
        assert sorted(part["row_number"]) == list(range(1, len(part) + 1))
        assert set(part["group_size"]) == {len(part)}
        assert part.sort_values("row_number")["o"].is_monotonic_increasing


@pytest.mark.parametrize("n,sizes", [(11, [4, 4, 3]), (9, [3, 3, 3]), (2, [1, 1]), (1, [1])])
def test_fold_sizes(spark, n, sizes):
    rows = splits.assign_folds(spark.range(n).withColumn("g", F.lit("x")), ["g"], ["id"]).orderBy("id").collect()
    folds = [r.fold for r in rows]
    assert folds == sorted(folds) and [folds.count(k) for k in sorted(set(folds))] == sizes


def test_holdout_sizes_and_repeatability(spark):
    rows = spark.range(135).withColumn("g", F.when(F.col("id") < 11, "small").otherwise("large"))
    first = splits.holdout_split(rows, ["g"], ["id"])
    again = splits.holdout_split(rows.repartition(9), ["g"], ["id"])
    tests = lambda df: sorted((r.g, r.id) for r in df.where("is_test").collect())
    assert tests(first) == tests(again)
    assert [g for g, _ in tests(first)].count("small") == 2 and [g for g, _ in tests(first)].count("large") == 13
    other = splits.holdout_split(rows, ["g"], ["id"], seed=7)
    assert tests(other) != tests(first)


def test_ids_go_on_from_the_table(spark):
    table = spark.createDataFrame([(5,), (9,)], "id int")
    rows = ranks.assign_ids(spark.createDataFrame([("b",), ("a",)], "name string"), table, "id", ["name"])
    assert sorted((r.name, r.id) for r in rows.collect()) == [("a", 10), ("b", 11)]


# --- metrics --------------------------------------------------------------------------------------


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(10, 2, (40, 2))
    p = y + rng.normal(0, 1, (40, 2))
    df = spark.createDataFrame([("g", *map(float, (*a, *b))) for a, b in zip(y, p)], "g string, a double, b double, pa double, pb double")
    row = metrics.r2(df, ["g"], {"a": "pa", "b": "pb"}).first()
    want = 1 - ((y - p) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)
    assert row.r2_a == pytest.approx(want[0]) and row.r2 == pytest.approx(want.mean())
    hit = metrics.tolerance_accuracy(df, ["g"], {"a": "pa", "b": "pb"}, {"a": 0.5, "b": 1.0}).first()
    inside = np.abs(y - p) <= [0.5, 1.0]
    assert hit.acc_a == pytest.approx(inside[:, 0].mean()) and hit.acc_overall == pytest.approx(inside.all(1).mean())


def test_tree_spread(spark):
    df = spark.createDataFrame([("g", [1.0, 3.0], [2.0, 2.0]), ("g", [0.0, 4.0], [1.0, 3.0])], "g string, a array<double>, b array<double>")
    assert metrics.mean_tree_std(df, ["g"], {"x": "a", "y": "b"}).first().mean_std == pytest.approx((1 + 0 + 2 + 1) / 4)


# --- features -------------------------------------------------------------------------------------


def test_alignment_and_one_hot(spark):
    train = spark.createDataFrame([("k", "雨", 1.0), ("k", "晴れ", 2.0), ("m", "雪", 3.0), ("m", None, 4.0)], "g string, weather string, x double")
    lists = features.feature_lists(train, ["g"], {"weather": "weather"}, ["x"])
    assert {r.g: r.feature_names for r in lists.collect()} == {"k": ["x", "weather_晴れ", "weather_雨"], "m": ["x", "weather_雪"]}
    asked = spark.createDataFrame([("k", "雪", 7.0), ("m", "雪", 8.0), ("k", None, 9.0)], "g string, weather string, x double")
    got = features.align(asked, lists, ["g"], {"weather": "weather"}, ["x"])
    assert sorted(r.features for r in got.collect()) == [[7.0, 0.0, 0.0], [8.0, 1.0], [9.0, 0.0, 0.0]]
    row = features.one_hot(asked, "weather", "weather", ["雪", "雨"]).orderBy("x").collect()
    assert [(r["weather_雪"], r["weather_雨"]) for r in row] == [(1, 0), (1, 0), (0, 0)]


def test_gate_statuses(spark):
    sizes = {"a": 0, "b": 9, "c": 10, "d": 11}
    dims = spark.createDataFrame([(k,) for k in sizes], "k string")
    facts = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "f string")
    got = {r.k: r.status for r in features.training_gate(dims, facts, "k", "f").collect()}
    assert got == {"a": "no_data", "b": "too_few", "c": "ok", "d": "ok"}
    assert features.trainable(facts, ["f"]).select("f").distinct().count() == 2


# --- forests --------------------------------------------------------------------------------------


def grow(x, y, w, edges, depth, node=1, out=None):
    """Plain recursive tree on the same candidate cuts: {node: (feature, cut)} by largest squared-error drop."""
    out = {} if out is None else out
    if depth == 0 or w.sum() < 2:
        return out
    total = (w[:, None] * y).sum(0)
    best = (0.0, None)
    q = (w[:, None] * y**2).sum()
    for f in range(x.shape[1]):
        for b, e in enumerate(edges[f]):
            left = x[:, f] <= e
            nl, nr = w[left].sum(), w[~left].sum()
            if nl and nr:
                sl = (w[left, None] * y[left]).sum(0)
                gain = ((sl**2) / nl + ((total - sl) ** 2) / nr - (total**2) / w.sum()).sum()
                share = round(gain / q, 9)
                if share > best[0]:
                    best = (share, (f, b, e))
    if best[1] is None:
        return out
    f, b, e = best[1]
    out[node] = (f, b)
    left = x[:, f] <= e
    grow(x[left], y[left], w[left], edges, depth - 1, node * 2, out)
    grow(x[~left], y[~left], w[~left], edges, depth - 1, node * 2 + 1, out)
    return out


def sample(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(0, 10, n), rng.integers(0, 2, n), rng.uniform(-1, 1, n)]).astype(float)
    y = np.column_stack([np.where(x[:, 0] > 4, 5.0, 1.0) + x[:, 1], x[:, 0] * 2 + rng.normal(0, 0.1, n)])
    return x, y


def frame(spark, groups):
    rows = []
    for name, (x, y) in groups.items():
        rows += [(name, i, [float(v) for v in a], float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, id int, features array<double>, p double, t double")


@pytest.mark.parametrize("bootstrap", [False, True])
def test_trees_equal_brute_force(spark, bootstrap):
    groups = {"a": sample(120, 5), "b": sample(60, 6)}
    spec = forest.ForestSpec(trees=2, max_depth=4, bins=8, binning="width", bootstrap=bootstrap)
    df = frame(spark, groups)
    fitted = forest.fit_forest(df, ["g"], ["p", "t"], ["id"], spec)
    got = {(r.g, r.tree, r.node): (r.feature, r.bin) for r in fitted.splits().collect()}
    hashes = {r.id: r.h for r in df.select("id", forest.row_hash(["id"]).alias("h")).distinct().collect()}
    want = {}
    for name, (x, y) in groups.items():
        edges = []
        for f in range(x.shape[1]):
            low, high = x[:, f].min(), x[:, f].max()
            cuts = sorted({low, *(low + (high - low) / 8 * i for i in range(1, 8))})
            edges.append([c for c in cuts if c < high])
        for tree, a, b in forest.tree_constants(spec.trees, spec.seed):
            w = np.ones(len(x))
            if bootstrap:
                draws = [(hashes[i] * a + b) % forest.PRIME for i in range(len(x))]
                w = np.array([sum(d >= c for c in forest.weight_cuts()) for d in draws], float)
            kept = w > 0
            for node, cut in grow(x[kept], y[kept], w[kept], edges, spec.max_depth).items():
                want[(name, tree, node)] = cut
    assert got == want


def test_forest_learns_and_ranks_features(spark):
    x, y = sample(300)
    df = frame(spark, {"a": (x, y)})
    fitted = forest.fit_forest(df, ["g"], ["p", "t"], ["id"], forest.ForestSpec(trees=20, max_depth=5))
    scored = forest.predict(df, fitted, ["id"], spread="spread_").join(df, ["g", "id"]).toPandas()
    assert len(scored) == 300 and (scored.spread_p >= 0).all()
    for target in ("p", "t"):
        rmse = math.sqrt(((scored[f"predicted_{target}"] - scored[target]) ** 2).mean())
        assert rmse < 0.3 * scored[target].std()
    shares = {r.feature: r.importance for r in forest.rank_importances(forest.importances(fitted), ["g"]).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and max(shares, key=shares.get) == 0


def test_growth_ends_when_nothing_splits(spark):
    df = spark.createDataFrame([("a", i, [float(i % 2)], float(i % 2)) for i in range(20)] + [("c", i, [1.0], 4.0) for i in range(12)],
                               "g string, id int, features array<double>, p double")
    fitted = forest.fit_forest(df, ["g"], ["p"], ["id"], forest.ForestSpec(trees=5, max_depth=30))
    assert len(fitted.levels) == 1
    got = {(r.g, r.id): r.predicted_p for r in forest.predict(df, fitted, ["id"]).collect()}
    assert got[("a", 3)] == 1.0 and got[("a", 4)] == 0.0 and got[("c", 0)] == 4.0


def brews(spark, sizes):
    rows = []
    for bean, n in sizes.items():
        for i in range(n):
            rows.append((bean, i, f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", ["雨", "晴れ"][i % 2], 10.0 + i % 7, 50.0, None,
                         8.0 + 0.1 * (i % 2), 15.0 + 0.5 * (i % 2), 28.0 + 3 * (i % 2)))
    df = spark.createDataFrame(rows, "bean_name string, id int, d string, weather string, temperature double, humidity double, "
                                     "days_passed double, mesh double, gram double, extraction_time double")
    return df.withColumn("date", F.to_date("d")).drop("d")


SPEC = forest.ForestSpec(trees=8, max_depth=2)


def test_evaluation_of_all_sizes(spark):
    sizes = {"one": 1, "two": 2, "five": 5, "nine": 9, "ten": 10, "eleven": 11, "many": 90}
    report = {r.bean_name: r for r in evaluation.evaluate(brews(spark, sizes), ["id"], spec=SPEC).collect()}
    assert {k: r.sample_count for k, r in report.items()} == sizes
    assert {k: r.eval_sample_count for k, r in report.items()} == {k: math.ceil(0.1 * n) for k, n in sizes.items()}
    for name, r in report.items():
        assert r.confidence <= 0.95
        if name not in ("one", "two"):
            assert r.confidence >= 0.3
    # The weather decides every target, so a bean with enough rows is predicted exactly.
    many = report["many"]
    assert many.tolerance_accuracy.overall == 1.0 and many.confidence > 0.9 and many.feature_count == 9
    assert many.tolerance_accuracy.tolerance.gram == 0.3


def test_trained_confidence_needs_ten_rows(spark):
    got = {r.bean_name: r for r in evaluation.trained_confidence(brews(spark, {"nine": 9, "ten": 10}), ["id"], ["id"], spec=SPEC).collect()}
    assert list(got) == ["ten"] and 0.3 <= got["ten"].confidence <= 0.95


def test_models_are_stored_and_replaced(spark, tmp_path):
    base = f"{tmp_path}/models"
    asked = spark.createDataFrame(
        [(1, "old", None, "2024-05-05", "雨", 12.0, None, None), (2, "gone", None, "2024-05-05", "雨", 12.0, 50.0, 3.0),
         (3, "new/bean", None, "2024-05-05", "霧", None, None, None)], REQUEST)
    for as_of, sizes in (("t1", {"old": 30}), ("t2", {"new/bean": 40}), ("t3", {"old": 50})):
        fitted, lists = evaluation.train(brews(spark, sizes), ["id"], spec=SPEC)
        registry.save_model(spark, base, fitted, registry.registry_rows(lists, "bean_name", as_of))
    rows = registry.load_registry(spark, base)
    assert {(r.bean_name, r.model_key, r.last_updated, r.sample_count) for r in rows.collect()} == {
        ("old", "old", "t3", 50), ("new/bean", "new_bean", "t2", 40)}
    loaded = registry.load_model(spark, base)
    fresh = features.align(registry.request_features(asked), lists, ["bean_name"], {"weather": "weather"})
    want = forest.predict(fresh, fitted, ["request_id"], prefix="").first()
    got = {r.request_id: r for r in registry.score_saved(asked, loaded, rows).collect()}
    assert got[1].mesh == pytest.approx(want.mesh) and got[1].confidence == pytest.approx(0.8) and got[1].status == "ok"
    assert got[2].status == "no_model" and got[2].mesh is None and got[2].confidence is None
    assert got[3].status == "ok" and 8.0 <= got[3].mesh <= 8.1
    batch = {r.request_id: r for r in registry.score_batch(asked, loaded, rows).collect()}
    assert batch[1].confidence == 0.8 and batch[1].temperature == 12.0 and batch[1].humidity is None
    assert registry.load_model(spark, base, ["old"]).roots.select("bean_name").distinct().count() == 1
    assert registry.model_status(rows).first().mode == "mixed"
    assert registry.model_status(rows.where("false")).first().mode == "dynamic"
    assert registry.model_info(rows).count() == 2


def test_a_save_that_ends_midway_changes_nothing_for_readers(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/models"

    def fit(n):
        fitted, lists = evaluation.train(brews(spark, {"b": n}), ["id"], spec=SPEC)
        return fitted, registry.registry_rows(lists, "bean_name", f"t{n}")

    def state():
        rows = registry.load_registry(spark, base)
        roots = registry.load_model(spark, base, registry=rows).roots
        return [(r.last_updated, r.sample_count) for r in rows.collect()], sorted(tuple(r) for r in roots.collect())

    registry.save_model(spark, base, *fit(30))
    before = state()
    other = fit(60)
    with monkeypatch.context() as patch:
        patch.setattr(registry, "register_model", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            registry.save_model(spark, base, *other)
    assert state() == before

    # A second writer that has read the same registry loses, and readers keep what the first one stored.
    commit = registry.register_model

    def late(spark_, base_, rows, after):
        commit(spark_, base_, registry.load_registry(spark, base).withColumn("last_updated", F.lit("first")), after)
        return commit(spark_, base_, rows, after)

    with monkeypatch.context() as patch:
        patch.setattr(registry, "register_model", late)
        with pytest.raises(FileExistsError):
            registry.save_model(spark, base, *other)
    assert state()[0] == [("first", 30)] and state()[1] == before[1]
    registry.save_model(spark, base, *other)
    assert state()[0] == [("t60", 60)]
