"""Features, splits, metrics and forests on brew-shaped rows: one per line item, its part's brand as the bean."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from steepgrid.functions import scores
from steepgrid.operators import counts, features, forest, metrics, ranks, registry, splits
from steepgrid.plans import evaluation, forest_sql
from steepgrid.plans.catalog import query, table
from steepgrid.schemas import BASE_FEATURES, TARGETS
from steepgrid.session import materialise, scratch_dir

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
KEY_SQL = ", ".join(KEY)
TOLERANCES = {"mesh": 10.0, "gram": 0.03, "extraction_time": 15000.0}
AS_OF = "2001-12-31T00:00:00"

BREWS_SQL = """
    brews AS (SELECT p_brand AS bean_name, p_type AS bean_origin, CAST(l_shipdate AS DATE) AS date,
        l_returnflag AS weather, NULLIF(l_tax, 0.0::DOUBLE) AS temperature, CAST(l_linenumber AS DOUBLE) AS humidity,
        CAST(NULLIF(p_size, 7) AS DOUBLE) AS days_passed, l_quantity AS mesh, l_discount AS gram,
        l_extendedprice AS extraction_time, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents
      FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def brews(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    lines = table(spark, sf, "lineitem")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("p_brand").alias("bean_name"),
        F.col("p_type").alias("bean_origin"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("weather"),
        F.nullif("l_tax", F.lit(0.0)).alias("temperature"),
        F.col("l_linenumber").cast("double").alias("humidity"),
        F.nullif("p_size", F.lit(7)).cast("double").alias("days_passed"),
        F.col("l_quantity").alias("mesh"),
        F.col("l_discount").alias("gram"),
        F.col("l_extendedprice").alias("extraction_time"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )


# --- features -------------------------------------------------------------------------------------

NAMES_SQL = f"""
    {BREWS_SQL},
    base AS (SELECT * FROM (VALUES (0, 'temperature'), (1, 'humidity'), (2, 'year'), (3, 'month'), (4, 'day'),
                                   (5, 'day_of_week'), (6, 'days_passed')) b(feature, name)),
    weathers AS (SELECT bean_name, weather, row_number() OVER (PARTITION BY bean_name ORDER BY weather) AS i
                 FROM (SELECT DISTINCT bean_name, weather FROM brews)),
    origins AS (SELECT bean_name, bean_origin, row_number() OVER (PARTITION BY bean_name ORDER BY bean_origin) AS i
                FROM (SELECT DISTINCT bean_name, bean_origin FROM brews)),
    names AS (
        SELECT bean_name, feature, name FROM (SELECT DISTINCT bean_name FROM brews) CROSS JOIN base
        UNION ALL SELECT bean_name, 6 + i, 'weather_' || weather FROM weathers
        UNION ALL SELECT bean_name, 6 + i + (SELECT COUNT(*) FROM weathers w WHERE w.bean_name = o.bean_name),
                         'origin_' || bean_origin FROM origins o)
"""

VALUES_SQL = f"""
    {NAMES_SQL},
    filled AS (SELECT *, COALESCE(temperature, 20.0) AS t, COALESCE(humidity, 60.0) AS u,
                      COALESCE(days_passed, 15.0) AS d FROM brews),
    long AS (SELECT bean_name, {KEY_SQL}, feature, CAST(CASE name
                WHEN 'temperature' THEN t WHEN 'humidity' THEN u WHEN 'days_passed' THEN d
                WHEN 'year' THEN year(date) WHEN 'month' THEN month(date) WHEN 'day' THEN day(date)
                WHEN 'day_of_week' THEN isodow(date) - 1
                ELSE CASE WHEN name IN ('weather_' || weather, 'origin_' || bean_origin) THEN 1 ELSE 0 END
             END AS DOUBLE) AS x, mesh, gram, extraction_time
             FROM filled JOIN names USING (bean_name))
"""


@query(
    f"""
    WITH {NAMES_SQL}
    SELECT bean_name, string_agg(name, ',' ORDER BY feature) AS feature_names, COUNT(*) AS feature_count
    FROM names GROUP BY bean_name
    """
)
def feature_lists(spark, sf):
    lists = features.feature_lists(brews(spark, sf), ["bean_name"], evaluation.WITH_ORIGIN)
    return lists.select(
        "bean_name",
        F.array_join("feature_names", ",").alias("feature_names"),
        F.size("feature_names").cast("bigint").alias("feature_count"),
    )


def _aligned(spark, sf) -> DataFrame:
    rows = brews(spark, sf)
    lists = materialise(features.feature_lists(rows, ["bean_name"], evaluation.WITH_ORIGIN), "lists")
    return features.align(features.base_features(rows), lists, ["bean_name"], evaluation.WITH_ORIGIN)


@query(
    f"""
    WITH {VALUES_SQL}
    SELECT bean_name, {KEY_SQL}, string_agg(CAST(ROUND(x * 100) AS BIGINT), ',' ORDER BY feature) AS encoded
    FROM long GROUP BY bean_name, {KEY_SQL}
    """
)
def one_hot_aligned(spark, sf):
    values = F.transform("features", lambda x: F.round(x * 100).cast("bigint").cast("string"))
    return _aligned(spark, sf).select("bean_name", *KEY, F.array_join(values, ",").alias("encoded"))


@query(
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "weather_A",
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "weather_R",
           0 AS "weather_Z"
    FROM lineitem
    """
)
def one_hot_listed(spark, sf):
    rows = table(spark, sf, "lineitem")
    encoded = features.one_hot(rows, "l_returnflag", "weather", ["A", "R", "Z"])
    return encoded.select(*KEY[:-1], "l_extendedprice", "weather_A", "weather_R", "weather_Z")


@query(
    """
    SELECT c_custkey, CAST(COUNT(o_orderkey) AS BIGINT) AS sample_count,
           CASE WHEN COUNT(o_orderkey) = 0 THEN 'no_data' WHEN COUNT(o_orderkey) < 10 THEN 'too_few' ELSE 'ok' END AS status
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey
    GROUP BY c_custkey
    """
)
def training_gate(spark, sf):
    return features.training_gate(
        table(spark, sf, "customer").select("c_custkey"),
        table(spark, sf, "orders").where("o_orderstatus = 'F'"),
        "c_custkey", "o_custkey",
    )


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) >= 10)
    """
)
def trainable_rows(spark, sf):
    return features.trainable(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


# --- splits and metrics ---------------------------------------------------------------------------

DIGEST_SQL = f"md5(concat_ws('|', {KEY_SQL}) || ':42')"


@query(
    f"""
    WITH {BREWS_SQL}
    SELECT bean_name, {KEY_SQL}, COUNT(*) OVER (PARTITION BY bean_name) AS group_size,
           row_number() OVER (PARTITION BY bean_name ORDER BY {DIGEST_SQL}, {KEY_SQL})
             <= ceil(0.1::DOUBLE * COUNT(*) OVER (PARTITION BY bean_name)) AS is_test
    FROM brews
    """
)
def holdout_split(spark, sf):
    return splits.holdout_split(brews(spark, sf).select("bean_name", *KEY), ["bean_name"], KEY)


@query(
    f"""
    WITH {BREWS_SQL}
    SELECT bean_name, {KEY_SQL}, CAST(ntile(3) OVER (PARTITION BY bean_name ORDER BY {KEY_SQL}) AS INTEGER) AS fold
    FROM brews
    """
)
def kfold_assign(spark, sf):
    return splits.assign_folds(brews(spark, sf).select("bean_name", *KEY), ["bean_name"], KEY)


@query(
    f"""
    WITH {BREWS_SQL}
    SELECT {KEY_SQL}, row_number() OVER (ORDER BY {KEY_SQL}) AS place, COUNT(*) OVER () AS total FROM brews
    """
)
def whole_table_numbering(spark, sf):
    return ranks.number_rows(brews(spark, sf).select(*KEY), [], KEY, "place", "total")


# The predictor of these metric queries: the group's mean over the rows outside the fold.
FOLDED_SQL = f"""
    {BREWS_SQL},
    folded AS (SELECT *, ntile(3) OVER (PARTITION BY bean_name ORDER BY {KEY_SQL}) AS fold FROM brews),
    sums AS (SELECT bean_name, fold, COUNT(*) AS n, SUM(mesh) AS s0, SUM(gram) AS s1, SUM(extraction_time) AS s2
             FROM folded GROUP BY bean_name, fold),
    means AS (SELECT bean_name, fold,
                (SUM(s0) OVER w - s0) / (SUM(n) OVER w - n) AS p_mesh, (SUM(s1) OVER w - s1) / (SUM(n) OVER w - n) AS p_gram,
                (SUM(s2) OVER w - s2) / (SUM(n) OVER w - n) AS p_extraction_time
              FROM sums WINDOW w AS (PARTITION BY bean_name)),
    predicted AS (SELECT * FROM folded JOIN means USING (bean_name, fold)),
    fold_r2 AS (SELECT bean_name, fold, COUNT(*) AS n,
        {", ".join(f"1 - SUM(({t} - p_{t}) * ({t} - p_{t})) / (SUM({t} * {t}) - SUM({t}) * SUM({t}) / COUNT(*)) AS r2_{t}" for t in TARGETS)}
        FROM predicted GROUP BY bean_name, fold),
    scored AS (SELECT *, (r2_mesh + r2_gram + r2_extraction_time) / 3 AS r2 FROM fold_r2)
"""

PAIRS = {t: f"p_{t}" for t in TARGETS}


def _fold_means(folded: DataFrame) -> DataFrame:
    whole = Window.partitionBy("bean_name")
    sums = folded.groupBy("bean_name", "fold").agg(
        F.count("*").alias("n"), *[F.sum(t).alias(f"s_{t}") for t in TARGETS]
    )
    rest = F.sum("n").over(whole) - F.col("n")
    means = [((F.sum(f"s_{t}").over(whole) - F.col(f"s_{t}")) / rest).alias(f"p_{t}") for t in TARGETS]
    return materialise(sums.select("bean_name", "fold", *means), "means")


def _folded(spark, sf) -> DataFrame:
    rows = brews(spark, sf).select("bean_name", *KEY, *TARGETS)
    return materialise(splits.assign_folds(rows, ["bean_name"], KEY), "folded")


def _predicted(spark, sf) -> DataFrame:
    folded = _folded(spark, sf)
    return folded.join(_fold_means(folded), ["bean_name", "fold"])


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(
    f"""
    WITH {FOLDED_SQL}
    SELECT bean_name, CAST(fold AS INTEGER) AS fold, n, ROUND(r2_mesh, 6) + 0.0 AS r2_mesh, ROUND(r2_gram, 6) + 0.0 AS r2_gram,
           ROUND(r2_extraction_time, 6) + 0.0 AS r2_extraction_time, ROUND(r2, 6) + 0.0 AS r2 FROM scored
    """
)
def kfold_r2(spark, sf):
    return _rounded(metrics.r2(_predicted(spark, sf), ["bean_name", "fold"], PAIRS))


@query(
    f"""
    WITH {FOLDED_SQL}
    SELECT bean_name, ROUND(AVG(r2), 6) + 0.0 AS fold_mean, ROUND(stddev_pop(r2), 6) AS fold_std, COUNT(*) AS folds
    FROM scored GROUP BY bean_name
    """
)
def fold_stats(spark, sf):
    per_fold = metrics.r2(_predicted(spark, sf), ["bean_name", "fold"], PAIRS)
    return _rounded(metrics.fold_stats(per_fold, ["bean_name"]))


@query(
    f"""
    WITH {FOLDED_SQL},
    hits AS (SELECT bean_name, CASE WHEN abs(p_mesh - mesh) <= 10.0::DOUBLE THEN 1 ELSE 0 END AS h0,
                    CASE WHEN abs(p_gram - gram) <= 0.03::DOUBLE THEN 1 ELSE 0 END AS h1,
                    CASE WHEN abs(p_extraction_time - extraction_time) <= 15000.0::DOUBLE THEN 1 ELSE 0 END AS h2 FROM predicted)
    SELECT bean_name, COUNT(*) AS n_eval, ROUND(AVG(h0), 6) AS acc_mesh, ROUND(AVG(h1), 6) AS acc_gram,
           ROUND(AVG(h2), 6) AS acc_extraction_time, ROUND(AVG(h0 * h1 * h2), 6) AS acc_overall
    FROM hits GROUP BY bean_name
    """
)
def tolerance_accuracy(spark, sf):
    return _rounded(metrics.tolerance_accuracy(_predicted(spark, sf), ["bean_name"], PAIRS, TOLERANCES))


SPREAD_SQL = f"""
    {FOLDED_SQL},
    spreads AS (SELECT bean_name, (stddev_pop(p_mesh) + stddev_pop(p_gram) + stddev_pop(p_extraction_time)) / 3 AS mean_std
                FROM means GROUP BY bean_name)
"""


def _spread(folded: DataFrame) -> DataFrame:
    means = _fold_means(folded)
    trees = materialise(
        means.groupBy("bean_name").agg(*[F.collect_list(f"p_{t}").alias(f"trees_{t}") for t in TARGETS]), "trees"
    )
    return metrics.mean_tree_std(
        folded.join(trees, "bean_name"), ["bean_name"], {t: f"trees_{t}" for t in TARGETS}
    )


@query(f"WITH {SPREAD_SQL} SELECT bean_name, ROUND(mean_std, 6) AS mean_std FROM spreads")
def mean_tree_std(spark, sf):
    """The three fold means of a group stand for its trees."""
    return _rounded(_spread(_folded(spark, sf)))


@query(
    f"""
    WITH {SPREAD_SQL},
    inputs AS (SELECT bean_name, AVG(r2) AS m, stddev_pop(r2) AS s, SUM(n) AS n FROM scored GROUP BY bean_name)
    SELECT bean_name, ROUND(LEAST(0.95, GREATEST(0.3,
             0.4 * GREATEST(0, LEAST(1, m + 0.5)) + 0.3 * GREATEST(0, LEAST(1, 1 - mean_std / 200 / 2))
             + 0.2 * LEAST(1, n / 50) + 0.1 * GREATEST(0, LEAST(1, 1 - s)))), 6) AS confidence
    FROM inputs JOIN spreads USING (bean_name)
    """
)
def confidence(spark, sf):
    """Composite confidence of the mean predictor, with its training R² taken as m + 1 and its spread / 200."""
    folded = _folded(spark, sf)
    predicted = folded.join(_fold_means(folded), ["bean_name", "fold"])
    per_fold = metrics.r2(predicted, ["bean_name", "fold"], PAIRS)
    stats = metrics.fold_stats(per_fold, ["bean_name"])
    sizes = folded.groupBy("bean_name").agg(F.count("*").alias("n"))
    joined = stats.join(_spread(folded), "bean_name").join(sizes, "bean_name")
    score = scores.confidence(
        F.col("fold_mean"), F.col("fold_std"), F.col("fold_mean") + 1.0, F.col("mean_std") / 200.0, F.col("n")
    )
    return _rounded(joined.select("bean_name", score.alias("confidence")))


@query(
    """
    SELECT c_custkey, ROUND(LEAST(0.95, 0.3 + (n - 10) * 0.02), 6)::DOUBLE AS fallback,
           ROUND(LEAST(0.95, 0.7 + n / 100.0 * 0.2), 6)::DOUBLE AS saved
    FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    """
)
def confidence_by_count(spark, sf):
    counted = counts.fact_counts(
        table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "n"
    )
    return counted.select(
        "c_custkey",
        F.round(scores.fallback_confidence(F.col("n")), 6).alias("fallback"),
        F.round(scores.saved_confidence(F.col("n")), 6).alias("saved"),
    )


# --- forests --------------------------------------------------------------------------------------

# Small enough that SQL can grow the same trees; equal-width bins, as quantile sketches differ between engines.
SMALL = forest.ForestSpec(trees=3, max_depth=2, bins=8, binning="width")
# The SQL of the others knows exact cuts only, whatever the size of a bean.
FULL = forest.ForestSpec(trees=100, max_depth=3, bins=32, binning="exact")
EVALUATION = forest.ForestSpec(trees=20, max_depth=3, bins=32, binning="exact")


def _forest_sql(spec: forest.ForestSpec) -> str:
    """The forest of the whole table in SQL: same bins, bootstrap weights, cuts and tie rule."""
    trees = ", ".join(f"({t}, {a}, {b})" for t, a, b in forest.tree_constants(spec.trees, spec.seed))
    draw = f"((h * a + b) % {forest.PRIME})"
    weight = " + ".join(f"CASE WHEN {draw} >= {cut} THEN 1 ELSE 0 END" for cut in forest.weight_cuts())
    steps = ", ".join(f"low + (high - low) / {float(spec.bins)}::DOUBLE * {i}" for i in range(1, spec.bins))
    sums = ["s0", "s1", "s2"]
    gain = " + ".join(f"l{s} * l{s} / ln + ({s} - l{s}) * ({s} - l{s}) / (n - ln) - {s} * {s} / n" for s in sums)
    parts = [
        VALUES_SQL,
        f"""ranges AS (SELECT bean_name, feature, MIN(x) AS low, MAX(x) AS high FROM long GROUP BY 1, 2),
        edges AS (SELECT bean_name, feature, list_filter(list_sort(list_distinct([low, {steps}])), lambda e: e < high) AS es
                  FROM ranges),
        binned AS (SELECT l.*, len(list_filter(es, lambda e: e < x)) AS bin,
                     CAST('0x' || substr(md5(concat_ws('|', {KEY_SQL})), 1, 8) AS BIGINT) % {forest.PRIME} AS h
                   FROM long l JOIN edges USING (bean_name, feature)),
        trees(tree, a, b) AS (VALUES {trees}),
        pairs0 AS (SELECT * EXCLUDE (h, a, b), 1::BIGINT AS node, {weight} AS w FROM binned CROSS JOIN trees
                   WHERE {weight} > 0)""",
    ]
    for depth in range(spec.max_depth):
        parts.append(
            f"""hist{depth} AS (SELECT bean_name, tree, node, feature, bin, SUM(w) AS n,
                SUM(w * (mesh * mesh + gram * gram + extraction_time * extraction_time)) AS q,
                SUM(w * mesh) AS s0, SUM(w * gram) AS s1, SUM(w * extraction_time) AS s2
                FROM pairs{depth} GROUP BY 1, 2, 3, 4, 5),
            cells{depth} AS (SELECT bean_name, tree, node, feature, bin, SUM(n) OVER v AS n, SUM(q) OVER v AS q, SUM(n) OVER u AS ln,
                {", ".join(f"SUM({s}) OVER v AS {s}, SUM({s}) OVER u AS l{s}" for s in sums)}
                FROM hist{depth}
                WINDOW v AS (PARTITION BY bean_name, tree, node, feature),
                       u AS (PARTITION BY bean_name, tree, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
            cuts{depth} AS (SELECT *, CASE WHEN n > ln AND q > 0 THEN ROUND(({gain}) / q, 9) ELSE 0 END AS share,
                CASE WHEN n > ln THEN {gain} ELSE 0 END AS gain FROM cells{depth}),
            nodes{depth} AS (SELECT * FROM cuts{depth} QUALIFY row_number() OVER
                (PARTITION BY bean_name, tree, node ORDER BY share DESC, feature, bin) = 1),
            splits{depth} AS (SELECT * FROM nodes{depth} WHERE share > 0 AND n >= 2),
            chosen{depth} AS (SELECT p.bean_name, {", ".join("p." + k for k in KEY)}, p.tree,
                p.node * 2 + CASE WHEN p.bin > s.bin THEN 1 ELSE 0 END AS child
                FROM pairs{depth} p JOIN splits{depth} s USING (bean_name, tree, node, feature)),
            pairs{depth + 1} AS (SELECT p.* EXCLUDE (node), c.child AS node FROM pairs{depth} p
                JOIN chosen{depth} c USING (bean_name, {KEY_SQL}, tree))"""
        )
    return ",\n".join(parts)


def _small_forest(spark, sf) -> tuple[forest.Forest, DataFrame]:
    rows = brews(spark, sf)
    lists = materialise(features.feature_lists(rows, ["bean_name"], evaluation.WITH_ORIGIN), "lists")
    encoded = features.encode(features.base_features(rows), lists, ["bean_name"], evaluation.WITH_ORIGIN)
    encoded = materialise(encoded.select("bean_name", *KEY, *TARGETS, "features", "ones"), "encoded")
    return forest.fit_forest(encoded, ["bean_name"], TARGETS, KEY, SMALL, ones="ones"), encoded


@query(
    f"""
    WITH {_forest_sql(SMALL)}
    {" UNION ALL ".join(
        f"SELECT bean_name, CAST(tree AS INTEGER) AS tree, {d} AS level, node, CAST(feature AS INTEGER) AS feature, "
        f"CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, CAST(ln AS BIGINT) AS left_n, "
        f"CAST(ROUND(ls0) AS BIGINT) AS left_mesh, CAST(ROUND(s0 - ls0) AS BIGINT) AS right_mesh, "
        f"CAST(ROUND((s2 - ls2) * 100) AS BIGINT) AS right_cents FROM splits{d}"
        for d in range(SMALL.max_depth))}
    """
)
def forest_splits(spark, sf):
    """Whole sums of quantities and cents, which no order of summation can round differently."""
    fitted, _ = _small_forest(spark, sf)
    right = F.col("n") - F.col("left_n")
    return fitted.splits().select(
        "bean_name", "tree", "level", "node", "feature", "bin", "n", "left_n",
        F.round(F.col("left0") * F.col("left_n")).cast("bigint").alias("left_mesh"),
        F.round(F.col("right0") * right).cast("bigint").alias("right_mesh"),
        F.round(F.col("right2") * right * 100).cast("bigint").alias("right_cents"),
    )


def _walk_sql(spec: forest.ForestSpec) -> str:
    """Every row through every tree of the SQL forest."""
    parts = [
        f"""walk0 AS (SELECT bean_name, {KEY_SQL}, tree, 1::BIGINT AS node, n.s0 / n.n AS v0, n.s1 / n.n AS v1, n.s2 / n.n AS v2
            FROM brews JOIN nodes0 n USING (bean_name))"""
    ]
    for d in range(spec.max_depth):
        values = ", ".join(
            f"CASE WHEN s.node IS NULL THEN v{i} WHEN b.bin > s.bin THEN (s.s{i} - s.ls{i}) / (s.n - s.ln) ELSE s.ls{i} / s.ln END AS v{i}"
            for i in range(3)
        )
        parts.append(
            f"""walk{d + 1} AS (SELECT w.bean_name, {", ".join("w." + k for k in KEY)}, w.tree,
                CASE WHEN s.node IS NULL THEN w.node ELSE w.node * 2 + CASE WHEN b.bin > s.bin THEN 1 ELSE 0 END END AS node, {values}
                FROM walk{d} w LEFT JOIN splits{d} s ON w.bean_name = s.bean_name AND w.tree = s.tree AND w.node = s.node
                LEFT JOIN binned b ON b.bean_name = w.bean_name AND b.feature = s.feature AND {" AND ".join(f"b.{k} = w.{k}" for k in KEY)})"""
        )
    return ",\n".join(parts)


@query(
    f"""
    WITH {_forest_sql(SMALL)}, {_walk_sql(SMALL)}
    SELECT bean_name, {KEY_SQL}, ROUND(AVG(v0), 4) AS mesh, ROUND(AVG(v1), 6) AS gram, ROUND(AVG(v2), 2) AS extraction_time
    FROM walk{SMALL.max_depth} GROUP BY bean_name, {KEY_SQL}
    """
)
def forest_predictions(spark, sf):
    fitted, encoded = _small_forest(spark, sf)
    scored = forest.predict(encoded, fitted, KEY, prefix="", ones="ones")
    return scored.select(
        "bean_name", *KEY, F.round("mesh", 4).alias("mesh"), F.round("gram", 6).alias("gram"),
        F.round("extraction_time", 2).alias("extraction_time"),
    )


@query(
    f"""
    WITH {_forest_sql(SMALL)},
    gains AS ({" UNION ALL ".join(f"SELECT bean_name, tree, feature, gain FROM splits{d}" for d in range(SMALL.max_depth))}),
    shares AS (SELECT bean_name, feature, SUM(gain) / SUM(SUM(gain)) OVER (PARTITION BY bean_name, tree) AS share
               FROM gains GROUP BY bean_name, tree, feature)
    SELECT bean_name, name AS feature_name, CAST(feature AS INTEGER) AS feature,
           ROUND(SUM(share) / SUM(SUM(share)) OVER (PARTITION BY bean_name), 6) AS importance
    FROM shares JOIN names USING (bean_name, feature) GROUP BY bean_name, name, feature
    """
)
def feature_importance(spark, sf):
    fitted, _ = _small_forest(spark, sf)
    lists = features.feature_lists(brews(spark, sf), ["bean_name"], evaluation.WITH_ORIGIN)
    table_ = forest.importances(fitted, lists).withColumn("importance", F.round("importance", 6))
    return forest.rank_importances(table_, ["bean_name"])


# Deep enough that most nodes end pure or with a few rows.
DEEP = forest.ForestSpec(trees=2, max_depth=6, binning="exact")


GATED_SQL = """SELECT *, 1 AS fold FROM brews
    WHERE bean_name IN (SELECT bean_name FROM brews GROUP BY bean_name HAVING COUNT(*) >= 10)"""


@query(
    f"""
    WITH {forest_sql.grown(DEEP, VALUES_SQL, GATED_SQL, KEY)}
    {" UNION ALL ".join(
        f"SELECT s.bean_name, CAST(s.tree AS INTEGER) AS tree, {d} AS level, s.node, CAST(s.feature AS INTEGER) AS feature, "
        f"ROUND(s.threshold, 6) AS threshold, CAST(s.n AS BIGINT) AS n, CAST(s.ln AS BIGINT) AS left_n, "
        f"CAST(ROUND(c.m0 * c.n) AS BIGINT) AS left_mesh, CAST(ROUND(c.m2 * c.n * 100) AS BIGINT) AS left_cents "
        f"FROM splits{d} s JOIN stats{d + 1} c ON c.bean_name = s.bean_name AND c.tree = s.tree AND c.node = 2 * s.node"
        for d in range(DEEP.max_depth))}
    """
)
def deep_forest_splits(spark, sf):
    """Nodes of trees with exact cuts, six levels of them."""
    fitted, _ = evaluation.train(brews(spark, sf), KEY, spec=DEEP)
    return fitted.splits().select(
        "bean_name", "tree", "level", "node", "feature", F.round("threshold", 6).alias("threshold"), "n", "left_n",
        F.round(F.col("left0") * F.col("left_n")).cast("bigint").alias("left_mesh"),
        F.round(F.col("left2") * F.col("left_n") * 100).cast("bigint").alias("left_cents"),
    )


def _requests(spark, sf) -> DataFrame:
    """Every order asks for one prediction; some name beans without a model or leave measurements out."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("Brand#"), F.dayofmonth("o_orderdate").cast("string")).alias("bean_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ECONOMY").otherwise("UNKNOWN").alias("bean_origin"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderstatus").alias("weather"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.lit(0.04)).alias("temperature"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.lit(3.0)).alias("humidity"),
        F.lit(None).cast("double").alias("days_passed"),
    )


def _stored(spark, sf, categories, spec=EVALUATION):
    """Train every bean, store and register the models, and load them again."""
    base = f"{scratch_dir(spark)}/models-{'-'.join(categories)}-{uuid.uuid4().hex}"
    fitted, lists = evaluation.train(brews(spark, sf), KEY, categories=categories, spec=spec)
    rows = registry.registry_rows(lists, "bean_name", AS_OF, categories=list(categories))
    registry.save_model(spark, base, fitted, rows)
    known = registry.load_registry(spark, base)
    return registry.load_model(spark, base, registry=known), known


def _scored_sql(spec: forest.ForestSpec, origins: bool = False) -> str:
    """Every order's request through every tree of its bean."""
    known = "" if origins else "WHERE name NOT LIKE 'origin%'"
    return ",\n".join(
        [
            forest_sql.grown(spec, VALUES_SQL, GATED_SQL, KEY, origins=origins),
            f"""asked AS (SELECT o_orderkey AS request_id, 'Brand#' || day(o_orderdate) AS bean_name, 0 AS variant,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'ECONOMY' ELSE 'UNKNOWN' END AS bean_origin,
              strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS weather,
              CASE WHEN o_orderpriority <> '2-HIGH' THEN 0.04::DOUBLE END AS temperature,
              CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 3.0::DOUBLE END AS humidity, CAST(NULL AS DOUBLE) AS days_passed,
              CAST(o_orderdate AS DATE) AS d FROM orders),
            asked_values AS (SELECT request_id, feature, CAST(CASE name WHEN 'temperature' THEN COALESCE(temperature, 20.0)
              WHEN 'humidity' THEN COALESCE(humidity, 60.0) WHEN 'days_passed' THEN 15.0 WHEN 'year' THEN year(d)
              WHEN 'month' THEN month(d) WHEN 'day' THEN day(d) WHEN 'day_of_week' THEN isodow(d) - 1
              ELSE CASE WHEN name IN ('weather_' || weather, 'origin_' || bean_origin) THEN 1 ELSE 0 END END AS DOUBLE) AS x
            FROM asked JOIN names USING (bean_name) {known})""",
            forest_sql.walked(spec, "asked", ["request_id"], "asked_values", ["request_id"]),
            """rounded AS (SELECT request_id, bean_name, ROUND(p0, 6) AS mesh, ROUND(p1, 6) AS gram, ROUND(p2, 4) AS extraction_time
               FROM scored),
            sampled AS (SELECT bean_name, COUNT(*) AS sample_count FROM training GROUP BY bean_name)""",
        ]
    )


def _answers_sql(confidence: str) -> str:
    return f"""SELECT request_id, a.bean_name, bean_origin, date, weather, temperature, humidity, days_passed, mesh, gram, extraction_time,
           CASE WHEN sample_count IS NULL THEN 'no_model' ELSE 'ok' END AS status,
           CASE WHEN sample_count IS NOT NULL THEN ROUND(({confidence})::DOUBLE, 6) END AS confidence
        FROM asked a LEFT JOIN rounded USING (request_id) LEFT JOIN sampled ON sampled.bean_name = a.bean_name"""


@query(f"WITH {_scored_sql(FULL)} SELECT * FROM rounded")
def forest_train_score(spark, sf):
    """A hundred shallow trees per bean on all rows, then every order's request scored by the fresh models."""
    fitted, lists = evaluation.train(brews(spark, sf), KEY, spec=FULL)
    asked = features.encode(
        registry.request_features(_requests(spark, sf)), lists, ["bean_name"], evaluation.WEATHER_ONLY
    )
    predicted = forest.predict(asked, fitted, ["request_id"], prefix="", ones="ones")
    return predicted.withColumns(
        {"mesh": F.round("mesh", 6), "gram": F.round("gram", 6), "extraction_time": F.round("extraction_time", 4)}
    )


def _rounded_scores(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            "mesh": F.round("mesh", 6),
            "gram": F.round("gram", 6),
            "extraction_time": F.round("extraction_time", 4),
            "confidence": F.round("confidence", 6),
        }
    )


@query(
    f"""
    WITH {_scored_sql(EVALUATION)}
    {_answers_sql("LEAST(0.95::DOUBLE, 0.7::DOUBLE + sample_count / 100.0::DOUBLE * 0.2::DOUBLE)")}
    """
)
def score_saved_models(spark, sf):
    fitted, rows = _stored(spark, sf, evaluation.WEATHER_ONLY)
    return _rounded_scores(registry.score_saved(_requests(spark, sf), fitted, rows))


@query(f"WITH {_scored_sql(EVALUATION, origins=True)} {_answers_sql(str(scores.LOADED_MODEL_CONFIDENCE))}")
def score_registry_models(spark, sf):
    fitted, rows = _stored(spark, sf, evaluation.WITH_ORIGIN)
    return _rounded_scores(registry.score_registry(_requests(spark, sf), fitted, rows))


@query(f"WITH {_scored_sql(EVALUATION, origins=True)} {_answers_sql(str(scores.BATCH_CONFIDENCE))}")
def score_batch(spark, sf):
    fitted, rows = _stored(spark, sf, evaluation.WITH_ORIGIN)
    return _rounded_scores(registry.score_batch(_requests(spark, sf), fitted, rows))


REGISTRY_SQL = f"""
    {NAMES_SQL},
    listed AS (SELECT bean_name, string_agg(name, ',' ORDER BY feature) AS feature_names, COUNT(*) AS feature_count
               FROM names GROUP BY bean_name),
    counted AS (SELECT bean_name, COUNT(*) AS sample_count FROM brews GROUP BY bean_name HAVING COUNT(*) >= 10)
"""


def _registry(spark, sf) -> DataFrame:
    """Registry of all beans, written twice: the second write replaces every row."""
    lists = materialise(evaluation.gated_lists(brews(spark, sf), "bean_name", evaluation.WITH_ORIGIN), "lists")
    base = f"{scratch_dir(spark)}/registry-{uuid.uuid4().hex}"
    for when in ("2001-01-01T00:00:00", AS_OF):
        registry.register_model(
            spark, base,
            registry.registry_rows(lists, "bean_name", when, categories=list(evaluation.WITH_ORIGIN)),
        )
    return registry.load_registry(spark, base)


@query(
    f"""
    WITH {REGISTRY_SQL}
    SELECT bean_name, translate(bean_name, ' /', '__') AS model_key, feature_names, sample_count,
           '{AS_OF}' AS last_updated FROM listed JOIN counted USING (bean_name)
    """
)
def model_registry(spark, sf):
    return _registry(spark, sf).select(
        "bean_name", "model_key", F.array_join("feature_names", ",").alias("feature_names"), "sample_count", "last_updated"
    )


@query(
    f"""
    WITH {REGISTRY_SQL}
    SELECT bean_name, CAST(feature_count AS INTEGER) AS feature_count, feature_names, 'mesh,gram,extraction_time' AS target_names,
           'weather,bean_origin' AS categorical_columns,
           'temperature,humidity,year,month,day,day_of_week,days_passed' AS numerical_columns,
           'recipe' AS data_source, 'multi-output random forest' AS model_type, sample_count, '{AS_OF}' AS last_updated
    FROM listed JOIN counted USING (bean_name)
    """
)
def model_info(spark, sf):
    info = registry.model_info(_registry(spark, sf))
    return info.select(*[F.array_join(c, ",").alias(c) if k == "array<string>" else F.col(c) for c, k in info.dtypes])


@query(f"WITH {REGISTRY_SQL} SELECT COUNT(*) AS model_count, 'mixed' AS mode FROM counted")
def model_status(spark, sf):
    return registry.model_status(_registry(spark, sf))


HOLDOUT_SQL = f"""
    SELECT * REPLACE (CASE WHEN fold > 0 THEN fold END AS fold) FROM (
        SELECT bean_name, {KEY_SQL}, mesh, gram, extraction_time, 0 AS fold FROM numbered WHERE rn <= ceil(0.1::DOUBLE * size)
        UNION ALL SELECT bean_name, {KEY_SQL}, mesh, gram, extraction_time,
            ntile(3) OVER (PARTITION BY bean_name ORDER BY rn) FROM numbered WHERE rn > ceil(0.1::DOUBLE * size))
"""
NUMBERED_SQL = f"""
    {VALUES_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY bean_name ORDER BY {DIGEST_SQL}, {KEY_SQL}) AS rn,
        COUNT(*) OVER (PARTITION BY bean_name) AS size FROM brews)
"""
HITS_SQL = {t: f"CASE WHEN abs(p{i} - {t}) <= {TOLERANCES[t]}::DOUBLE THEN 1 ELSE 0 END" for i, t in enumerate(TARGETS)}


@query(
    f"""
    WITH {forest_sql.evaluated(EVALUATION, NUMBERED_SQL, HOLDOUT_SQL, KEY)},
    accurate AS (SELECT bean_name, COUNT(*) AS eval_sample_count,
        {", ".join(f"ROUND(AVG({hit}), 6) AS acc_{t}" for t, hit in HITS_SQL.items())},
        ROUND(AVG({" * ".join(HITS_SQL.values())}), 6) AS acc_overall
        FROM outcome WHERE role = 'test' GROUP BY bean_name),
    counted AS (SELECT bean_name, CAST(COUNT(*) AS INTEGER) AS feature_count FROM names WHERE name NOT LIKE 'origin%' GROUP BY bean_name)
    SELECT bean_name, sample_count, eval_sample_count, confidence, feature_count,
        {", ".join(f"{TOLERANCES[t]}::DOUBLE AS tolerance_{t}" for t in TARGETS)},
        {", ".join(f"acc_{t}" for t in TARGETS)}, acc_overall
    FROM confident JOIN accurate USING (bean_name) JOIN counted USING (bean_name)
    """
)
def evaluation_report(spark, sf):
    """The report's nested columns laid out flat."""
    report = evaluation.evaluate(brews(spark, sf), KEY, tolerances=TOLERANCES, spec=EVALUATION)
    return _rounded(
        report.select(
            "bean_name", "sample_count", "eval_sample_count", "confidence", "feature_count",
            *[F.col(f"tolerance_accuracy.tolerance.{t}").alias(f"tolerance_{t}") for t in TARGETS],
            *[F.col(f"tolerance_accuracy.per_target.{t}").alias(f"acc_{t}") for t in TARGETS],
            F.col("tolerance_accuracy.overall").alias("acc_overall"),
        )
    )


FOLDS_SQL = f"""
    SELECT bean_name, {KEY_SQL}, mesh, gram, extraction_time, ntile(3) OVER (PARTITION BY bean_name ORDER BY {KEY_SQL}) AS fold
    FROM brews WHERE bean_name IN (SELECT bean_name FROM brews GROUP BY bean_name HAVING COUNT(*) >= 10)
"""


@query(f"WITH {forest_sql.evaluated(EVALUATION, VALUES_SQL, FOLDS_SQL, KEY)} SELECT * FROM confident")
def trained_confidence(spark, sf):
    return _rounded(evaluation.trained_confidence(brews(spark, sf), KEY, KEY, spec=EVALUATION))
