"""Owner-scoped reads, listings, top-k and counts on the star-schema tables.

Owner = customer, dimension = order or part, fact = line item.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from steepgrid.functions.columns import default_role, display_view
from steepgrid.operators import counts, reads
from steepgrid.plans.catalog import moment, query, table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_KEY_SQL = ", ".join(LINE_KEY)


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderpriority, c_name AS owner_name
    FROM orders JOIN customer ON o_custkey = c_custkey
    ORDER BY owner_name, o_orderkey
    """
)
def owner_dim_join(spark, sf):
    owners = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("owner_name"))
    dims = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = reads.dims_with_owner(dims, owners, "o_custkey", "c_custkey", ["owner_name", "o_orderkey"])
    return reads.listing(joined, ["o_orderkey", "o_custkey", "o_orderpriority", "owner_name"])


@query(
    f"""
    SELECT {LINE_KEY_SQL}, CAST(l_shipdate AS DATE) AS ship_date, l_quantity
    FROM lineitem
    WHERE l_shipdate BETWEEN '1996-01-01' AND '1997-12-31'
      AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
          (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
    """
)
def facts_by_owner_range(spark, sf):
    facts = table(spark, sf, "lineitem")
    owners = reads.by_key(table(spark, sf, "customer"), "c_mktsegment", "BUILDING")
    dates = (moment(facts, "l_shipdate", "1996-01-01"), moment(facts, "l_shipdate", "1997-12-31"))
    rows = reads.facts_by_owner(
        facts, table(spark, sf, "orders"), owners, "l_orderkey", "o_orderkey", "o_custkey", "c_custkey",
        date_col="l_shipdate", dates=dates, ties=LINE_KEY,
    )
    return rows.select(*LINE_KEY, F.to_date("l_shipdate").alias("ship_date"), "l_quantity")


@query(
    f"""
    SELECT {LINE_KEY_SQL}, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag
    FROM lineitem
    WHERE l_returnflag = 'R'
      AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN
          (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
    """
)
def facts_by_owner_category(spark, sf):
    owners = reads.by_key(table(spark, sf, "customer"), "c_mktsegment", "MACHINERY")
    rows = reads.facts_by_owner(
        table(spark, sf, "lineitem"), table(spark, sf, "orders"), owners,
        "l_orderkey", "o_orderkey", "o_custkey", "c_custkey",
        date_col="l_shipdate", category=("l_returnflag", "R"), ties=LINE_KEY,
    )
    return rows.select(*LINE_KEY, F.to_date("l_shipdate").alias("ship_date"), "l_returnflag")


@query(
    f"""
    SELECT {LINE_KEY_SQL}, l_returnflag, l_quantity, CAST(l_shipdate AS DATE) AS ship_date
    FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20
    """
)
def similar_conditions(spark, sf):
    rows = reads.similar_conditions(
        table(spark, sf, "lineitem"), "R", 10.0, 20.0, "l_returnflag", "l_quantity", "l_shipdate", LINE_KEY
    )
    return rows.select(*LINE_KEY, "l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("ship_date"))


@query(
    f"""
    SELECT {LINE_KEY_SQL}, l_tax, l_discount FROM lineitem
    WHERE l_tax BETWEEN 0.02 AND 0.05 AND l_discount BETWEEN 0.01 AND 0.04
    """
)
def measures_in_range(spark, sf):
    rows = reads.in_range(table(spark, sf, "lineitem"), "l_tax", 0.02, 0.05)
    return reads.in_range(rows, "l_discount", 0.01, 0.04).select(*LINE_KEY, "l_tax", "l_discount")


@query(
    f"""
    SELECT {LINE_KEY_SQL}, p_brand, l_quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12'
    """
)
def facts_by_dim_name(spark, sf):
    rows = reads.facts_by_dim_name(
        table(spark, sf, "lineitem"), table(spark, sf, "part"), "l_partkey", "p_partkey", "p_brand", "Brand#12"
    )
    return rows.select(*LINE_KEY, "p_brand", "l_quantity")


@query(
    """
    SELECT p_brand, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag,
           COALESCE(NULLIF(l_tax, 0.01), 0) AS l_tax, l_linenumber, l_discount, l_quantity, l_extendedprice
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= DATE '2001-08-01' - INTERVAL 12 MONTH
    """
)
def dim_history(spark, sf):
    facts = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.01)))
    rows = reads.dim_history(
        facts, table(spark, sf, "part"), "l_partkey", "p_partkey", "p_brand",
        ["p_brand", "l_shipdate", "l_returnflag", "l_tax", "l_linenumber", "l_discount", "l_quantity", "l_extendedprice"],
        as_of="2001-08-01", date_col="l_shipdate", numeric=["l_tax"], ties=LINE_KEY,
    )
    return rows.withColumn("l_shipdate", F.to_date("l_shipdate")).withColumnRenamed("l_shipdate", "ship_date")


@query(
    f"""
    SELECT {LINE_KEY_SQL}, COALESCE(origin, 'その他') AS origin
    FROM lineitem LEFT JOIN
      (SELECT p_partkey, MIN(p_type) AS origin FROM part WHERE p_size <= 25 GROUP BY p_partkey)
      ON l_partkey = p_partkey
    """
)
def origin_lookup(spark, sf):
    known = table(spark, sf, "part").where(F.col("p_size") <= 25)
    rows = reads.with_origin(table(spark, sf, "lineitem"), known, "l_partkey", "p_partkey", "p_type")
    return rows.select(*LINE_KEY, "origin")


@query(
    """
    SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
       AND o_orderstatus = 'P') AS found
    FROM customer
    """
)
def existence_flags(spark, sf):
    ref = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return reads.exists_flag(
        table(spark, sf, "customer").select("c_custkey", "c_name"), ref, [("c_custkey", "o_custkey")]
    )


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'small ring' ORDER BY p_partkey LIMIT 1")
def name_lookup(spark, sf):
    return reads.lookup(table(spark, sf, "part"), "p_name", "small ring", ["p_partkey"]).select(
        "p_partkey", "p_name", "p_brand"
    )


@query("SELECT p_name, MIN(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_id_per_name(spark, sf):
    return reads.lookup_first(table(spark, sf, "part"), "p_name", "p_partkey")


@query(
    """
    SELECT c_custkey, c_name, CAST(COUNT(o_orderkey) AS BIGINT) AS recipe_count
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    GROUP BY c_custkey, c_name ORDER BY recipe_count DESC, c_custkey
    """
)
def count_per_dim(spark, sf):
    dims = table(spark, sf, "customer").select("c_custkey", "c_name")
    return counts.fact_counts(dims, table(spark, sf, "orders"), "c_custkey", "o_custkey", ordered=True)


@query(
    """
    SELECT c_custkey, c_name, CAST(COUNT(o_orderkey) AS BIGINT) AS usage_count
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    WHERE c_mktsegment = 'HOUSEHOLD'
    GROUP BY c_custkey, c_name ORDER BY usage_count DESC, c_custkey LIMIT 5
    """
)
def popular_topk(spark, sf):
    dims = reads.by_key(table(spark, sf, "customer"), "c_mktsegment", "HOUSEHOLD").select("c_custkey", "c_name")
    return counts.popular(dims, table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query(
    """
    SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS order_date
    FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 5
    """
)
def latest_by_id(spark, sf):
    rows = reads.latest_facts(
        table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "c_name",
        [F.desc("o_orderkey")],
    )
    return rows.select("o_orderkey", "c_name", F.to_date("o_orderdate").alias("order_date"))


@query(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice
    FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5
    """
)
def recent_by_date(spark, sf):
    rows = reads.top_k(table(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 5)
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"), "o_totalprice")


def _list_rows(spark, sf):
    facts = table(spark, sf, "lineitem").select(*LINE_KEY, "l_shipdate", "l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return reads.facts_by_dim_name(facts, table(spark, sf, "part"), "l_partkey", "p_partkey", "p_brand")


LIST_SQL = f"""
    SELECT {LINE_KEY_SQL}, l_returnflag, p_brand, NULLIF(l_tax, 0.0) AS l_tax
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""


@query(LIST_SQL)
def sorted_list_bean(spark, sf):
    rows = reads.sort_list(_list_rows(spark, sf), "bean", "l_shipdate", "p_brand", "l_returnflag", "l_tax", ties=LINE_KEY)
    return rows.drop("l_shipdate")


@query(LIST_SQL)
def sorted_list_temperature(spark, sf):
    rows = reads.sort_list(
        _list_rows(spark, sf), "temperature", "l_shipdate", "p_brand", "l_returnflag", "l_tax", ties=LINE_KEY
    )
    return rows.drop("l_shipdate")


# The same rows in the same order, with the order checked through the position of the k best.
@query(
    f"""
    SELECT {LINE_KEY_SQL}, p_brand, NULLIF(l_tax, 0.0) AS l_tax
    FROM lineitem JOIN part ON l_partkey = p_partkey
    ORDER BY COALESCE(NULLIF(l_tax, 0.0), 0) DESC, {LINE_KEY_SQL} LIMIT 20
    """
)
def sorted_list_top(spark, sf):
    rows = reads.sort_list(
        _list_rows(spark, sf), "temperature", "l_shipdate", "p_brand", "l_returnflag", "l_tax", ties=LINE_KEY
    )
    return rows.limit(20).select(*LINE_KEY, "p_brand", "l_tax")


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey = (SELECT MIN(c_custkey) FROM customer WHERE c_name = 'Customer#000000042')
    """
)
def owned_or_all_known(spark, sf):
    dims = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reads.owned_or_all(
        dims, table(spark, sf, "customer"), "Customer#000000042", "o_custkey", "c_custkey", "c_name"
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def owned_or_all_unknown(spark, sf):
    dims = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reads.owned_or_all(dims, table(spark, sf, "customer"), "nobody", "o_custkey", "c_custkey", "c_name")


@query(f"SELECT {LINE_KEY_SQL}, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def optional_filter(spark, sf):
    rows = reads.optional_filter(table(spark, sf, "lineitem"), "l_returnflag", "A")
    return reads.optional_filter(rows, "l_linestatus", "").select(*LINE_KEY, "l_returnflag")


@query(
    """
    SELECT c_custkey, c_name, c_nationkey,
           COALESCE(CASE WHEN c_mktsegment = 'BUILDING' THEN 'ROLE_ADMIN' END, 'ROLE_USER') AS role
    FROM customer
    """
)
def public_users(spark, sf):
    role = default_role(F.when(F.col("c_mktsegment") == "BUILDING", "ROLE_ADMIN"))
    users = table(spark, sf, "customer").withColumns({"role": role, "password": F.md5("c_name")})
    return reads.listing(reads.public_view(users), ["c_custkey", "c_name", "c_nationkey", "role"])


@query("SELECT COUNT(*) AS row_count FROM lineitem")
def table_count(spark, sf):
    return counts.table_count(table(spark, sf, "lineitem"))


@query(
    """
    SELECT 'users' AS table_name, COUNT(*) AS row_count FROM customer
    UNION ALL SELECT 'beans', COUNT(*) FROM orders
    UNION ALL SELECT 'recipe', COUNT(*) FROM lineitem
    """
)
def labelled_counts(spark, sf):
    return counts.labelled_counts(_stores(spark, sf))


@query(
    """
    SELECT u AS users_count, b AS beans_count, r AS recipe_count, CAST(u + b + r AS BIGINT) AS total_records
    FROM (SELECT (SELECT COUNT(*) FROM customer) AS u, (SELECT COUNT(*) FROM orders) AS b,
                 (SELECT COUNT(*) FROM lineitem) AS r)
    """
)
def database_stats(spark, sf):
    return counts.database_stats(_stores(spark, sf))


def _stores(spark, sf):
    return {
        "users": table(spark, sf, "customer"),
        "beans": table(spark, sf, "orders"),
        "recipe": table(spark, sf, "lineitem"),
    }


@query(
    """
    SELECT c_custkey, c_name, CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS bean_count,
           CAST(COUNT(l_orderkey) AS BIGINT) AS recipe_count
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_custkey, c_name
    """
)
def owner_totals(spark, sf):
    return counts.owner_totals(
        table(spark, sf, "customer").select("c_custkey", "c_name"),
        table(spark, sf, "orders"), table(spark, sf, "lineitem"),
        "c_custkey", "o_custkey", "o_orderkey", "l_orderkey",
    )


@query(
    """
    SELECT COUNT(*) AS row_count, MIN(CAST(l_shipdate AS DATE)) AS first_date, MAX(CAST(l_shipdate AS DATE)) AS last_date,
           COUNT(DISTINCT p_brand) AS beans, COUNT(DISTINCT l_suppkey) AS users,
           ROUND(MIN(l_quantity), 1) AS min_temperature, ROUND(MAX(l_quantity), 1) AS max_temperature,
           ROUND(MIN(l_extendedprice), 1) AS min_humidity, ROUND(MAX(l_extendedprice), 1) AS max_humidity
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """
)
def dataset_summary(spark, sf):
    rows = reads.facts_by_dim_name(
        table(spark, sf, "lineitem"), table(spark, sf, "part"), "l_partkey", "p_partkey", "p_brand"
    ).withColumn("date", F.to_date("l_shipdate"))
    return counts.dataset_summary(
        rows,
        distinct={"beans": "p_brand", "users": "l_suppkey"},
        measures={"temperature": "l_quantity", "humidity": "l_extendedprice"},
    )


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y/%-m/%-d') AS date_text, o_custkey || '°C' AS temperature_text,
           o_orderstatus || '%' AS humidity_text, o_orderkey || '秒' AS time_text
    FROM orders
    """
)
def report_lines(spark, sf):
    shown = display_view(table(spark, sf, "orders"), "o_orderdate", "o_custkey", "o_orderstatus", "o_orderkey")
    return shown.select("o_orderkey", "date_text", "temperature_text", "humidity_text", "time_text")
