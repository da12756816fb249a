"""Duplicate detection, appends, validation, updates and deletes on the star-schema tables.

The batch is every line item; what is stored already are the line items with status F.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from steepgrid.functions import columns
from steepgrid.operators import changes, partitions, reads
from steepgrid.operators.ranks import assign_ids
from steepgrid.plans.catalog import query, table
from steepgrid.plans.read_queries import LINE_KEY, LINE_KEY_SQL
from steepgrid.session import scratch_dir
from steepgrid.sources.tables import append_rows

# Idempotence key: (bean, date, extraction time); the rest of the row orders rows of one key.
BREW_KEY = ["l_orderkey", "l_shipdate", "l_quantity"]
BREW_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = ", ".join(BREW_KEY)
ORDER_SQL = ", ".join(BREW_ORDER)
STORED_SQL = f"(SELECT DISTINCT {KEY_SQL} FROM lineitem WHERE l_linestatus = 'F')"


def _batch(spark, sf):
    return table(spark, sf, "lineitem").select(*BREW_KEY, *BREW_ORDER)


def _stored(spark, sf):
    return table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(*BREW_KEY, *BREW_ORDER)


def _ship_date(df):
    return df.withColumn("l_shipdate", F.to_date("l_shipdate")).withColumnRenamed("l_shipdate", "ship_date")


OUT_SQL = f"l_orderkey, CAST(l_shipdate AS DATE) AS ship_date, l_quantity, {ORDER_SQL}"


@query(f"SELECT {OUT_SQL} FROM lineitem SEMI JOIN {STORED_SQL} USING ({KEY_SQL})")
def existing_rows(spark, sf):
    return _ship_date(changes.existing_rows(_batch(spark, sf), _stored(spark, sf), BREW_KEY))


@query(f"SELECT {OUT_SQL} FROM lineitem ANTI JOIN {STORED_SQL} USING ({KEY_SQL})")
def new_rows(spark, sf):
    return _ship_date(changes.new_rows(_batch(spark, sf), _stored(spark, sf), BREW_KEY))


REPORT_SQL = f"""
    SELECT CAST(SUM(hit) AS BIGINT) AS existing_count, COUNT(*) AS total_count,
           ROUND(SUM(hit) * 100.0 / COUNT(*), 6) AS duplicate_rate
    FROM (SELECT CASE WHEN s.l_orderkey IS NULL THEN 0 ELSE 1 END AS hit
          FROM lineitem l LEFT JOIN {STORED_SQL} s USING ({KEY_SQL}))
"""


@query(f"SELECT existing_count, total_count, CAST(duplicate_rate AS DOUBLE) AS duplicate_rate FROM ({REPORT_SQL})")
def duplicate_report(spark, sf):
    report = changes.duplicate_rate(_batch(spark, sf), _stored(spark, sf), BREW_KEY)
    return report.withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query(
    f"""
    SELECT {OUT_SQL} FROM lineitem ANTI JOIN {STORED_SQL} USING ({KEY_SQL})
    WHERE (SELECT existing_count < total_count AND duplicate_rate <= 80 FROM ({REPORT_SQL}))
    """
)
def duplicate_gate(spark, sf):
    return _ship_date(changes.gate(_batch(spark, sf), _stored(spark, sf), BREW_KEY))


@query(
    f"""
    SELECT {OUT_SQL} FROM lineitem ANTI JOIN {STORED_SQL} USING ({KEY_SQL})
    WHERE (SELECT existing_count < total_count AND duplicate_rate <= 10 FROM ({REPORT_SQL}))
    """
)
def duplicate_gate_closed(spark, sf):
    return _ship_date(changes.gate(_batch(spark, sf), _stored(spark, sf), BREW_KEY, limit=10.0))


@query(
    f"""
    SELECT {OUT_SQL} FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, {ORDER_SQL}) = 1
    """
)
def first_per_key(spark, sf):
    return _ship_date(
        changes.first_per_key(_batch(spark, sf), ["l_suppkey", "l_shipdate"], ["l_orderkey", *BREW_ORDER])
    )


# Names are order priorities with the smallest order key of each as its id.
@query(
    """
    SELECT name, MIN(o_orderkey) AS bean_id, COUNT(*) AS row_count
    FROM (SELECT o_orderkey AS k, o_orderpriority AS name FROM orders) b
    JOIN (SELECT o_orderpriority, MIN(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority < '5' GROUP BY 1) d
      ON b.name = d.o_orderpriority
    GROUP BY name
    """
)
def resolved_names(spark, sf):
    known, _ = _resolve(spark, sf)
    return known.groupBy("name").agg(F.min("bean_id").alias("bean_id"), F.count("*").alias("row_count"))


@query("SELECT o_orderpriority AS name, COUNT(*) AS row_count FROM orders WHERE o_orderpriority >= '5' GROUP BY 1")
def unknown_names(spark, sf):
    _, unknown = _resolve(spark, sf)
    return unknown.groupBy("name").agg(F.count("*").alias("row_count"))


def _resolve(spark, sf):
    orders = table(spark, sf, "orders")
    batch = orders.select("o_custkey", F.col("o_orderpriority").alias("name"))
    return changes.resolve_dim(batch, orders.where("o_orderpriority < '5'"), "name", "o_orderpriority", "o_orderkey")


# A brew names its bean by part name; the smallest part key of that name outside type ECONOMY is its id.
APPEND_SQL = f"""
    WITH ids AS (SELECT p_name, MIN(p_partkey) AS bean_id FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_name),
    named AS (SELECT l.*, p_name FROM lineitem l JOIN part ON l_partkey = p_partkey),
    batch AS (SELECT n.*, i.bean_id FROM named n LEFT JOIN ids i USING (p_name)),
    stored AS (SELECT DISTINCT bean_id, l_shipdate, l_quantity FROM batch
               WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND bean_id IS NOT NULL),
    firsts AS (SELECT bean_id, l_shipdate, l_quantity, l_orderkey, {ORDER_SQL} FROM batch WHERE bean_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY bean_id, l_shipdate, l_quantity
                                          ORDER BY l_orderkey, {ORDER_SQL}) = 1),
    inserted AS (SELECT * FROM firsts ANTI JOIN stored USING (bean_id, l_shipdate, l_quantity))
"""


def _append_inputs(spark, sf):
    parts = table(spark, sf, "part")
    batch = reads.facts_by_dim_name(
        table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", *BREW_ORDER, "l_linestatus", "l_returnflag"),
        parts, "l_partkey", "p_partkey", "p_name",
    )
    dims = parts.where("p_type <> 'ECONOMY'")
    known, _ = changes.resolve_dim(batch, dims, "p_name", "p_name", "p_partkey")
    stored = known.where("l_linestatus = 'F' AND l_returnflag = 'R'")
    return batch.drop("l_linestatus", "l_returnflag"), stored, dims, known


APPEND_KEY = ["bean_id", "l_shipdate", "l_quantity"]


@query(
    f"""
    {APPEND_SQL}
    SELECT bean_id, CAST(l_shipdate AS DATE) AS ship_date, l_quantity, l_orderkey, {ORDER_SQL} FROM inserted
    """
)
def idempotent_append(spark, sf):
    batch, stored, dims, _ = _append_inputs(spark, sf)
    rows = changes.append_new(
        batch, stored, dims, APPEND_KEY, ["l_orderkey", *BREW_ORDER], "p_name", "p_name", "p_partkey"
    )
    return _ship_date(rows.drop("p_name"))


@query(
    f"""
    {APPEND_SQL}
    SELECT bean_id, CAST(l_shipdate AS DATE) AS ship_date, l_quantity, l_orderkey, {ORDER_SQL} FROM inserted
    WHERE year(l_shipdate) = 1995
    """
)
def partitioned_append(spark, sf):
    """What the line items of 1995 add to a table stored by month, of which only that year's months are read."""
    rows, _ = _append_by_month(spark, sf)
    return _ship_date(rows.drop("p_name", "month"))


def _append_by_month(spark, sf):
    """(rows to append, path of the stored table)."""
    batch, stored, dims, _ = _append_inputs(spark, sf)
    by_month = lambda df: df.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    path = f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}"
    partitions.store_partitioned(by_month(stored).drop("l_linestatus", "l_returnflag"), path, "month")
    rows = changes.append_new(
        by_month(batch).where(F.year("l_shipdate") == 1995), spark.read.parquet(path), dims, APPEND_KEY,
        ["l_orderkey", *BREW_ORDER], "p_name", "p_name", "p_partkey", partition="month",
    )
    return rows, path


@query(
    f"""
    {APPEND_SQL}
    SELECT bean_id, CAST(l_shipdate AS DATE) AS ship_date, l_quantity, l_orderkey, {ORDER_SQL} FROM batch
    WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND bean_id IS NOT NULL
    UNION ALL SELECT bean_id, CAST(l_shipdate AS DATE), l_quantity, l_orderkey, {ORDER_SQL} FROM inserted
    WHERE year(l_shipdate) = 1995
    """
)
def appended_table(spark, sf):
    """The stored table after that append."""
    rows, path = _append_by_month(spark, sf)
    append_rows(rows, path, "month")
    return _ship_date(spark.read.parquet(path).drop("p_name", "month"))


@query(
    f"""
    {APPEND_SQL}
    SELECT (SELECT COUNT(*) FROM inserted) AS inserted,
           (SELECT COUNT(*) FROM batch WHERE bean_id IS NOT NULL) - (SELECT COUNT(*) FROM inserted) AS skipped
    """
)
def append_counters(spark, sf):
    _, stored, _, known = _append_inputs(spark, sf)
    return changes.append_report(known, stored, APPEND_KEY)


@query(
    """
    SELECT c_custkey, c_name, c_nationkey, (SELECT COALESCE(MAX(o_orderkey), 0) FROM orders)
           + row_number() OVER (ORDER BY c_nationkey, c_custkey) AS o_orderkey
    FROM customer
    """
)
def assigned_ids(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return assign_ids(rows, table(spark, sf, "orders"), "o_orderkey", ["c_nationkey", "c_custkey"])


# Customers as submitted beans: negative balances have a blank name, nation 5 an overlong one, and a
# name may be used once per nation. Balances above 9000 are stored already.
SUBMITTED_SQL = """
    SELECT c_custkey, c_nationkey, c_acctbal,
           CASE WHEN c_acctbal < 0 THEN '   ' WHEN c_nationkey = 5 THEN repeat(c_mktsegment, 8)
                ELSE c_mktsegment || CAST(c_custkey // 40 AS VARCHAR) END AS name,
           CASE WHEN c_nationkey = 6 THEN c_name ELSE 'c' || c_custkey || '@example.com' END AS email,
           CASE WHEN c_nationkey = 7 THEN 'short' ELSE 'long enough' END AS password
    FROM customer
"""
CHECKED_SQL = f"""
    WITH submitted AS ({SUBMITTED_SQL}),
    stored AS (SELECT name, c_nationkey FROM submitted WHERE c_acctbal > 9000),
    ruled AS (SELECT *, CASE WHEN length(trim(name)) = 0 THEN 'blank_name' WHEN length(trim(name)) > 50 THEN 'long_name'
                  WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'bad_email'
                  WHEN length(password) < 6 THEN 'short_password'
                  WHEN (name, c_nationkey) IN (SELECT (name, c_nationkey) FROM stored) THEN 'already_exists' END AS early
              FROM submitted WHERE c_acctbal <= 9000),
    placed AS (SELECT *, MIN(CASE WHEN early IS NULL THEN c_custkey END) OVER (PARTITION BY name, c_nationkey) AS winner
               FROM ruled)
    SELECT c_custkey, c_nationkey, name,
           COALESCE(early, CASE WHEN winner <> c_custkey THEN 'repeated_in_batch' END) AS reason FROM placed
"""


def _submitted(spark, sf):
    nation = F.col("c_nationkey")
    block = F.floor(F.col("c_custkey") / F.lit(40)).cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        F.when(F.col("c_acctbal") < 0, "   ")
        .when(nation == 5, F.repeat("c_mktsegment", F.lit(8)))
        .otherwise(F.concat("c_mktsegment", block))
        .alias("name"),
        F.when(nation == 6, F.col("c_name"))
        .otherwise(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.when(nation == 7, "short").otherwise("long enough").alias("password"),
    )


def _checked(spark, sf):
    submitted = _submitted(spark, sf)
    rules = {
        "blank_name": columns.is_blank("name"),
        "long_name": columns.too_long("name"),
        "bad_email": columns.bad_email("email"),
        "short_password": columns.short_password("password"),
    }
    checked = changes.validate_insert(
        submitted.where("c_acctbal <= 9000"), rules, submitted.where("c_acctbal > 9000"),
        ["name", "c_nationkey"], ["c_custkey"],
    )
    return checked.select("c_custkey", "c_nationkey", "name", "reason")


@query(CHECKED_SQL)
def validated_insert(spark, sf):
    return _checked(spark, sf)


@query(f"SELECT c_custkey, c_nationkey, name FROM ({CHECKED_SQL}) WHERE reason IS NULL")
def accepted_rows(spark, sf):
    return changes.accepted(_checked(spark, sf))


@query(f"SELECT * FROM ({CHECKED_SQL}) WHERE reason IS NOT NULL")
def rejected_rows(spark, sf):
    return changes.rejected(_checked(spark, sf))


# The acting owner of a line item is taken to be the customer numbered like its supplier.
OWNED_SQL = "EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = l_suppkey)"


def _owner_check(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINE_KEY)
    return reads.owner_check(rows, table(spark, sf, "orders"), "l_orderkey", "l_suppkey", "o_orderkey", "o_custkey")


@query(f"SELECT {LINE_KEY_SQL} FROM lineitem WHERE {OWNED_SQL}")
def owner_check_passed(spark, sf):
    return _owner_check(spark, sf)[0]


@query(f"SELECT {LINE_KEY_SQL} FROM lineitem WHERE NOT {OWNED_SQL}")
def owner_check_refused(spark, sf):
    return _owner_check(spark, sf)[1]


# Every order is a change of its customer's row; the last one stands.
CHANGES_SQL = """
    SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, o_orderpriority AS c_mktsegment FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""


def _changes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        "o_orderdate",
        "o_orderkey",
    )


@query(
    f"""
    SELECT c.c_custkey, c_name, c_nationkey, COALESCE(n.c_acctbal, c.c_acctbal) AS c_acctbal,
           COALESCE(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment
    FROM customer c LEFT JOIN ({CHANGES_SQL}) n ON c.c_custkey = n.c_custkey
    """
)
def update_rows(spark, sf):
    return changes.update_rows(
        table(spark, sf, "customer"), _changes(spark, sf), "c_custkey", ["c_acctbal", "c_mktsegment"],
        ["o_orderdate", "o_orderkey"],
    )


@query(
    f"""
    SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
    WHERE c_mktsegment = 'FURNITURE' AND c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM ({CHANGES_SQL})
    """
)
def upsert(spark, sf):
    columns_kept = ["c_custkey", "c_acctbal", "c_mktsegment"]
    latest = changes.last_per_key(_changes(spark, sf), ["c_custkey"], ["o_orderdate", "o_orderkey"])
    stored = table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").select(*columns_kept)
    return changes.upsert(stored, latest, "c_custkey")


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """
)
def delete_rows(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    stored = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return changes.delete_rows(stored, ids, "o_orderkey")


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
      (SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       JOIN customer ON c_custkey = o_custkey WHERE l_linenumber = c_nationkey)
    """
)
def delete_owned(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("actor")
    )
    stored = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return changes.delete_owned(
        stored, requests, table(spark, sf, "customer"), "o_orderkey", "o_custkey", "c_custkey", "c_nationkey", "actor"
    )


# Orders stored by month. Urgent orders of 1996 change, orders of 1997 come anew with another price, some under new
# keys, and the orders whose key is divisible by 50 go.
STORED_ORDERS_SQL = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, o_totalprice FROM orders"


def _monthly_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query(
    f"""
    WITH stored AS ({STORED_ORDERS_SQL}),
    updated AS (SELECT s.o_orderkey, month, CASE WHEN hit THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
                  CASE WHEN hit THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
                FROM stored s JOIN (SELECT o_orderkey, o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996 AS hit FROM orders)
                USING (o_orderkey)),
    fresh AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey,
                month, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM stored WHERE month LIKE '1997%'),
    merged AS (SELECT * FROM updated WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fresh) UNION ALL SELECT * FROM fresh)
    SELECT * FROM merged WHERE o_orderkey % 50 <> 0
    """
)
def changed_partitions(spark, sf):
    """An update, an upsert and a delete on a table in month folders, each rewriting the folders that it touches."""
    orders = _monthly_orders(spark, sf)
    path = f"{scratch_dir(spark)}/orders-{uuid.uuid4().hex}"
    columns_kept = ["o_orderkey", "month", "o_orderstatus", "o_totalprice"]
    partitions.store_partitioned(orders.select(*columns_kept), path, "month")
    urgent = orders.where("o_orderpriority = '1-URGENT' and month like '1996%'").withColumns(
        {"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 1}
    )
    partitions.update_partitions(spark, path, "month", urgent, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    moved = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey"))
    fresh = orders.where("month like '1997%'").select(
        moved.alias("o_orderkey"), "month", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice")
    )
    partitions.upsert_partitions(spark, path, "month", fresh, "o_orderkey")
    gone = spark.read.parquet(path).where("o_orderkey % 50 = 0")
    partitions.delete_partitions(spark, path, "month", gone, "o_orderkey")
    return spark.read.parquet(path).select(*columns_kept)


def _cascade(spark, sf):
    owners = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return changes.cascade_delete(
        owners,
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        table(spark, sf, "lineitem").select(*LINE_KEY),
        reads.by_key(owners, "c_mktsegment", "FURNITURE"),
        "c_custkey", "o_custkey", "o_orderkey", "l_orderkey",
    )


KEPT_SQL = "(SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE')"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def cascade_delete_owners(spark, sf):
    return _cascade(spark, sf)[0]


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN {KEPT_SQL}")
def cascade_delete_dims(spark, sf):
    return _cascade(spark, sf)[1]


@query(
    f"""
    SELECT {LINE_KEY_SQL} FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {KEPT_SQL})
    """
)
def cascade_delete_facts(spark, sf):
    return _cascade(spark, sf)[2]
