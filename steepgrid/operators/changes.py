"""Duplicate gate, idempotent append, validation, update and delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.functions.columns import collated, first_reason
from steepgrid.operators.reads import exists_flag
from steepgrid.session import materialise

GATE_PERCENT = 80.0


def ids_by_name(
    dims: DataFrame, dim_name: str, dim_id: str, alias: str = "bean_id", collation: str | None = None
) -> DataFrame:
    """``_name`` and the smallest id of every name; names that a collation takes for equal are one name."""
    return dims.groupBy(collated(dim_name, collation).alias("_name")).agg(F.min(dim_id).alias(alias))


def resolve_dim(
    batch: DataFrame,
    dims: DataFrame,
    name_col: str,
    dim_name: str,
    dim_id: str,
    alias: str = "bean_id",
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows with the id of their name, rows whose name is unknown); a repeated name means its smallest id."""
    ids = ids_by_name(dims, dim_name, dim_id, alias, collation)
    on = collated(name_col, collation) == F.col("_name")
    return batch.join(ids, on, "inner").drop("_name"), batch.join(ids, on, "left_anti")


def table_slice(table: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """The rows of a table partitioned by ``partition`` that share a partition with the batch.

    The batch's partition values are written first; their range is a filter that the listing of the table's
    partitions meets, and inside it a dynamic filter leaves out the partitions between.
    """
    values = materialise(batch.select(partition).where(F.col(partition).isNotNull()).distinct(), "batch-partitions")
    ends = values.agg(F.min(partition).alias("low"), F.max(partition).alias("high")).first()
    if ends["low"] is None:
        return table.where(F.lit(False))
    inside = F.col(partition).between(F.lit(ends["low"]), F.lit(ends["high"]))
    return table.where(inside).join(values.where(inside), partition, "left_semi").select(*table.columns)


def _keys_of(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys: a key held by many rows becomes one row per map task before the shuffle."""
    return table.select(*keys).distinct()


def existing_rows(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.join(_keys_of(table, keys), list(keys), "left_semi")


def new_rows(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.join(_keys_of(table, keys), list(keys), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in a stated order, as an aggregate with partial merge on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key, for changes that follow one another."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[c for c in order if c not in keys], *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def duplicate_rate(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows already stored, all rows, rate in percent (0 for an empty batch)."""
    per_key = batch.groupBy(*keys).agg(F.count("*").alias("_rows"))
    flagged = exists_flag(per_key, table, [(k, k) for k in keys], "_found")
    existing = F.coalesce(F.sum(F.when(F.col("_found"), F.col("_rows"))), F.lit(0)).cast("bigint")
    total = F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint")
    return flagged.agg(existing.alias("existing_count"), total.alias("total_count")).withColumn(
        "duplicate_rate",
        F.when(
            F.col("total_count") > 0, F.col("existing_count").cast("double") / F.col("total_count") * 100.0
        ).otherwise(0.0),
    )


def gate_open(report: DataFrame, limit: float = GATE_PERCENT) -> DataFrame:
    """One boolean: closed when everything exists already or the rate is above the limit."""
    return report.select(
        ((F.col("existing_count") < F.col("total_count")) & (F.col("duplicate_rate") <= limit)).alias("open")
    )


def gate(
    batch: DataFrame, table: DataFrame, keys: Sequence[str], limit: float = GATE_PERCENT
) -> DataFrame:
    """The batch's new rows, or none when the gate is closed; decided inside the plan."""
    is_open = gate_open(duplicate_rate(batch, table, keys), limit)
    return new_rows(batch, table, keys).where(is_open.scalar())


def append_new(
    batch: DataFrame,
    table: DataFrame,
    dims: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name_col: str,
    dim_name: str,
    dim_id: str,
    id_alias: str = "bean_id",
    limit: float = GATE_PERCENT,
    collation: str | None = None,
    partition: str | None = None,
) -> DataFrame:
    """Rows an idempotent append adds: gate, name resolved, not stored yet, first of its key.

    The gate's total counts unknown names too. A NULL in the key cannot be stored and is left out. ``partition`` names
    the column that the stored table is partitioned by, if it is a function of the key: then only the
    batch's partitions are read.
    """
    if partition is not None:
        table = table_slice(table, batch, partition)
    ids = ids_by_name(dims, dim_name, dim_id, id_alias, collation)
    resolved = batch.join(ids, collated(name_col, collation) == F.col("_name"), "left").drop("_name")
    is_open = gate_open(duplicate_rate(resolved, table, keys), limit)
    storable = resolved.dropna(subset=list(keys)).where(is_open.scalar())
    return new_rows(first_per_key(storable, keys, order), table, keys)


def append_report(
    batch: DataFrame, table: DataFrame, keys: Sequence[str], is_open: DataFrame | None = None
) -> DataFrame:
    """Inserted and skipped counters of a resolved batch.

    One row per new key goes in and the rest is skipped; behind a closed gate nothing goes in.
    """
    per_key = batch.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
    flagged = exists_flag(per_key, table, [(k, k) for k in keys], "_found")
    new = ~F.col("_found") if is_open is None else ~F.col("_found") & is_open.scalar()
    inserted = F.coalesce(F.sum(F.when(new, 1).otherwise(0)), F.lit(0)).cast("bigint")
    total = F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint")
    return flagged.agg(inserted.alias("inserted"), (total - inserted).cast("bigint").alias("skipped"))


def validate_insert(
    batch: DataFrame,
    rules: Mapping[str, Column],
    table: DataFrame | None = None,
    unique: Sequence[str] = (),
    order: Sequence[str] = (),
    reason: str = "reason",
) -> DataFrame:
    """Add the reason a row is refused, NULL when it is accepted.

    Rules are tried in the order given, then the unique key against the table, then against earlier
    accepted rows of the batch.
    """
    checked = batch.withColumn(reason, first_reason(rules))
    if not unique:
        return checked
    if table is not None:
        checked = exists_flag(checked, table, [(k, k) for k in unique], "_taken")
        checked = checked.withColumn(
            reason, F.coalesce(reason, F.when(F.col("_taken"), F.lit("already_exists")))
        ).drop("_taken")
    winners = (
        checked.where(F.col(reason).isNull())
        .groupBy(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(unique)])
        .agg(F.min(F.struct(*order)).alias("_winner"))
    )
    on = [F.col(k) == F.col(f"_u{i}") for i, k in enumerate(unique)]
    return (
        checked.join(winners, on, "left")
        .withColumn(
            reason,
            F.coalesce(
                reason,
                F.when(F.col("_winner") != F.struct(*order), F.lit("repeated_in_batch")),
            ),
        )
        .drop("_winner", *[f"_u{i}" for i in range(len(unique))])
    )


def accepted(checked: DataFrame, reason: str = "reason") -> DataFrame:
    return checked.where(F.col(reason).isNull()).drop(reason)


def rejected(checked: DataFrame, reason: str = "reason") -> DataFrame:
    return checked.where(F.col(reason).isNotNull())


def update_rows(
    table: DataFrame, changes: DataFrame, key: str, cols: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Set the listed columns of the rows named by ``changes``; several changes of a row apply in order."""
    latest = last_per_key(changes, [key], order) if order else changes
    new = latest.select(F.col(key).alias("_key"), F.struct(*cols).alias("_new"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[
            F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in table.columns
        ]
    )


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of the same key, and new keys are added."""
    kept = table.join(changes.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(changes.select(*table.columns))


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """What is left after deleting the rows named by ``ids``."""
    return table.join(_keys_of(ids, [key]), key, "left_anti")


def delete_owned(
    table: DataFrame, requests: DataFrame, dims: DataFrame, key: str, table_dim: str, dim_key: str, dim_owner: str, actor: str
) -> DataFrame:
    """Delete only where the acting owner owns the row's dimension; ``requests`` holds (key, actor)."""
    owner_of = dims.select(F.col(dim_key).alias("_d"), F.col(dim_owner).alias("_o"))
    allowed = (
        table.select(key, table_dim)
        .join(requests, key)
        .join(owner_of, (F.col(table_dim) == F.col("_d")) & (F.col(actor) == F.col("_o")), "left_semi")
    )
    return delete_rows(table, allowed, key)


def cascade_delete(
    owners: DataFrame,
    dims: DataFrame,
    facts: DataFrame,
    ids: DataFrame,
    owner_key: str,
    dim_owner: str,
    dim_key: str,
    fact_key: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove owners with all their dimensions and facts; returns what is left of each table."""
    gone = _keys_of(ids, [owner_key])
    gone_dims = dims.join(gone, dims[dim_owner] == gone[owner_key], "left_semi").select(dim_key)
    return (
        owners.join(gone, owner_key, "left_anti"),
        dims.join(gone, dims[dim_owner] == gone[owner_key], "left_anti"),
        facts.join(gone_dims, facts[fact_key] == gone_dims[dim_key], "left_anti"),
    )
