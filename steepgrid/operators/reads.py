"""Filters, joins, listings and orderings over owner, dimension and fact tables.

Owner = user, dimension = bean, fact = recipe. No join carries a broadcast hint: Spark broadcasts a
side whose size it has checked, and splits hot keys of a shuffled join through adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.functions.columns import DEFAULT_ORIGIN, collated, zero_nulls

SECRET_COLUMNS = ("password",)


def by_key(df: DataFrame, col: str, value, collation: str | None = None) -> DataFrame:
    """Rows whose column equals a value: bean name, bean id, weather."""
    return df.where(collated(col, collation) == F.lit(value))


def in_range(df: DataFrame, col: str, low, high) -> DataFrame:
    """Both ends included; NULL drops out."""
    return df.where(F.col(col).between(F.lit(low), F.lit(high)))


def trailing_year(df: DataFrame, as_of: str, date_col: str = "date") -> DataFrame:
    return df.where(F.col(date_col) >= F.add_months(F.to_date(F.lit(as_of)), -12))


def similar_conditions(
    df: DataFrame,
    category,
    low: float,
    high: float,
    category_col: str = "weather",
    range_col: str = "temperature",
    date_col: str = "date",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Facts of one category with a measure in range, newest first."""
    return by_date(in_range(by_key(df, category_col, category), range_col, low, high), date_col, ties=ties)


def owned_by(
    facts: DataFrame,
    dims: DataFrame,
    owners: DataFrame,
    fact_key: str,
    dim_key: str,
    dim_owner: str,
    owner_key: str,
) -> DataFrame:
    """Facts whose dimension row belongs to one of ``owners``."""
    mine = dims.join(owners, dims[dim_owner] == owners[owner_key], "left_semi")
    return facts.join(mine, facts[fact_key] == mine[dim_key], "left_semi")


def lookup(df: DataFrame, col: str, value, order: Sequence[str], collation: str | None = None) -> DataFrame:
    """One row by id, e-mail or name; the stated order decides among several."""
    return by_key(df, col, value, collation).orderBy(*order).limit(1)


def lookup_first(df: DataFrame, name_col: str, id_col: str, collation: str | None = None) -> DataFrame:
    """Smallest id for every name."""
    return df.groupBy(collated(name_col, collation).alias(name_col)).agg(F.min(id_col).alias(id_col))


def exists_flag(df: DataFrame, ref: DataFrame, keys: Sequence[tuple[str, str]], flag: str = "found") -> DataFrame:
    """Add whether ``ref`` holds the row's key; pairs are (column here, column there)."""
    known = ref.select(*[F.col(there).alias(f"_k{i}") for i, (_, there) in enumerate(keys)]).distinct()
    known = known.withColumn("_hit", F.lit(True))
    on = [F.col(here) == F.col(f"_k{i}") for i, (here, _) in enumerate(keys)]
    return (
        df.join(known, on, "left")
        .withColumn(flag, F.col("_hit").isNotNull())
        .drop("_hit", *[f"_k{i}" for i in range(len(keys))])
    )


def public_view(users: DataFrame, secrets: Sequence[str] = SECRET_COLUMNS) -> DataFrame:
    return users.drop(*secrets)


def optional_filter(df: DataFrame, col: str, value=None) -> DataFrame:
    """Equality filter; an empty value keeps everything."""
    return df if value is None or value == "" else by_key(df, col, value)


def owned_or_all(dims: DataFrame, users: DataFrame, owner_name: str | None, dim_owner: str, user_id: str, user_name: str) -> DataFrame:
    """One user's dimension rows; all of them when the user is anonymous or unknown."""
    if owner_name is None:
        return dims
    owner = by_key(users, user_name, owner_name).agg(F.min(user_id).alias("owner"))
    return dims.where(F.coalesce(F.col(dim_owner) == owner.scalar(), F.lit(True)))


def listing(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.select(*cols)


def join_weather(brews: DataFrame, weather: DataFrame, on: str = "date") -> DataFrame:
    """Brews with that day's weather; every brew is kept."""
    return brews.join(weather, on, "left")


def dims_with_owner(
    dims: DataFrame,
    owners: DataFrame,
    dim_owner: str,
    owner_key: str,
    order: Sequence[Column | str] = (),
    owner_filter: Column | None = None,
) -> DataFrame:
    """Each dimension row with its owner's columns, in name order."""
    people = owners if owner_filter is None else owners.where(owner_filter)
    joined = dims.join(people, dims[dim_owner] == people[owner_key], "inner")
    return joined.orderBy(*order) if order else joined


def facts_by_dim_name(
    facts: DataFrame,
    dims: DataFrame,
    fact_key: str,
    dim_key: str,
    name_col: str,
    name: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Facts with their dimension's name, for one name or all; same-named dimensions are pooled."""
    named = dims.select(F.col(dim_key).alias("_dim"), F.col(name_col))
    if name is not None:
        named = by_key(named, name_col, name, collation)
    return facts.join(named, facts[fact_key] == named["_dim"], "inner").drop("_dim")


def facts_by_owner(
    facts: DataFrame,
    dims: DataFrame,
    owners: DataFrame,
    fact_key: str,
    dim_key: str,
    dim_owner: str,
    owner_key: str,
    date_col: str = "date",
    dates: tuple | None = None,
    category: tuple[str, object] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Owners' facts, newest first, optionally inside a date range or of one category."""
    rows = facts
    if dates is not None:
        rows = in_range(rows, date_col, *dates)
    if category is not None:
        rows = by_key(rows, *category)
    return by_date(owned_by(rows, dims, owners, fact_key, dim_key, dim_owner, owner_key), date_col, ties=ties)


def with_origin(
    df: DataFrame,
    dims: DataFrame,
    df_key: str,
    dim_key: str,
    origin_col: str,
    default: str = DEFAULT_ORIGIN,
    alias: str = "origin",
    collation: str | None = None,
) -> DataFrame:
    """Add the origin a name stands for, with a default; several rows per name give the smallest."""
    known = dims.groupBy(collated(dim_key, collation).alias("_name")).agg(F.min(origin_col).alias("_origin"))
    return (
        df.join(known, collated(df_key, collation) == F.col("_name"), "left")
        .withColumn(alias, F.coalesce("_origin", F.lit(default)))
        .drop("_name", "_origin")
    )


def owner_check(
    rows: DataFrame, dims: DataFrame, row_key: str, row_owner: str, dim_key: str, dim_owner: str
) -> tuple[DataFrame, DataFrame]:
    """(rows whose dimension belongs to the acting owner, the rest)."""
    on = (rows[row_key] == dims[dim_key]) & (rows[row_owner] == dims[dim_owner])
    return rows.join(dims, on, "left_semi"), rows.join(dims, on, "left_anti")


def dim_history(
    facts: DataFrame,
    dims: DataFrame,
    fact_key: str,
    dim_key: str,
    name_col: str,
    cols: Sequence[str],
    as_of: str,
    name: str | None = None,
    date_col: str = "date",
    numeric: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Facts of the trailing year by dimension name, oldest first, NULL numerics read as 0."""
    recent = trailing_year(facts, as_of, date_col)
    rows = facts_by_dim_name(recent, dims, fact_key, dim_key, name_col, name)
    return by_date(zero_nulls(rows, list(numeric)), date_col, descending=False, ties=ties).select(*cols)


def by_name(df: DataFrame, name_col: str = "name", ties: Sequence[str] = (), collation: str | None = None) -> DataFrame:
    return df.orderBy(collated(name_col, collation).asc_nulls_first(), *ties)


def by_date(df: DataFrame, date_col: str = "date", descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    key = F.col(date_col)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *ties)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int = 5) -> DataFrame:
    """First k rows in an order; Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def latest_facts(
    facts: DataFrame,
    dims: DataFrame,
    fact_key: str,
    dim_key: str,
    name_col: str,
    order: Sequence[Column | str],
    k: int = 5,
) -> DataFrame:
    """Latest k facts with their dimension's name.

    The k rows are chosen after the join, as a fact without a dimension does not count.
    """
    return top_k(facts_by_dim_name(facts, dims, fact_key, dim_key, name_col), order, k)


SORT_MODES = ("date", "bean", "weather", "temperature")


def sort_list(
    df: DataFrame,
    mode: str,
    date_col: str = "date",
    name_col: str = "bean_name",
    weather_col: str = "weather",
    temperature_col: str = "temperature",
    collation: str | None = "UNICODE",
    ties: Sequence[str] = (),
) -> DataFrame:
    """List order by mode; an unknown mode leaves the rows as they are."""
    keys = {
        "date": F.col(date_col).desc_nulls_last(),
        "bean": collated(name_col, collation).asc_nulls_first(),
        "weather": collated(weather_col, collation).asc_nulls_first(),
        "temperature": F.coalesce(F.col(temperature_col), F.lit(0)).desc(),
    }
    return df.orderBy(keys[mode], *ties) if mode in keys else df
