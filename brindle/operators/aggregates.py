"""Aggregations: merged copies, arity, tallies, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T


def merge_copies(rows: DataFrame, key: list[str], order: str, first: list[str], first_known: list[str]) -> DataFrame:
    """One row a key: the first-seen ``first`` columns, the first ``first_known`` that are not null, and the order of first sight."""
    aggs = [F.min_by(c, order).alias(c) for c in first]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_known]
    return rows.groupBy(*key).agg(*aggs, F.min(order).alias("first_seen"))


def arity(signatures: str) -> tuple[Column, Column]:
    """Least and most arguments over a ``parameters`` array: a range parameter stands for as many as it says."""
    p = F.col(signatures)
    least = F.size(F.filter(p, lambda x: x["required"]))
    most = F.aggregate(p, F.lit(0), lambda n, x: n + F.coalesce(T.range_upper(x["name"]), F.lit(1)))
    return least, most


# Methods that take any number of arguments, though their signature shows one.
VARIADIC = "макс мин max min продолжитьвызов continuecall".split()


def accepts(signatures: Column, count: Column, name: Column | None = None) -> Column:
    """Whether some overload takes ``count`` arguments; with the method's ``name``, those that take any number have no upper bound."""
    free = F.lower(name).isin(VARIADIC) if name is not None else F.lit(False)

    def fits(s: Column) -> Column:
        least = F.size(F.filter(s["parameters"], lambda x: x["required"]))
        most = F.aggregate(s["parameters"], F.lit(0), lambda n, x: n + F.coalesce(T.range_upper(x["name"]), F.lit(1)))
        return (count >= least) & (free | (count <= most))

    return F.exists(signatures, fits)


def expected(signatures: Column, name: Column) -> Column:
    """What numbers of arguments the overloads take, as text: ``2``, ``1..3`` or ``1+``, with slashes between."""
    free = F.lower(name).isin(VARIADIC)

    def one(s: Column) -> Column:
        least = F.size(F.filter(s["parameters"], lambda x: x["required"]))
        most = F.aggregate(s["parameters"], F.lit(0), lambda n, x: n + F.coalesce(T.range_upper(x["name"]), F.lit(1)))
        return F.when(free, F.concat(least.cast("string"), F.lit("+"))).when(least == most, least.cast("string")).otherwise(F.concat_ws("..", least.cast("string"), most.cast("string")))

    return F.array_join(F.transform(signatures, one), " / ")


def type_counts(types: DataFrame) -> DataFrame:
    """One row: how many types of a catalog are enumerations, and how many others there are."""
    return types.agg(F.count_if("is_enum").alias("enumerations"), F.count_if(~F.col("is_enum")).alias("others"))


def tally(rows: DataFrame, group: Column, name: str, distinct: str, limit: int, sample: str | None = None) -> DataFrame:
    """Count, distinct count and least sample for each group, largest first."""
    aggs = [F.count("*").alias("n"), F.countDistinct(distinct).alias("n_distinct")] + ([F.min(sample).alias("sample")] if sample else [])
    return rows.groupBy(group.alias(name)).agg(*aggs).orderBy(F.desc("n"), F.col(name).asc_nulls_last()).limit(limit)


def compare_runs(rows: DataFrame, group: list[str], before: Column, after: Column) -> DataFrame:
    """Counts of two ranges side by side, and their difference."""
    a, b = F.count_if(before), F.count_if(after)
    return rows.groupBy(*group).agg(a.alias("before"), b.alias("after"), (b - a).alias("change"))


def run_totals(rows: DataFrame, run: list[str], module: str, failed: Column, errors: Column) -> DataFrame:
    return rows.groupBy(*run).agg(
        F.count("*").alias("scanned"), F.count_if(errors > 0).alias("with_errors"), F.sum(errors).cast("long").alias("errors_total"), F.count_if(failed).alias("failed"),
        F.countDistinct(module).alias("modules"),
    )
