"""Tabular operators: selection, profiling, grouping, pivots, ranks, samples, de-duplication.

Null keys are dropped from groupings and value counts, as data-frame libraries
do; an all-null column has count 0 and null statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from corpusloom.session import cut

STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ty.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ty.StringType)]


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower()]


def not_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is none of these; nulls stay."""
    return df.filter(~F.col(column).isin(list(values)) | F.col(column).isNull())


def _unpivot(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of struct columns as one row a struct."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{n}").alias(n) for n in names]) for c in columns])).alias("s")).select("s.*")


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """column and one array ``q`` of the exact percentiles of numeric columns, linear between neighbours; null values don't count.

    Distinct values are counted map-side, cut into ranges and numbered by the
    totals of the ranges before them, so that no task holds a column.
    """
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*").filter("value is not null")
    counted = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = cut(counted.repartitionByRange("column", "value").withColumn("slice", F.spark_partition_id()))  # both uses must see the same ranges
    totals = ordered.groupBy("column", "slice").agg(F.sum("n").alias("t"))
    w = Window.partitionBy("column")
    before = totals.select("column", "slice", F.coalesce(F.sum("t").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("t").over(w).alias("all"))
    run = F.coalesce(F.sum("n").over(Window.partitionBy("column", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("run", run).join(before, ["column", "slice"]).withColumn("low", F.col("before") + F.col("run"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("all") - 1)).alias("h")) for i, q in enumerate(shares)])).alias("w")
    holds = lambda x: (F.col("low") <= x) & (x < F.col("low") + F.col("n"))
    low, high = F.floor("w.h"), F.ceil("w.h")
    found = placed.select("column", "value", "low", "n", at).filter(holds(low) | holds(high))
    ends = found.groupBy("column", "w.i", "w.h").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
    value = F.struct("i", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("v"))
    return ends.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"]).alias("q"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, mean, std, min, quartiles, max of numeric columns, with exact percentiles."""
    cols = list(columns or numeric_columns(df))

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.count(x).alias("count"), F.mean(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c)

    stats = _unpivot(df.agg(*map(one, cols)), cols, ("count", "mean", "std", "min", "max"))
    q = percentiles(df, cols, (0.25, 0.5, 0.75))
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), "max")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, unique, top, freq of text columns; ties of the top to the smaller value."""
    cols = list(columns or text_columns(df))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("s")).select("s.*").filter("value is not null")
    n = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    got = n.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("t"))
    return got.select("column", "count", "unique", F.col("t.value").alias("top"), (-F.col("t.m")).alias("freq"))


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, sum, mean, median, min, max, std, range, cv: coefficient of variation in per cent."""
    cols = list(columns or numeric_columns(df))
    names = ("count", "sum", "mean", "min", "max", "std", "range", "cv")

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        cv = F.when(F.mean(x) != 0, F.stddev_samp(x) / F.mean(x) * 100)
        return F.struct(
            F.count(x).alias("count"), F.sum(x).alias("sum"), F.mean(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("std"), (F.max(x) - F.min(x)).alias("range"), cv.alias("cv")
        ).alias(c)

    stats = _unpivot(df.agg(*map(one, cols)), cols, names)
    return stats.join(percentiles(df, cols, (0.5,)).select("column", F.get("q", F.lit(0)).alias("median")), "column", "left").select("column", "count", "sum", "mean", "median", *names[3:])


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, count, mean, sum, min, max; rows with a null key are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(value).alias("count"), F.mean(value).alias("mean"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.na.drop(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Counts of a by the given values of b, with the margin All on both sides."""
    cube = df.na.drop(subset=[a, b]).cube(a, b).agg(F.count(F.lit(1)).alias("n"))
    named = cube.select(F.coalesce(F.col(a).cast("string"), F.lit("All")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("All")).alias(b), "n")
    return named.groupBy(a).pivot(b, [*map(str, values), "All"]).agg(F.first("n")).na.fill(0)


def pivot(df: DataFrame, index: str, column: str, value: str, values: Sequence) -> DataFrame:
    """Mean of value by index and the given values of a column."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.mean(value))


def nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, nulls, percent."""
    cols = list(columns or df.columns)
    n = F.count(F.lit(1))
    row = df.agg(*[F.struct(F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.round(F.sum(F.col(c).isNull().cast("long")) / n * 100, 4).alias("percent")).alias(c) for c in cols])
    return _unpivot(row, cols, ("nulls", "percent"))


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, ties to the smallest."""
    n = value_counts(df, column)
    return n.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("t")).select(F.col("t.v").alias(column), (-F.col("t.m")).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr: Pearson, over rows where both are present, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 9).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, ascending: bool = False) -> Column:
    """The rank of a value within a group, ties at the average of their places."""
    w = Window.partitionBy(*keys)
    order = F.asc(value) if ascending else F.desc(value)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def ranked_counts(df: DataFrame, value: str) -> DataFrame:
    """value, rank, percent for a whole column: ranks come from the counts of distinct values, by a two-level prefix sum.

    No window spans the rows: distinct values are cut into ranges and only the
    range totals are summed in one place.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ordered = cut(n.repartitionByRange(value).withColumn("slice", F.spark_partition_id()))  # both uses must see the same ranges
    totals = ordered.groupBy("slice").agg(F.sum("n").alias("t"))
    before = totals.select("slice", "t", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(1)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all"))
    run = F.coalesce(F.sum("n").over(Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = ordered.withColumn("run", run).join(F.broadcast(before), "slice")
    low = F.col("before") + F.col("run")
    return place.select(value, "n", (F.col("all") - low - (F.col("n") - 1) / 2).alias("rank"), F.round((low + (F.col("n") + 1) / 2) / F.col("all") * 100, 6).alias("percent"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same for the same key and seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Rows with part train or test, by a hash of the key."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.withColumn("part", F.when(h < share, "train").otherwise("test"))


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(df: DataFrame, keys: Sequence[str], by: str, keep: int = 1) -> DataFrame:
    """The newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def numbered_parts(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with part: rows in order of a unique key, ``size`` to a part, by prefix sums of range partitions."""
    ordered = cut(df.repartitionByRange(key).withColumn("slice", F.spark_partition_id()))  # both uses must see the same ranges
    totals = ordered.groupBy("slice").agg(F.count(F.lit(1)).alias("t"))
    before = totals.select("slice", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(1)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("slice").orderBy(key)) - 1
    return ordered.withColumn("nth", nth).join(F.broadcast(before), "slice").withColumn("part", F.floor((F.col("before") + F.col("nth")) / size)).drop("slice", "nth", "before")


def codes(df: DataFrame, column: str) -> DataFrame:
    """Rows with code: the place of the value among the sorted distinct values (few), -1 for null."""
    w = Window.partitionBy(F.lit(1)).orderBy(column)
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(w) - 1)
    return df.join(values, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def ingest(store: DataFrame, rows: DataFrame, name: str, text: str, least: int = 20) -> DataFrame:
    """The store with texts added under their names, line ends normalised; texts of fewer than ``least`` characters and null ones are left out, equal names replaced.

    Of rows of one name the longest text counts.
    """
    from corpusloom.functions import text as T

    clean = rows.withColumn(text, T.line_ends(F.col(text))).filter(F.length(F.trim(text)) >= least).filter(F.col(name).isNotNull())
    best = clean.groupBy(name).agg(F.max_by(text, F.struct(F.length(text), text)).alias(text))
    return store.select(name, text).join(best.select(name), name, "left_anti").unionByName(best)
