"""Statistics as columns: intervals, percentile ranks, distances, scaling. All of it stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def half_up(c: Column, places: int) -> Column:
    """Rounded half up as a decimal, so that the last bits of a sum do not decide ties."""
    return F.round(c.cast("decimal(24,8)"), places).cast("double")


def round_scaled(c: Column, places: int) -> Column:
    """Rounded as SQL engines round doubles: the product with 10**places to the nearest whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal that names the double instead; the two differ where a value lies next to a half.
    """
    scaled = F.abs(c) * 10.0**places
    low = F.floor(scaled).cast("double")
    return F.signum(c) * (low + (scaled - low >= 0.5).cast("double")) / 10.0**places


def share(x: Column, n: Column) -> Column:
    """x / n, null where n is 0 or null."""
    return F.try_divide(x.cast("double"), F.nullif(n, F.lit(0)).cast("double"))


def wilson(x: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson score interval; nulls where n is 0."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = x.cast("double") / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(clip01(centre - half).alias("low"), clip01(centre + half).alias("high"))


def jeffreys_mean(x: Column, n: Column) -> Column:
    """Mean of Beta(x + 1/2, n - x + 1/2)."""
    return (x + 0.5) / (n + 1.0)


PARTS = 64  # ordered parts that a column's distinct values are cut into


def cut_points(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One row per group of ``by``: ``cuts``, values that split the group's rows into PARTS parts of nearly equal size."""
    share = [(k + 1) / PARTS for k in range(PARTS - 1)]
    return values.groupBy(*by).agg(F.percentile_approx(value, share, 20 * PARTS).alias("cuts"))


def part_of(value: Column, cuts: Column) -> Column:
    """How many cuts lie below a value: never falls as the value grows, whatever the cuts are."""
    return F.size(F.filter(cuts, lambda c: c < value))


def pct_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Percentile ranks (column -> name of its rank) with average ties: (values below + (ties + 1) / 2) / all non-null.

    All columns' values are counted in one aggregation. Each column's distinct values are cut into parts at sampled
    quantiles; counts by part say how many values lie below each, so ordered passes run over the distinct values of
    one part, never over a whole column, however its values are spread. Nulls stay null.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    counted = df.select(pairs.alias("p")).where("p.value is not null").select("p.column", "p.value").groupBy("column", "value").agg(F.count("*").alias("ties"))
    cuts = cut_points(counted, ["column"]).select(F.col("column").alias("of"), "cuts")  # one row a column
    counted = counted.join(F.broadcast(cuts), F.col("column") == F.col("of")).withColumn("part", part_of(F.col("value"), F.col("cuts"))).drop("of", "cuts")
    parts = counted.groupBy("column", "part").agg(F.sum("ties").alias("n"))
    by = Window.partitionBy("column")
    parts = parts.select(
        F.col("column").alias("c"), F.col("part").alias("b"), F.sum("n").over(by).alias("all"),
        F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )  # PARTS rows a column at most
    inside = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("below", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    ranked = placed.join(F.broadcast(parts), (F.col("column") == F.col("c")) & (F.col("part") == F.col("b"))).select(
        "column", "value", ((F.col("before") + F.col("below") + (F.col("ties") + 1) / 2.0) / F.col("all")).alias("rank")
    )
    for c, out in columns.items():
        own = ranked.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("rank").alias(out))
        df = df.join(own, F.col(c).cast("double") == F.col("__value"), "left").drop("__value")
    return df


def few_pct_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The same for tables of one row per region: one window a column, which one task sees whole."""
    for c, out in columns.items():
        known, same = Window.partitionBy(F.col(c).isNull()), Window.partitionBy(c)
        below = F.rank().over(known.orderBy(c)) - 1
        df = df.withColumn(out, F.when(F.col(c).isNotNull(), (below + (F.count("*").over(same) + 1) / 2.0) / F.count(c).over(known)))
    return df


def pct_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    return pct_ranks(df, {column: out})


def quantiles(df: DataFrame, keys: Sequence[str], column: str, levels: Sequence[float], ties: str | None = None) -> DataFrame:
    """(keys, n, q array<double>): exact quantiles of the non-null values of each group, interpolated between neighbours.

    Values are counted first (``ties``: a column that says how often each stands). The distinct values of all groups are
    cut into parts at sampled quantiles; counts by part tell which parts hold the wanted places, and only those are
    ordered; no task holds a group, or even its distinct values, however they are spread. Null keys form groups of
    their own.
    """
    known = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("value"), *([F.col(ties).alias("ties")] if ties else []))
    counted = known.groupBy(*keys, "value").agg((F.sum("ties") if ties else F.count("*")).alias("ties"))
    counted = counted.crossJoin(F.broadcast(cut_points(counted, []))).withColumn("part_no", part_of(F.col("value"), F.col("cuts"))).drop("cuts")  # one row is sent
    parts = counted.groupBy(*keys, "part_no").agg(F.sum("ties").alias("part"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = by.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"n": F.sum("part").over(by), "before": F.coalesce(F.sum("part").over(upto), F.lit(0))})
    wanted = F.array(
        *(F.struct(F.lit(k).alias("level"), F.lit(float(q)).alias("q"), (F.floor(F.lit(float(q)) * (F.col("n") - 1)) + side).alias("place"), F.lit(side).alias("side"))
          for k, q in enumerate(levels) for side in (0, 1))
    )
    here = F.filter(wanted, lambda w: (F.least(w["place"], F.col("n") - 1) >= F.col("before")) & (F.least(w["place"], F.col("n") - 1) < F.col("before") + F.col("part")))
    asked = parts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("part_no").alias("__part"), "before", "n", here.alias("asked")).where("size(asked) > 0")
    inside = Window.partitionBy(*keys, "part_no").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("part_no") == F.col("__part")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = counted.join(asked, match).withColumn("last", F.sum("ties").over(inside))
    found = placed.select(*keys, "value", "ties", "before", "n", "last", F.explode("asked").alias("w")).select(*keys, "value", "ties", "before", "n", "last", "w.*")
    found = found.where("least(place, n - 1) - before < last and least(place, n - 1) - before >= last - ties")
    one = found.groupBy(*keys, "level").agg(
        F.max("n").alias("n"), F.max("q").alias("q"), F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high")
    )
    share = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    value = F.col("low") + (F.col("high") - F.col("low")) * share
    return one.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("level", value.alias("value")))), lambda x: x["value"]).alias("q")).where("n is not null")


def normality(n: Column, skew: Column, kurtosis: Column) -> Column:
    """struct(k2, p): D'Agostino and Pearson's test of normality from a sample's size, population skewness and excess kurtosis.

    Both are transformed to nearly standard normal scores; k2, the sum of their squares, has a chi-square tail of two
    degrees, exp(-k2 / 2). Null below 20 values, or where the moments are not numbers.
    """
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(y / alpha) / F.sqrt(F.log(w2) / 2)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis + 3 - mean) / F.sqrt(var)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    down = 1 + x * F.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - F.signum(down) * F.pow((1 - 2 / a) / F.abs(down), F.lit(1 / 3.0))) / F.sqrt(2 / (9 * a))
    k2 = F.when(n >= 20, z1 * z1 + z2 * z2)
    return F.struct(k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def min_max(df: DataFrame, column: str, out: str, default: float = 0.0) -> DataFrame:
    """Add (x - min) / (max - min) over the whole frame; ``default`` where all values are equal. One row is sent along."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(column) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.lit(default))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__low", "__high")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))  # least would skip a null


def grid_cell(lat: Column, lon: Column, size: float) -> Column:
    """A square cell's name; stands in for hexagonal cells, which need a package that is not here."""
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def clip01(c: Column) -> Column:
    """Into [0, 1]; null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relative_width(low: Column, high: Column, point: Column) -> Column:
    """w / (1 + w) of the interval's width relative to its point; 0 where that is unknown."""
    w = F.try_divide(high - low, F.nullif(F.abs(point), F.lit(0.0)))
    return F.coalesce(w / (1 + w), F.lit(0.0))


def band(c: Column, steps: list[tuple[float, str]], least: str, unknown: str | None = None) -> Column:
    """The name of the first step (from the top) that the value reaches."""
    out = F.when(c.isNull(), F.lit(unknown))
    for bar, name in steps:
        out = out.when(c >= bar, F.lit(name))
    return out.otherwise(F.lit(least))


def equal_width_bin(p: Column, bins: int) -> Column:
    """0 .. bins - 1 for p in [0, 1], the last bin closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")
