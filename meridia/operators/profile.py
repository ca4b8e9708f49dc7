"""Profiles and audits: distributions, coverage, dictionaries, category shares, expectations. One pass each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, mean, sd, quartiles, p95, extremes, population skewness and excess kurtosis of each column, in one long pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    moments = long.groupBy("column").agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev("x"), 6).alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.round(F.skewness("x"), 4).alias("skew"), F.round(F.kurtosis("x"), 4).alias("kurtosis"),
    )
    q = stats.quantiles(long, ["column"], "x", (0.25, 0.5, 0.75, 0.95)).select("column", *(F.col("q")[k].alias(n) for k, n in enumerate(("p25", "median", "p75", "p95"))))
    return moments.join(q, "column", "left").select("column", "n", "mean", "sd", "least", "p25", "median", "p75", "p95", "most", "skew", "kurtosis")


def normality_report(df: DataFrame, columns: Sequence[str], least: int = 20, distinct: int = 8) -> DataFrame:
    """(column, scale, n, skew, kurtosis, k2, p) of each column as it is, and of log1p of its positive values; one pass.

    Untested (k2 and p null) below ``least`` values or ``distinct`` different ones. Distinct values are estimated, which
    is exact where they are few; the test is taken from moments of four decimals.
    """
    shapes = F.array(*(
        F.struct(F.lit(c).alias("column"), F.lit(scale).alias("scale"), x.alias("x"))
        for c in columns for scale, x in (("raw", F.col(c).cast("double")), ("log1p", F.when(F.col(c) > 0, F.log1p(F.col(c).cast("double")))))
    ))
    long = df.select(F.explode(shapes).alias("s")).select("s.*")
    m = long.groupBy("column", "scale").agg(
        F.count("x").alias("n"), F.approx_count_distinct("x", 0.01).alias("__d"), F.round(F.skewness("x"), 4).alias("skew"), F.round(F.kurtosis("x"), 4).alias("kurtosis")
    )
    test = stats.normality(F.col("n"), F.col("skew"), F.col("kurtosis"))
    tried = (F.col("n") >= least) & (F.col("__d") >= distinct)
    return m.select("column", "scale", "n", "skew", "kurtosis", *(F.when(tried, F.round(test[k], 4)).alias(k) for k in ("k2", "p")))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-blank rows and share of each column, with a Wilson interval."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(filled(c)).alias(f"x_{c}") for c in columns))
    long = counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"x_{c}").alias("filled")) for c in columns))).alias("s"))
    ci = stats.wilson(F.col("filled"), F.col("n"))
    return long.select("s.column", "s.filled", "n").select(
        "column", "filled", "n", F.round(stats.share(F.col("filled"), F.col("n")), 6).alias("share"), F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high")
    )


def dictionary(df: DataFrame) -> DataFrame:
    """Column, type and non-null rows."""
    counts = df.agg(*(F.count(c).alias(c) for c, _ in df.dtypes))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("filled")) for c, t in df.dtypes))).alias("x")).select("x.*")


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """Each category's count and share of all rows, Wilson and Jeffreys; blanks are a category of their own."""
    name = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", "missing").otherwise(F.col(column).cast("string"))
    counts = df.groupBy(name.alias("category")).agg(F.count("*").alias("x"))
    whole = counts.agg(F.sum("x").alias("n"))
    ci = stats.wilson(F.col("x"), F.col("n"))
    return counts.crossJoin(F.broadcast(whole)).select(
        F.lit(column).alias("column"), "category", "x", "n", F.round(F.col("x") / F.col("n"), 6).alias("share"), F.round(ci["low"], 6).alias("low"),
        F.round(ci["high"], 6).alias("high"), F.round(stats.jeffreys_mean(F.col("x"), F.col("n")), 6).alias("jeffreys"),
    )


def flag_shares(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many rows each of several overlapping flags holds for, from one pass."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    long = counts.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("x")) for k in flags))).alias("s"))
    return long.select("s.flag", "s.x", "n", F.round(stats.share(F.col("s.x"), F.col("n")), 6).alias("share"))


def expectations(df: DataFrame, table: str, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(table, check, severity, failed, passed): rows that break each stated condition; unknown counts as broken."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(f"c{i}").alias("failed")) for i, (name, (_, severity)) in enumerate(checks.items())))
    return counts.select(F.explode(rows).alias("x")).select(F.lit(table).alias("table"), "x.*").withColumn("passed", F.col("failed") == 0)


# ------------------------------------------------------------------- audits over several tables


@dataclass(frozen=True)
class Check:
    """One check of an audit: what it is called, how grave a failure is, the table and what is asked of it."""

    name: str
    severity: str
    kind: str  # one of KINDS
    table: str
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    other: str = ""  # the table that a key must stand in
    other_columns: tuple[str, ...] = ()


KINDS = ("rows", "columns", "unique", "not_null", "bounds", "at_most", "domain", "presence", "foreign")


def _in_bounds(check: Check, c: Column) -> Column:
    x = c.try_cast("double")
    low = x >= check.low if check.low is not None else F.lit(True)
    return low & (x <= check.high if check.high is not None else F.lit(True))


def _row_failures(check: Check) -> Column:
    """Rows that break a check of single rows. Null breaks no bound, comparison or domain: only not_null asks for values."""
    c = [F.col(x) for x in check.columns]
    if check.kind == "not_null":
        return F.count_if(reduce(lambda a, b: a | b, (x.isNull() for x in c)))
    if check.kind == "bounds":
        return F.count_if(~F.coalesce(_in_bounds(check, c[0]), F.lit(True)))
    if check.kind == "at_most":
        return F.count_if(F.coalesce(c[0] > c[1], F.lit(False)))
    return F.count_if(~F.coalesce(c[0].isin(*check.values), F.lit(True)))


def audit(tables: dict[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(check, severity, kind, failed, passed), one row per check; ``failed`` counts what breaks it.

    rows: how far a table's size is outside low .. high. columns: how many named columns it lacks. unique: rows beyond
    the first of a key. presence: how many of the values no row has. foreign: rows whose key, null keys aside, stands
    nowhere in the other table (an anti-join of distinct keys). Checks of single rows share one pass over their table;
    a check that needs a column its table lacks fails by one and is not run.
    """
    unknown = {c.kind for c in checks} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of checks: {sorted(unknown)}")
    parts, single = [], {}
    stated = lambda df, check, failed: df.select(F.lit(check.name).alias("check"), F.lit(check.severity).alias("severity"), F.lit(check.kind).alias("kind"), failed.cast("long").alias("failed"))
    for check in checks:
        df = tables[check.table]
        lacking = [c for c in check.columns if c not in df.columns]
        if check.kind == "columns" or lacking:
            parts.append(stated(df.sparkSession.range(1), check, F.lit(len(lacking) if check.kind == "columns" else 1)))
        elif check.kind == "rows":
            n = F.col("n")
            outside = F.greatest(F.lit(check.low or 0) - n, n - F.lit(check.high if check.high is not None else float("inf")), F.lit(0.0))
            parts.append(stated(df.agg(F.count("*").alias("n")), check, outside))
        elif check.kind == "unique":
            parts.append(stated(df.groupBy(*check.columns).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n")), check, F.col("n")))
        elif check.kind == "presence":
            parts.append(stated(df.where(F.col(check.columns[0]).isin(*check.values)).agg(F.count_distinct(check.columns[0]).alias("n")), check, len(set(check.values)) - F.col("n")))
        elif check.kind == "foreign":
            keys = [f"__k{i}" for i in range(len(check.columns))]
            own = df.select(*(F.col(c).alias(k) for c, k in zip(check.columns, keys, strict=True))).dropna().groupBy(*keys).agg(F.count("*").alias("n"))
            known = tables[check.other].select(*(F.col(c).alias(k) for c, k in zip(check.other_columns or check.columns, keys, strict=True))).distinct()
            parts.append(stated(own.join(known, keys, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), check, F.col("n")))
        else:
            single.setdefault(check.table, []).append(check)
    for name, own in single.items():
        counts = tables[name].agg(*(_row_failures(c).alias(f"c{i}") for i, c in enumerate(own)))
        rows = F.array(*(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.lit(c.kind).alias("kind"), F.col(f"c{i}").cast("long").alias("failed")) for i, c in enumerate(own)))
        parts.append(counts.select(F.explode(rows).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failed") == 0)
