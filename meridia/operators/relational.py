"""Aggregates, joins, windows and rankings that take column names, so they run on any table."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import stats, text


_WRITTEN: list = []


@atexit.register
def _clear_written() -> None:
    """Delete what ``pinned`` wrote when the driver ends; results are the caller's to write before that."""
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_folder(df: DataFrame) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session that names none."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: for frames that several branches of a plan read, so that none
    computes them again. Runs a job at once; the table goes when the driver ends."""
    path = f"{scratch_folder(df)}/meridia-pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


PART_ROWS = 10_000  # rows a task gets where each of them is dear to compute


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """The same rows dealt over tasks of PART_ROWS or so by a hash of their key; ``rows``: their number, counted if unknown.

    A small file of narrow rows is one task, however much is then made of each row; a table written from parts of so many
    rows is read in parts of no more than 32 of them (Spark counts 4 MB for each file, and reads 128 MB at once).
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(1, -(-n // PART_ROWS)), key)


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): each key's most frequent non-blank value; ties go to the smallest."""
    counted = df.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    first = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return counted.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def bridge(df: DataFrame, key: str, modal: Sequence[str], distinct: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row per key: modes of some columns, distinct counts, means, and whether the key is ambiguous."""
    out = df.groupBy(key).agg(
        F.count("*").alias("n_rows"), *(F.count_distinct(c).alias(f"n_{c}") for c in distinct), *(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in means)
    )
    for c in modal:
        out = out.join(dominant(df, key, c).select(key, F.col(c).alias(f"modal_{c}")), key, "left")
    return out.withColumn("ambiguous", F.greatest(*(F.col(f"n_{c}") for c in distinct), F.lit(0)) > 1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_group_size(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.count("*").over(Window.partitionBy(*keys)))


def distinct_sample(df: DataFrame, key: str, column: str, order: str, limit: int, max_chars: int, sep: str = "; ") -> DataFrame:
    """(key, sample): each key's first ``limit`` distinct non-blank values by their first place, joined and cut.

    Every value is brought down to its first place before anything is collected, and at most ``limit`` are.
    """
    firsts = df.where(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != "").groupBy(key, column).agg(F.min(order).alias("__o"))
    kept = firsts.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__o", column))).where(F.col("__n") <= limit)
    values = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(column).alias("v")))), lambda x: x["v"])
    return kept.groupBy(key).agg(F.substring(F.array_join(values, sep), 1, max_chars).alias("sample"))


def cohort_stats(df: DataFrame, value: str, keys: Sequence[str], least: int) -> DataFrame:
    """n, median, p10, p90 per group of non-null keys that has ``least`` values."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    out = stats.quantiles(df, keys, value, (0.5, 0.1, 0.9)).where(F.col("n") >= least)
    return out.select(*keys, "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def top(df: DataFrame, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows; the rank is numbered on those n rows alone."""
    out = df.orderBy(*order).limit(n)
    return rank_within(out, [], order, rank) if rank else out


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def explode_counts(df: DataFrame, items: Column, name: str) -> DataFrame:
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def rates(df: DataFrame, counts: Sequence[str], denominator: str) -> DataFrame:
    return df.withColumns({f"{c}_rate": F.round(stats.share(F.col(c), F.col(denominator)), 6) for c in counts})


def semi_scope(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys, folded, stand in the scope."""
    folded = scope.select(*(text.key_spaced(F.col(k)).alias(f"__{k}") for k in keys)).distinct()
    own = df.withColumns({f"__{k}": text.key_spaced(F.col(k)) for k in keys})
    return own.join(folded, [f"__{k}" for k in keys], "left_semi").select(*df.columns)


def zero_supply(need: DataFrame, supply: DataFrame, key: str) -> DataFrame:
    """Rows of ``need`` that no row of ``supply`` serves."""
    return need.join(supply.select(key).distinct(), key, "left_anti")


def override(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join in which the right side's non-null values win."""
    renamed = right.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = left.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*left.columns)


def threshold_share(df: DataFrame, group: str, option: str, score: str, watched: str, boost: float) -> DataFrame:
    """Share of groups in which the watched option, its score raised by ``boost``, is not the best."""
    per = df.groupBy(group).agg(
        F.max(F.when(F.col(option) != watched, F.col(score))).alias("others"), F.max(F.when(F.col(option) == watched, F.col(score))).alias("own")
    )
    return per.agg(F.round(F.avg((F.col("others") > F.col("own") + F.lit(boost)).cast("double")), 6).alias("agreement"), F.count("*").alias("n_groups"))
