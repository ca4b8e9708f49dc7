"""Missing numbers: hierarchical cohort medians with bands, and trained regressors checked out of fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators.relational import pinned, spread

# Cohorts from narrow to wide, and how many values each needs.
LEVELS = [(("kind", "operator", "state"), 5), (("kind", "operator"), 10), (("kind",), 10), (("operator",), 10)]


def hierarchical(df: DataFrame, value: str, usable: Column, levels: Sequence[tuple[Sequence[str], int]] = LEVELS) -> DataFrame:
    """Add estimate, low, high, level, n and confidence: the value itself, else the narrowest cohort's median and p10-p90.

    Values are counted once by the finest cohort; the counts are spread to cohorts of all levels, whose quantiles are
    taken together. Each finest cohort then picks its level, and only that table is joined to the rows.
    """
    used = list(dict.fromkeys(k for keys, _ in levels for k in keys))
    names = [f"__{k}" for k in used]
    known = df.where(usable & F.col(value).isNotNull()).groupBy(*(F.col(k).alias(n) for k, n in zip(used, names, strict=True)), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__ties"))
    every = [*levels, ((), 1)]
    cohorts = F.explode(F.array(*(
        F.struct(F.lit(k).alias("__level"), *(F.col(n).alias(n) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(n) for c, n in zip(used, names, strict=True)),
                 reduce(lambda a, c: a & F.col(f"__{c}").isNotNull(), keys, F.lit(True)).alias("full"))
        for k, (keys, _) in enumerate(every)
    ))).alias("c")
    spread = known.select("__v", "__ties", cohorts).where("c.full").select("__v", "__ties", "c.__level", *(f"c.{n}" for n in names))
    stated = stats.quantiles(spread, ["__level", *names], "__v", (0.5, 0.1, 0.9), "__ties")
    enough = F.element_at(F.array(*(F.lit(least) for _, least in every)), F.col("__level") + 1)
    named = F.element_at(F.array(*(F.lit("_".join(keys) or "global") for keys, _ in every)), F.col("__level") + 1)
    stated = stated.where(F.col("n") >= enough).select(
        "__level", *(F.col(n).alias(f"{n}_of") for n in names), F.struct(F.col("__level").alias("k"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"), "n", named.alias("level")).alias("best")
    )
    asked = df.select(*(F.col(k).alias(n) for k, n in zip(used, names, strict=True))).distinct()  # the finest cohorts: no more than rows, most often few
    tried = asked.select(F.struct(*names).alias("own"), cohorts).where("c.full").select("own", "c.__level", *(f"c.{n}" for n in names))
    match = tried["__level"] == stated["__level"]
    for n in names:
        match = match & tried[n].eqNullSafe(stated[f"{n}_of"])
    chosen = tried.join(stated, match).groupBy("own").agg(F.min("best").alias("__best")).select(*(F.col(f"own.{n}").alias(n) for n in names), "__best")
    match = F.lit(True)
    for k, n in zip(used, names, strict=True):
        match = match & df[k].eqNullSafe(chosen[n])
    out = df.join(chosen, match, "left").drop(*names)
    observed = usable & F.col(value).isNotNull()
    best = F.col("__best")
    confidence = peer_confidence(observed, best["n"])
    return out.withColumns(
        {
            "estimate": F.when(observed, F.col(value)).otherwise(best["median"]), "low": F.when(observed, F.col(value)).otherwise(best["p10"]),
            "high": F.when(observed, F.col(value)).otherwise(best["p90"]), "level": F.when(observed, "observed").otherwise(best["level"]),
            "n": F.when(observed, F.lit(1)).otherwise(best["n"]).cast("long"), "confidence": confidence,
        }
    ).drop("__best")


def peer_confidence(observed: Column, n: Column) -> Column:
    """How far a number can be relied on: observed, or estimated from so many peers."""
    return F.when(observed, "observed").when(n >= 50, "medium").when(n >= 10, "low_medium").otherwise("low")


def with_peers(df: DataFrame, observed: dict[str, Column], levels: Sequence[tuple[Sequence[str], int]] = LEVELS) -> DataFrame:
    """Add <name>_peers and <name>_confidence: how many observed values the narrowest sufficient cohort has.

    Cohorts of all levels come from one count by the finest keys; only that small table is joined, once.
    """
    finest = list(dict.fromkeys(k for keys, _ in levels for k in keys))
    counted = df.groupBy(*finest).agg(*(F.count_if(c).alias(f"__{name}") for name, c in observed.items()))
    whole = Window.partitionBy()
    sizes = counted
    for name in observed:
        sums = []
        for keys, least in levels:
            full = F.lit(True)
            for k in keys:
                full = full & F.col(k).isNotNull()
            n = F.sum(f"__{name}").over(Window.partitionBy(*keys))
            sums.append(F.when(full & (n >= least), n))
        sizes = sizes.withColumn(f"{name}_peers", F.coalesce(*sums, F.sum(f"__{name}").over(whole)))
    sizes = sizes.select(*(F.col(k).alias(f"__k_{k}") for k in finest), *(f"{name}_peers" for name in observed))
    match = F.lit(True)
    for k in finest:
        match = match & df[k].eqNullSafe(F.col(f"__k_{k}"))
    out = df.join(sizes, match, "left").drop(*(f"__k_{k}" for k in finest))
    return out.withColumns({f"{name}_confidence": peer_confidence(c, F.col(f"{name}_peers")) for name, c in observed.items()})


def design(categorical: Sequence[str], numeric: Sequence[str]) -> list:
    """Indexed one-hot categories (unknown ones kept) and median-filled numbers as one vector; either may be none."""
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_hot" for c in categorical]))
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=[f"{c}_full" for c in numeric], strategy="median"))
    return [*stages, VectorAssembler(inputCols=[f"{c}_hot" for c in categorical] + [f"{c}_full" for c in numeric], outputCol="features")]


def usable_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns that hold anything at all, by one aggregation."""
    r = df.agg(*(F.count(c).alias(c) for c in numeric), *(F.count_if(F.trim(c) != "").alias(c) for c in categorical)).first()
    return [c for c in numeric if r[c]], [c for c in categorical if r[c]]


def fold(key: str, folds: int) -> Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % folds).cast("int")


def out_of_fold(df: DataFrame, key: str, target: str, categorical: Sequence[str], numeric: Sequence[str], folds: int = 3, trees: int = 10, top: float = 5000.0) -> DataFrame:
    """(key, target, predicted, baseline): each row predicted by boosted trees, on log1p, fitted without its fold.

    The baseline is the training fold's median. Numbers are clipped to 1 .. top.
    """
    known = df.where(F.col(target) > 0).select(*dict.fromkeys([key, target, *categorical, *numeric]))
    # Trees keep their rows in memory by task, so a task gets so many rows, not so many bytes of a file.
    filled = pinned(spread(known, key).fillna("missing", list(categorical)).withColumn("__fold", fold(key, folds)).withColumn("__y", F.log1p(target)))
    out = None
    for k in range(folds):
        train, test = filled.where(F.col("__fold") != k), filled.where(F.col("__fold") == k)
        model = Pipeline(stages=[*design(categorical, numeric), GBTRegressor(labelCol="__y", maxIter=trees, maxDepth=4, seed=42)]).fit(train)
        middle = stats.quantiles(train, [], target, [0.5]).select(F.col("q")[0].alias("baseline"))
        part = model.transform(test).crossJoin(F.broadcast(middle)).select(
            key, target, F.greatest(F.lit(1.0), F.least(F.lit(top), F.expm1("prediction"))).alias("predicted"), "baseline"
        )
        out = part if out is None else out.unionByName(part)
    return out


def regression_metrics(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """One row of errors; their median is taken part by part, as no task should hold all distinct errors."""
    e = F.col(target) - F.col(predicted)
    mean = df.agg(F.avg(target).alias("__mean"))
    middle = stats.quantiles(df.select(F.abs(e).alias("off")), [], "off", [0.5]).select(F.round(F.col("q")[0], 6).alias("median_ae"))
    errors = df.crossJoin(F.broadcast(mean)).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col(target) - F.col("__mean")) ** 2)), 6).alias("r2"),
    )
    return errors.join(F.broadcast(middle), F.lit(True), "left")  # no row where there are no errors


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    y, p = F.col(label).cast("double"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    hit = (F.col(score) >= threshold).cast("double")
    sure = F.greatest(F.col(score), 1 - F.col(score))
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg((hit == y).cast("double")), 6).alias("accuracy"),
        F.round(F.try_divide(F.sum(hit * y), F.sum(hit)), 6).alias("precision"), F.round(F.try_divide(F.sum(hit * y), F.sum(y)), 6).alias("recall"),
        F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"), F.round(F.avg((y - p) ** 2), 6).alias("brier"),
        F.round(F.avg((sure >= 0.8).cast("double")), 6).alias("coverage_80"),
    )


def fit_classifier(df: DataFrame, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str], least: int = 50) -> DataFrame | None:
    """(key, label, score) of the held-out fifth, Platt-scaled on another fifth; None below ``least`` rows or with one class."""
    df = pinned(df.select(*dict.fromkeys([key, label, *categorical, *numeric])))  # read by every step of the fits
    stats = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
    if stats.n < least or stats.k < 2:
        return None
    known = spread(df.where(F.col(label).isNotNull()), key, stats.n).fillna("missing", list(categorical))
    known = pinned(known.withColumn("__fold", fold(key, 5)).withColumn("__y", F.col(label).cast("double")))
    model = Pipeline(stages=[*design(categorical, numeric), LogisticRegression(labelCol="__y", regParam=0.01)]).fit(known.where("__fold > 1"))
    raw = model.transform(known.where("__fold <= 1")).withColumn("margin", vector_to_array("rawPrediction")[1]).select(key, label, "__y", "__fold", "margin")
    raw = pinned(raw)
    platt = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="m"), LogisticRegression(featuresCol="m", labelCol="__y", rawPredictionCol="r2", probabilityCol="p2", predictionCol="h2")])
    return platt.fit(raw.where("__fold = 1")).transform(raw.where("__fold = 0")).select(key, label, vector_to_array("p2")[1].alias("score"))
