"""Fitted models that are kept: imputers of missing numbers with intervals, and classifiers of several tasks.

Training is Spark ML throughout; what reaches the driver are coefficients, a few quantiles and one row per task or class.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import impute
from meridia.operators.relational import pinned, spread

LEAST, MOST = 1.0, 5000.0  # Fixed values: the range of an imputed number
FOLDS = 5

# ------------------------------------------------------------------- imputation


@dataclass
class Imputer:
    """A regression on log1p of a number, with the band that out-of-fold residuals keep to."""

    model: PipelineModel
    target: str
    categorical: list[str]
    low: float  # residuals on log1p
    high: float

    def apply(self, df: DataFrame, observed: Column) -> DataFrame:
        """Add estimate, estimate_low, estimate_high and estimated: the number itself where ``observed``, else the model's."""
        names = [c for c in df.columns if c not in self.categorical]
        guess = self.model.transform(df.withColumns({f"__own_{c}": F.col(c) for c in self.categorical}).fillna("missing", self.categorical))
        at = lambda shift: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.expm1(F.col("prediction") + F.lit(shift))))
        pick = lambda c: F.when(observed, F.col(self.target).cast("double")).otherwise(c)
        return guess.select(
            *names, *(F.col(f"__own_{c}").alias(c) for c in self.categorical),
            pick(at(0.0)).alias("estimate"), pick(at(self.low)).alias("estimate_low"), pick(at(self.high)).alias("estimate_high"), (~observed).alias("estimated"),
        ).select(*df.columns, "estimate", "estimate_low", "estimate_high", "estimated")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        row = [(self.target, json.dumps(self.categorical), self.low, self.high)]
        SparkSession.active().createDataFrame(row, "target string, categorical string, low double, high double").write.mode("overwrite").parquet(f"{path}/band")

    @staticmethod
    def load(path: str) -> Imputer:
        r = SparkSession.active().read.parquet(f"{path}/band").first()
        return Imputer(PipelineModel.load(f"{path}/model"), r.target, json.loads(r.categorical), r.low, r.high)


def _regressor(trees: int) -> GBTRegressor:
    return GBTRegressor(labelCol="__y", maxIter=trees, maxDepth=4, seed=42)


def fit_imputer(
    df: DataFrame, key: str, target: str, usable: Column, categorical: Sequence[str], numeric: Sequence[str],
    folds: int = FOLDS, trees: int = 20, band: tuple[float, float] = (0.1, 0.9), cohorts=impute.LEVELS,
) -> tuple[Imputer, DataFrame]:
    """An imputer of ``target``, and (key, target, predicted, baseline, low, high) of every row it learned from, out of fold.

    Rows with a positive ``usable`` number teach. Each fold (by a hash of the key) is predicted by trees fitted without
    it, and by medians of cohorts that know nothing of it; the residuals' quantiles become the interval. The kept model
    is fitted on all rows.
    """
    keys = list(dict.fromkeys(k for names, _ in cohorts for k in names))
    columns = list(dict.fromkeys([key, target, *categorical, *numeric, *keys]))
    known = df.where(usable & (F.col(target) > 0)).select(*columns)
    known = pinned(spread(known, key).fillna("missing", list(categorical)).withColumns({"__fold": impute.fold(key, folds), "__y": F.log1p(F.col(target).cast("double"))}))
    stages = lambda: [*impute.design(categorical, numeric), _regressor(trees)]
    guessed = []
    for k in range(folds):
        train, test = known.where(F.col("__fold") != k), known.where(F.col("__fold") == k)
        if train.isEmpty() or test.isEmpty():
            continue
        guessed.append(Pipeline(stages=stages()).fit(train).transform(test).select(key, target, "__y", "__fold", F.col("prediction").alias("guess")))
    if not guessed:
        raise ValueError(f"{target}: too few rows to learn from")
    guessed = pinned(reduce(DataFrame.unionByName, guessed))
    # Cohort medians of the other folds, for all folds at once: a row teaches the folds that it is not of.
    others = F.explode(F.filter(F.array(*(F.lit(k) for k in range(folds))), lambda k: k != F.col("__fold")))
    teaching = known.select(key, target, *keys, others.alias("__held"), F.lit(True).alias("__teaches"))
    asking = known.select(key, target, *keys, F.col("__fold").alias("__held"), F.lit(False).alias("__teaches"))
    apart = [(("__held", *names), least) for names, least in cohorts] + [(("__held",), 1)]
    blind = impute.hierarchical(teaching.union(asking), target, F.col("__teaches"), apart).where(~F.col("__teaches")).select(key, F.col("estimate").alias("baseline"))
    q = stats.quantiles(guessed.select((F.col("__y") - F.col("guess")).alias("off")), [], "off", band).first().q
    imputer = Imputer(Pipeline(stages=stages()).fit(known), target, list(categorical), float(q[0]), float(q[1]))
    clip = lambda c: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), c))
    out = guessed.join(blind, key, "left").select(
        key, F.col(target).cast("double").alias(target), clip(F.expm1("guess")).alias("predicted"), clip(F.col("baseline")).alias("baseline"),
        clip(F.expm1(F.col("guess") + imputer.low)).alias("low"), clip(F.expm1(F.col("guess") + imputer.high)).alias("high"),
    )
    return imputer, out


def imputer_report(out_of_fold: DataFrame, target: str) -> DataFrame:
    """One row per model: its errors, and how much smaller its mean error is than the cohort medians'; coverage of its band."""
    held = pinned(out_of_fold)
    inside = held.agg(F.round(F.avg(F.col(target).between(F.col("low"), F.col("high")).cast("double")), 6).alias("coverage"))
    base = impute.regression_metrics(held, target, "baseline").select(F.lit("cohort_median").alias("model"), "*")
    mine = impute.regression_metrics(held, target, "predicted").select(F.lit("boosted_trees").alias("model"), "*")
    less = base.select(F.col("mae").alias("__base"))
    both = mine.crossJoin(less).crossJoin(inside).withColumn("improvement_pct", F.round(100 * F.try_divide(F.col("__base") - F.col("mae"), F.col("__base")), 4)).drop("__base")
    return both.unionByName(base.withColumns({"coverage": F.lit(None).cast("double"), "improvement_pct": F.lit(0.0)})).select(F.lit(target).alias("target"), "*")


# ------------------------------------------------------------------- labels

# Tasks, and which of them are one label of a list.
TASKS = ("trust_posture", "facility_type", "capacity_band", "doctor_count_band")
SERVICES = ("maternity", "emergency", "diagnostic", "ncd")
MIN_ROWS = 50
HOLDOUT = 4  # one row in so many is held out
RARE = 5  # a category of fewer rows counts as unknown


def capacity_band(c: Column) -> Column:
    named = F.when(c < 30, "small").when(c < 100, "medium").when(c < 300, "large").otherwise("very_large")
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c <= 0, "none_or_unknown").otherwise(named)


def doctor_band(c: Column) -> Column:
    named = F.when(c <= 2, "solo_or_small_team").when(c <= 10, "medium_team").when(c <= 50, "large_team").otherwise("very_large_team")
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c <= 0, "none_or_unknown").otherwise(named)


def long_labels(df: DataFrame, key: str, labels: str, services: str) -> DataFrame:
    """(key, task, label): one row for each task that a row's JSON labels name, and one for each service.

    ``labels`` holds a JSON object of strings; ``services`` a JSON list, whose items are compared in lower case. Text
    that does not parse, or null, names no task and no service; a service that is not listed has the label "false".
    """
    named = F.map_filter(F.coalesce(F.from_json(labels, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*TASKS) & v.isNotNull())
    listed = F.transform(F.coalesce(F.from_json(services, "array<string>"), F.array().cast("array<string>")), F.lower)
    told = F.map_concat(named, F.create_map(*(x for s in SERVICES for x in (F.lit(f"service_{s}"), F.coalesce(F.array_contains(listed, s), F.lit(False)).cast("string")))))
    return df.select(key, F.explode(told).alias("task", "label"))


def skip_reasons(labels: DataFrame, tasks: Sequence[str], least: int = MIN_ROWS) -> dict[str, tuple[int, str | None]]:
    """{task: (rows, why it cannot be learned or None)}, from one count of labels."""
    counts = labels.groupBy("task", "label").agg(F.count("*").alias("n")).groupBy("task").agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.min("n").alias("fewest"))
    found = {r.task: r for r in counts.where(F.col("task").isin(*tasks)).collect()}
    out = {}
    for task in tasks:
        r = found.get(task)
        reason = (
            f"missing target {task}" if r is None else f"only {r.rows} trainable rows; need at least {least}" if r.rows < least
            else "target has fewer than two classes" if r.classes < 2 else "at least one class has fewer than two examples" if r.fewest < 2 else None
        )
        out[task] = (r.rows if r else 0, reason)
    return out


# ------------------------------------------------------------------- classifiers


@dataclass
class TaskModel:
    """A balanced logistic regression whose margins are turned into probabilities class by class."""

    task: str
    classes: list[str]
    model: object
    slopes: list[float] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)

    def probabilities(self, features: DataFrame) -> DataFrame:
        """``features`` with probability (array by class) and predicted."""
        raw = vector_to_array("rawPrediction")
        own = F.array(*(stats.sigmoid(F.lit(a) * F.get(raw, F.lit(k)) + F.lit(b)) for k, (a, b) in enumerate(zip(self.slopes, self.offsets, strict=True))))
        total = F.aggregate("__own", F.lit(0.0), lambda s, x: s + x)
        scored = self.model.transform(features).withColumn("__own", own)
        scored = scored.withColumn("probability", F.transform("__own", lambda x: F.coalesce(F.try_divide(x, total), F.lit(1.0 / len(self.classes)))))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        names = F.array(*(F.lit(c) for c in self.classes))
        return scored.withColumn("predicted", F.element_at(names, best)).drop("__own", "rawPrediction", "prediction")


def platt(margins: DataFrame, classes: int, rounds: int = 12) -> tuple[list[float], list[float]]:
    """(slopes, offsets) of sigmoids from margins (array by class) to whether ``label_at`` is the class: Newton steps, all classes at once.

    Targets are Platt's: (n + 1) / (n + 2) and 1 / (n + 2), so that classes which margins separate keep finite slopes.
    """
    long = pinned(margins.select(F.posexplode("margin").alias("k", "m"), "label_at").withColumn("hit", F.col("label_at") == F.col("k")))
    counts = {r.k: (r.hits, r.rows - r.hits) for r in long.groupBy("k").agg(F.count_if("hit").alias("hits"), F.count("*").alias("rows")).collect()}
    a, b = [1.0] * classes, [0.0] * classes
    at = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), F.col("k") + 1)
    yes, no = ([(counts.get(k, (0, 0))[0] + 1) / (counts.get(k, (0, 0))[0] + 2) for k in range(classes)], [1 / (counts.get(k, (0, 0))[1] + 2) for k in range(classes)])
    for _ in range(rounds):
        p = stats.sigmoid(at(a) * F.col("m") + at(b))
        step = long.select("k", "m", (p - F.when(F.col("hit"), at(yes)).otherwise(at(no))).alias("g"), (p * (1 - p)).alias("h"))
        sums = step.groupBy("k").agg(*(F.sum(x).alias(n) for n, x in (("ga", F.col("g") * F.col("m")), ("gb", F.col("g")), ("aa", F.col("h") * F.col("m") ** 2), ("ab", F.col("h") * F.col("m")), ("bb", F.col("h")))))
        moved = 0.0
        for r in sums.collect():  # one row a class
            aa, bb = r.aa + 1e-6, r.bb + 1e-6
            det = aa * bb - r.ab**2
            da, db = (bb * r.ga - r.ab * r.gb) / det, (aa * r.gb - r.ab * r.ga) / det
            da, db = max(-2.0, min(2.0, da)), max(-2.0, min(2.0, db))
            a[r.k], b[r.k] = a[r.k] - da, b[r.k] - db
            moved = max(moved, abs(da), abs(db))
        if moved < 1e-6:
            break
    return a, b


def fit_task(rows: DataFrame, task: str, folds: int = 3) -> TaskModel:
    """Fit one task on rows (features, label, __key_hash): margins out of fold teach the sigmoids, all rows the model."""
    counts = sorted((r.label, r.n) for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect())  # one row a class
    classes, whole = [c for c, _ in counts], sum(n for _, n in counts)
    place = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))))
    weight = F.create_map(*(x for c, n in counts for x in (F.lit(c), F.lit(whole / (len(classes) * n)))))
    ready = spread(rows, "__key_hash", whole).select("features", place[F.col("label")].alias("label_at"), weight[F.col("label")].alias("__w"), F.pmod("__key_hash", F.lit(folds)).alias("__fold"))
    ready = pinned(ready)  # this task's rows alone, which every fold reads several times
    fit = lambda df: LogisticRegression(labelCol="label_at", weightCol="__w", family="multinomial", regParam=1.0 / max(whole, 1), maxIter=60).fit(df)
    margins = []
    for k in range(folds):
        train, test = ready.where(F.col("__fold") != k), ready.where(F.col("__fold") == k)
        if train.select("label_at").distinct().count() == len(classes) and not test.isEmpty():
            margins.append(fit(train).transform(test).select("label_at", vector_to_array("rawPrediction").alias("margin")))
    model = fit(ready)
    if not margins:  # too few to hold some out: the model's own probabilities, as margins go through one sigmoid each
        margins = [model.transform(ready).select("label_at", vector_to_array("rawPrediction").alias("margin"))]
    slopes, offsets = platt(reduce(DataFrame.union, margins), len(classes))
    return TaskModel(task, classes, model, slopes, offsets)


def holdout_metrics(scored: DataFrame, classes: Sequence[str], bars: Sequence[float] = (0.5, 0.7, 0.8, 0.9)) -> dict:
    """Accuracy, balanced accuracy, macro F1, log loss, and coverage and accuracy where the surest class reaches a bar; one pass."""
    sure = F.array_max("probability")
    right = (F.col("predicted") == F.col("label")).cast("double")
    own = F.coalesce(F.element_at("probability", F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")).cast("int")), F.lit(0.0))
    parts = [F.count("*").alias("rows"), F.avg(right).alias("accuracy"), (-F.avg(F.log(F.greatest(own, F.lit(1e-15))))).alias("log_loss")]
    for k, c in enumerate(classes):
        is_c, says_c = F.col("label") == c, F.col("predicted") == c
        parts += [F.count_if(is_c).alias(f"n{k}"), F.count_if(says_c).alias(f"s{k}"), F.count_if(is_c & says_c).alias(f"h{k}")]
    for b in bars:
        parts += [F.avg((sure >= b).cast("double")).alias(f"c{b}"), F.avg(F.when(sure >= b, right)).alias(f"a{b}")]
    r = scored.agg(*parts).first().asDict()
    seen = [k for k in range(len(classes)) if r[f"n{k}"] or r[f"s{k}"]]
    recall = [r[f"h{k}"] / r[f"n{k}"] for k in seen if r[f"n{k}"]]
    f1 = [2 * r[f"h{k}"] / (r[f"n{k}"] + r[f"s{k}"]) for k in seen]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    short = lambda x: None if x is None else round(x, 4)
    out = {"n_holdout": r["rows"], "accuracy": short(r["accuracy"]), "balanced_accuracy": short(mean(recall)), "f1_macro": short(mean(f1)), "log_loss": short(r["log_loss"])}
    return out | {f"coverage_{int(100 * b)}": short(r[f"c{b}"]) for b in bars} | {f"accuracy_{int(100 * b)}": short(r[f"a{b}"]) for b in bars}


REPORT = (
    "task string, status string, reason string, n_rows long, n_classes int, n_holdout long, accuracy double, balanced_accuracy double, f1_macro double, log_loss double, "
    + ", ".join(f"{n}_{b} double" for b in (50, 70, 80, 90) for n in ("coverage", "accuracy"))
)


def common_categories(df: DataFrame, categorical: Sequence[str], least: int = RARE) -> DataFrame:
    """``df`` with categories of fewer than ``least`` rows as "rare" and nulls as "missing"; each column's counts are joined back.

    Common categories are few (each becomes a feature, whose names the driver holds); dealt by category, rows would meet in
    as few tasks.
    """
    for c in categorical:
        common = df.groupBy(c).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(F.col(c).alias("__c"), F.lit(True).alias("__common"))
        df = df.join(F.broadcast(common), F.col(c) == F.col("__c"), "left").withColumn(c, F.when(F.col(c).isNull(), "missing").when(F.col("__common"), F.col(c)).otherwise("rare")).drop("__c", "__common")
    return df


def fit_tasks(features: DataFrame, labels: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str], tasks: Sequence[str], least: int = MIN_ROWS) -> tuple[DataFrame, dict[str, TaskModel], DataFrame]:
    """(report, models, prepared): one report row per task, trained or skipped with its reason; ``prepared`` is what the models score.

    ``labels`` is (key, task, label). Every HOLDOUT-th row by hash of the key is held out of all tasks; the features'
    medians, scales and categories come from the others. Each task is fitted on its own rows.
    """
    spark = features.sparkSession
    features = pinned(features.select(*dict.fromkeys([key, *numeric, *categorical])))  # counted by column and by category before they are used
    used_numeric, used_categorical = impute.usable_features(features, numeric, categorical)
    if not used_numeric and not used_categorical:
        rows = [(t, "skipped", "no usable feature columns", n, *[None] * 14) for t, (n, _) in skip_reasons(labels, tasks, least).items()]
        return spark.createDataFrame(rows, REPORT), {}, features.limit(0)
    hashed = common_categories(features.select(key, *used_categorical, *(F.col(c).cast("double").alias(c) for c in used_numeric)), used_categorical)
    hashed = pinned(spread(hashed, key, features.count()).withColumn("__key_hash", F.crc32(F.col(key).cast("string").cast("binary"))))
    held = F.pmod("__key_hash", F.lit(HOLDOUT)) == 0
    design = Pipeline(stages=impute.design(used_categorical, used_numeric)).fit(hashed.where(~held))
    prepared = pinned(design.transform(hashed).select(key, "__key_hash", "features"))
    known = pinned(labels.where(F.col("label").isNotNull() & F.col("task").isin(*tasks)).join(prepared, key))
    rows, models = [], {}
    for task, (n, reason) in skip_reasons(known, tasks, least).items():
        own = known.where(F.col("task") == task)
        if reason is None and own.where(~held).select("label").distinct().count() < 2:
            reason = "target has fewer than two classes"
        if reason:
            rows.append((task, "skipped", reason, n, *[None] * 14))
            continue
        train = own.where(~held).withColumn("__key_hash", F.floor(F.col("__key_hash") / HOLDOUT))
        models[task] = fit_task(train, task)
        m = holdout_metrics(models[task].probabilities(own.where(held)), models[task].classes)
        rows.append((task, "trained", None, n, len(models[task].classes), *(m[c] for c in [x.split()[0] for x in REPORT.split(", ")[5:]])))
    return spark.createDataFrame(rows, REPORT), models, prepared


def predict_tasks(prepared: DataFrame, models: dict[str, TaskModel], key: str) -> DataFrame:
    """(key, task, predicted, confidence) of every row for every trained task."""
    parts = [m.probabilities(prepared).select(key, F.lit(t).alias("task"), "predicted", F.round(F.array_max("probability"), 6).alias("confidence")) for t, m in models.items()]
    return reduce(DataFrame.unionByName, parts) if parts else prepared.select(key, F.lit("").alias("task"), F.lit("").alias("predicted"), F.lit(0.0).alias("confidence")).limit(0)
