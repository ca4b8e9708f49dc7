"""Global ranks, order statistics of awkward columns, imputers and supervised tasks, against plain computations."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import impute, models, ranks
from meridia.operators import relational as rel


def test_global_ranks_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.5, 2.5, float("nan"), -0.0, 7.0]), rng.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double, s string").repartition(7)
    got = {r.k: r.place for r in ranks.global_ranks(df, [F.desc("x"), F.asc("s"), F.asc("k")], "place").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -float("inf") if r[1] is not None and np.isnan(r[1]) else -(r[1] or 0), r[2], r[0]))
    assert got == {k: n for n, (k, *_) in enumerate(order, 1)}
    dense = {r.x: r.place for r in ranks.global_dense_ranks(df.where("not isnan(x)"), "x", "place").select("x", "place").distinct().collect()}
    assert [dense[x] for x in (7.0, 2.5, 1.5, 0.0)] == [1, 2, 3, 4]
    assert ranks.global_ranks(df.limit(0), [F.asc("k")], "place").collect() == []


def test_ranking_is_spread_over_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"))
    plan = ranks.global_ranks(df, [F.asc("k")], "place")
    assert "rangepartitioning" in df.repartitionByRange("k")._jdf.queryExecution().toString() and plan.agg(F.max("place"), F.count_distinct("place")).first() == (20_000, 20_000)


@pytest.mark.parametrize("values", [
    [1.7e9 + 37 * (i * 7919 % 5000) for i in range(5000)], [5.0e9 + i * 20_011 for i in range(5000)], [0.9 + i / 50_000 for i in range(5000)], [3.0] * 4000 + list(range(1000)),
], ids=["seconds", "ids", "scores", "hot value"])
def test_no_part_of_a_narrow_column_is_large(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    distinct = df.distinct().withColumnRenamed("x", "value")
    parts = distinct.crossJoin(stats.cut_points(distinct, [])).groupBy(stats.part_of(F.col("value"), F.col("cuts")).alias("part")).count().collect()
    assert max(r["count"] for r in parts) <= 0.05 * distinct.count()
    q = stats.quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.99, 1.0]).first().q
    assert np.allclose(q, np.quantile(values, [0.0, 0.25, 0.5, 0.99, 1.0]), rtol=1e-12)
    got = {r.x: r.r for r in stats.pct_rank(df, "x", "r").collect()}
    arr = np.array(values)
    for x in list(got)[:50]:
        assert abs(got[x] - ((arr < x).sum() + ((arr == x).sum() + 1) / 2) / len(arr)) < 1e-12
    few = {r.x: r.r for r in stats.few_pct_ranks(df, {"x": "r"}).collect()}
    assert few.keys() == got.keys() and all(abs(few[x] - got[x]) < 1e-12 for x in got)


def test_hierarchical_medians_by_plain_computation(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["p", "q", None]), rng.choice(["s", "t"]), rng.choice([None, float(rng.randint(1, 9))]), rng.random() < 0.1) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, kind string, operator string, state string, v double, bad boolean")
    out = {r.k: r for r in impute.hierarchical(df, "v", ~F.col("bad")).collect()}
    known = [(dict(kind=a, operator=b, state=c), v) for _, a, b, c, v, bad in rows if v is not None and not bad]
    for k, a, b, c, v, bad in rows:
        own = dict(kind=a, operator=b, state=c)
        if v is not None and not bad:
            assert (out[k].estimate, out[k].level, out[k].n, out[k].confidence) == (v, "observed", 1, "observed")
            continue
        for keys, least in [*impute.LEVELS, ((), 1)]:
            peers = [x for d, x in known if all(d[n] == own[n] is not None for n in keys)] if all(own[n] is not None for n in keys) else []
            if len(peers) >= least:
                break
        assert (out[k].level, out[k].n) == ("_".join(keys) or "global", len(peers)) and np.allclose([out[k].low, out[k].estimate, out[k].high], np.quantile(peers, [0.1, 0.5, 0.9]))


def sized(n, seed=5):
    rng = np.random.default_rng(seed)
    kind = rng.choice(["clinic", "hospital"], n)
    beds = rng.integers(1, 60, n)
    size = np.expm1(1.0 + 2.0 * (kind == "hospital") + 0.04 * beds + rng.normal(0, 0.3, n))
    return [(i, str(kind[i]), None if i % 17 == 0 else "p", "s", float(beds[i]), None if i % 3 == 0 else float(size[i])) for i in range(n)], size


def test_imputer_fills_all_rows_keeps_and_covers(spark, tmp_path):
    rows, size = sized(900)
    df = spark.createDataFrame(rows, "k long, kind string, operator string, state string, beds double, size double")
    imputer, oof = models.fit_imputer(df, "k", "size", F.col("size").isNotNull(), ["kind", "operator"], ["beds"], folds=3, trees=6)
    filled = imputer.apply(df, F.col("size").isNotNull()).orderBy("k").collect()
    imputer.save(f"{tmp_path}/m")
    assert models.Imputer.load(f"{tmp_path}/m").apply(df, F.col("size").isNotNull()).orderBy("k").collect() == filled
    assert len(filled) == 900 and filled[0].asDict().keys() == {"k", "kind", "operator", "state", "beds", "size", "estimate", "estimate_low", "estimate_high", "estimated"} and filled[17].operator is None
    hidden = [r for r in filled if r.size is None]
    assert len(hidden) == 300 and all(r.estimated and 1 <= r.estimate_low <= r.estimate <= r.estimate_high <= 5000 for r in hidden)
    assert 0.68 <= np.mean([r.estimate_low <= size[r.k] <= r.estimate_high for r in hidden]) <= 0.92  # rows that no model saw
    assert all(not r.estimated and r.estimate == r.estimate_low == r.size for r in filled if r.size is not None)
    report = {r.model: r for r in models.imputer_report(oof, "size").collect()}
    assert report["boosted_trees"].n == 600 and report["boosted_trees"].improvement_pct > 20 and 0.7 <= report["boosted_trees"].coverage <= 0.9
    medians = {r.k: r.baseline for r in oof.collect()}
    fold = {r.k: r.f for r in df.select("k", impute.fold("k", 3).alias("f")).collect()}
    for k in [k for k in medians if rows[k][2] is not None][:40]:  # cohorts of a known operator are large enough at once
        peers = [r[5] for r in rows if r[5] is not None and fold[r[0]] != fold[k] and r[1:4] == rows[k][1:4]]
        assert len(peers) >= 5 and abs(medians[k] - np.median(peers)) < 1e-9


def test_labels_from_json(spark):
    rows = [
        (1, '{"trust_posture": "a", "facility_type": null, "else": "x"}', '["Maternity", "NCD", 3]'), (2, "{broken", "broken"), (3, None, None),
        (4, '{"capacity_band": "small", "doctor_count_band": 7}', "[]"), (5, "[]", '{"a": 1}'),
    ]
    got = {(r.k, r.task): r.label for r in models.long_labels(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()}
    want = {(1, "trust_posture"): "a", (4, "capacity_band"): "small", (4, "doctor_count_band"): "7"}
    for k, a, b in rows:
        try:
            listed = json.loads(b)
        except (TypeError, ValueError):
            listed = []
        for s in models.SERVICES:
            want[k, f"service_{s}"] = "true" if isinstance(listed, list) and s in {str(x).lower() for x in listed} else "false"
    assert got == want


def test_bands(spark):
    values = [None, float("nan"), -1.0, 0.0, 1.0, 2.0, 3.0, 10.0, 29.0, 30.0, 50.0, 99.0, 100.0, 299.0, 300.0]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(models.capacity_band(F.col("x")).alias("c"), models.doctor_band(F.col("x")).alias("d")).collect()
    assert [r.c for r in got] == ["unknown"] * 2 + ["none_or_unknown"] * 2 + ["small"] * 5 + ["medium"] * 3 + ["large"] * 2 + ["very_large"]
    assert [r.d for r in got] == ["unknown"] * 2 + ["none_or_unknown"] * 2 + ["solo_or_small_team"] * 2 + ["medium_team"] * 2 + ["large_team"] * 3 + ["very_large_team"] * 4


def test_tasks_are_learned_or_skipped_with_a_reason(spark):
    rng = np.random.default_rng(2)
    n = 900
    x, noise = rng.normal(0, 1, n), rng.normal(0, 0.6, n)
    kind = rng.choice(["p", "q", "r"], n)
    level = np.digitize(x + 0.8 * (kind == "q") + noise, [-0.5, 0.8])
    features = spark.createDataFrame([(i, None if i % 31 == 0 else float(x[i]), None if i % 29 == 0 else str(kind[i]), None) for i in range(n)], "k long, x double, kind string, nothing double")
    labels = [(i, "band", "low mid high".split()[level[i]]) for i in range(n)] + [(i, "few", "a") for i in range(20)] + [(i, "one", "a") for i in range(n)]
    labels += [(i, "lone", "b" if i == 5 else "a") for i in range(n)] + [(i, "none", None) for i in range(n)]
    tasks = ["band", "few", "one", "lone", "none", "absent"]
    report, fitted, prepared = models.fit_tasks(features, spark.createDataFrame(labels, "k long, task string, label string"), "k", ["kind"], ["x", "nothing"], tasks)
    by = {r.task: r for r in report.collect()}
    assert list(fitted) == ["band"] and by["band"].status == "trained" and by["band"].n_classes == 3
    assert by["few"].reason == "only 20 trainable rows; need at least 50" and by["one"].reason == "target has fewer than two classes"
    assert by["lone"].reason == "at least one class has fewer than two examples" and by["none"].reason == "missing target none" and by["absent"].status == "skipped"
    b = by["band"]
    assert b.accuracy > 0.55 and b.log_loss < 1.0 and b.balanced_accuracy > 0.5 and b.coverage_50 >= b.coverage_90
    assert b.accuracy_70 is None or b.accuracy_70 > 0.55  # surer means right more often
    told = models.predict_tasks(prepared, fitted, "k").collect()
    assert len(told) == n and all(1 / 3 - 1e-6 <= r.confidence <= 1 and r.predicted in ("low", "mid", "high") for r in told)


def test_platt_matches_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 2, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.7 * m[:, 1] - 0.4)))).astype(int)
    a, b = models.platt(spark.createDataFrame([([float(u), float(v)], float(c)) for (u, v), c in zip(m, y, strict=True)], "margin array<double>, label_at double"), 2)
    n = y.sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (400 - n + 2))
    loss = lambda p, q: -(t * np.log(1 / (1 + np.exp(-(p * m[:, 1] + q)))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(-(p * m[:, 1] + q))))).sum()
    least = loss(a[1], b[1])
    assert all(least <= loss(a[1] + u, b[1] + v) for u in (-0.01, 0.01, 0) for v in (-0.01, 0.01, 0))


def counted(spark, df):
    """``df`` and an accumulator of how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x

    return df.withColumn("x", F.udf(see, "double")("x")), seen


def test_ranks_compute_rows_once(spark):
    df, seen = counted(spark, spark.range(500).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x"))
    got = ranks.global_ranks(df, [F.desc("x"), F.asc("id")], "place").orderBy("place").collect()
    assert [(r.x, r.id) for r in got] == sorted(((float(i % 7), i) for i in range(500)), key=lambda r: (-r[0], r[1])) and [r.place for r in got] == list(range(1, 501))
    assert seen.value == 500


def test_fits_read_rows_that_are_computed_once_and_dealt(spark, monkeypatch):
    df = spark.range(25_000).coalesce(1).selectExpr("id", "CAST(id % 5 AS STRING) AS c", "CAST(id % 11 AS DOUBLE) AS x", "1e0 + id % 13 AS y", "CAST(id % 11 > 4 AND id % 3 > 0 AS INT) AS label")
    parts = []
    monkeypatch.setattr(impute, "pinned", lambda d: parts.append(d.rdd.getNumPartitions()) or rel.pinned(d))
    impute.out_of_fold(df, "id", "y", ["c"], ["x"], folds=2, trees=1)
    assert parts == [3]
    once, seen = counted(spark, df.where("id < 2000"))
    assert impute.fit_classifier(once, "id", "label", ["c"], ["x"]).count() and seen.value <= 4000  # by the test's own look at the plan at most once more


def test_median_error_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 5.5), (None, 1.0), (9.0, 5.0)], "y double, p double")
    assert impute.regression_metrics(df, "y", "p").first().median_ae == 1.0
    none = impute.regression_metrics(df.where("y > 100"), "y", "p").collect()
    assert len(none) == 1 and none[0].n == 0 and none[0].median_ae is None


def test_categories_are_joined_without_dealing_rows_by_them(spark):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = models.common_categories(spark.range(100).selectExpr("id", "CASE WHEN id > 0 THEN id % 2 END || 'x' AS c"), ["c"])
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.c: r["count"] for r in df.groupBy("c").count().collect()} == {"0x": 49, "1x": 50, "missing": 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
