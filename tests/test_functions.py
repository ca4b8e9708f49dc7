"""Edge frames: parsers, three-valued logic, intervals, ranks."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import beta, stats, text
from meridia.operators import matching, profile, scores
from meridia.operators import relational as rel
from meridia.sources import io


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, lambda c: text.first_int(c, 5000), "1,200 beds", "12345678", "NA", None, "9000") == [1200, None, None, None, None]
    assert values(spark, text.number, "1.5 km", "NA", None, "1.2.3") == [1.5, None, None, None]
    assert values(spark, text.year, "1799", "1800", "2026", "2029", "Est. 1987.", None) == [None, 1800, 2026, None, 1987, None]
    assert values(spark, text.first_pin, "560001", "0560001", "5600012", "PIN-560001,", "560 001", None) == ["560001", None, None, "560001", None, None]


def test_items(spark):
    got = values(spark, text.semantic_items, None, "[]", '[""]', '["null","X-ray"]', '{"a":"MRI"}', "No equipment details provided", "[x")
    assert got == [[], [], [], ["X-ray"], ["MRI"], [], ["[x"]]


def test_recency(spark):
    got = values(spark, lambda c: text.recency(c, "2026-06-15")["status"], None, "not a date", "2026-06-16", "2026-06-15", "2024-06-15", "2024-06-16")
    assert got == ["missing", "invalid", "future", "valid", "stale", "valid"]


def test_contacts(spark):
    assert values(spark, text.phones, "+91 98765-43210", "00919876543210", "1111111111", "1234567") == [["9876543210"], ["9876543210"], [], []]
    assert values(spark, text.emails, "Mail A.b@X.org, a.b@x.org") == [["a.b@x.org"]]
    assert values(spark, text.boolish, "true", "no", None, "yes", "0", "maybe") == [True, False, None, True, False, None]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 10)], "x int, n int")
    got = [(r.low, r.high) for r in df.select(stats.wilson(F.col("x"), F.col("n")).alias("w")).select("w.*").collect()]
    assert got[0] == (None, None) and got[1][0] == 0 and got[2][1] == 1
    assert got[3] == pytest.approx((0.2366, 0.7634), abs=1e-4)


def test_round_scaled_is_that_of_sql(spark):
    import duckdb

    money = [k / 100 for k in range(-99999, 999999, 4321)]
    rows = [(1 - abs(a - b) / 1000,) for a in money[:60] for b in money[-60:]] + [(k / 2000,) for k in range(-2001, 2001)] + [(0.49999999999999994,), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "v double").select(stats.round_scaled(F.col("v"), 3).alias("x")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 3)", r).fetchone()[0] for r in rows]


def test_pair_similarity_of_money_next_to_a_half(spark, tmp_path):
    from meridia.plans.decision_queries import PAIRS, _pairs

    import duckdb

    rows = [(k, f"Supplier#{k:09d}", k % 2, cents / 100) for k, cents in enumerate(range(1017, 5517, 50))]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got = sorted(tuple(r) for r in _pairs(spark, str(tmp_path)).select("left", "right", "name", "address").collect())
    assert got == sorted(con.execute(f"SELECT l, r, name, address FROM ({PAIRS})").fetchall())


def test_pct_rank(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 30.0), (4, 40.0), (5, None)], "i int, v double")
    got = {r.i: r.p for r in stats.pct_rank(df, "v", "p").collect()}
    assert got == {1: 0.375, 2: 0.375, 3: 0.75, 4: 1.0, 5: None}


def test_posterior_bounds_and_monotony(spark):
    base = dict(join_confidence=0.9, geo_quality="plausible", lat=20.0, lon=80.0, has_source=True, has_contact=True, gaps=0, kind="k", recency="valid", trusted=True,
                capacity=1.0, doctors=1.0, contradicted=False, needs_review=False, capacity_outlier=False, doctors_outlier=False)
    rows = [base, base | {"contradicted": True}, base | {"has_source": None, "join_confidence": None, "gaps": None}, base | {"needs_review": True}]
    schema = "join_confidence double, geo_quality string, lat double, lon double, has_source boolean, has_contact boolean, gaps int, kind string, recency string, trusted boolean, capacity double, doctors double, contradicted boolean, needs_review boolean, capacity_outlier boolean, doctors_outlier boolean"
    p = [r.p for r in spark.createDataFrame([tuple(r.values()) for r in rows], schema).select(scores.validity_posterior().alias("p")).collect()]
    assert all(0 < x < 1 and not math.isnan(x) for x in p) and p[0] > p[3] > p[1] and p[0] > p[2]


def test_conformal_set_of_small_samples(spark):
    df = spark.createDataFrame([(i, i / 10, True) for i in range(10)], "k int, p double, y boolean")
    r = scores.conformal(df, "k", "p", "y").first()
    assert 0.05 <= r.q <= 0.95 and min(0.99, r.q + 0.05) <= r.stale_q + 1e-9 and r.n_calibration + r.n_evaluation == 10


def test_blocks_beyond_the_cap_are_reported(spark):
    df = spark.createDataFrame([(i, "big" if i < 251 else f"b{i // 2}") for i in range(261)], "id int, k string")
    blocks = matching.block_keys({"k": F.col("k")})
    assert matching.blocked_pairs(df, "id", blocks).count() == 4
    assert matching.block_report(df, blocks).first().n_too_large == 1


def test_clusters_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 51)], "left long, right long")
    assert {r.node: r.cluster for r in matching.clusters(edges).collect()} == {**{i: 0 for i in range(13)}, 50: 50, 51: 50}


def test_keys_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    r = io.key_report(df, ["k"]).first()
    assert (r.n_rows, r.n_null_keys, r.n_repeated_keys) == (3, 1, 1)
    with pytest.raises(ValueError):
        io.assert_key(df, ["k"])
    names = io.create_logs(spark, "t_")
    io.append_row(spark, names[0], {"feedback_id": "1", "geography_id": "x|y", "status": "open", "created_at": "2026-01-01T00:00:00"})
    io.append_row(spark, names[0], {"feedback_id": "2", "geography_id": "x|y", "status": "open"})
    got = io.read_log(spark.table(names[0]), geography_id="x|y").collect()
    assert [r.feedback_id for r in got] == ["2", "1"]
    assert io.first_existing(spark, "nothing_here", names[0]) == names[0]
    assert io.optional_csv(spark, f"{tmp_path}/none.csv") is None
    assert io.first_available(spark, ["nothing", f"{tmp_path}/none"], df.schema).count() == 0
    assert io.save_keyed(df.where("v = 'a'"), "t_keyed", ["k"], "a table").count() == 1
    (tmp_path / "x.csv").write_text('a,b\n"1 ""q""\nline",2\n')
    assert io.read_csv(spark, f"{tmp_path}/x.csv").first().a == '1 "q"\nline'
    assert io.cached(spark, f"{tmp_path}/c", lambda: df).count() == 3


def test_expectations_count_unknown_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    r = profile.expectations(df, "t", {"x above 0": (F.col("x") > 0, "error")}).first()
    assert (r.failed, r.passed) == (1, False)


def test_dominant_breaks_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, " "), (2, None)], "k int, v string")
    assert [(r.k, r.v, r.n) for r in rel.dominant(df, "k", "v").collect()] == [(1, "a", 1)]


def test_sequence_ratio_is_that_of_difflib(spark):
    from difflib import SequenceMatcher

    r = spark.createDataFrame([("district", "distict x")], "a string, b string").select(matching.sequence_ratio("a", "b").alias("x")).first().x
    assert r == SequenceMatcher(None, "district", "distict x").ratio()


def test_beta_quantiles():
    import numpy as np

    a, b = np.array([0.5, 1.0, 5.5, 2.0]), np.array([0.5, 1.0, 5.5, 1.0])
    assert beta.quantile(0.025, a, b)[1] == pytest.approx(0.025, abs=1e-9)
    assert beta.quantile(0.25, a, b)[0] == pytest.approx(math.sin(math.pi / 8) ** 2, abs=1e-9)  # the arcsine law
    assert beta.quantile(0.5, a, b)[2] == pytest.approx(0.5, abs=1e-9)
    assert beta.quantile(0.49, a, b)[3] == pytest.approx(0.7, abs=1e-9)


def test_records_and_sinks(spark, tmp_path):
    texts = {"list": '[{"a":1},{"a":2}]', "lines": '{"a":1}\n{"a":2}\n', "nested": '{"records":[{"a":1},{"a":2}]}', "one": '{"a":1}'}
    for name, t in texts.items():
        (tmp_path / f"{name}.json").write_text(t)
    got = {n: sorted(r.a for r in io.read_records(spark, f"{tmp_path}/{n}.json", "struct<a:int>").collect()) for n in texts}
    assert got == {"list": [1, 2], "lines": [1, 2], "nested": [1, 2], "one": [1]}
    df = spark.createDataFrame([(1, 'x "y"\nz'), (2, None)], "a int, b string")
    for kind in ("csv", "json", "parquet"):
        io.write(df, f"{tmp_path}/{kind}", kind)
    assert sorted(r.b or "" for r in io.read_csv(spark, f"{tmp_path}/csv").collect()) == ["", 'x "y"\nz']
    assert io.markdown(df.select("a")) == "|a|\n|-|\n|1|\n|2|"
