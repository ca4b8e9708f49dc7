"""Hexagonal cells, folding, normality, scopes, supply, lookups and audits against published values and brute force."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import hexcells, stats, text
from meridia.operators import profile, serve
from meridia.operators.profile import Check
from meridia.sources import io

# Published ids.
KNOWN = [
    (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (0.0, 0.0, 0, "8075fffffffffff"),
]
PENTAGONS = ["8009fffffffffff", "801dfffffffffff", "8031fffffffffff", "804dfffffffffff", "8063fffffffffff", "8075fffffffffff", "807ffffffffffff", "8091fffffffffff", "80a7fffffffffff", "80c3fffffffffff", "80d7fffffffffff", "80ebfffffffffff"]


def sphere(n, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1)[:, None]


def degrees(v):
    return np.degrees(np.arcsin(v[:, 2])), np.degrees(np.arctan2(v[:, 1], v[:, 0]))


def test_published_cells_and_pentagons(spark):
    for lat, lon, res, want in KNOWN:
        assert f"{hexcells.cells(np.array([lat]), np.array([lon]), res)[0]:x}" == want
    cell, _, pentagon, _ = hexcells.base_cell_table()
    assert sorted(f"{1 << 59 | int(n) << 45 | (1 << 45) - 1:x}" for n in np.unique(cell[pentagon])) == PENTAGONS
    rows = [(lat, lon) for lat, lon, *_ in KNOWN] + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))]
    got = [r.c for r in spark.createDataFrame(rows, "a double, b double").select(hexcells.hex_cell(F.col("a"), F.col("b"), 9).alias("c")).collect()]
    assert got[0] == KNOWN[0][3] and got[5:] == [""] * 4


def test_base_cells_are_numbered_from_north_to_south():
    latitudes = []
    for name in hexcells.BASE_CELLS:
        face = int(name.rstrip("cijkV"))
        latitudes.append(hexcells._on_sphere(face, hexcells._flat(hexcells.PLACES[name[len(str(face)) :]]))[2])
    assert len(latitudes) == 122 and all(a > b - 1e-9 for a, b in zip(latitudes, latitudes[1:], strict=False))


@pytest.mark.parametrize(("res", "most"), [(0, 0.40), (1, 0.16), (2, 0.062), (3, 0.0235)])
def test_cells_are_all_there_and_hold_together(res, most):
    v = sphere(2_500_000 if res == 3 else 600_000)
    ids, code = np.unique(hexcells.cells(*degrees(v), res), return_inverse=True)
    assert len(ids) == 2 + 120 * 7**res  # pentagons have no child toward k: 12 of 6 children, the others of 7
    centre = np.stack([np.bincount(code, weights=v[:, k]) for k in range(3)], axis=1)
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    assert np.linalg.norm(v - centre[code], axis=1).max() < most  # no cell is scattered
    some = np.random.default_rng(1).choice(len(v), 400)
    assert ((v[some] @ centre.T).argmax(axis=1) == code[some]).mean() > 0.9


@pytest.mark.parametrize("res", [1, 4, 9])
def test_cells_across_the_antimeridian_and_at_the_poles(res):
    lat = np.linspace(-89, 89, 200)
    assert (hexcells.cells(lat, np.full(200, 180.0), res) == hexcells.cells(lat, np.full(200, -180.0), res)).all()
    assert (hexcells.cells(lat, np.full(200, 180 - 1e-9), res) == hexcells.cells(lat, np.full(200, -180 + 1e-9), res)).mean() > 0.98
    assert len(set(hexcells.cells(np.full(36, 90.0), np.arange(36) * 10.0, res).tolist())) == 1
    inner = hexcells.cells(*degrees(sphere(2000, 3)), res)
    outer = hexcells.cells(*degrees(sphere(2000, 3)), res - 1)
    digits = np.uint64(3 * (15 - res))
    parent = inner & ~(np.uint64(15) << np.uint64(52)) | np.uint64(res - 1) << np.uint64(52) | np.uint64(7) << digits
    assert (parent == outer).mean() > 0.75  # a child may reach over its parent's border, not more


def test_ascii_fold_is_nfkd_for_every_character(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(every[i : i + 400]) for i in range(0, len(every), 400)] + ["", "é", "ﬁn ½ Ⅷ ㍱", None, "plain"]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", text.ascii_fold(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode() for t in lines]
    single = [c for c in every if c > "\x7f"][:60_000]
    got = [r.f for r in spark.createDataFrame([(i, c) for i, c in enumerate(single)], "i int, t string").select("i", text.ascii_fold(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in single]
    assert spark.createDataFrame([("  Höpital & Ñandú—№5 ",)], "t string").select(text.key_words(F.col("t")).alias("k")).first().k == "hopital and nanduno5"


def test_normality_test_values(spark):
    rng = np.random.default_rng(3)
    data = {"bell": rng.normal(5, 2, 400), "skewed": np.exp(rng.normal(0, 1, 400)), "few": np.repeat([1.0, 2.0], 200)}
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in data) for i in range(400)], ", ".join(f"{c} double" for c in data))
    got = {(r.column, r.scale): r for r in profile.normality_report(df, list(data)).collect()}
    assert got["bell", "raw"].p > 0.01 and got["skewed", "raw"].p < 1e-4 and got["few", "raw"].k2 is None and got["few", "raw"].n == 400
    r = spark.range(1).select(stats.normality(F.lit(62), F.lit(1.02), F.lit(1.58)).alias("t"), stats.normality(F.lit(19), F.lit(0.1), F.lit(0.1)).alias("u")).first()
    assert abs(r.t.k2 - plain_k2(62, 1.02, 1.58)) < 1e-9 and abs(r.t.p - math.exp(-r.t.k2 / 2)) < 1e-12 and r.u.k2 is None
    rate = [math.exp(-plain_k2(200, ((x - x.mean()) ** 3).mean() / x.std() ** 3, ((x - x.mean()) ** 4).mean() / x.std() ** 4 - 3) / 2) < 0.05 for x in rng.normal(size=(4000, 200))]
    assert 0.035 < np.mean(rate) < 0.07  # of normal samples about one in twenty fails


def plain_k2(n, g1, g2):
    """Scores of skewness (a Johnson curve) and kurtosis (a cube root of a chi-square), squared and added."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / 6 / (n - 2))
    b = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / (n - 2) / (n + 5) / (n + 7) / (n + 9)
    w = math.sqrt(math.sqrt(2 * b - 2) - 1)
    t = y / math.sqrt(2 / (w * w - 1))
    first = math.log(t + math.sqrt(t * t + 1)) / math.sqrt(math.log(w))
    spread = math.sqrt(24 * n * (n - 2) * (n - 3) / (n + 1) ** 2 / (n + 3) / (n + 5))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / spread
    beta = 6 * (n * n - 5 * n + 2) / (n + 7) / (n + 9) * math.sqrt(6 * (n + 3) * (n + 5) / n / (n - 2) / (n - 3))
    a = 6 + 8 / beta * (2 / beta + math.sqrt(1 + 4 / beta**2))
    second = (1 - 2 / 9 / a - np.cbrt((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / 9 / a)
    return first**2 + second**2


def test_scopes_fall_back_one_by_one(spark):
    records = [(1, "d1", "s1", 0.9, False), (2, "d1", "s1", 0.8, True), (3, "d2", "s1", 0.7, False), (4, "d2", "s1", 0.6, False), (5, "d2", "s1", 0.5, False), (6, "d9", "s9", 0.4, True), (7, None, None, 0.99, False), (8, "d3", "s3", 0.3, False)]
    df = spark.createDataFrame(records, "id long, district string, state string, score double, wanted boolean")
    asked = spark.createDataFrame([("d1", "s1"), ("d2", "s1"), ("d4", "s1"), ("d5", "s5"), ("d3", "s3")], "district string, state string")
    order = [F.desc("score"), F.asc("id")]
    got = {}
    for r in serve.scoped_examples(asked, df, ["district", "state"], "id", order, 2).collect():
        got.setdefault(r.district, []).append((r.place, r.scope, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {
        "d1": [(1, "district", 1), (2, "district", 2)], "d2": [(1, "district", 3), (2, "district", 4)], "d4": [(1, "state", 1), (2, "state", 2)], "d5": [(1, "all", 7), (2, "all", 1)], "d3": [(1, "district", 8)]}
    liked = {(r.district, r.scope, r.id) for r in serve.scoped_examples(asked, df, ["district", "state"], "id", order, 2, F.col("wanted"), F.col("id") == 8).collect()}
    assert liked == {("d1", "district", 2), ("d2", "district", 3), ("d2", "district", 4), ("d4", "state", 2), ("d5", "all", 2), ("d5", "all", 6), ("d3", "state", 8)}
    assert serve.scoped_examples(asked, df.limit(0), ["district", "state"], "id", order, 2).collect() == []


def test_supply_is_monotone_and_worked_by_hand(spark):
    rng = random.Random(4)
    rows = [("x", True, 10.0, 10.0, 10.0, 10.0), ("x", False, None, 30.0, 5.0, 80.0), ("y", False, None, 8.0, 2.0, 9.0), ("y", None, 4.0, 4.0, 4.0, 4.0), ("z", False, None, None, None, None)]
    rows += [(f"r{rng.randint(0, 30)}", rng.random() < 0.4, *(rng.choice([None, 50.0 * rng.random()]) for _ in range(2)), *sorted([100 * rng.random(), 100 * rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, trusted boolean, seen double, mid double, low double, high double")
    got = {(r.a, r.scenario): r for r in serve.supply_intervals(df, "a", "trusted", "seen", "mid", "low", "high").collect()}
    assert [(got["x", s].facilities, got["x", s].capacity) for s in ("best", "likely", "worst")] == [(2, 90.0), (1, 50.0), (1, 10.0)]
    assert [(got["y", s].facilities, got["y", s].capacity) for s in ("best", "likely", "worst")] == [(2, 13.0), (0, 6.5), (0, 0.0)]
    assert got["z", "best"].capacity == 0.0
    for a in {a for a, _ in got}:
        b, m, w = (got[a, s] for s in ("best", "likely", "worst"))
        assert b.capacity >= m.capacity >= w.capacity >= 0 and b.facilities >= m.facilities >= w.facilities and b.low == w.capacity and m.high == b.capacity


def test_lookup_takes_the_first_key_that_meets(spark):
    index = io.metadata_index(spark.createDataFrame([(1, "A-1", "north"), (2, "b 2", "North"), (3, None, "a1"), (4, "", "x")], "id long, k string, name string"), ["k", "name"], "id")
    rows = [(10, "zz", "NORTH!", "b2"), (11, "a 1", "north", None), (12, None, None, ""), (13, "?", "b2", "north"), (14, "none", "such", "key")]
    df = spark.createDataFrame(rows, "key long, a string, b string, c string")
    got = {r.key: (r.place, r.id) for r in io.lookup_any(df, "key", [F.col(c) for c in "abc"], index, ["id"]).collect()}
    assert got == {10: (1, 2), 11: (0, 3), 13: (1, 2)}


def test_every_kind_of_check_fails_and_passes(spark):
    t = spark.createDataFrame([(1, 0.5, 1, 2, "a", 7), (1, None, 3, 2, None, None), (2, 1.5, None, 2, "b", 8)], "k int, x double, lo int, hi int, kind string, ref int")
    other = spark.createDataFrame([(7,), (7,)], "id int")
    cases = {
        "rows": (Check("", "error", "rows", "t", low=5, high=9), 2, Check("", "error", "rows", "t", low=1, high=3)), "columns": (Check("", "error", "columns", "t", ("k", "no", "none")), 2, Check("", "error", "columns", "t", ("k",))),
        "unique": (Check("", "error", "unique", "t", ("k",)), 1, Check("", "error", "unique", "t", ("k", "lo"))), "not_null": (Check("", "error", "not_null", "t", ("x", "kind")), 1, Check("", "error", "not_null", "t", ("k",))),
        "bounds": (Check("", "error", "bounds", "t", ("x",), 0, 1), 1, Check("", "error", "bounds", "t", ("x",), 0)), "at_most": (Check("", "error", "at_most", "t", ("lo", "hi")), 1, Check("", "error", "at_most", "t", ("k", "hi"))),
        "domain": (Check("", "error", "domain", "t", ("kind",), values=("a",)), 1, Check("", "error", "domain", "t", ("kind",), values=("a", "b"))), "presence": (Check("", "warning", "presence", "t", ("kind",), values=("a", "z", "y")), 2, Check("", "warning", "presence", "t", ("kind",), values=("b",))),
        "foreign": (Check("", "error", "foreign", "t", ("ref",), other="other", other_columns=("id",)), 1, Check("", "error", "foreign", "other", ("id",), other="t", other_columns=("ref",))),
    }
    assert set(cases) == set(profile.KINDS)
    named = [Check(**{**vars(c), "name": f"{kind} {which}"}) for kind, (bad, _, good) in cases.items() for which, c in (("bad", bad), ("good", good))]
    got = {r.check: (r.failed, r.passed) for r in profile.audit({"t": t, "other": other}, [*named, Check("lacks", "error", "bounds", "t", ("nothing",), 0, 1)]).collect()}
    assert got == {f"{kind} bad": (n, False) for kind, (_, n, _) in cases.items()} | {f"{kind} good": (0, True) for kind in cases} | {"lacks": (1, False)}
    with pytest.raises(ValueError):
        profile.audit({"t": t}, [Check("x", "error", "odd", "t")])
