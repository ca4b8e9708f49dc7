import random
import re
from collections import Counter

import pytest

from meridia.llm import collocations as col
from meridia.llm.oracles import OP13
from meridia.llm.sketch import Shape
from tests.llm.frames import corpus, frame
from tests.oracle import expected, rows

LOWER = {c: c + 32 for c in range(65, 91)}
NARROW = Shape(log2_width=12, log2_block=10, depth=1, log2_coarse=10)  # buckets that many phrases share


def brute(data, least, longest=4, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in frequent.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
        if any(x == lang and len(v) > len(w) and 100 * f >= 80 * a and inside(v) for (x, v), f in frequent.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def prose(seed, n):
    rng = random.Random(seed)
    some = "New York river bank of the It's\x00 ÉCOLE école 日本 a-b (x) \x01".split(" ")
    phrase = ["kind regards from us", "river bank", "of the", "the river bank of", "New York"]
    text = lambda: "".join(rng.choice([*some, *phrase]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ", "\x0b"]) for _ in range(rng.randint(0, 30)))
    return [(i, text(), rng.choice(["en", "en", "fr", None, ""]), "a") for i in range(n)]


@pytest.mark.parametrize("shape", [Shape(log2_width=20, log2_block=18, depth=1, log2_coarse=16), NARROW], ids=["wide", "narrow"])
def test_phrases_match_brute_force(spark, shape):
    data = corpus() + prose(1, 300)
    got = {tuple(r) for r in col.collocations(frame(spark, data), least=5, shape=shape).collect()}
    assert got == brute(data, 5) and len(got) > 50


def test_ranks_end_at_the_top_and_lots_add_up(spark, monkeypatch):
    monkeypatch.setattr(col, "LOT", 100)
    data = prose(2, 200)
    got = {tuple(r) for r in col.collocations(frame(spark, data, extra=False), least=4, top=3, shape=NARROW).collect()}
    assert got == brute(data, 4, top=3)


def test_one_text_repeated_and_very_long(spark):
    data = [(1, "a b c d e. " * 20_000, "en", "s")] * 3 + [(2, "x", None, None), (None, None, None, None)]
    got = {tuple(r) for r in col.collocations(frame(spark, data), shape=NARROW).collect()}
    assert got == {("en", 1, "a b c d", 60_000, 60_000, 60_000, 300_000, 1_000_000), ("en", 2, "b c d e", 60_000, 60_000, 60_000, 300_000, 1_000_000)}


def test_no_documents(spark):
    assert col.collocations(frame(spark, []), shape=NARROW).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4 * 10**15 + 1
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", 3 * big), ("en", "a b", big)], "lang string, phrase string, f long")
    one = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    assert [tuple(r) for r in col.weakest_cuts(one, counts).collect()] == [("en", "a b", big, big, 3 * big, 2_000_000 * big // (4 * big))]


def test_phrases_match_their_sql(spark):
    df = col.op13_hashed_collocations(spark, "/root/testdata/sf0.01")
    names, data = rows(df.columns, [tuple(r) for r in df.collect()])
    assert (names, data) == expected(OP13, "/root/testdata/sf0.01") and len(data) > 100
