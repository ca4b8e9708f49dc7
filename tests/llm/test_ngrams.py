import random

import numpy as np
import pytest

from meridia.llm import ngrams
from meridia.llm._shared import components
from meridia.llm.sketch import Shape
from tests.llm.frames import corpus, frame, shingles

SMALL = Shape(log2_width=16, log2_block=12, log2_coarse=10)


def brute(rows):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y) and root[a] > root[b]:
                    root[a], changed = root[b], True
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_matches_brute_force_on_awkward_rows(spark):
    rows = corpus()
    out = ngrams.ngram_join(frame(spark, rows), shape=SMALL).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    assert {r.id: (r.n_shingles, r.component) for r in out if r.id is not None} == expected
    anonymous = sorted((r.n_shingles, r.component) for r in out if r.id is None and r.n_shingles)
    assert anonymous == [(len(shingles(rows[0][1])), 0)]


def test_groups_of_near_copies_and_chains(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows, text = [], list(base)
    for i in range(60):
        text = list(text) if i % 3 else list(base)
        text[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(text), "en", "a"))
    out = ngrams.ngram_join(frame(spark, rows), shape=SMALL).collect()
    assert {r.id: (r.n_shingles, r.component) for r in out} == brute(rows)


def test_exact_threshold(spark):
    a = " ".join(f"a{i}" for i in range(18))  # 14 shingles
    b = " ".join([f"a{i}" for i in range(16)] + ["x", "y"])  # shares 12 of 16: exactly 75
    c = " ".join([f"a{i}" for i in range(15)] + ["p", "q", "r"])  # shares 11 of 17 with a
    out = ngrams.ngram_join(frame(spark, [(2, a, "", ""), (1, b, "", ""), (0, c, "", "")]), shape=SMALL)
    assert {r.id: r.component for r in out.collect()} == {k: v[1] for k, v in brute([(2, a), (1, b), (0, c)]).items()}


def test_keep_first_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = ngrams.keep_first(frame(spark, rows)).collect()
    heads = {d for d, (_, c) in brute(rows).items() if d == c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(heads)
    assert set(kept[0].asDict()) == set(frame(spark, rows).columns)


def test_empty_table(spark):
    assert ngrams.ngram_join(frame(spark, []), shape=SMALL).collect() == []


def test_short_and_long_hashes_agree():
    one, two = ngrams.shingle_sets([b"a b c d e f", b"A b\tc d  e f"], 5)
    assert np.array_equal(one, two) and len(one) == 2
    assert len(ngrams.shingle_sets([b"a b"], 5)[0]) == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, 100 + i) for i in range(1, 20)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {x: x for e in links for x in e}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}
