"""Word and window hashes: regular patterns must not cancel out, and rows that share an id keep apart."""

import numpy as np
import pytest

from meridia.llm import ngrams, substrings
from meridia.llm._shared import window_hashes, word_hashes
from meridia.llm.sketch import Shape
from tests.llm.frames import frame, shingles
from tests.llm.test_substrings import SMALL
from tests.llm.test_substrings import brute as brute_removals


def thue_morse(length, flip=0):
    return [(i.bit_count() + flip) % 2 for i in range(length)]


@pytest.mark.parametrize("which", [0, 1])
def test_thue_morse_strings_do_not_collide(which):
    for length in (64, 1024, 4096):
        pair = [bytes(97 + b for b in thue_morse(length, f)) for f in (0, 1)]
        hashes, counts = word_hashes(pair, which)
        assert counts.tolist() == [1, 1] and hashes[0] != hashes[1]
        words = word_hashes([b"a b"], which)[0]
        runs = [window_hashes(words[thue_morse(length, f)], length, which)[0] for f in (0, 1)]
        assert runs[0] != runs[1]


def test_documents_that_differ_in_one_long_word_keep_all(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(f, "".join("ab"[b] for b in thue_morse(4096, f)) + " " + rest, "en", "a") for f in (0, 1)]
    out = {r.id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows), shape=SMALL).collect()}
    assert out == {0: 0, 1: 0}
    linked = ngrams.ngram_join(frame(spark, [(d, t.split()[0], *r) for d, t, *r in rows]), shape=SMALL).collect()
    assert {r.id: r.component for r in linked} == {0: 0, 1: 1}


def test_hashes_depend_on_words_alone():
    texts = [b"one twelve-letters " + b"x" * 200, b"  one\n", b"", b"x" * 200 + b"\ttwelve-letters", b"\xc3\xa9t\xc3\xa9 one"]
    for which in (0, 1):
        h, counts = word_hashes(texts, which)
        assert counts.tolist() == [3, 1, 0, 2, 2]
        assert h[0] == h[3] == h[7] and h[1] == h[5] and h[2] == h[4] and len({*h[[0, 1, 2, 6]]}) == 4
    assert word_hashes([b"one"], 0)[0] != word_hashes([b"one"], 1)[0]
    words = np.arange(40, dtype=np.uint64)
    for n in (1, 2, 3, 5, 20):
        runs = window_hashes(words, n)
        assert len(np.unique(runs)) == 41 - n and runs[7] == window_hashes(words[7 : 7 + n], n)[0]
    assert window_hashes(words[:1], 1) != window_hashes(np.append(words[:1], words[:1]), 2)


def test_ids_with_two_texts(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, " ".join(a), "", ""), (5, " ".join(b), "", ""), (7, " ".join(b[:58] + ["x"]), "", ""), (3, " ".join(a[:59]), "", ""), (5, " ".join(a), "", "")]
    out = ngrams.ngram_join(frame(spark, rows), shape=SMALL).collect()
    assert sorted((r.id, r.n_shingles, r.component) for r in out) == [(3, 55, 3), (5, 56, 3), (5, 56, 3), (5, 56, 5), (7, 55, 5)]
    kept = ngrams.keep_first(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, rows[3][1]), (5, rows[1][1])])
    gone = {(r.id, r.kept): r.n_removed for r in substrings.remove_repeats(frame(spark, rows), shape=SMALL).collect()}
    assert gone == {(3, " ".join(a[:59])): 0, (5, "a59"): 59, (5, " ".join(b)): 0, (7, "x"): 58}


def test_large_ids_stay(spark):
    rows = [((1 << 62) + 9, "one two three four five six", "", ""), ((1 << 62) + 10, "One two three four five six", "", "")]
    out = ngrams.ngram_join(frame(spark, rows), shape=SMALL).collect()
    assert sorted((r.id, r.component) for r in out) == [((1 << 62) + 9, (1 << 62) + 9), ((1 << 62) + 10, (1 << 62) + 9)]


def test_the_default_shape_matches_brute_force(spark):
    base = [f"w{i}" for i in range(90)]
    rows = [(k, " ".join(base[: 40 + k] + [f"n{k}"] + base[40 + k :]), "en", "a") for k in range(12)]
    out = substrings.remove_repeats(frame(spark, rows), shape=Shape()).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_removals(rows)
    links = ngrams.ngram_join(frame(spark, rows), shape=Shape()).collect()
    assert {r.component for r in links} == {0} and all(r.n_shingles == len(shingles(rows[r.id][1])) for r in links)


def test_suffix_filter_never_rejects_a_link():
    rng = np.random.default_rng(6)
    tried = passed = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
        y = x.copy()
        y[rng.choice(len(y), rng.integers(0, 40), replace=False)] = rng.integers(0, 1 << 63, 1)
        y = np.unique(y)
        i, j = (int(np.flatnonzero(np.isin(s, o))[0]) for s, o in ((x, y), (y, x)))
        side = lambda s, k: (np.bincount(ngrams.bins_of(s), minlength=ngrams.BINS).astype("<u4").tobytes(), ngrams.bins_of(s).tobytes(), k)
        links = ngrams._jaccard(x.tobytes(), y.tobytes(), 75)
        kept = ngrams.suffix_passes(side(x, i), side(y, j), 75)
        assert kept or not links
        tried, passed = tried + (not links), passed + (kept and not links)
    assert tried > passed
