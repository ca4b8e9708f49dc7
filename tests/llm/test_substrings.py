from meridia.llm import substrings
from meridia.llm.sketch import PartitionSketch, Shape, pack_gaps, read_payload, unpack_gaps
from tests.llm.frames import corpus, frame, split_words

import numpy as np

SMALL = Shape(log2_width=16, log2_block=12, log2_coarse=10)


def brute(rows, n=20):
    seen, out = set(), {}
    docs = {}
    for d, t, *_ in rows:
        if d is not None:
            docs[d] = split_words(t)
    for d in sorted(docs):
        w, gone = docs[d], set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone.update(range(i, i + n))
            seen.add(k)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    out = substrings.remove_repeats(frame(spark, rows), shape=SMALL).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    for r in out:
        if r.id is not None:
            assert (r.n_words, r.n_removed, r.kept) == expected[r.id]
        elif r.n_words:  # the copy without an id comes after all others and goes
            assert r.n_removed == r.n_words


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, []), shape=SMALL).collect() == []


def test_a_saturated_sketch_loses_nothing(spark):
    rows = corpus(8)
    tiny = Shape(log2_width=8, log2_block=6, log2_coarse=4)
    out = {r.id: r.kept for r in substrings.remove_repeats(frame(spark, rows), shape=tiny).collect()}
    assert {d: out[d] for d in out if d is not None} == {d: v[2] for d, v in brute(rows).items()}


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    for top in (2, 127, 128, 1 << 14, 1 << 30):
        x = rng.integers(0, top, 1000)
        assert np.array_equal(unpack_gaps(pack_gaps(x)), x)
    assert len(unpack_gaps(b"")) == 0


def test_partition_sketch_counts():
    h = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    sketch = PartitionSketch(SMALL)
    assert list(sketch.add(np.concatenate([h, h[:100], h[:10]]))) == []
    total = {0: np.zeros(1 << 16, int), 1: np.zeros(1 << 16, int)}
    for part, payload in sketch.flush():
        places, times = read_payload(payload)
        total[part >> 16][(part & 0xFFFF) * 4096 + places] += times
    for row in (0, 1):
        at = SMALL.places(h, row)
        assert total[row].sum() == 610 and (total[row][at[:10]] >= 3).all() and (total[row][at] >= 1).all()
