import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meridia.llm import dominance
from tests.llm.frames import corpus, frame


def fewest(items, window):
    """The fewest windows, by trying all ways."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) < best[0]:
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in {r for r in rooms if r >= items[i]}:
                k = rooms.index(room)
                go(i + 1, rooms[:k] + [room - items[i]] + rooms[k + 1 :])
            go(i + 1, [*rooms, window - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_fewest_windows(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 20, 30, 100])
    least = rng.choice([1, window // 5, window // 4])
    items = [rng.randint(least, window) for _ in range(rng.randint(0, 10))]
    fixed, left = dominance.reduce_by_dominance(Counter(items), window)
    rest = list(Counter(left).elements())
    assert Counter(x for s, n in fixed for _ in range(n) for x in s) + Counter(rest) == Counter(items)
    best = fewest(items, window)
    assert sum(n for _, n in fixed) + fewest(rest, window) == best
    assert dominance.lower_bound(Counter(items), window) <= best <= sum(n for _, n in dominance.pack_counts(Counter(items), window))


def test_reduction_fixes_sets_of_one_two_and_three():
    fixed, left = dominance.reduce_by_dominance({95: 2, 60: 3, 40: 3, 50: 1, 31: 1, 19: 1}, 100)
    assert left == {} and sorted(fixed) == [((50, 31, 19), 1), ((60, 40), 3), ((95,), 2)]


def test_best_fit_of_counts_is_best_fit_decreasing():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 500)
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        fit = [(room, k) for k, room in enumerate(rooms) if room >= x]
        k = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(100)
        rooms[k] -= x
    sets = dominance.best_fit(Counter(lengths.tolist()), 100)
    assert sorted(rooms) == sorted(100 - sum(s) for s, n in sets for _ in range(n))
    assert Counter(x for s, n in sets for _ in range(n) for x in s) == Counter(lengths.tolist())


def test_sets_stay_few_however_many_pieces():
    rng = random.Random(2)
    counts = {x: rng.randint(1, 10**10) for x in range(1, 1025)}
    sets = dominance.pack_counts(counts)
    assert len(sets) < 4 * 1024 and len(dominance.dealing(sets)["base"]) < 16 * 1024
    assert sum(n for _, n in sets) <= 1.005 * dominance.lower_bound(counts)


@pytest.mark.parametrize("window", [16, 1024])
def test_pieces_hold_every_id_and_sequences_have_no_gaps(spark, window):
    from tokenizers import Tokenizer

    rows = corpus() + [(200, "<|endoftext|> twice <|endoftext|>", "en", "a"), (201, "a  b   c \n\n d  ", "en", "a")]
    tokenizer, ranks = dominance.default_tokenizer()
    out = dominance.pack_reduced(frame(spark, rows), tokenizer, ranks, window).toPandas()
    by_json = Tokenizer.from_file(tokenizer)
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*by_json.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % window or window
        for piece, start in enumerate([0, *range(first, len(ids), window)]):
            part = ids[start : first + piece * window]
            want[d, piece, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = zip(out.doc_id.astype(object).where(out.doc_id.notna(), None), out.piece, out.start, out.length, out.ids_crc32, out.doc_tokens, strict=True)
    assert Counter(got) == want
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.append(0, s.length.cumsum().to_numpy()[:-1])).all() and s.length.sum() <= window
    assert sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))
    assert out.sequence_id.nunique() <= dominance.lower_bound(Counter(out.length), window) + 1


def test_chunks_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer, ranks = dominance.default_tokenizer()
    by_json, fast, slow = Tokenizer.from_file(tokenizer), dominance.ChunkIds(tokenizer, ranks), dominance.ChunkIds(tokenizer, None)
    rng = random.Random(0)
    signs = ["a", "b", "É", "  ", " ", "\n", "\t", "'s", "'ll", "1", "²", "!", "　", "\xa0", "\x1c", "<|endoftext|>", "日", "😀", "\x85", "  \n", " ."]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        ids = np.array(by_json.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert fast.ids(text) == ids == slow.ids(text), repr(text)


def test_packing_nothing(spark):
    assert dominance.pack_reduced(frame(spark, []), *dominance.default_tokenizer()).collect() == []
