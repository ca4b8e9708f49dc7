"""Bin packing of all pieces at once: Martello and Toth's dominance reduction, then best fit for what it leaves.

Which pieces share a sequence depends on their lengths alone, and there are no more lengths than tokens in a window. So
Spark counts the pieces of each length, at most WINDOW rows whatever the corpus; the reduction and the best fit work on
these counts, many equal sets at a time; and Spark deals the pieces, numbered within their length, to the places of
the sets. One instance holds the whole corpus: no group is packed apart and no sequence stays open at a group's end.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import lean, read_table, settle, text_slices, worker_cache

WINDOW = 1024
END_ID = 2
CACHE = 150_000  # chunks whose ids a Python worker keeps before it tidies up
LONGEST = 16  # characters of a chunk that is worth remembering
SLICE = 2_000_000  # bytes of text that a worker holds as Python objects

# ------------------------------------------------------------------- sets of lengths

Sets = list[tuple[tuple[int, ...], int]]  # (lengths that share a sequence, how many such sequences)


class Stock:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, lengths: tuple[int, ...]) -> int:
        """Remove this set as often as it is there; how often."""
        times = min(self.left.get(x, 0) // lengths.count(x) for x in lengths)
        for x in lengths:
            self.left[x] -= times
            if not self.left[x]:
                del self.left[x]
                self.lengths.remove(x)
        return times

    def without(self, length: int) -> Stock:
        """The same with one piece of this length less."""
        other = Stock({})
        other.left, other.lengths = dict(self.left), self.lengths
        other.left[length] -= 1
        if not other.left[length]:
            other.lengths = [x for x in self.lengths if x != length]
        return other

    def largest(self, room: int) -> int:
        """The largest length of at most ``room``, 0 if there is none."""
        k = bisect_left(self.lengths, room + 1)
        return self.lengths[k - 1] if k else 0

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The n smallest pieces longer than ``above``, repeats included."""
        k = bisect_left(self.lengths, above + 1)
        return list(islice((x for length in self.lengths[k : k + n] for x in [length] * min(n, self.left[length])), n))

    def best_pair(self, room: int) -> tuple[int, int]:
        """(a, b), a >= b, two pieces of the largest sum that is at most ``room``; there must be two that fit."""
        best, low, high = (0, 0), 0, bisect_left(self.lengths, room + 1) - 1
        while low <= high:
            a, b = self.lengths[high], self.lengths[low]
            if a + b > room or (low == high and self.left[a] < 2):
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            low += 1
        return best


def dominating(stock: Stock, length: int, window: int) -> tuple[int, ...] | None:
    """A set with a piece of this length that dominates every other set with it, where one of at most three is known.

    A set dominates another if the other's pieces can be dealt to its pieces without any overflowing: some best
    packing then holds it.
    """
    room = window - length
    others = stock.without(length)
    top = others.largest(room)
    if not top:
        return (length,)
    small = others.smallest(3)
    if top == room or len(small) < 2 or small[0] + small[1] > room:  # it fills the window, or one more piece fits at most
        return (length, top)
    if len(small) == 3 and sum(small) <= room:
        return None  # three others may fit: no rule
    a, b = others.best_pair(room)
    if top >= a + b:
        return (length, top)
    if top == a:  # every pair with a piece of at most b is dominated; are there pairs of longer ones?
        beside = others.without(a).smallest(2, above=b)
        if len(beside) < 2 or sum(beside) > room:
            return (length, a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], window: int) -> tuple[Sets, dict[int, int]]:
    """(sets that some best packing holds, counts of the pieces that are left): Martello and Toth's reduction.

    Lengths are tried from the longest down, again and again until none has a dominating set. Taking a set away only
    shrinks what its rule compared it with, so it is taken as often as its pieces are there.
    """
    stock, fixed, moved = Stock(counts), [], True
    while moved:
        moved = False
        for length in sorted(stock.left, reverse=True):
            while stock.left.get(length) and (found := dominating(stock, length, window)):
                fixed.append((found, stock.take(found)))
                moved = True
    return fixed, stock.left


def best_fit(counts: dict[int, int], window: int) -> Sets:
    """Best-fit decreasing on counts. Equal pieces fill a window as far as they can before they go to the next one,
    which the rule of the tightest window says too; windows with the same contents are handled as one."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            fit, rest = room // length, []
            for held, times in by_room.pop(room):
                full = min(times, left // fit)
                left -= full * fit
                part = left if full < times else 0
                for put, n in ((fit, full), (part, 1 if part else 0), (0, times - full - (1 if part else 0))):
                    if n and put:
                        by_room.setdefault(room - put * length, []).append((held + (length,) * put, n))
                    elif n:
                        rest.append((held, n))
                left -= part
            if rest:
                by_room[room] = rest
            if not left:
                break
        fit = window // length
        for put, n in ((fit, left // fit), (left % fit, 1 if left % fit else 0)):
            if n:
                by_room.setdefault(window - put * length, []).append(((length,) * put, n))
    return [s for sets in by_room.values() for s in sets]


def pack_counts(counts: dict[int, int], window: int = WINDOW) -> Sets:
    """Sets of lengths, each with the number of sequences that hold it; together all pieces."""
    fixed, left = reduce_by_dominance(counts, window)
    return fixed + best_fit(left, window)


def lower_bound(counts: dict[int, int], window: int = WINDOW) -> int:
    """Martello and Toth's bound L2: no packing has fewer sequences."""
    counts = {length: n for length, n in counts.items() if n}
    best = -(-sum(length * n for length, n in counts.items()) // window)
    for k in {0, *(x for x in counts if 2 * x <= window)}:
        large = sum(n for x, n in counts.items() if x > window - k)
        middle = {x: n for x, n in counts.items() if window - k >= x > window / 2}
        small = sum(x * n for x, n in counts.items() if window / 2 >= x >= k)
        over = small - (window * sum(middle.values()) - sum(x * n for x, n in middle.items()))
        best = max(best, large + sum(middle.values()) + max(0, -(-over // window)))
    return best


def dealing(sets: Sets) -> dict[str, np.ndarray]:
    """How pieces numbered within their length are dealt: one row per set and length in it, by length and first number.

    ``first``: the first number that goes there; ``copies`` pieces go to each of the set's sequences, which are
    numbered from ``base``; the first of them starts at ``offset``.
    """
    rows, following, base = [], {}, 0
    for lengths, times in sets:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            first = following.get(length, 0)
            rows.append((length, first, copies, base, offset))
            following[length] = first + copies * times
            offset += copies * length
        base += times
    rows.sort()
    return dict(zip(("length", "first", "copies", "base", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T.copy(), strict=True))


# ------------------------------------------------------------------- tokens

_ACROSS = re.compile(r"\s\x20(?:\s|\Z)")  # a space that is neither the first nor the last of a run of white space


class ChunkIds(dict):
    """Ids of texts by a byte-level tokenizer, chunk by chunk between spaces; short chunks are remembered.

    The tokenizer cuts before every space that follows no white space, and before a run's last space where a word
    follows, and its cuts depend on nothing before them. So a text's ids are those of its chunks, each with the space
    before it, unless a space stands inside a run. Such texts, and texts that hold a special token, go whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(tokenizer)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.encode = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        if ranks:
            import public_tokenizers

            with open(ranks, "rb") as lines:
                held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), dtype="<u4").tobytes()
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _ACROSS.search(text):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, rest))

    def trim(self) -> None:
        if len(self) > CACHE:  # short chunks are the common ones
            for chunk in [c for c in self if len(c) > 6]:
                del self[chunk]
            if len(self) > CACHE // 2:
                self.clear()


def load_chunks(tokenizer: str, ranks: str | None) -> ChunkIds:
    kept = worker_cache(f"tokenizer {tokenizer}")
    if tokenizer not in kept:
        kept[tokenizer] = ChunkIds(tokenizer, ranks)
    return kept[tokenizer]


def cut(n: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of n ids: whole windows from the end, so that the first one may be shorter."""
    start = 0
    for end in range(n % window or window, n + 1, window):
        yield start, end
        start = end


PIECES = "part long, number long, doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(c, pa.int32() if kind == "int" else pa.int64()) for c, kind in (x.split() for x in PIECES.split(", "))])


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, window: int, end_id: int) -> DataFrame:
    """The pieces of every document; ``number`` counts those of one length within a task, ``part`` is the task's."""
    end = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = load_chunks(tokenizer, ranks), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), SLICE):
                chunks.trim()
                rows = []
                for key, text in zip(keys[a:b], texts, strict=True):
                    ids = memoryview(chunks.ids(text.decode()) + end)
                    n = len(ids) // 4
                    for piece, (start, stop) in enumerate(cut(n, window)):
                        length = stop - start
                        rows.append((part, seen[length], key, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), n))
                        seen[length] += 1
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long"


def deal(numbered: DataFrame, table: dict[str, np.ndarray]) -> DataFrame:
    """Give each piece, numbered within its length, its sequence and offset by ``dealing``'s table."""
    sent = numbered.sparkSession.sparkContext.broadcast(table)
    names = [x.split()[0] for x in PACKED.split(", ")]

    @partial(lean, owner="dealing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        begin = np.searchsorted(t["length"], np.arange(int(t["length"].max(initial=0)) + 2))
        at = t["length"].astype(np.int64) << 50 | t["first"]  # lengths are below 2**13, numbers below 2**50
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            row = np.searchsorted(at, length << 50 | number, side="right") - 1
            assert (row >= begin[length]).all()
            place = number - t["first"][row]
            found = {
                "sequence_id": pa.array(t["base"][row] + place // t["copies"][row]),
                "offset": pa.array(t["offset"][row] + place % t["copies"][row] * length),
            }
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in names], names=names)

    return numbered.mapInArrow(run, PACKED)


def pack_reduced(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens.

    Documents of more than ``window`` ids (the end id included) are cut into whole windows, counted from their end, so
    their first piece may be shorter; others stay whole. Sequences are numbered from 0 without gaps. A null or empty
    text is the end id alone; repeated rows are packed each; null ids are kept; an empty table gives no rows; other
    columns are not read. ``ranks``: the tokenizer's vocabulary as ranks, for a faster encoder with equal ids.

    The driver holds counts by length (``window`` rows at most) and the table of sets: best fit adds at most two
    kinds of sets a length and each reduction uses up a length, so some thousands of rows, whatever the corpus.
    """
    pieces = settle(token_pieces(docs, tokenizer, ranks, window, end_id), "numbered")
    by_part = settle(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "parts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["length", "part"]).withColumn("number", F.col("number") + F.col("before"))
    return deal(numbered, dealing(pack_counts(counts, window)))


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_reduced(read_table(spark, sf_dir, "documents"), *default_tokenizer())
