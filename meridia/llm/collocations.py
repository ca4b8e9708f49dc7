"""Phrase collocations by hashed a-priori counting (PCY, with DHP's pruning of what is hashed).

Pass n counts phrases of n words exactly and, in the same scan, hashes those of n + 1 words into buckets. A phrase of
n words is counted only where its bucket was filled LEAST times in the pass before and both its phrases of n - 1 words
are frequent; one of n + 1 words is hashed only where both its phrases of n words may still be. Buckets and frequent
phrases travel as bitmaps of fixed size: hashes that meet let too much by, never too little, so all counts of frequent
phrases are exact. Counts are added up lot by lot in the workers, then by Spark, keyed by the phrases themselves.

Bitmaps have ``SHAPE``'s size whatever the corpus. Once most buckets of a large corpus are full they stop to filter,
and what is left is the pruning by frequent parts; SHAPE should grow with the corpus then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import drop_settled, lean, mix64, read_table, settle, text_slices, window_hashes, word_hashes
from meridia.llm.sketch import PartitionSketch, Repeats, Shape, broadcast_repeats, merge_parts

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
COVERED = 80  # per cent of a phrase's occurrences that a longer one must have to replace it
TOP = 2000  # phrases of a language
SHAPE = Shape(log2_width=27, depth=1)  # one hash, as in PCY: 16 MiB of bits
LOT = 2_000_000  # bytes of text that are counted together
SALTS = 64  # parts of a language that are cut to TOP before they meet

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))


class Vocabulary(dict):
    """Numbers of a lot's words in order of appearance; -1 a break between pieces, -2 nothing."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": -2})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(numbers of all words in order with -1 at breaks, the words): pieces end at breaks and at texts' ends."""
    known = Vocabulary()
    cut = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
    numbers = np.fromiter(map(known.__getitem__, cut), dtype=np.int64, count=len(cut))
    return numbers[numbers > -2], list(known)[2:]


def language_hash(lang: str) -> np.uint64:
    return word_hashes([lang.encode().hex().encode() + b"."], 1)[0][0]


def phrase_hashes(words: np.ndarray, lang: np.ndarray | np.uint64, n: int) -> np.ndarray:
    """Hashes of all runs of n of these words, given their own hashes and their language's."""
    return window_hashes(mix64(words ^ lang), n)


def distinct_runs(numbers: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first places, counts) of the distinct runs of n words that start at these places; no hash is trusted."""
    key = numbers[at]
    for k in range(1, n):
        _, code = np.unique(key * (numbers.max(initial=0) + 1) + numbers[at + k], return_inverse=True)
        key = code.astype(np.int64)
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return at[first], times


COUNTED = "lang string, phrase string, n long, part int, payload binary"
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


def scan(docs: DataFrame, n: int, frequent: Callable[[], Repeats] | None, buckets: Callable[[], Repeats] | None, shape: Shape, hash_next: bool) -> DataFrame:
    """Pass n: rows (lang, phrase, n) of counts by lot, and rows (part, payload) of buckets of phrases of n + 1 words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PartitionSketch(shape)
        parts, full = (frequent(), buckets()) if n > 1 else (None, None)

        def sent(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for part, payload in rows:
                yield pa.RecordBatch.from_pylist([{"part": part, "payload": payload}], schema=_COUNTED)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for a, b, texts in text_slices(batch.column(1), LOT):
                for lang in sorted(set(langs[a:b])):
                    numbers, words = numbered_words([t for t, x in zip(texts, langs[a:b], strict=True) if x == lang])
                    if len(numbers) < n or not words:
                        continue
                    own = word_hashes([b" ".join(words)])[0][numbers]
                    code = language_hash(lang)
                    free = np.concatenate(([0], np.cumsum(numbers < 0)))
                    whole = lambda m: free[m:] == free[:-m]  # runs of m words without a break  # noqa: B023, E731
                    passed = whole(n)
                    if n > 1:
                        part = parts.repeated(phrase_hashes(own, code, n - 1))
                        passed &= part[:-1] & part[1:]
                        at = np.flatnonzero(passed)
                        passed[at] = full.repeated(phrase_hashes(own, code, n)[at])
                    first, times = distinct_runs(numbers, np.flatnonzero(passed), n)
                    phrases = [b" ".join([words[i] for i in run]).decode() for run in numbers[first[:, None] + np.arange(n)].tolist()]
                    if phrases:
                        nothing = [pa.nulls(len(phrases), t) for t in (pa.int32(), pa.binary())]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases), pa.array(times), *nothing], schema=_COUNTED)
                    if hash_next and len(passed) > 1:
                        next_at = np.flatnonzero(passed[:-1] & passed[1:])
                        yield from sent(sketch.add(phrase_hashes(own, code, n + 1)[next_at]))
        yield from sent(sketch.flush())

    return docs.mapInArrow(run, COUNTED)


def phrase_bits(phrases: DataFrame, n: int, shape: Shape) -> Callable[[], Repeats]:
    """A bitmap of phrases (lang, phrase) of n words each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PartitionSketch(shape)
        schema = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
        codes: dict[str, np.uint64] = {}
        sent = lambda rows: (pa.RecordBatch.from_pylist([{"part": p, "payload": x}], schema=schema) for p, x in rows)
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            if not langs:
                continue
            for lang in set(langs) - codes.keys():
                codes[lang] = language_hash(lang)
            words = word_hashes([t.encode() for t in texts])[0]
            lang = np.repeat(np.array([codes[x] for x in langs], dtype=np.uint64), n)
            yield from sent(sketch.add(phrase_hashes(words, lang, n)[::n]))
        yield from sent(sketch.flush())

    parts = phrases.select("lang", "phrase").mapInArrow(run, "part int, payload binary")
    return broadcast_repeats(merge_parts(parts, shape, with_counts=False, least=1), shape, with_counts=False)


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shape: Shape = SHAPE) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of the phrases of 1, 2, ... words with f >= ``least``], (lang, n): all words of a language)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    found, totals, frequent, buckets = [], None, None, None
    for n in range(1, longest + 1):
        rows = settle(scan(texts, n, frequent, buckets, shape, n < longest), "counted")
        counts = rows.where("part is null")
        if n == 1:
            totals = settle(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found.append(settle(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent"))
        if n < longest:
            frequent = phrase_bits(found[-1], n, shape)
            filled = rows.where("part is not null").select("part", "payload")
            buckets = broadcast_repeats(merge_parts(filled, shape, with_counts=False, least=least), shape, with_counts=False)
        drop_settled(rows)
    return found, totals


def joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def weakest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each candidate's cut of lowest score, the earliest of several."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w")).select(
        "lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", joined(F.col("w"), 1, F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    known = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    whole = F.expr("cast(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    least = known.groupBy("lang", "phrase", "a").agg(F.min(F.struct(whole.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates (lang, phrase, a) that no longer candidate with ``covered`` per cent of their occurrences holds."""
    words = candidates.select("lang", "a", F.split("phrase", " ").alias("w")).where("size(w) > 2")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: joined(F.col("w"), i, m))))
    longer = words.select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * big("most") < covered * big("a"))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shape: Shape = SHAPE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Null languages are ``und``, null and empty texts hold no words; repeated rows count each; a text of any length is
    counted whole; an empty table gives no rows; other columns are not read. Ties in score go to the larger count,
    then to the phrase whose UTF-8 bytes come first.
    """
    found, totals = count_phrases(docs, least, longest, shape)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    candidates = found[1]
    for part in found[2:]:
        candidates = candidates.union(part)
    scored = weakest_cuts(uncovered(candidates.withColumnRenamed("f", "a")), every)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_hashed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
