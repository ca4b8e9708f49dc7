"""N-gram Jaccard join: which documents share most of their distinct word n-grams?

Rare-first prefix filtering. A merged sketch of all n-grams orders each set, unrepeated n-grams first, then by
estimated count, then by hash; only the first n - ceil(t n) + 1 n-grams of a set (its prefix) are indexed, and of
those only the ones that may occur elsewhere: sets that match must share one. Any total order that all sets share
keeps this exact, so estimates only affect speed. Sets that share a prefix n-gram pass a length and a positional
filter, then a suffix filter on small outlines of the sets (what stands before the shared n-gram differs, and
histograms of what stands behind it bound how much of that differs). Only then do whole sets travel, and each
pair is verified once.

Equal sets are one class from the start. Within a posting list, all members are first verified against one pivot;
components of these links come next, and only pairs from different components that were not verified yet are
verified after that. So a group of near copies costs its size, not its square, and no link that joins different
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import (
    NULL_ID, components, document_key, drop_settled, fresh, lean, lower_ascii, mix64, read_table, settle, signed, text_slices, window_hashes, word_hashes,
)
from meridia.llm.sketch import PartitionSketch, Repeats, Shape, broadcast_repeats, drop_repeats, merge_parts

SHINGLE = 5
PERCENT = 75
SETS_AT_ONCE = 16_000_000  # bytes of sets that a task compares among themselves before it sends them
SKETCH = Shape(log2_width=28)  # 64 MiB of bits: false repeats only lengthen postings here
BINS = 64  # of the suffix filter's histograms, by the highest bits of the hashes
PAIR_ROWS = 256  # pairs with their sets that a verifying task reads at once
OUTLINE_ROWS = 4096


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams; a text of fewer words has one, of all its words."""
    words, counts = word_hashes([lower_ascii(t) for t in texts])
    runs = window_hashes(words, n)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(runs[at : at + count - n + 1]))
        elif count:
            out.append(window_hashes(words[at : at + count], count))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed numbers."""
    if not len(own):
        return 0, 0
    a = mix64(np.array([np.add.reduce(mix64(own))], dtype=np.uint64) + np.uint64(len(own)))
    b = mix64(np.array([np.add.reduce(mix64(own ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x2545F4914F6CDD1D))], dtype=np.uint64))
    return int(signed(a)[0]), int(signed(b)[0])


# ------------------------------------------------------------------- pass 1

_PASS1 = "doc long, tie long, n long, h1 long, h2 long, part int, payload binary"
_PASS1_ARROW = pa.schema(
    [*((x, pa.int64()) for x in ("doc", "tie", "n", "h1", "h2")), ("part", pa.int32()), ("payload", pa.binary())]
)


def _digest_and_sketch(n: int, shape: Shape):
    """Rows of two kinds: a document's digest, or a part of the partition's sketch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PartitionSketch(shape)

        def parts(rows) -> Iterator[pa.RecordBatch]:
            for part, payload in rows:
                yield pa.RecordBatch.from_pylist([{"part": part, "payload": payload}], schema=_PASS1_ARROW)

        for batch in batches:
            sizes, h1, h2 = [], [], []
            for _, _, texts in text_slices(batch.column(2)):
                sets = shingle_sets(texts, n)
                for own in sets:
                    x, y = set_digest(own)
                    sizes.append(len(own))
                    h1.append(x)
                    h2.append(y)
                yield from parts(sketch.add(np.concatenate(sets)))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 none.cast(pa.int32()), none.cast(pa.binary())],
                schema=_PASS1_ARROW,
            )
        yield from parts(sketch.flush())

    return run


# ------------------------------------------------------------------- pass 2

_ALIVE = "n long, h1 long, h2 long, grams array<long>, places array<int>, front binary, histogram binary, own binary"
_ALIVE_ARROW = pa.schema(
    [*((x, pa.int64()) for x in ("n", "h1", "h2")), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("front", pa.binary()), ("histogram", pa.binary()), ("own", pa.binary())]
)


def bins_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint8)


def prefix_of(own: np.ndarray, repeats: Repeats, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, places) of a set's prefix in the common order that may occur in another set; the whole prefix in that order."""
    counts = repeats.counts(own)
    order = np.lexsort((own, counts))
    length = len(own) - -(-percent * len(own) // 100) + 1
    front = order[:length]
    places = np.flatnonzero(counts[front] > 1)
    return own[front[places]], places, own[front]


def _index(n: int, percent: int, load):
    """The sets that may have a partner: prefix postings, outline (bins of the prefix, histogram) and hashes; equal sets of a lot once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = load()
        best: dict[tuple[int, int], tuple] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for rows in _slices(list(best.values()), 200):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ALIVE_ARROW, strict=True)], schema=_ALIVE_ARROW)

        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                for own in shingle_sets(texts, n):
                    if not len(own) or (digest := set_digest(own)) in best:
                        continue
                    grams, places, front = prefix_of(own, repeats, percent)
                    if len(grams):
                        histogram = np.bincount(bins_of(own), minlength=BINS).astype("<u4")
                        best[digest] = (len(own), *digest, signed(grams), places, bins_of(front).tobytes(), histogram.tobytes(), own.tobytes())
                        held += own.nbytes
                if held > SETS_AT_ONCE:
                    yield from sent()
                    best, held = {}, 0
        yield from sent()

    return run


def _slices(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


# ------------------------------------------------------------------- candidates and links


def required_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection at which 100 * intersection >= percent * union."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def may_link(percent: int, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length filter, and positional filter at a shared n-gram that stands at places i and j.

    At the first n-gram that two sets share, all they share stands there or later, so the rest must have room for
    the required overlap. A pair that links passes at its first shared n-gram; whether it passes at later ones
    does not matter.
    """
    length = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    room = 1 + F.least(n - i - 1, m - j - 1)
    return length & (room >= required_overlap(n, m, percent))


def suffix_passes(x: tuple[bytes, bytes, int], y: tuple[bytes, bytes, int], percent: int) -> bool:
    """May two sets link, given (histogram, bins of the prefix, place of the first shared n-gram) of each?

    None of what stands before their first shared n-gram is shared; behind it the sets differ by what their
    histograms differ there, at least.
    """
    sizes, behind = 0, []
    for histogram, front, place in (x, y):
        own = np.frombuffer(histogram, dtype="<u4").astype(np.int64)
        sizes += int(own.sum())
        behind.append(own - np.bincount(np.frombuffer(front, dtype=np.uint8, count=place + 1), minlength=BINS))
    differ = x[2] + y[2] + int(np.abs(behind[0] - behind[1]).sum())
    return differ <= sizes - 2 * -(-percent * sizes // (100 + percent))


def _jaccard(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _filtered(pairs: DataFrame, sides: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) that pass ``test(row)``, each joined to ``columns`` of its two sides; row as (pair's columns, a's, b's)."""

    @partial(lean, owner="pairs")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [test(r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    left, right = (sides.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns)) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, *(f"{k}_{c}" for k in "ab" for c in columns)).mapInArrow(run, "a long, b long")


def verified(candidates: DataFrame, sets: DataFrame, percent: int, name: str, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, pairs tried) of candidates (a, b, i, j); pairs that ``tried`` holds are left out."""
    pairs = candidates.groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("at")).select("a", "b", "at.i", "at.j")
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    outlined = _filtered(pairs, sets, ["histogram", "front"], lambda r: suffix_passes((r[4], r[5], r[2]), (r[6], r[7], r[3]), percent))
    close = settle(outlined, f"{name}-pairs", OUTLINE_ROWS)
    return settle(_filtered(close, sets, ["own"], lambda r: _jaccard(r[2], r[3], percent)), f"{name}-links", PAIR_ROWS), close


def _class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes (sets that are all different), enough to connect all that are linked."""
    postings = sets.select("node", "n", F.col("places")[0].cast("long").alias("lead"), F.explode(F.arrays_zip("grams", "places")).alias("x")).select(
        F.col("x.grams").alias("gram"), "node", "n", "lead", F.col("x.places").cast("long").alias("at")
    )
    # The pivot is the member with the fewest n-grams of its own: the text that the others are copies of, if any is.
    member = F.struct("lead", F.negative("n").alias("less"), "node", "n", "at")
    lists = postings.groupBy("gram").agg(F.min(member).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    postings = settle(postings.join(lists, "gram"), "postings")

    to_pivot = postings.where(
        (F.col("node") != F.col("pivot.node")) & may_link(percent, F.col("n"), F.col("at"), F.col("pivot.n"), F.col("pivot.at"))
    )
    ahead = F.col("node") < F.col("pivot.node")
    stars = to_pivot.select(
        F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"),
        F.when(ahead, F.col("at")).otherwise(F.col("pivot.at")).alias("i"), F.when(ahead, F.col("pivot.at")).otherwise(F.col("at")).alias("j"),
    )
    first, tried = verified(stars, sets, percent, "star")

    groups = components(first, "stars")
    own = F.coalesce("component", "node")
    placed = postings.select("gram", "node", "n", "at").join(groups, "node", "left").select("gram", "node", "n", "at", own.alias("group"))
    mixed = placed.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("gram")
    open_lists = settle(placed.join(mixed, "gram"), "open")
    drop_settled(postings)
    left, right = open_lists.alias("l"), open_lists.alias("r")
    crossing = left.join(
        right,
        (F.col("l.gram") == F.col("r.gram"))
        & (F.col("l.node") < F.col("r.node"))
        & (F.col("l.group") != F.col("r.group"))
        & may_link(percent, F.col("l.n"), F.col("l.at"), F.col("r.n"), F.col("r.at")),
    ).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.at").alias("i"), F.col("r.at").alias("j"))
    second, late = verified(crossing, sets, percent, "crossing", tried)
    links = settle(first.union(second), "all-links")
    for used in (open_lists, tried, late, first, second):
        drop_settled(used)
    return links


def ngram_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = SHINGLE, percent: int = PERCENT, shape: Shape | None = None,
    keep_keys: bool = False,
) -> DataFrame:
    """(id, n_shingles, component): each row's set size and the smallest id that links reach, itself included.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct n-word shingles. Null, empty
    and blank texts have no shingles and no links. Rows that repeat an id and a text are one document; rows that
    share an id but not a text are documents of their own; a row without id reports null as its own component unless
    a link reaches an id. Empty tables give no rows. Only the two columns are read.
    With ``keep_keys`` rows are (doc, tie, n_shingles, head): keys as in ``document_key`` and the component's first key.
    """
    shape = shape or SKETCH
    doc, tie = document_key(id_column, text_column)
    rows = docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text_column).alias("text"))
    first = settle(rows.mapInArrow(_digest_and_sketch(n, shape), _PASS1), "digests")
    load = broadcast_repeats(merge_parts(first.where("part is not null").select("part", "payload"), shape, True), shape, True)
    digests = settle(first.where("part is null").select("doc", "tie", "n", "h1", "h2"), "digests")
    drop_settled(first)
    alive = settle(
        rows.select("text").mapInArrow(_index(n, percent, load), _ALIVE).withColumn("node", F.monotonically_increasing_id()), "alive"
    )  # written once, so nodes do not change any more
    nodes = alive.groupBy("h1", "h2").agg(F.min("node").alias("node"))
    sets = settle(alive.join(nodes.select("node"), "node", "left_semi"), "sets")
    drop_settled(alive)

    groups = components(_class_links(sets, percent))
    classes = digests.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc", "tie")).alias("head"))
    linked = sets.select("node", "h1", "h2").join(groups, "node").join(classes, ["h1", "h2"]).select("h1", "h2", "component", "head")
    heads = linked.groupBy("component").agg(F.min("head").alias("least"))
    named = classes.join(linked.join(heads, "component").select("h1", "h2", "least"), ["h1", "h2"], "left").select(
        "h1", "h2", F.coalesce("least", "head").alias("head")
    )
    drop_repeats(load)
    out = digests.join(named, ["h1", "h2"], "left")
    head = F.when(F.col("n") > 0, F.col("head")).otherwise(F.struct("doc", "tie"))
    out = out.select("doc", "tie", F.col("n").alias("n_shingles"), head.alias("head"))
    if keep_keys:
        return out
    known = lambda c: F.nullif(c, F.lit(NULL_ID))
    return out.select(known(F.col("doc")).alias("id"), "n_shingles", known(F.col("head.doc")).alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that head their component: one document of each group stays, all columns as they are.

    Of rows that repeat an id and a text one stays. Rows without any word are linked with nothing and all stay.
    """
    heads = ngram_join(docs, keep_keys=True).where("n_shingles > 0 and head = struct(doc, tie)").select("doc", "tie").distinct()
    d, t, wordless = fresh(docs, "doc", "tie", "wordless")
    doc, tie = document_key("doc_id", "text")
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumns({d: doc, t: tie, wordless: blank})
    kept = keyed.where(~F.col(wordless)).join(heads.toDF(d, t), [d, t], "left_semi").dropDuplicates([d, t])
    return keyed.where(wordless).select(*docs.columns).union(kept.select(*docs.columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
