"""Exact removal of repeated passages: windows of words, a count-min prefilter, exact grouping of what it lets by.

Pass 1 sketches all windows. Pass 2 groups exactly only the windows that the merged sketch estimates repeated. In
each lot of texts all but the first place of a window are settled on the spot, so one row for each window and lot is
shuffled, however often a passage repeats. Pass 3 joins the removals to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import document_key, lean, mix64, read_table, signed, text_slices, window_hashes, word_hashes
from meridia.llm.sketch import PartitionSketch, Shape, broadcast_repeats, merge_parts

WINDOW = 20
SETTLED_AT_ONCE = 750_000  # windows that a task compares among themselves before it sends them


def _windows(texts: list[bytes], n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each, start of each) of all windows that lie within one text."""
    words, counts = word_hashes(texts, which)
    hashes = window_hashes(words, n, which)
    row = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.flatnonzero(start[: len(hashes)] + n <= counts[row[: len(hashes)]])
    return hashes[inside], row[inside], start[inside]


def _sketch(n: int, shape: Shape):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PartitionSketch(shape)

        def send(rows) -> Iterator[pa.RecordBatch]:
            for part, payload in rows:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                yield from send(sketch.add(_windows(texts, n)[0]))
        yield from send(sketch.flush())

    return run


# place: 32 bits of the second hash above the start (31 bits). Where bit 31 is set the row is settled: the windows from
# the start on, as many as the upper 32 bits say, are removals; its key is only there to spread such rows.
REMOVALS = "key long, place long, doc long, tie long"
_REMOVALS = pa.schema([(x.split()[0], pa.int64()) for x in REMOVALS.split(", ")])
_SETTLED = 1 << 31


def _settle_lot(hashes: np.ndarray, check: np.ndarray, at: np.ndarray, docs: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
    """One row for the first place of each window; the later places, which are removals for sure, as runs.

    ``at`` is a row's number << 31 | start; docs and ties are the rows' keys, and rows that repeat them are one document.
    """
    order = np.lexsort((ties, docs))
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (np.diff(docs[order]) != 0) | (np.diff(ties[order]) != 0)
    number = np.empty(len(docs), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    docs, ties = docs[order[new]], ties[order[new]]
    at = number[at >> 31] << 31 | at & (_SETTLED - 1)
    order = np.lexsort((at, check, hashes))
    hashes, check, at = hashes[order], check[order], at[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    later = np.unique(at[at != at[first][np.cumsum(new) - 1]])
    first = first[np.argsort(at[first])]  # neighbours share their document, so shuffled rows compress
    head = np.flatnonzero(np.append(True, later[1:] != later[:-1] + 1)) if len(later) else np.zeros(0, dtype=np.int64)
    run = np.diff(np.append(head, len(later)))
    later = later[head]
    place = np.concatenate([check[first].astype(np.int64) << 32 | at[first] & (_SETTLED - 1), run << 32 | _SETTLED | later & (_SETTLED - 1)])
    which = np.concatenate([at[first], later]) >> 31
    key = np.concatenate([signed(hashes[first]), signed(mix64(later.astype(np.uint64)))])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, place, docs[which], ties[which])], schema=_REMOVALS)


def _candidates(n: int, load):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = load()
        lot, rows, held = [], 0, 0

        def settled() -> pa.RecordBatch:
            return _settle_lot(*(np.concatenate(x) for x in zip(*lot, strict=True)))

        for batch in batches:
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in text_slices(batch.column(2)):
                hashes, row, start = _windows(texts, n)
                some = np.flatnonzero(repeats.repeated(hashes))
                if len(some):
                    check = signed(_windows(texts, n, 1)[0][some]).astype(np.int32)
                    used, own = np.unique(row[some], return_inverse=True)
                    lot.append((hashes[some], check, (rows + own) << 31 | start[some], docs[a:b][used], ties[a:b][used]))
                    rows += len(used)
                    held += len(some)
                if held > SETTLED_AT_ONCE:
                    yield settled()
                    lot, rows, held = [], 0, 0
        if lot:
            yield settled()

    return run


def repeated_places(docs: DataFrame, n: int = WINDOW, shape: Shape | None = None) -> DataFrame:
    """(doc, tie, start, run): windows start .. start + run - 1 of a document whose words also start earlier.

    ``docs`` has doc and tie (``document_key``) and text, none of them null. Windows are told apart by 96 bits of two
    independent hashes. The sketch of shape ``shape`` (128 MiB of bits by default) is all that is broadcast; more
    windows than it can tell apart make the exact grouping larger, never wrong.
    """
    shape = shape or Shape()
    load = broadcast_repeats(merge_parts(docs.select("text").mapInArrow(_sketch(n, shape), "part int, payload binary"), shape, False), shape, False)
    found = docs.select("doc", "tie", "text").mapInArrow(_candidates(n, load), REMOVALS)
    start, settled = F.col("place").bitwiseAND(F.lit(_SETTLED - 1)), F.col("place").bitwiseAND(F.lit(_SETTLED)) != 0
    above = F.shiftright("place", 32)
    first = Window.partitionBy("key", above, settled).orderBy("doc", "tie", start)
    later = found.withColumn("rank", F.rank().over(first)).where(settled | (F.col("rank") > 1))
    return later.select("doc", "tie", start.cast("int").alias("start"), F.when(settled, above).otherwise(F.lit(1)).cast("int").alias("run"))


def with_removals(docs: DataFrame, id_column: str, text_column: str, n: int = WINDOW, shape: Shape | None = None) -> DataFrame:
    """All rows as (id, text, removals array<struct<start, run>>); no column but the two is read."""
    doc, tie = document_key(id_column, text_column)
    rows = docs.select(doc.alias("doc"), tie.alias("tie"), F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    places = repeated_places(rows, n, shape)
    lists = places.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "run")).alias("removals"))
    return rows.join(lists, ["doc", "tie"], "left").select("id", "text", "removals")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WINDOW, shape: Shape | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): every text without its repeated passages, words joined by one space.

    A null text has no words; texts shorter than a window stay whole; rows that repeat an id and a text are one
    document and keep the same words; rows that share an id but not a text are documents of their own, in the order
    of their texts' hashes; documents without id come after all others; empty tables give no rows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            starts, runs = (lists.values.field(k).to_numpy() for k in ("start", "run"))
            filled = lists.is_valid().to_numpy(zero_copy_only=False)
            for first, last, texts in text_slices(batch.column(1)):
                counts, removed, kept = [], [], []
                for i, text in enumerate(texts, first):
                    words = text.split()
                    counts.append(len(words))
                    if filled[i] and ends[i + 1] > ends[i]:
                        s, r = starts[ends[i] : ends[i + 1]].astype(np.int64), runs[ends[i] : ends[i + 1]].astype(np.int64)
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(change, s, 1)
                        np.add.at(change, np.minimum(len(words), s + r + n - 1), -1)
                        stay = np.cumsum(change[:-1]) == 0
                        words = [w for w, k in zip(words, stay, strict=True) if k]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return with_removals(docs, id_column, text_column, n, shape).mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
