"""Count-min sketches of 64-bit hashes over a whole table, built by partition and merged by block.

A partition's counters are sparse, so it sends, for each block of counters, the touched places as varint gaps
(about a byte each). Blocks are merged counter by counter in a streaming pass that holds one block at a time. What
comes back is one bit for each counter, "counted twice or more", and optionally a coarse table of counts; both
have a fixed size (``Shape``), whatever the input: that is the bound on what is broadcast.

Counters only overestimate: a hash whose bits are not all set occurs once at most, so nothing repeated is lost.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridia.llm._shared import drop_settled, lean, settle, worker_cache

ROWS_AT_ONCE = 1_000_000  # hashes that a partition gathers before it sends them


@dataclass(frozen=True)
class Shape:
    """Two rows of 2**log2_width counters in blocks of 2**log2_block; 2 * 2**log2_width / 8 bytes of bits."""

    log2_width: int = 29
    log2_block: int = 23
    depth: int = 2
    log2_coarse: int = 22

    def places(self, hashes: np.ndarray, row: int) -> np.ndarray:
        factor = np.uint64((1, 0x9FB21C651E98DF25)[row])
        return (hashes * factor >> np.uint64(64 - self.log2_width)).astype(np.uint32)


def pack_gaps(gaps: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as bytes of 7 bits, the lowest first."""
    gaps = gaps.astype(np.uint32)
    size = np.ones(len(gaps), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += gaps >= np.uint32(1 << bits)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    start = end - size
    for k in range(5):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        low = (gaps[some] >> np.uint32(7 * k)) & np.uint32(127)
        out[start[some] + k] = low | ((size[some] > k + 1).astype(np.uint32) << np.uint32(7))
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    last = raw < 128
    start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start)


class PartitionSketch:
    """What one partition has counted since it last sent; rows (part, payload), part = row of counters and block."""

    def __init__(self, shape: Shape):
        self.shape, self.held, self.n = shape, [], 0
        worker_cache("counting")  # drops what earlier queries kept

    def add(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.held.append(hashes)
        self.n += len(hashes)
        if self.n >= ROWS_AT_ONCE:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        hashes = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint64)
        self.held, self.n = [], 0
        if not len(hashes):
            return
        shape = self.shape
        for row in range(shape.depth):
            places = np.sort(shape.places(hashes, row))
            first = np.flatnonzero(np.diff(places, prepend=places[0] ^ np.uint32(1)))
            times = np.minimum(np.diff(first, append=len(places)), 255).astype(np.uint8)
            places = places[first]
            blocks = places >> np.uint32(shape.log2_block)
            cut = np.flatnonzero(np.diff(blocks, prepend=blocks[0] ^ np.uint32(1)))
            for a, b in zip(cut, np.append(cut[1:], len(blocks)), strict=True):
                inside = places[a:b] & np.uint32((1 << shape.log2_block) - 1)
                gaps = pack_gaps(np.diff(inside, prepend=np.uint32(0)))
                more = np.flatnonzero(times[a:b] > 1)
                extra = pack_gaps(np.diff(more, prepend=0))
                payload = struct.pack("<II", len(gaps), len(extra)) + gaps + extra + times[a:b][more].tobytes()
                yield row << 16 | int(blocks[a]), payload


def read_payload(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, times counted there)."""
    n_gaps, n_extra = struct.unpack_from("<II", payload)
    places = np.cumsum(unpack_gaps(payload[8 : 8 + n_gaps]))
    times = np.ones(len(places), dtype=np.uint16)
    more = np.cumsum(unpack_gaps(payload[8 + n_gaps : 8 + n_gaps + n_extra]))
    times[more] = np.frombuffer(payload, dtype=np.uint8, offset=8 + n_gaps + n_extra)
    return places, times


@dataclass
class Repeats:
    """A merged sketch: which counters were counted twice or more, and coarse counts of those that were."""

    shape: Shape
    bits: list[np.ndarray]
    coarse: np.ndarray | None

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """May these hashes occur twice or more in the table? Never false for one that does."""
        found = np.ones(len(hashes), dtype=bool)
        for row, bits in enumerate(self.bits):
            places = self.shape.places(hashes, row)
            found &= (bits[places >> np.uint32(3)] >> (places & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return found

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts, at most 255; 1 where a hash is not repeated."""
        places = self.shape.places(hashes, 0) >> np.uint32(self.shape.log2_width - self.shape.log2_coarse)
        return np.where(self.repeated(hashes), np.maximum(self.coarse[places], 2), 1)


MERGED = "part int, bits binary, coarse binary"


def merge_parts(parts: DataFrame, shape: Shape, with_counts: bool, least: int = 2) -> DataFrame:
    """Merge rows (part, payload) into one row per block of counters; a task streams through its payloads.

    A bit is set where its counter reaches ``least`` (at most 255); 2 tells what may be repeated.
    """
    size = 1 << shape.log2_block
    fold = 1 << (shape.log2_width - shape.log2_coarse)  # neighbouring counters share a coarse one

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counters = None, np.zeros(0, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            bits = np.packbits(counters >= least, bitorder="little").tobytes()
            coarse = np.where(counters >= 2, counters, 0).reshape(-1, fold).max(axis=1).tobytes() if with_counts else b""
            row = {"part": part, "bits": zlib.compress(bits, 1), "coarse": zlib.compress(coarse, 1)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("bits", pa.binary()), ("coarse", pa.binary())]))

        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != part:
                    if part is not None:
                        yield done()
                    part, counters = key, np.zeros(size, dtype=np.uint8)
                places, times = read_payload(payload)
                counters[places] = np.minimum(counters[places] + times, 255)
        if part is not None:
            yield done()

    n = shape.depth << (shape.log2_width - shape.log2_block)
    return parts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, MERGED)


def broadcast_repeats(merged: DataFrame, shape: Shape, with_counts: bool) -> Callable[[], Repeats]:
    """Broadcast a merged sketch. At most 2 * 2**log2_width / 8 bytes pass the driver, compressed; each Python
    worker unpacks them once and keeps them for later tasks of the same query."""
    merged = settle(merged, "sketch")
    rows = [(r.part, bytes(r.bits), bytes(r.coarse)) for r in merged.toLocalIterator()]
    drop_settled(merged)
    sent = merged.sparkSession.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    def load() -> Repeats:
        kept = worker_cache(f"sketch {name}")
        held = kept.get(name)
        if held is None:
            bits = [np.zeros(1 << (shape.log2_width - 3), dtype=np.uint8) for _ in range(shape.depth)]
            coarse = np.zeros(1 << shape.log2_coarse, dtype=np.uint8) if with_counts else None
            step = 1 << (shape.log2_block - 3)
            for part, packed, folded in sent.value:
                row, block = part >> 16, part & 0xFFFF
                bits[row][block * step : (block + 1) * step] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
                if with_counts and row == 0:
                    own = np.frombuffer(zlib.decompress(folded), dtype=np.uint8)
                    coarse[block * len(own) : (block + 1) * len(own)] = own
            held = kept[name] = Repeats(shape, bits, coarse)
            vars(sent).pop("_value", None)  # the packed form is not needed again
        return held

    load.sent = sent
    return load


def drop_repeats(load: Callable[[], Repeats]) -> None:
    """Free a broadcast sketch on the driver and the executors, once everything made with it is written down."""
    load.sent.destroy()
