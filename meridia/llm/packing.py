"""Packing token sequences: best-fit decreasing over a segment tree indexed by remaining capacity.

Documents are tokenised once. Each is cut into full windows and a tail; pieces are dealt into groups of about
GROUP_ROWS and each group is packed by itself, so no task holds more than a group and at most one window of each
group stays poorly filled.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import lean, read_table, text_slices, worker_cache

WINDOW = 4096
END_ID = 2
GROUP_ROWS = 4096
CACHE = 400_000  # words whose ids a Python worker keeps before it tidies up
LONGEST = 24  # characters of a word that is worth remembering
SLICE = 2_000_000  # bytes of text that a worker holds as Python objects

# ------------------------------------------------------------------- packing


class CapacityTree:
    """A segment tree over remaining capacities 0 .. size: which is the smallest capacity >= need of an open window?"""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += change
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest open window that has room, removed from the tree."""
        node = self.leaves + need
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces are at most a window long, ties keep their order."""
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, where = found
        sequence[i], offset[i] = where, window - room
        if room > need:
            tree.put(room - need, where)
    return sequence, offset


# ------------------------------------------------------------------- tokens


def _byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one character: visible Latin-1 as itself, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SIGNS = _byte_signs()

# Plain characters: composed ones that fold one by one. Texts with others, or with what may begin a special token,
# go to the tokenizer whole.
_PLAIN = [
    c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x180), *range(0x2010, 0x2028), 0x20AC])
    if c != "\u0130" and unicodedata.normalize("NFC", c) == c
]
_OTHER = re.compile(f"[^{re.escape(''.join(_PLAIN))}]|<\\|")


def _class(kind: str) -> str:
    return re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind))


# The tokenizer's own rule for cutting lower-cased text, for plain characters.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")


class WordIds(dict):
    """Ids of chunks without white space, and of their pieces (a piece's ids are those of a chunk of that piece alone), remembered.

    The tokenizer composes (NFC), lower-cases, drops white space, cuts at class changes and merges within each
    piece by itself. So a plain text's ids are those of its chunks' pieces in turn, each merged by the tokenizer's
    own model once for as long as it is remembered.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join(map(_SIGNS.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        parts = _PIECE.findall(chunk)
        if len(parts) == 1:
            return self.piece(chunk)
        known, piece = self.get, self.piece
        ids = b"".join([known(p) or piece(p) for p in parts])
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def trim(self) -> None:
        """Forget what a full memory holds of long words, and all of it where short ones alone fill half."""
        if len(self) > CACHE:  # short words are the common ones
            short = {c: ids for c, ids in self.items() if len(c) <= 8}
            self.clear()
            self.update(short if len(short) <= CACHE // 2 else {})


def batch_ids(texts: list[str], words: WordIds) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    words.trim()
    for text in texts:
        if _OTHER.search(text):
            yield np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            yield b"".join(map(words.__getitem__, text.lower().split()))


def load_words(path: str) -> WordIds:
    kept = worker_cache(f"tokenizer {path}")
    if path not in kept:
        from tokenizers import Tokenizer

        kept[path] = WordIds(Tokenizer.from_file(path))
    return kept[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def token_pieces(docs: DataFrame, id_column: str, text_column: str, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and the end id, cut into full windows and a tail: (doc_id, start, length, ids_crc32, doc_tokens)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_words(tokenizer)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), SLICE):
                rows = []
                for key, ids in zip(keys[a:b], batch_ids([t.decode() for t in texts], words), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part = ids[4 * start : 4 * (start + window)]
                        rows.append((key, start, len(part) // 4, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECES)

    return docs.select(id_column, text_column).mapInArrow(run, PIECES)


PACKED = PIECES + ", sequence_id long, offset long"


def pack_pieces(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces of at most a window; groups are packed apart.

    Sequence ids are group * 2**32 + window of the group. Pieces are dealt by content and by their place in the scan,
    so repeated rows spread over all groups.
    """

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        sequence, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
        first = rows.column("group")[0].as_py() << 32
        return rows.drop_columns("group").append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; null ids are kept; an empty table
    gives no rows; other columns are not read. Pieces of one text may stand in different sequences.
    """
    groups = max(1, docs.count() // GROUP_ROWS)
    return pack_pieces(token_pieces(docs, "doc_id", "text", tokenizer, window), groups, window)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
