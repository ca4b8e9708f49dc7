"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their inner product reaches a threshold, that is, when it lies in
a spherical cap. Directions are all pairs of words from two small random codes, one for each half of the
dimensions, so a vector's filters are list-decoded from two short lists of inner products instead of one long one.
Below SMALL dimensions random caps miss pairs, so there the caps are the cells of a grid, which miss none.
Vectors that share a filter are compared exactly, and a pair counts at its smallest common filter only. Equal
vectors are one class with a multiplicity; buckets beyond CHUNK members are compared chunk by chunk. Sorted buckets
stream through a task and many small ones are multiplied at once. Per member only a count and one link go on, so
copies never become pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import NULL_ID, components, drop_settled, read_table, settle

MIN_COSINE = 0.98
FILTERS = 12  # that a vector passes on average
LEAST = 12  # that every vector gets with codes of 16 words: its best ones where fewer reach the threshold
MORE = 2  # by which that grows whenever the words double, as a larger code splits close pairs more often
CHUNK = 1024  # members of a bucket that are compared at once with as many others
STEP = 256  # vectors that are decoded at once
SMALL = 8  # dimensions below which caps are cells of a grid: every pair shares one
BEST = 32  # words of each half whose sums are looked at together; what else reaches the bar is found one by one
PAIRS_AT_ONCE = 100_000


@lru_cache(maxsize=8)
def product_code(dimensions: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codes of random unit vectors, one for each half of the dimensions (the same on every executor)."""
    half = -(-dimensions // 2)
    codes = []
    for k, width in enumerate((half, dimensions - half)):
        g = np.random.default_rng([dimensions, words, k]).standard_normal((words, width))
        codes.append(g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12))
    return codes[0], codes[1]


def least_filters(words: int) -> int:
    """How many filters every vector gets; so few pairs at MIN_COSINE share none that codes of all sizes miss alike."""
    return LEAST + MORE * max(0, words.bit_length() - 5)


def _decode_one(a: np.ndarray, b: np.ndarray, bar: float, words: int) -> np.ndarray:
    """All filters of one vector whose two inner products sum to the bar at least."""
    order_a, order_b = np.argsort(-a), np.argsort(-b)
    a, b = a[order_a], b[order_b]
    reach = np.searchsorted(-b, a - bar, side="right")  # how many words of half 2 go with each word of half 1
    k = int(np.argmin(reach > 0)) if (reach == 0).any() else len(a)
    i = np.repeat(np.arange(k), reach[:k])
    j = np.arange(len(i)) - np.repeat(np.cumsum(reach[:k]) - reach[:k], reach[:k])
    return np.sort(order_a[i] * words + order_b[j])


def decode_filters(x: np.ndarray, words: int) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all filters (word of half 1 * words + word of half 2) in whose cap it lies."""
    first, second = product_code(x.shape[1], words)
    half = first.shape[1]
    need = math.sqrt(2) * NormalDist().inv_cdf(1 - min(0.4, FILTERS / words**2)) / math.sqrt(x.shape[1])
    least = least_filters(words)
    best = min(words, max(BEST, least + 1))  # the ``least`` best sums are among these words'
    out: list[np.ndarray] = []
    for k in range(0, len(x), STEP):
        one, two = x[k : k + STEP, :half] @ first.T, x[k : k + STEP, half:] @ second.T
        top = [np.argpartition(-y, best - 1, axis=1)[:, :best] for y in (one, two)]
        a, b = (np.take_along_axis(y, t, 1) for y, t in zip((one, two), top, strict=True))
        sums = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
        bar = np.minimum(need, np.partition(sums, -least, axis=1)[:, -least]) if sums.shape[1] >= least else np.full(len(a), need)
        number = (top[0][:, :, None] * words + top[1][:, None, :]).reshape(len(a), -1)
        more = np.zeros(len(a), dtype=bool)
        if best < words:  # may a word beyond the best ones reach the bar with the other half's best?
            more = (a.min(axis=1) + b.max(axis=1) >= bar) | (b.min(axis=1) + a.max(axis=1) >= bar)
        for i in range(len(a)):
            out.append(_decode_one(one[i], two[i], bar[i], words) if more[i] else np.sort(number[i][sums[i] >= bar[i]]))
    return out


def code_words(dimensions: int, words: int) -> int:
    """Words of a code for so many dimensions, ``words`` at most: caps of few dimensions must not shrink below close pairs."""
    return min(words, 4 ** (dimensions // 2 - 1))


def grid_filters(x: np.ndarray) -> list[np.ndarray]:
    """For each unit vector of few dimensions the sorted numbers of the grid cells around it, on its first three coordinates.

    Vectors at MIN_COSINE are at most a cell's width apart in each coordinate, so each one's cell is around the other.
    """
    width = math.sqrt(2 - 2 * MIN_COSINE) + 1e-9
    own = np.floor(x[:, :3] / width).astype(np.int64) + 32  # coordinates are in [-1, 1], so cells are in 26 .. 37
    around = np.stack(np.meshgrid(*[(-1, 0, 1)] * own.shape[1], indexing="ij"), axis=-1).reshape(-1, own.shape[1])
    return list(np.sort((own[:, None, :] + around) @ (64 ** np.arange(own.shape[1])), axis=1))


_READ = "vec long, id long, label long, digest string, unit binary"
_READ_ARROW = pa.schema([("vec", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("digest", pa.string()), ("unit", pa.binary())])


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision and a digest; neither where a vector cannot be compared."""
    for batch in batches:
        rows = []
        for key, values, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            unit = digest = None
            if label is not None and values and None not in values:
                x = np.array(values, dtype=np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    digest = hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest()
                    x = x / top
                    unit = (x / np.sqrt(x @ x)).tobytes()
            rows.append((NULL_ID if key is None else key, key, label, digest, unit))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ_ARROW, strict=True)], schema=_READ_ARROW)


def _filters(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(u, dtype=np.float64) for u in batch.column(1).to_pylist()]
            found: list = [None] * len(units)
            for size in {len(u) for u in units}:
                where = [i for i, u in enumerate(units) if len(u) == size]
                x = np.stack([units[i] for i in where])
                for i, f in zip(where, grid_filters(x) if size < SMALL else decode_filters(x, code_words(size, words)), strict=True):
                    found[i] = f
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(u) for u in units], pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["node", "size", "filters"],
            )

    return run


_COMPARED = "node long, links long, root long"
_COMPARED_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _COMPARED.split(", ")])
_BUCKET = ["size", "label", "filter", "low", "high"]


def _close_pairs(x: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, q) of rows of the same run (start, count) whose cosine reaches MIN_COSINE, p before q."""
    for size in np.unique(count[count > 1]).tolist():
        runs = start[count == size]
        step = max(1, PAIRS_AT_ONCE // (size * size))
        for k in range(0, len(runs), step):
            rows = runs[k : k + step, None] + np.arange(size)
            y = x[rows]
            g, i, j = np.nonzero(y @ y.transpose(0, 2, 1) >= MIN_COSINE)
            g, i, j = g[i < j], i[i < j], j[i < j]
            yield rows[g, i], rows[g, j]


def _first_shared(p: np.ndarray, q: np.ndarray, here: np.ndarray, flat: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Is the filter ``here`` the smallest one that rows p and q share? Row r has the sorted filters flat[offset[r] : offset[r + 1]]."""
    places = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    _, code = np.unique(flat, return_inverse=True)
    width = int(code.max()) + 1 if len(code) else 1
    keys = places * width + code  # sorted, as every row's filters are
    length = offset[p + 1] - offset[p]
    pair = np.repeat(np.arange(len(p)), length)
    at = np.repeat(offset[p] - (np.cumsum(length) - length), length) + np.arange(len(pair))
    smaller = flat[at] < here[pair]
    pair, at = pair[smaller], at[smaller]
    wanted = q[pair] * width + code[at]
    found = np.searchsorted(keys, wanted)
    hit = keys[np.minimum(found, len(keys) - 1)] == wanted
    new = np.ones(len(p), dtype=bool)
    new[pair[hit]] = False
    return new


def _compare_buckets(table: pa.Table) -> pa.RecordBatch:
    """Links within each whole bucket, or pair of chunks of one: per member the weight it links with, and one member it is connected to."""
    keys = [table.column(c).to_numpy() for c in _BUCKET]
    node, weight, chunk = (table.column(c).to_numpy() for c in ("node", "weight", "chunk"))
    lists = table.column("filters").combine_chunks()
    offset, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    offset, flat = offset - offset[0], flat[offset[0] : offset[-1]]
    edge = np.flatnonzero(np.any([np.append(True, k[1:] != k[:-1]) for k in keys], axis=0))
    count = np.diff(np.append(edge, len(node)))
    units = table.column("unit").to_pylist()
    links, root = np.zeros(len(node), dtype=np.int64), node.copy()
    for size in np.unique(keys[0]).tolist():
        rows = np.flatnonzero(keys[0] == size)  # one run: rows are sorted by size first
        x = np.frombuffer(b"".join(units[rows[0] : rows[-1] + 1]), dtype=np.float64).reshape(-1, size)
        own = keys[0][edge] == size
        for p, q in _close_pairs(x, edge[own] - rows[0], count[own]):
            p, q = p + rows[0], q + rows[0]
            apart = (keys[3][p] == keys[4][p]) | (chunk[p] != chunk[q])  # two chunks: pairs within one are compared elsewhere
            p, q = p[apart], q[apart]
            if not len(p):
                continue
            new = _first_shared(p, q, keys[2][p], flat, offset)
            np.add.at(links, p[new], weight[q[new]])
            np.add.at(links, q[new], weight[p[new]])
            while True:
                least = np.minimum(root[p], root[q])
                if (least == root[p]).all() and (least == root[q]).all():
                    break
                np.minimum.at(root, p, least)
                np.minimum.at(root, q, least)
    some = np.flatnonzero((links > 0) | (root != node))
    return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (node, links, root)], schema=_COMPARED_ARROW)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted; the last one of a batch waits for its rest."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = [table.column(c)[-1].as_py() for c in _BUCKET]
        same = np.all([table.column(c).to_numpy() == v for c, v in zip(_BUCKET, last, strict=True)], axis=0)
        cut = int(np.argmax(same))
        if cut:
            yield _compare_buckets(table.slice(0, cut))
        held = table.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield _compare_buckets(held)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component): links of cosine >= MIN_COSINE among vectors of equal labels.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing;
    so do vectors of different lengths. Equal vectors link with each other; each repeated row counts as a vector, and
    so does each row of an id that stands with several vectors. Vectors without id come after all others and report a
    null component unless a link reaches an id. An empty table gives no rows. Only the three columns are read.
    """
    rows = settle(vectors.select(id_column, vector_column, F.col(label_column).cast("long")).mapInArrow(_unit_vectors, _READ), "vectors")
    able = rows.where("digest is not null")
    classes = able.groupBy("label", "digest").agg(F.min("vec").alias("first"), F.count("*").alias("weight"), F.max("unit").alias("unit"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so nodes do not change
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    words = 1 << max(4, math.ceil(math.log2(4 * largest) / 2))  # buckets stay small as labels grow

    lists = settle(classes.select("node", "unit").mapInArrow(_filters(words), "node long, size int, filters array<long>"), "filters")
    passed = lists.join(classes.select("node", "label"), "node").select("node", "label", "size", F.explode("filters").alias("filter"))
    bucket = ["label", "size", "filter"]
    crowd = passed.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dealt = (
        passed.join(crowd, bucket)
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", *bucket, "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )
    full = dealt.join(classes.select("node", "weight", "unit"), "node").join(lists.select("node", "filters"), "node")
    sorted_buckets = full.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    compared = settle(sorted_buckets.mapInArrow(_compare, _COMPARED), "compared")
    drop_settled(lists)

    counted = compared.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(compared.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = classes.select("label", "digest", "node", "weight", "first").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    smallest = members.groupBy("group").agg(F.min("first").alias("component"))
    named = (
        members.drop("component").join(smallest, "group").join(counted, "node", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    )
    out = able.join(named, ["label", "digest"]).select("id", "n_links", "component")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    return out.union(alone).withColumn("component", F.nullif("component", F.lit(NULL_ID)))


def op5_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return out.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
