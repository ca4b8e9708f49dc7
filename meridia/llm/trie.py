"""A prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

Turns are numbered within their conversation by a sort over ranges. A prefix is named by its depth and the running XOR
of 128-bit hashes of its (place, turn) pairs, so equal prefixes meet by grouping and no turn waits for the one before
it. A node is named by its smallest member and its depth; the nodes of one smallest member form a chain.

Every node's child with most members continues the node's heavy path, its other children start light paths. A light
child has at most half its parent's members, so no node lies under more than log2(members) light edges. Sums of whole
paths climb from path to path in as many rounds; then one suffix sum along all paths gives every node its subtree's.

Running sums and maxima along chains and paths go block by block (BLOCK depths each), so a very long conversation is
spread over tasks. Joins of children to a parent that many share are left to AQE, which splits skewed ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import drop_settled, read_table, settle

BLOCK = 4096  # depths that one task runs over at a time
CHUNK = 65_536  # ids that are written as one piece of a list
HEADS = 3  # turns that a conversation may take from another at most
SIBLINGS = 20  # conversations that take their first turns from the same one
MAX_ROUNDS = 64

# ------------------------------------------------------------------- places of turns


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, number, a, b, words): every turn's number in its conversation from 1, its hashes and its words.

    Turns are ordered by ``turn`` (null first), then role, then text. Rows are sorted in ranges, which may cut a long
    conversation; what its earlier ranges hold is added from a table of one row per range.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    turn = F.asc_nulls_first("turn")
    ranged = turns.repartitionByRange("conv_id", turn, "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", turn, "role", "text")
    hashed = ranged.select(
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(5), "text", "role").alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    names = ["part", "number", "conv_id", "a", "b", "words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            number = np.arange(1, len(ids) + 1) - np.repeat(start, np.diff(np.append(start, len(ids))))
            if ids[0] == held:
                number[: start[1] if len(start) > 1 else None] += n
            held, n = ids[-1], int(number[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), pa.array(number), *batch.columns], names=names)

    numbered = settle(hashed.mapInArrow(count, ", ".join(f"{c} long" for c in names)), "turns")
    last = numbered.groupBy("part").agg(F.max(F.struct("conv_id", "number")).alias("last"))  # one row per range
    carried = last.select(
        F.col("last.conv_id").alias("conv_id"), F.lead("part").over(Window.orderBy("part")).alias("part"),
        F.sum("last.number").over(Window.partitionBy("last.conv_id").orderBy("part")).alias("before"),
    )
    return numbered.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("number"), "a", "b", "words"
    )


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, depth: how many turns they have when rebuilt) and their turns (conv_id, depth, a, b, words, last).

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % SIBLINGS, then its own from h + 1 on.
    """
    turn = F.struct("number", "a", "b", "words")
    heads = numbered.where((F.col("conv_id") % SIBLINGS == 0) & (F.col("number") <= HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    known = numbered.groupBy("conv_id").agg(F.max("number").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % SIBLINGS})
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<number:bigint,a:bigint,b:bigint,words:bigint>>")), 1, F.col("h").cast("int"))
    taken = settle(known.join(heads, "base", "left").select("conv_id", "own", "h", head.alias("head")), "known")
    convs = taken.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("depth"))
    first = taken.select("conv_id", F.explode("head").alias("t"), (F.col("own") <= F.col("h")).alias("all"), F.size("head").alias("n")).select(
        "conv_id", F.col("t.number").alias("depth"), "t.a", "t.b", "t.words", (F.col("all") & (F.col("t.number") == F.col("n"))).alias("last")
    )
    rest = numbered.join(taken.select("conv_id", "own", "h", F.size("head").alias("n")), "conv_id").where("number > h").select(
        "conv_id", (F.col("number") - F.col("h") + F.col("n")).alias("depth"), "a", "b", "words", (F.col("number") == F.col("own")).alias("last")
    )
    return convs, settle(first.union(rest), "rebuilt")


# ------------------------------------------------------------------- running values


def running(rows: DataFrame, keys: list[str], values: dict[str, Column], total: Callable[[Column], Column], join: Callable[[Column, Column], Column], up: bool = True) -> DataFrame:
    """``rows`` with running values along ``depth`` within each key, this row included, from below (``up``) or from above.

    Blocks of BLOCK depths are totalled, totals run over a key's blocks, then each block runs by itself.
    """
    order = (lambda c: F.asc(c)) if up else (lambda c: F.desc(c))
    cut = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    whole = cut.groupBy(*keys, "block").agg(*(total(v).alias(f"{n}_before") for n, v in values.items()))
    before = Window.partitionBy(*keys).orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = whole.select(*keys, "block", *(total(F.col(f"{n}_before")).over(before).alias(f"{n}_before") for n in values))
    several = sums.where(" or ".join(f"{n}_before is not null" for n in values))
    within = Window.partitionBy(*keys, "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {n: total(v).over(within) for n, v in values.items()}
    joined = cut.join(several, [*keys, "block"], "left")
    out = {n: F.coalesce(join(own[n], F.col(f"{n}_before")), own[n], F.col(f"{n}_before")) for n in values}
    return joined.withColumns(out).drop("block", *(f"{n}_before" for n in values))


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): every rebuilt turn with the names of its prefix and of the one before."""
    placed = turns.withColumns({"t1": F.xxhash64("depth", "a", "b"), "t2": F.xxhash64(F.lit(7), "b", "a", "depth")})
    named = running(placed, ["conv_id"], {"k1": F.col("t1"), "k2": F.col("t2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return named.select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "words", "last"
    )


# ------------------------------------------------------------------- nodes

NAME = ["depth", "k1", "k2"]


def trie_nodes(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, n_convs, words, n_children, parent, heavy): one row per node; the root's parent is null.

    ``heavy``: it is its parent's child with most members (the smallest conv_id of several).
    """
    grouped = prefixes.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("words"), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2"))
    )
    nodes = settle(grouped.unionByName(root), "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(
        F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.negative("conv_id").alias("less"))).alias("most")
    )
    known = settle(nodes.join(children, NAME, "left").fillna(0, ["n_children"]), "families")
    parents = known.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"), (-F.col("most.less")).alias("next")
    )
    drop_settled(nodes)
    return settle(
        known.join(parents, ["depth", "p1", "p2"], "left").select(
            "conv_id", *NAME, "n_convs", "words", "n_children", "parent", F.coalesce(F.col("next") == F.col("conv_id"), F.lit(False)).alias("heavy")
        ),
        "trie",
    )


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the top of their heavy path (top_conv, top_depth).

    Along a chain the last light node above (or at) a node is its top. Nodes above a chain's first light one lie on the
    path of the chain head's parent; such heads are followed by doubling, so rounds grow with the logarithm of the
    chains on one path.
    """
    light = F.when(~F.col("heavy"), F.col("depth"))
    along = settle(running(nodes, ["conv_id"], {"top_depth": light}, F.max, lambda a, b: F.greatest(a, b)), "along")
    heads = along.where("heavy and parent <> conv_id").select(F.col("conv_id").alias("head"), F.col("parent").alias("to"), (F.col("depth") - 1).alias("at"))
    places = along.select(F.col("conv_id").alias("to"), F.col("depth").alias("at"), F.col("top_depth").alias("found"))
    links = settle(heads.join(places, ["to", "at"], "left").select("head", "to", "found"), "links")
    for _ in range(MAX_ROUNDS):
        if links.where("found is null").isEmpty():
            break
        ends = links.select(F.col("head").alias("to"), F.col("to").alias("next"), F.col("found").alias("there"))
        moved = links.where("found is null").join(ends, "to").select("head", F.col("next").alias("to"), F.col("there").alias("found"))
        after = settle(links.where("found is not null").union(moved), "links")
        drop_settled(links)
        links = after
    else:
        raise RuntimeError("chains did not end")
    return settle(
        along.join(links.select(F.col("head").alias("conv_id"), "to", "found"), "conv_id", "left").select(
            *nodes.columns, F.when(F.col("top_depth").isNull(), F.col("to")).otherwise(F.col("conv_id")).alias("top_conv"), F.coalesce("top_depth", "found").alias("top_depth")
        ),
        "paths",
    )


PATH = ["top_conv", "top_depth"]


def path_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved): what the light paths below each node sum up to, their own light paths included.

    Each path's own sums climb one path a round, added up where they meet: as many rounds as light edges in a row.
    """
    values = ["leaves", "saved"]
    own = nodes.groupBy(*PATH).agg(*(F.sum(v).alias(v) for v in values))
    tops = nodes.where((F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth")) & F.col("parent").isNotNull())
    tops = tops.select(*PATH, F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    upper = nodes.select("conv_id", "depth", F.col("top_conv").alias("up_conv"), F.col("top_depth").alias("up_depth"))
    above = settle(tops.join(upper, ["conv_id", "depth"]), "above")
    climbing = totals = settle(own, "sums")
    for _ in range(MAX_ROUNDS):
        step = climbing.join(above, PATH).groupBy(F.col("up_conv").alias("top_conv"), F.col("up_depth").alias("top_depth")).agg(*(F.sum(v).alias(v) for v in values))
        climbing = settle(step, "sums")
        if climbing.isEmpty():
            break
        totals = totals.union(climbing)
    else:
        raise RuntimeError("paths did not end")
    totals = totals.groupBy(*PATH).agg(*(F.sum(v).alias(v) for v in values))
    return above.join(totals, PATH).groupBy("conv_id", "depth").agg(*(F.sum(v).alias(f"below_{v}") for v in values))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens: sums over subtrees, by one suffix sum along all heavy paths."""
    own = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    valued = own.join(path_totals(own), ["conv_id", "depth"], "left")
    values = {"n_leaves": F.col("leaves") + F.coalesce("below_leaves", F.lit(0)), "saved_tokens": F.col("saved") + F.coalesce("below_saved", F.lit(0))}
    return running(settle(valued, "valued"), PATH, values, F.sum, lambda a, b: a + b, up=False)


# ------------------------------------------------------------------- lists of members


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from (depth, k1, k2, conv_id): digests of the ids in order, joined by commas.

    Ids are sorted in ranges and written as pieces of at most CHUNK; a digest reads its pieces one by one, so a node
    where very many conversations end holds one piece of them at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *key, ids = (c.to_numpy() for c in batch.columns)
            cut = np.zeros(len(ids), dtype=bool)
            cut[::CHUNK] = True
            for k in key:
                cut[1:] |= k[1:] != k[:-1]
            start = np.flatnonzero(cut)
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(start, np.append(start[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[start]) for k in key), pa.array(ids[start]), pa.array(texts, pa.string())], names=[*NAME, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []

        def out() -> pa.RecordBatch:
            *key, sha = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in key), pa.array(sha, pa.string())], names=[*NAME, "ends_sha256"])

        for batch in batches:
            *key, _, ids = (c.to_pylist() for c in batch.columns)
            for name, text in zip(zip(*key, strict=True), ids, strict=True):
                if name == held:
                    state.update(b"," + text.encode())
                    continue
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = name, hashlib.sha256(text.encode())
            if done:
                yield out()
        if held is not None:
            done.append((*held, state.hexdigest()))
            yield out()

    order = [*NAME, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, heavy.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own. Null roles and
    texts are empty ones. Rows of null conv_id belong to no conversation and are left out. Remainders of negative ids
    have the ids' sign. An empty table gives no rows; other columns are not read.
    """
    convs, turns = rebuild(number_turns(conversations))
    prefixes = settle(named_prefixes(turns), "prefixes")
    drop_settled(turns)
    ends = prefixes.where("last").select(*NAME, "conv_id")
    zero = F.lit(0).cast("long")
    ends = ends.union(convs.where("depth = 0").select(zero, zero, zero, "conv_id"))
    nodes = subtree_sums(heavy_paths(trie_nodes(convs, prefixes)))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_digests(ends), NAME, "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"), "heavy",
    )


def op12_heavy_path_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))
