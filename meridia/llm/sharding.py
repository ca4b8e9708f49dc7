"""Sharding by a hierarchical weighted hash tree (native: DataFrame functions only).

The tree has three levels, region, rack and shard, with a fixed number of places in every rack and region. A key
descends it by exponential waiting times drawn from hashes of (key, level, node), smallest first:

* a region waits a draw over the number of its places;
* among a region's racks the one with the smallest draw waits as long as the region, each other one longer by what
  its draw exceeds the smallest; shards within a rack likewise.

By the memorylessness of waiting times all places then wait independently, though only visited nodes draw. A shard
of weight w waits 1 / w of its place's time, and the shortest wait wins. Subtrees whose shards are all there with one
weight compete as a whole by their own draw and are descended only where they win; subtrees with missing or unequal
shards are opened. So a key costs the regions, the children on its way and the opened subtrees, not all shards.

As a place's wait never depends on other shards, a changed weight moves rows only into that shard (more weight) or out
of it (less weight), and a new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm._shared import fresh, read_table, settle

SLOT_ROWS = 50_000  # rows that are numbered together
PER_RACK, RACKS_PER_REGION = 4, 3
REGION, RACK, SHARD = 0, 1, 2


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> list[Leaf]:
    """Shards of equal weight, filled rack by rack and region by region; tree(n) is a prefix of tree(n + 1)."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def _draw(key: Column, level: int, node: Column) -> Column:
    """An exponential waiting time of rate 1, from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level).cast("long"), node.cast("long")), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53))


def _first_child(key: Column, level: int, first: Column, n: int) -> Column:
    """The child with the smallest draw among n from ``first`` on."""
    draws = (F.struct(_draw(key, level, first + i).alias("draw"), (first + i).alias("node")) for i in range(n))
    return F.array_min(F.array(*draws))["node"]


def _common_weight(weights: dict[int, float], first: int, n: int) -> float | None:
    """The weight that all shards from ``first`` on have, if they are all there."""
    found = {weights.get(s) for s in range(first, first + n)}
    return found.pop() if len(found) == 1 else None


def _waits(key: Column, weights: dict[int, float], p: int, q: int) -> list[tuple[Column, int, int]]:
    """(wait, level, node) of everything that competes: whole subtrees and, in opened ones, their parts."""
    out = []
    for region in sorted({s // (p * q) for s in weights}):
        wait = _draw(key, REGION, F.lit(region)) / F.lit(float(p * q))
        whole = _common_weight(weights, region * p * q, p * q)
        if whole:
            out.append((wait / whole, REGION, region))
            continue
        racks = range(region * q, region * q + q)
        draws = [_draw(key, RACK, F.lit(k)) / F.lit(float(p)) for k in racks]
        least = F.least(*draws) if q > 1 else draws[0]
        for rack, draw in zip(racks, draws, strict=True):
            here = [s for s in range(rack * p, rack * p + p) if s in weights]
            rack_wait, whole = wait + (draw - least), _common_weight(weights, rack * p, p)
            if whole:
                out.append((rack_wait / whole, RACK, rack))
                continue
            shard_draws = {s: _draw(key, SHARD, F.lit(s)) for s in range(rack * p, rack * p + p)}
            shard_least = F.least(*shard_draws.values()) if p > 1 else shard_draws[rack * p]
            out += [((rack_wait + (shard_draws[s] - shard_least)) / weights[s], SHARD, s) for s in here]
    return out


def competition(key: Column, leaves: list[Leaf], per_rack: int = PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Column:
    """struct(wait, level, node) of what waits least; leaves of no weight take nothing."""
    for x in leaves:
        if x.rack != x.shard // per_rack or x.region != x.rack // racks_per_region:
            raise ValueError(f"{x} does not stand where trees of {racks_per_region} racks of {per_rack} have it")
    weights = {x.shard: float(x.weight) for x in leaves if x.weight > 0}
    if not weights:
        raise ValueError("a tree needs a shard with weight")
    waits = _waits(key, weights, per_rack, racks_per_region)
    return F.array_min(F.array(*(F.struct(w.alias("wait"), F.lit(level).alias("level"), F.lit(node).alias("node")) for w, level, node in waits)))


def assign_shards(df: DataFrame, key: str, leaves: list[Leaf], prefix: str = "", per_rack: int = PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> DataFrame:
    """Add region, rack and shard to every row. Null keys are one key like any other; equal keys share a shard.

    Each level is a projection of its own, so a row draws for its own nodes only, once.
    """
    won, name = fresh(df, "won", "name")
    out = df.withColumn(name, F.coalesce(F.col(key).cast("string"), F.lit("")))
    out = out.withColumn(won, competition(F.col(name), leaves, per_rack, racks_per_region))
    level, node = F.col(f"{won}.level"), F.col(f"{won}.node")
    inside = _first_child(F.col(name), RACK, node * racks_per_region, racks_per_region)
    out = out.withColumn(prefix + "rack", F.when(level == REGION, inside).when(level == RACK, node).otherwise(F.floor(node / per_rack).cast("int")))
    inside = _first_child(F.col(name), SHARD, F.col(prefix + "rack") * per_rack, per_rack)
    out = out.withColumn(prefix + "shard", F.when(level == SHARD, node).otherwise(inside))
    return out.withColumn(prefix + "region", F.floor(F.col(prefix + "rack") / racks_per_region).cast("int")).drop(won, name)


def number_slots(df: DataFrame, shard: str, shards: int, slot: str, rows: int) -> DataFrame:
    """Number the rows of each shard 0, 1, ... without gaps and without one task holding a whole shard.

    Equal rows are counted first and cut into lots of SLOT_ROWS at most, so they need no common task. The lots of
    ``rows`` rows in ``shards`` shards are hashed into buckets of about SLOT_ROWS rows each; a bucket is numbered by itself and
    starts where the buckets before it end. The starts come from one row per bucket.
    """
    n, lot, bucket, start, before = fresh(df, "n", "lot", "bucket", "start", "before")
    buckets = max(1, -(-rows // (SLOT_ROWS * shards)))
    lots = df.groupBy(*df.columns).agg(F.count("*").alias(n)).withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(SLOT_ROWS).cast("long"))))
    lots = lots.withColumn(n, F.least(F.lit(SLOT_ROWS), F.col(n) - F.col(lot))).withColumn(bucket, F.pmod(F.xxhash64(*df.columns, lot), F.lit(buckets)))
    lots = settle(lots, "lots")
    sofar = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = lots.groupBy(shard, bucket).agg(F.sum(n).alias(start))
    starts = starts.withColumn(start, F.coalesce(F.sum(start).over(sofar([shard], [bucket])), F.lit(0)))
    numbered = lots.withColumn(before, F.coalesce(F.sum(n).over(sofar([shard, bucket], [*df.columns, lot])), F.lit(0))).join(starts, [shard, bucket])
    first = F.col(start) + F.col(before)
    return numbered.withColumn(slot, F.explode(F.sequence(first, first + F.col(n) - 1))).select(*df.columns, slot)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Place every document; law ``key``: doc_id and the number of shards decide, one more takes rows only into itself.

    Returns doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard. A null text has no bytes (size
    8, CRC 0); null ids are one key; repeated rows stay together and get slots of their own; an empty table gives
    an empty result. Other columns of the input are not read, so clashing names do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(assign_shards(thin, "doc_id", tree(shards)), "doc_id", tree(shards + 1), prefix="grown_")
    kept = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "grown_shard")
    out = number_slots(kept, "shard", shards, "slot", docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
