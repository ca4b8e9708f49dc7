"""Entity resolution: block keys, blocked pairs, similarity, tiers, clusters, and the exact-then-fuzzy join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import stats, text
from meridia.functions.workers import ship
from meridia.operators.relational import pinned

MAX_BLOCK = 250  # members of a block that still say something; larger blocks are reported, not paired


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts in this order; the one similarity that has no built-in."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def text_similarity(a: Column, b: Column) -> Column:
    """The largest of the texts' sequence ratio, that of their sorted words, and the overlap of their words; 0 without a text."""
    ship()
    words = lambda c: text.tokens(c)
    ordered = lambda c: F.array_join(F.array_sort(words(c)), " ")
    best = F.greatest(sequence_ratio(a, b), sequence_ratio(ordered(a), ordered(b)), text.token_similarity(F.array_distinct(words(a)), F.array_distinct(words(b))))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).otherwise(F.round(best, 6))


def block_keys(families: dict[str, Column]) -> Column:
    """array of "family:key", unknown keys left out."""
    return F.filter(F.array(*(F.concat(F.lit(f"{k}:"), c) for k, c in families.items())), lambda x: x.isNotNull())


def blocked_pairs(df: DataFrame, id_column: str, blocks: Column, largest: int = MAX_BLOCK) -> DataFrame:
    """(left, right, methods): pairs that share a block of 2 to ``largest`` members, each once.

    Block sizes are counted and filtered before the self-join, so no block makes more than largest**2 / 2 pairs.
    """
    long = df.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(blocks)).alias("block"))
    sized = long.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, largest)).select("block")
    small = long.join(sized, "block")
    left, right = small.select("block", F.col("id").alias("left")), small.select("block", F.col("id").alias("right"))
    pairs = left.join(right, "block").where("left < right")
    return pairs.groupBy("left", "right").agg(F.array_sort(F.collect_set(F.split("block", ":", 2)[0])).alias("methods"))


def block_report(df: DataFrame, blocks: Column, largest: int = MAX_BLOCK) -> DataFrame:
    sizes = df.select(F.explode(F.array_distinct(blocks)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("n").between(2, largest)).alias("n_used"), F.count_if(F.col("n") > largest).alias("n_too_large"),
        F.coalesce(F.sum(F.when(F.col("n").between(2, largest), (F.col("n") * (F.col("n") - 1) / 2).cast("long"))), F.lit(0)).alias("n_mentions"),
    )


def shared_contacts(df: DataFrame, id_column: str, contacts: Column, most: int = 20) -> DataFrame:
    """(id, contact) for contacts of 2 to ``most`` holders: switchboards and shared inboxes say nothing."""
    long = df.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(contacts)).alias("contact"))
    useful = long.groupBy("contact").agg(F.count_distinct("id").alias("n")).where(F.col("n").between(2, most)).select("contact")
    return long.join(useful, "contact").select("id", "contact")


def pair_score(name: Column, address: Column, phone: Column, mail: Column, pin: Column, city: Column, km: Column) -> Column:
    geo = F.when(km <= 0.2, 1.0).when(km <= 1, 0.85).when(km <= 5, 0.65).when(km <= 10, 0.4).otherwise(0.0)
    num = lambda c: c.cast("double")
    return F.round(F.least(F.lit(1.0), 0.42 * name + 0.24 * address + 0.12 * num(phone) + 0.12 * num(mail) + 0.04 * num(pin) + 0.03 * num(city) + 0.03 * geo), 6)


def pair_tier(name: Column, address: Column, phone: Column, mail: Column, pin: Column, city: Column, km: Column) -> Column:
    """1 (same), 2 (likely), 3 (possible), or null; rules as alternatives within a tier."""
    near = lambda x: F.coalesce(km <= x, F.lit(False))
    local, close = pin | city | near(5), pin | city | near(1)
    placed = lambda bar: (address >= 0.82) | near(0.5) | (close & (address >= bar))
    one = [
        phone & mail & (name >= 0.70) & placed(0.45), mail & (name >= 0.80) & placed(0.45), phone & (name >= 0.84) & placed(0.50),
        (name >= 0.94) & (address >= 0.82) & local, (name >= 0.92) & near(0.2) & ((address >= 0.50) | pin | city),
    ]
    two = [
        (phone | mail) & (name >= 0.70) & ((address >= 0.35) | pin | city | near(10)), (name >= 0.88) & (address >= 0.65) & local,
        (name >= 0.86) & near(0.5) & (pin | city | (address >= 0.45)), (name >= 0.88) & pin & (address >= 0.55),
    ]
    three = [(name >= 0.78) & (address >= 0.50) & (pin | city), (name >= 0.80) & near(1), (phone | mail) & (name >= 0.55) & (address >= 0.30)]
    out = None
    for tier, rules in ((1, one), (2, two), (3, three)):
        hit = rules[0]
        for r in rules[1:]:
            hit = hit | r
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out


def clusters(edges: DataFrame, checkpoint: bool = True, most: int = 50) -> DataFrame:
    """(node, cluster) of undirected (left, right): cluster is the smallest node.

    Every node takes the smallest label around it, then the label of its label, until nothing changes; lineage is
    cut by tables in the session's shared folder.
    """
    both = edges.select(F.col("left").alias("a"), F.col("right").alias("b")).union(edges.select("right", "left")).distinct()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    if checkpoint:
        both, labels = pinned(both), pinned(labels)
    for _ in range(most):
        around = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = labels.join(around, "node").join(hop, "label").select("node", F.least("label", "near", "next").alias("label"), F.col("label").alias("old"))
        if checkpoint:
            new = pinned(new)
        if not new.where("label <> old").limit(1).count():
            break
        labels = new.select("node", "label")
    else:
        raise RuntimeError(f"clusters did not settle in {most} rounds")
    return labels.select("node", F.col("label").alias("cluster"))


def cluster_support(labels: DataFrame, edges: DataFrame, score: str) -> DataFrame:
    """Members, links, and least and mean score of each cluster."""
    own = edges.join(labels.withColumnRenamed("node", "left"), "left").groupBy("cluster").agg(
        F.count("*").alias("n_links"), F.round(F.min(score), 6).alias("least_score"), F.round(F.avg(score), 6).alias("mean_score")
    )
    return labels.groupBy("cluster").agg(F.count("*").alias("n_members")).join(own, "cluster")


def fuzzy_join(left: DataFrame, right: DataFrame, block: str, name: str, right_id: str, accept: float = 0.92, similarity=None) -> DataFrame:
    """(block, name, match_id, score, matched): exact on (block, name), else the most similar name of the block.

    Only distinct names that found no exact partner are compared, and only within their block; the best score is
    kept even where it is too low to count. Ties go to the first name.
    """
    similarity = similarity or (lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
    wanted = left.select(block, name).distinct()
    known = right.select(block, F.col(name).alias("__name"), F.col(right_id).alias("__id"))
    exact = wanted.join(known, (wanted[block] == known[block]) & (wanted[name] == known["__name"]), "left").select(wanted[block], wanted[name], "__id")
    done = exact.where("__id is not null").select(block, name, F.col("__id").alias("match_id"), F.lit(1.0).alias("score"))
    rest = exact.where("__id is null").select(block, name)
    compared = rest.join(known, block, "left").withColumn("score", F.round(similarity(F.col(name), F.col("__name")), 6))
    best = Window.partitionBy(block, name).orderBy(F.desc_nulls_last("score"), F.asc("__name"))
    top = compared.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    near = top.select(block, name, F.when(F.col("score") >= accept, F.col("__id")).alias("match_id"), "score")
    return done.unionByName(near).withColumn("matched", F.col("match_id").isNotNull())


def distance_of(a: str, b: str) -> Column:
    return stats.haversine_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))
