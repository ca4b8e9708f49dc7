"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic) over all documents. Raking scales the cells' weights until the
weighted tokens meet the target shares of each margin in turn. A sample that keeps a share of all tokens cannot hold
more of a value than there is, so targets beyond that are lowered to it and the others raised in proportion. No weight
may pass the one at which every document of its cell is drawn: cells that reach it stay there and the others are raked
on. So the expected sample itself meets the targets, wherever some weights can. Where none can (cells that are empty or
at their cap may tie margins together), all margins are scaled at once by roots of their factors, which settles between
them, and the best fit seen is kept; ``margin_report`` tells what stays off. A document is drawn with its cell's weight times the share to
keep as probability, by a hash of its id and text, so equal rows share their fate and reruns agree.

Up to MAX_DRIVER_CELLS cells are raked in memory on the driver, more by the same steps on DataFrames; both settle at
the same weights but for rounding.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import drop_settled, fresh, read_table, settle

MAX_DRIVER_CELLS = 50_000
ROUNDS = 400
TOLERANCE = 1e-6
MARGINS = ("source", "lang", "topic")
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}  # a target share is the present share to this power, scaled
KEEP = 0.8  # share of all tokens to draw

# A text's topic is the first whose pattern it holds.
TOPICS = [("table", r" \| "), ("markup", r"[{}<>]|https?://"), ("contact", r"[\w.]+@[\w.]+\.\w+"), ("numbers", r"[0-9]{4}")]


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def count_tokens(text: Column) -> Column:
    """Words between white space; every document counts as one at least, so none is weightless."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _level(reached, goal: float = 1.0) -> float:
    """The level (1 at least) at which an increasing function reaches the goal; ``reached`` maps levels to its values."""
    grid = [1.0] + [2.0**k for k in range(1, 32)]
    low = 0.0
    for _ in range(12):
        values = reached(grid)
        k = next((k for k, v in enumerate(values) if v >= goal), len(grid) - 1)
        if k == 0 and low == 0.0:
            return grid[0]
        low, high = grid[k - 1] if k else low, grid[k]
        grid = [low + (high - low) * (i + 1) / 32 for i in range(32)]
    return high


def bound_targets(wish: np.ndarray, share: np.ndarray, keep: float) -> np.ndarray:
    """Targets in the wishes' proportions, none above what a sample of ``keep`` of all tokens can hold."""
    most = share / keep
    return np.minimum(most, _level(lambda grid: [np.minimum(most, g * wish).sum() for g in grid]) * wish)


def wishes(by: DataFrame, margin: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """(margin, share, wish): each value's share of tokens, and that share to a power or the given one, scaled to sum to 1."""
    whole = by.agg(F.sum("tokens").cast("double").alias("all"))
    out = by.crossJoin(F.broadcast(whole)).select(margin, (F.col("tokens") / F.col("all")).alias("share"))
    if given is None:
        out = out.withColumn("wish", F.pow("share", F.lit(power)))
    else:
        rows = by.sparkSession.createDataFrame(list(given.items()), f"{margin} string, wish double")
        out = out.join(rows, margin, "left").fillna(0.0, ["wish"])
    total = out.agg(F.sum("wish").alias("total"))
    return out.crossJoin(F.broadcast(total)).select(margin, "share", F.coalesce(F.try_divide("wish", "total"), F.lit(0.0)).alias("wish"))


def bound_target_frame(wished: DataFrame, margin: str, keep: float) -> DataFrame:
    """(margin, target) from (margin, share, wish), as in ``bound_targets``."""
    at = lambda g: F.least(F.col("share") / keep, g * F.col("wish"))
    level = _level(lambda grid: [v or 0.0 for v in wished.agg(*(F.sum(at(F.lit(g))) for g in grid)).first()])
    return wished.select(margin, at(F.lit(level)).alias("target"))


def _settled(errors: list[float], before: list[float] | None, tolerance: float) -> bool:
    """Whether raking ends: every margin meets its targets, or no margin's error moves any more."""
    return max(errors, default=0.0) < tolerance or (before is not None and max(abs(a - b) for a, b in zip(errors, before, strict=True)) < tolerance / 100)


def rake_arrays(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE, cap: float = math.inf) -> np.ndarray:
    """Weights of cells, at most ``cap``, so that weighted token shares meet the targets of every margin (targets of each sum to 1).

    Where a value needs more than it has, its cells at the cap stay and the others make up for them; where that
    cannot do, all end at the cap. Ends when the targets are met or no error moves any more. If margin by margin does
    not get there in ``rounds``, as many rounds follow that scale all margins at once. The best weights are returned.
    """
    weight = np.ones(len(tokens))
    whole = tokens.sum()
    best, least, before = weight, math.inf, None
    for k in range(2 * rounds):
        alone = k < rounds
        errors, factors, entry = [], np.ones(len(tokens)), weight
        for code, target in zip(codes, targets, strict=True):
            sums = lambda x: np.bincount(code, weights=x * tokens, minlength=len(target)) / whole  # noqa: B023, E731
            now, full = sums(weight), sums(np.where(weight >= cap, weight, 0.0))
            errors.append(float(np.abs(now - target).max(initial=0)))
            more = target > now
            free = now - np.where(more, full, 0.0)
            factor = np.divide(target - np.where(more, full, 0.0), free, out=np.ones(len(target)), where=free > 0)
            moved = np.where(more[code] & (weight >= cap), 1.0, factor[code])
            if alone:
                weight = np.minimum(cap, weight * moved)
            else:
                factors *= moved
        if not alone:
            weight = np.minimum(cap, entry * factors ** (1 / max(len(codes), 1)))
            if max(errors, default=0.0) < least:
                best, least = entry, max(errors, default=0.0)
        if _settled(errors, before, tolerance):
            return weight if alone else best
        before = errors if k != rounds - 1 else None
    return best


def rake_frames(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float = TOLERANCE, cap: float = math.inf) -> DataFrame:
    """The same on DataFrames: one aggregation and one join a margin, the lineage cut after every round."""
    held = settle(cells.withColumn("weight", F.lit(1.0)), "cells")
    whole = held.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    mass = F.col("weight") * F.col("tokens")
    capped = F.col("weight") >= cap
    best, least, before = None, math.inf, None
    for k in range(2 * rounds):
        alone = k < rounds
        out = held.withColumn("together", F.lit(1.0))
        errors, factors = [], []
        for margin, target in targets.items():
            now = out.groupBy(margin).agg((F.sum(mass) / whole).alias("now"), (F.sum(F.when(capped, mass).otherwise(0.0)) / whole).alias("full"))
            full = F.when(F.col("more"), F.col("full")).otherwise(0.0)
            factor = settle(
                now.join(target, margin).withColumn("more", F.col("target") > F.col("now"))
                .withColumn("free", F.col("now") - full)
                .select(margin, "more", F.when(F.col("free") > 0, (F.col("target") - full) / F.col("free")).otherwise(1.0).alias("factor"),
                        F.abs(F.col("target") - F.col("now")).alias("off")),
                "factors",
            )
            factors.append(factor)
            errors.append(factor.agg(F.max("off")).first()[0] or 0.0)
            moved = F.when(F.col("more") & capped, 1.0).otherwise(F.col("factor"))
            changed = {"weight": F.least(F.lit(cap), F.col("weight") * moved)} if alone else {"together": F.col("together") * moved}
            out = out.join(factor.drop("off"), margin).withColumns(changed).drop("factor", "more")
        if not alone:
            out = out.withColumn("weight", F.least(F.lit(cap), F.col("weight") * F.pow("together", F.lit(1 / max(len(targets), 1)))))
        after = settle(out.drop("together"), "cells")
        better = not alone and max(errors, default=0.0) < least
        unused = [*factors, best if better else None, None if better else held if held is not best else None]
        if better:
            best, least = held, max(errors, default=0.0)
        for old in filter(lambda x: x is not None, unused):
            drop_settled(old)
        held = after
        if _settled(errors, before, tolerance):
            return held if alone else best
        before = errors if k != rounds - 1 else None
    return best


def calibrate(cells: DataFrame, flatten: dict[str, float], keep: float, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with their weight and probability = weight * ``keep``.

    ``given`` sets a margin's wished shares by hand; values that it leaves out share nothing. Weights stay at or below
    1 / keep, so no probability passes 1 and the drawn tokens meet the (bounded) targets, or come as close to them as
    the cells let them.
    """
    spark, given = cells.sparkSession, given or {}
    margins = list(flatten)
    if cells.limit(MAX_DRIVER_CELLS + 1).count() <= MAX_DRIVER_CELLS:
        local = cells.toPandas()
        tokens = local["tokens"].to_numpy(dtype=float)
        codes, goals = [], []
        for margin in margins:
            code, names = local[margin].factorize(sort=True)
            share = np.bincount(code, weights=tokens, minlength=len(names)) / max(tokens.sum(), 1.0)
            wish = np.array([given[margin].get(k, 0.0) for k in names]) if margin in given else share ** flatten[margin]
            codes.append(code)
            goals.append(bound_targets(wish / (wish.sum() or 1.0), share, keep))
        local["weight"] = rake_arrays(tokens, codes, goals, ROUNDS, cap=1 / keep) if len(local) else []
        schema = ", ".join([*(f"{m} string" for m in margins), "tokens long, weight double"])
        raked = spark.createDataFrame(local[[*margins, "tokens", "weight"]], schema) if len(local) else spark.createDataFrame([], schema)
    else:
        targets = {}
        for margin in margins:
            by = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
            wished = settle(wishes(by, margin, flatten[margin], given.get(margin)), "wishes")
            targets[margin] = settle(bound_target_frame(wished, margin, keep), "targets")
            drop_settled(wished)
        raked = rake_frames(cells, targets, ROUNDS, cap=1 / keep)
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(keep)))


def margin_report(cells: DataFrame, flatten: dict[str, float] | None = None, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, value, present, wished, target, expected, off): shares of tokens before, as wished, as bounded by what there
    is, and expected in the sample; ``off`` is how far the last two stay apart."""
    flatten, given = flatten or FLATTEN, given or {}
    fitted = settle(calibrate(cells, flatten, keep, given), "fitted")
    drawn = F.col("tokens") * F.col("probability")
    whole = fitted.agg(F.sum(drawn).alias("whole"))
    out = None
    for margin, power in flatten.items():
        wished = settle(wishes(fitted.groupBy(margin).agg(F.sum("tokens").alias("tokens")), margin, power, given.get(margin)), "wishes")
        got = fitted.groupBy(margin).agg(F.sum(drawn).alias("drawn")).crossJoin(F.broadcast(whole)).select(margin, (F.col("drawn") / F.col("whole")).alias("expected"))
        goal = bound_target_frame(wished, margin, keep)
        part = wished.join(got, margin).join(goal, margin).select(
            F.lit(margin).alias("margin"), F.col(margin).alias("value"), F.col("share").alias("present"), F.col("wish").alias("wished"), "target", "expected",
            F.abs(F.col("target") - F.col("expected")).alias("off"),
        )
        out = part if out is None else out.union(part)
    return out


def draw(key: Column, text: Column) -> Column:
    """A number in [0, 1) from the id and the text."""
    bits = F.shiftrightunsigned(F.xxhash64(key, text, F.lit(9)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens and draw of every document; null sources and languages are named ""."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic(text).alias("topic"), count_tokens(text).alias("tokens"), draw(F.col("doc_id"), text).alias("draw"),
    )


def mix(docs: DataFrame, flatten: dict[str, float] | None = None, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) of every document.

    Nulls in source or language form a value of their own; empty and null texts are prose of one token; repeated
    rows are sampled or left together; an empty table gives no rows.
    """
    rows = settle(described(docs), "described")
    cells = settle(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = calibrate(cells, flatten or FLATTEN, keep, given)
    return (
        rows.join(fitted.drop("tokens"), list(MARGINS))
        .select("doc_id", *MARGINS, "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"),
                (F.col("draw") < F.col("probability")).alias("sampled"))
    )


def sample_mixture(docs: DataFrame, flatten: dict[str, float] | None = None, keep: float = KEEP) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are, whatever their names."""
    cells = settle(described(docs).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    names = fresh(docs, *MARGINS, "probability", "draw")
    fitted = calibrate(cells, flatten or FLATTEN, keep).select(*MARGINS, "probability").toDF(*names[:-1])
    text = F.coalesce(F.col("text"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.withColumns(dict(zip([*names[:3], names[-1]], (known("source"), known("lang"), topic(text), draw(F.col("doc_id"), text)), strict=True)))
    return named.join(fitted, names[:3]).where(F.col(names[-1]) < F.col(names[3])).select(*docs.columns)


def op9_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
