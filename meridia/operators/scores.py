"""Scores as data: lists of (term, weight, value when unknown), evaluated by one function.

Weights and cut-offs are fixed values of the scoring policy; each function states one score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import stats

Term = tuple[Column, float, float | None]


def weighted(terms: list[Term]) -> Column:
    """Sum of weight * term; a term without default makes the sum unknown."""
    out = F.lit(0.0)
    for column, weight, default in terms:
        value = column.cast("double")
        out = out + F.lit(weight) * (value if default is None else F.coalesce(value, F.lit(default)))
    return out


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def mean_known(parts: list[Column]) -> Column:
    """Mean of the non-null parts; null where there are none."""
    n = sum((p.isNotNull().cast("double") for p in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), F.nullif(n, F.lit(0.0)))


def need_score(bad_high: list[str], bad_low: list[str]) -> Column:
    """Mean of the known percentile ranks, those of low-is-bad indicators turned round."""
    return stats.clip01(mean_known([F.col(c) for c in bad_high] + [1 - F.col(c) for c in bad_low]))


def district_scores(df: DataFrame) -> DataFrame:
    """care_gap, trust_gap, quality and best_care from need, count percentile and rates."""
    trust, review, critical = F.col("trust_rate"), F.col("review_rate"), F.col("critical_rate")
    quality = weighted(
        [(F.col("avg_readiness"), 0.22, 0), (F.col("avg_semantic"), 0.20, 0), (F.col("avg_join"), 0.18, 0), (F.col("plausible_rate"), 0.15, 0),
         (F.col("source_rate"), 0.10, 0), (1 - critical, 0.10, 0), (1 - review, 0.05, 0)]
    )
    df = df.withColumns(
        {
            "priority": stats.clip01(weighted([(F.col("need"), 0.65, None), (1 - F.col("count_pct"), 0.35, None)])),
            "care_gap": stats.clip01(weighted([(F.col("need"), 0.55, None), (1 - F.col("count_pct"), 0.25, None), (1 - trust, 0.20, 1)])),
            "trust_gap": stats.clip01(weighted([(1 - trust, 0.45, 1), (review, 0.25, 1), (critical, 0.20, 1), (F.col("contradicted_rate"), 0.10, 0)])),
            "quality": F.round(quality, 3),
        }
    )
    best = weighted([(1 - F.col("need"), 0.40, None), (trust, 0.30, 0), (F.col("quality"), 0.20, 0), (F.col("count_pct"), 0.10, 0)])
    return df.withColumn("best_care", stats.clip01(best))


def planning_category(df: DataFrame) -> DataFrame:
    """uncertainty and category; the thresholds are quantiles of the same frame, one row that is sent along."""
    cuts = df.agg(
        F.percentile("need", 0.75).alias("__need75"), F.median("observed").alias("__n50"), F.percentile("best_care", 0.80).alias("__best80")
    )
    df = df.crossJoin(F.broadcast(cuts))
    level = (
        F.when((F.col("quality") >= 0.85) & (F.col("observed") >= 5), "lower")
        .when((F.col("quality") >= 0.70) & (F.col("observed") >= 3), "medium").otherwise("higher")
    )
    high_need = F.col("need") >= F.col("__need75")
    category = (
        F.when((F.col("care_gap") >= 0.70) & high_need & (F.col("trusted_n") <= 2), "real_desert_candidate")
        .when(high_need & (F.col("observed") >= F.col("__n50")) & (F.col("trust_rate") < 0.60), "phantom_desert_or_verification_gap")
        .when(F.col("contradicted_rate") >= 0.25, "supply_record_quality_problem")
        .when((F.col("best_care") >= F.col("__best80")) & (F.col("quality") >= 0.75), "referral_or_capacity_candidate")
        .otherwise("mixed_or_monitor")
    )
    return df.withColumn("uncertainty", level).withColumn("category", category).drop("__need75", "__n50", "__best80")


def provider_confidence() -> Column:
    """Evidence quality of a record in [0, 1] from nine signed terms."""
    return stats.half_up(
        stats.clip01(
            weighted(
                [(F.col("readiness"), 0.35, 0), (F.col("supply_confidence"), 0.25, 0), (F.col("semantic_quality"), 0.10, 0),
                 (flag(in_box(F.col("lat"), F.col("lon"))), 0.10, 0), (flag(F.col("has_source")), 0.05, 0), (flag(F.col("has_contact")), 0.05, 0),
                 (F.least(F.col("sources").cast("double") / 3, F.lit(1.0)), 0.10, 0), ((F.col("recency") != "valid").cast("double"), -0.15, 1),
                 (flag(F.col("contradicted")), -0.25, 0)]
            )
        ),
        4,
    )


def in_box(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(6, 38) & lon.between(68, 98), F.lit(False))


def review_priority() -> Column:
    """35 / 25 / 20 / 8 / 6 / 6 points, one decimal."""
    return F.round(
        weighted(
            [(flag(F.col("contradicted")), 35, 0), (flag(F.col("needs_review")), 25, 0), (1 - F.col("readiness"), 20, 0), (1 - flag(F.col("has_source")), 8, 0),
             (1 - flag(F.col("has_contact")), 6, 0), ((F.col("recency") != "valid").cast("double"), 6, 1)]
        ),
        1,
    )


def review_concern() -> Column:
    return (
        F.when(F.col("contradicted"), "Contradicted or invalid geography")
        .when(F.col("join_confidence").isNull() | (F.col("join_confidence") < 0.75), "Weak district/PIN join")
        .when(~F.coalesce("has_source", F.lit(False)), "No source URL citation").when(~F.coalesce("has_contact", F.lit(False)), "No contact evidence")
        .when(F.col("needs_review"), "Manual review flag").otherwise("Positive control candidate")
    )


def app_priority() -> Column:
    """35 / 25 / 20 / 15 / 8 / 6 / 10 points of the serving side's queue."""
    return stats.half_up(
        weighted(
            [(flag(F.col("contradicted")), 35, 0), (flag(F.col("needs_review")), 25, 0), (1 - F.col("readiness"), 20, 1), (1 - F.col("join_confidence"), 15, 1),
             (1 - flag(F.col("has_contact")), 8, 0), (1 - flag(F.col("has_source")), 6, 0),
             (flag(F.col("capacity_outlier") | F.col("doctors_outlier")), 10, 0)]
        ),
        1,
    )


# Log-odds of the validity posterior.
POSTERIOR = {
    "plausible": 0.85, "moderate": 0.10, "join_strong": 0.70, "join_fair": 0.20, "join_weak": -0.55, "source": 0.55, "no_source": -0.55, "contact": 0.35,
    "no_contact": -0.20, "recent": 0.45, "stale": -0.45, "bad_date": -0.55, "trusted": 0.60, "no_gap": 0.40, "one_gap": 0.10, "many_gaps": -0.45,
    "capacity": 0.20, "doctors": 0.20, "contradicted": -1.40, "outside": -1.20, "no_place": -0.55, "far": -0.45, "review": -0.40, "capacity_outlier": -0.70,
    "doctors_outlier": -0.70,
}


def validity_posterior() -> Column:
    """Prior .50 (.06 more for a known type, .06 for a source) as log-odds, plus one weight per signal."""
    join, quality, box = F.col("join_confidence"), F.col("geo_quality"), in_box(F.col("lat"), F.col("lon"))
    source, contact = F.coalesce("has_source", F.lit(False)), F.coalesce("has_contact", F.lit(False))
    gaps = F.coalesce("gaps", F.lit(5))
    plausible = (quality == "plausible") & box
    prior = F.lit(0.50) + F.when(F.col("kind").isNotNull(), 0.06).otherwise(0.0) + F.when(source, 0.06).otherwise(0.0)
    signals = {
        "plausible": plausible, "moderate": quality == "moderate", "join_strong": join >= 0.85, "join_fair": (join >= 0.65) & (join < 0.85), "join_weak": join < 0.65,
        "source": source, "no_source": ~source, "contact": contact, "no_contact": ~contact, "recent": F.col("recency") == "valid", "stale": F.col("recency") == "stale",
        "bad_date": F.col("recency").isin("invalid", "future"), "trusted": F.col("trusted"), "no_gap": gaps == 0, "one_gap": gaps == 1, "many_gaps": gaps >= 3,
        "capacity": F.col("capacity").isNotNull(), "doctors": F.col("doctors").isNotNull(), "contradicted": F.col("contradicted"),
        "outside": ~plausible & ((quality == "outside") | (~box & (quality != "missing"))), "no_place": quality == "missing", "far": quality == "far",
        "review": F.col("needs_review"), "capacity_outlier": F.col("capacity_outlier"), "doctors_outlier": F.col("doctors_outlier"),
    }
    total = stats.logit(prior)
    for name, on in signals.items():
        total = total + F.when(on, F.lit(POSTERIOR[name])).otherwise(F.lit(0.0))
    return stats.sigmoid(total)


def trust_parts() -> Column:
    """array(struct(dimension, points, most, reason)): an additive decomposition of at most 100 points, in fixed steps."""
    gaps = F.coalesce(F.col("gaps"), F.lit(5))
    place, when_seen, sourced = F.coalesce("geo_quality", F.lit("")), F.coalesce("recency", F.lit("")), F.coalesce("has_source", F.lit(False))
    capacity_out, doctors_out = (F.coalesce(c, F.lit(False)) for c in ("capacity_outlier", "doctors_outlier"))
    outside = (place == "outside") | (~in_box(F.col("lat"), F.col("lon")) & (place != "missing") & (place != ""))
    parts = [  # dimension, most, (condition, points, reason) in order, then what else holds
        ("Data completeness", 18,
         [(gaps <= 0, 18, "All critical supply fields present (capacity, doctors, equipment, specialties, procedure)."),
          (gaps == 1, 13, "1 critical supply field missing or estimated."), (gaps == 2, 8, "2 critical supply fields missing or estimated.")],
         (2, F.concat(gaps.cast("string"), F.lit(" critical supply fields missing or estimated.")))),
        ("Evidence support", 16,
         [(F.coalesce("trusted", F.lit(False)), 16, "Passed the pipeline's proxy supply checks; claim is corroborated by available evidence."),
          (F.coalesce("readiness", F.lit(0.0)) >= 0.6, 10, "Partial evidence support; data readiness is moderate but proxy checks not fully passed.")],
         (4, "Weak evidence support; claims are largely unverified.")),
        ("Cross-field consistency", 14,
         [(F.coalesce("contradicted", F.lit(False)), 0, "Cross-source contradiction or invalid-geo flag set."),
          (capacity_out & doctors_out, 2, "Both capacity and doctor-count are implausible outliers."),
          (capacity_out | doctors_out, 7, "One operational field (capacity or doctor count) is an implausible outlier.")],
         (14, "No contradictions; capacity/doctor/type signals are mutually plausible.")),
        ("Geographic validity", 16,
         [(outside, 0, "Coordinates fall outside India."), (place == "missing", 5, "Coordinates missing; geography unverified."),
          (place == "far", 6, "Coordinates far from the PIN centroid."), (place == "moderate", 11, "Coordinates a moderate distance from the PIN centroid."),
          (place == "plausible", 16, "Coordinates plausible and inside India.")],
         (8, "Geography partially validated.")),
        ("Temporal validity", 10,
         [(when_seen == "valid", 10, "Source page recency observed and valid."), (when_seen == "stale", 4, "Source last updated over 2 years ago."),
          (when_seen.isin("invalid", "future"), 2, "Recency value is invalid or a future date (extraction artifact).")],
         (5, "Recency unknown; freshness could not be established.")),
        ("Provenance quality", 12,
         [(sourced & (F.coalesce("join_confidence", F.lit(0.0)) >= 0.85), 12, "Cited source URL and a high-confidence district/PIN join."),
          (sourced, 8, "Cited source URL present, but join confidence is moderate or low.")],
         (2, "No source URL citation.")),
        ("Digital trust signals", 6,
         [(F.coalesce("has_contact", F.lit(False)), 6, "Phone/email/website present (weak supporting signal only).")], (1, "No contact evidence (phone/email/site).")),
        ("Human review status", 8,
         [(~F.coalesce("needs_review", F.lit(False)), 8, "Not flagged for manual review by the pipeline.")],
         (2, "Flagged for human review (weak join, geo, missingness, or contradiction).")),
    ]
    out = []
    for name, most, steps, (rest, why) in parts:
        told = F.struct(F.lit(rest).alias("points"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
        for test, points, reason in reversed(steps):
            told = F.when(test, F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))).otherwise(told)
        out.append(F.struct(F.lit(name).alias("dimension"), told["points"].alias("points"), F.lit(most).alias("most"), told["reason"].alias("reason")))
    return F.array(*out)


def order_statistics(df: DataFrame, column: str, places: dict[str, int]) -> DataFrame:
    """One row: for each name the value at that place (from 1) in ascending order; no task sorts more than a bucket.

    Values are counted by bucket of their leading digits first; only the buckets that hold a wanted place are ordered.
    """
    keyed = df.select(F.col(column).alias("value"), F.floor(F.col(column) * 1024).alias("bucket")).where("value is not null")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).cast("long").alias("place")) for k, p in places.items()))
    asked = upto.select("bucket", "before", "n", F.explode(wanted).alias("w")).where("w.place > before and w.place <= before + n").select(
        "bucket", F.col("w.name").alias("name"), (F.col("w.place") - F.col("before")).alias("inside")
    )
    counted = keyed.join(F.broadcast(asked.select("bucket").distinct()), "bucket", "left_semi").groupBy("bucket", "value").agg(F.count("*").alias("ties"))
    placed = counted.withColumn("last", F.sum("ties").over(Window.partitionBy("bucket").orderBy("value")))
    found = placed.join(F.broadcast(asked), "bucket").where("inside <= last and inside > last - ties")
    return found.agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in places))


DEFAULT_Q = 0.40  # the half-width without any calibrating row


def conformal(df: DataFrame, key: str, posterior: str, label: str, alpha: float = 0.10) -> DataFrame:
    """One row: q, stale_q, coverage, n_calibration, n_evaluation, from a hash split into a calibrating and an evaluating half.

    Only rows whose proxy label is true calibrate and evaluate; a row's score is 1 - posterior. q is the score at level
    ceil((n + 1)(1 - alpha)) / n, taken higher between two, within [.05, .95]; stale_q the same at alpha / 2, at least
    q + .05 and at most .99.
    """
    half = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 1), 16, 10).cast("int") % 2
    scored = df.where(F.coalesce(F.col(label), F.lit(False))).select(half.alias("half"), (1 - F.col(posterior)).alias("s"))
    cal = scored.where("half = 0")
    n = cal.count()

    def place(a: float) -> int:  # of the order statistic, from 1
        level = min(1.0, math.ceil((n + 1) * (1 - a)) / n)
        return min(n, math.ceil(round(level * (n - 1), 9)) + 1)

    if n:
        raw = order_statistics(cal, "s", {"raw": place(alpha), "raw_half": place(alpha / 2)})
    else:
        raw = df.sparkSession.range(1).select(F.lit(DEFAULT_Q).alias("raw"), F.lit(DEFAULT_Q).alias("raw_half"))
    q = raw.withColumn("q", F.least(F.lit(0.95), F.greatest(F.lit(0.05), "raw")))
    q = q.withColumn("stale_q", F.least(F.lit(0.99), F.greatest(F.col("raw_half"), F.col("q") + 0.05))).withColumn("n_calibration", F.lit(n).cast("long"))
    inside = scored.where("half = 1").crossJoin(F.broadcast(q)).agg(F.count("*").alias("n_evaluation"), F.avg((F.col("s") <= F.col("q")).cast("double")).alias("coverage"))
    return q.crossJoin(F.broadcast(inside)).select("q", "stale_q", "n_calibration", "n_evaluation", "coverage")


def conformal_set(posterior: Column, contradicted: Column, recency: Column, q: Column, stale_q: Column) -> Column:
    """struct(labels, decision) of a row: {valid} where it is twice as near as q asks, and wider sets beyond."""
    s = 1 - F.coalesce(posterior, F.lit(0.0))
    sound = ~F.coalesce(contradicted, F.lit(False))
    stale = F.coalesce(recency.isin("stale", "invalid", "future"), F.lit(False)) | (s >= stale_q)
    wide = F.array_compact(F.array(F.when(sound, F.lit("valid")), F.when(stale, F.lit("stale")), F.lit("uncertain")))
    labels = F.when((s <= q * 0.5) & sound, F.array(F.lit("valid"))).when((s <= q) & sound, F.array(F.lit("valid"), F.lit("uncertain"))).otherwise(wide)
    decision = F.when((s <= q * 0.5) & sound, "auto-accept").when((s <= q) & sound, "review").otherwise("low-confidence")
    return F.struct(F.concat(F.lit("{"), F.array_join(labels, ", "), F.lit("}")).alias("labels"), decision.alias("decision"))


def shrunk_trust(df: DataFrame, group: str, posterior: str, passed: str) -> DataFrame:
    """Empirical-Bayes trust per group: .75 mean posterior + .25 (x + 2 prior) / (n + 2)."""
    prior = df.agg(F.avg(F.col(passed).cast("double")).alias("prior"))
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(passed).alias("x"), F.avg(posterior).alias("mean"))
    return per.crossJoin(F.broadcast(prior)).select(
        group, "n", "x", F.round(0.75 * F.col("mean") + 0.25 * (F.col("x") + 2 * F.col("prior")) / (F.col("n") + 2), 6).alias("trust")
    )


def geo_band(place: Column, km: Column, contradicted: Column) -> Column:
    """struct(low, high, score): how many kilometres a place may be off, and its uncertainty in [0, 1]."""
    km = F.greatest(F.coalesce(km, F.lit(0.0)), F.lit(0.0))
    within = lambda low, high: F.least(F.greatest(km, F.lit(low)), F.lit(high))
    alone = F.coalesce(contradicted, F.lit(False)) & ~F.coalesce(place.isin("outside", "far", "moderate", "missing"), F.lit(False))
    steps = [  # test, low, high, quality score
        (alone, 5.0, within(25.0, 1000.0), 0.65), (place == "missing", 10.0, F.lit(250.0), 1.0), (place == "moderate", 2.0, within(10.0, 250.0), 0.35),
        (place == "far", 10.0, within(50.0, 2500.0), 0.75), (place == "outside", 50.0, within(250.0, 5000.0), 1.0),
    ]
    band = F.struct(F.lit(0.1).alias("low"), F.lit(5.0).alias("high"), F.lit(0.0).alias("quality"))
    for test, low, high, quality in reversed(steps):
        band = F.when(test, F.struct(F.lit(low).alias("low"), high.alias("high"), F.lit(quality).alias("quality"))).otherwise(band)
    score = 0.68 * band["quality"] + 0.32 * F.least(km, F.lit(250.0)) / 250.0
    return F.struct(stats.half_up(band["low"], 2).alias("low"), stats.half_up(band["high"], 2).alias("high"), stats.half_up(stats.clip01(score), 4).alias("score"))


def record_uncertainty(df: DataFrame) -> DataFrame:
    """Add the active-learning scores of records: uncertainty, contradiction, leverage, total and the proxy band around trust.

    Needs the derived evidence, need and priority (of the district), capacity_width and doctors_width (relative
    widths of the estimates) and segment_n (records of the same kind, operator and state).
    """
    extreme = F.col("capacity_outlier") | F.col("doctors_outlier")
    low_join, blind_date = F.coalesce(F.col("join_confidence"), F.lit(0.0)) < 0.8, F.col("recency").isin("invalid", "future", "missing")
    geo = geo_band(F.col("geo_quality"), F.col("km"), F.col("contradicted"))
    rarity = stats.clip01(1 - F.least(F.col("segment_n"), F.lit(50)) / 50.0)
    need, priority = stats.clip01(F.coalesce("need", F.lit(0.5))), stats.clip01(F.coalesce("priority", F.lit(0.5)))
    df = df.withColumns(
        {
            "geo_score": geo["score"], "rarity": rarity,
            "uncertainty_score": stats.clip01(weighted(
                [(stats.clip01(1 - F.coalesce("semantic_quality", F.lit(0.0))), 0.22, 0), (flag(F.col("capacity_status") != "observed_valid"), 0.15, 0),
                 (flag(F.col("doctors_status") != "observed_valid"), 0.15, 0), (F.col("capacity_width"), 0.12, 0), (F.col("doctors_width"), 0.12, 0),
                 (flag(F.col("critical_gap")), 0.10, 0), (flag(low_join), 0.08, 0), (flag(blind_date), 0.06, 0)]
            )),
        }
    )
    df = df.withColumns(
        {
            "contradiction_score": stats.clip01(weighted(
                [(F.col("geo_score"), 0.35, 0), (flag(extreme), 0.25, 0), (flag(F.col("pin_ambiguous")), 0.15, 0), (flag(low_join), 0.15, 0), (flag(blind_date), 0.10, 0)]
            )),
            "leverage_score": stats.clip01(weighted(
                [(priority, 0.45, 0), (need, 0.25, 0), (stats.clip01(1 - F.coalesce("supply_confidence", F.lit(0.0))), 0.20, 0), (flag(F.col("needs_review")), 0.10, 0)]
            )),
        }
    )
    total = weighted(
        [(need, 0.30, 0), (F.col("uncertainty_score"), 0.30, 0), (F.col("contradiction_score"), 0.18, 0), (F.col("leverage_score"), 0.14, 0), (F.col("rarity"), 0.08, 0)]
    )
    width = F.greatest(F.lit(0.12), F.least(F.lit(0.56), 0.12 + 0.28 * F.col("uncertainty_score") + 0.16 * F.col("contradiction_score")))
    trust = stats.clip01(F.coalesce("semantic_quality", F.lit(0.0)))
    action = (
        F.when(extreme | F.col("geo_quality").isin("outside", "far"), "contradiction_audit").when(F.col("critical_gap"), "semantic_missingness_enrichment")
        .when(low_join | F.coalesce("pin_ambiguous", F.lit(False)), "join_bridge_enrichment")
        .when((need >= 0.75) & (F.col("uncertainty_score") >= 0.45), "high_impact_uncertainty_reduction").when(F.col("rarity") >= 0.75, "sparse_segment_coverage")
        .otherwise("uncertainty_monitor")
    )
    return df.withColumns(
        {
            "active_score": stats.half_up(stats.clip01(total), 4), "trust_low": stats.half_up(stats.clip01(trust - width / 2), 4),
            "trust_high": stats.half_up(stats.clip01(trust + width / 2), 4), "learning_action": action,
        }
    )


def external_check(place: Column, priority: Column, contradicted: Column) -> Column:
    """What a source outside should settle about a place."""
    return (
        F.when(place == "outside", "replace_coordinate_with_external_geocode").when(place == "missing", "geocode_missing_coordinate")
        .when(place == "far", "geocode_and_compare_pincode_district")
        .when((place == "moderate") & (F.coalesce(priority, F.lit(0.5)) >= 0.6), "high_impact_geocode_precision_check")
        .when(place == "moderate", "batch_geocode_precision_check").when(F.coalesce(contradicted, F.lit(False)), "external_source_contradiction_check")
        .otherwise("no_external_geocode_required")
    )


def district_uncertainty(rates: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(score, mean interval width) of a district from its scores, level and Wilson intervals of ``rates`` (count, of how many)."""
    widths = []
    for x, n in rates:
        ci = stats.wilson(F.col(x), F.col(n))
        widths.append(F.abs(ci["high"] - ci["low"]))
    width = F.coalesce(mean_known(widths), F.lit(0.0))
    level = F.when(F.col("uncertainty") == "lower", 0.1).when(F.col("uncertainty") == "medium", 0.55).otherwise(1.0)
    score = weighted(
        [(F.col("care_gap"), 0.24, 0), (F.col("trust_gap"), 0.22, 0), (F.col("need"), 0.18, 0), (stats.clip01(width), 0.14, 0), (level, 0.12, 0),
         (1 - F.least(F.col("observed"), F.lit(20)) / 20.0, 0.10, 0)]
    )
    return stats.half_up(stats.clip01(score), 4), stats.half_up(width, 4)
