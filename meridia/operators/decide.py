"""Decisions: expected-value ranking of interventions, what-if comparison, claim rules, remediation, seeds, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators.relational import rank_within
from meridia.operators.scores import flag, weighted


def wrong_chance(level: Column, n: Column, review: Column, critical: Column, ci_width: Column) -> Column:
    base = F.when(level == "lower", 0.12).when(level == "medium", 0.25).when(level == "higher", 0.42).otherwise(0.30)
    extra = F.when(n < 8, 0.15).otherwise(0.0) + F.when(review >= 0.85, 0.12).otherwise(0.0) + F.when(critical >= 0.75, 0.08).otherwise(0.0) + F.when(ci_width >= 0.5, 0.06).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.85), base + extra))


def candidates(c: dict[str, Column]) -> Column:
    """array(struct(option, gap, p, cost, harm, flagged)): seven interventions as functions of a district's rates.

    An unknown indicator opens no gap: neither missing insurance nor missing births count against a district.
    """
    clip, g = stats.clip01, {}
    g["mobile_clinic"] = clip(0.6 * (1 - c["trust"]) + 0.4 * (1 - c["capacity_rate"]))
    known = lambda x: F.coalesce(x, F.lit(0.0))
    g["maternal_outreach"] = clip(0.5 * known(1 - c["births"]) + 0.3 * known(c["anaemia"]) + 0.2 * (1 - c["maternity"]))
    g["chronic_care"] = clip(0.4 * known(c["pressure"]) + 0.4 * known(c["sugar"]) + 0.2 * (1 - F.greatest(c["chronic"], c["diagnostic"])))
    g["insurance"] = clip(known(1 - c["insurance"]))
    g["contact_outreach"] = clip(0.5 * c["review"] + 0.4 * (1 - c["contact"]) + 0.1 * (1 - c["source"]))
    fits = c["verify_fits"]
    g["verify_first"] = clip((0.5 * c["review"] + 0.5 * c["critical"]) * F.when(fits | (c["review"] >= 0.9), 1.0).otherwise(0.45))
    g["telehealth"] = clip(1 - c["trust"])
    p = {
        "mobile_clinic": 0.35 + 0.4 * g["mobile_clinic"] + F.when(c["deploy_fits"], 0.2).otherwise(0.0), "maternal_outreach": 0.3 + 0.5 * g["maternal_outreach"],
        "chronic_care": 0.3 + 0.5 * g["chronic_care"], "insurance": 0.25 + 0.55 * g["insurance"] + F.when(c["refer_fits"], 0.15).otherwise(0.0),
        "contact_outreach": 0.3 + 0.45 * g["contact_outreach"], "verify_first": 0.35 + 0.45 * g["verify_first"] + F.when(fits, 0.15).otherwise(0.0),
        "telehealth": F.least(F.lit(0.7), 0.18 + 0.25 * g["telehealth"]),
    }
    cost = {"mobile_clinic": 0.55, "maternal_outreach": 0.42, "chronic_care": 0.22, "insurance": 0.18, "contact_outreach": 0.30, "verify_first": 0.12, "telehealth": 0.20}
    harm = {"mobile_clinic": 0.60, "maternal_outreach": 0.45, "chronic_care": 0.30, "insurance": 0.25, "contact_outreach": 0.25, "verify_first": 0.10, "telehealth": 0.40}
    shaky = (c["review"] >= 0.7) | (c["level"] == "higher")
    return F.array(
        *(F.struct(F.lit(k).alias("option"), g[k].alias("gap"), F.least(F.lit(0.95), p[k]).alias("p"), F.lit(cost[k]).alias("cost"), F.lit(harm[k]).alias("harm"),
                   (shaky if k == "telehealth" else F.lit(False)).alias("flagged")) for k in g)
    )


def recommend(df: DataFrame, key: str, need: Column, options: Column, p_wrong: Column) -> DataFrame:
    """Expected value of every option per district, ranked; options that cannot be verified come last."""
    long = df.select(key, F.coalesce(need, F.lit(0.5)).alias("need"), p_wrong.alias("pw"), F.explode(options).alias("o"))
    pw = F.least(F.lit(0.95), F.col("pw") + F.when(F.col("o.flagged"), 0.15).otherwise(0.0))
    benefit = 1.6 * stats.clip01(0.35 + 0.65 * F.col("need")) * stats.clip01(0.3 + 0.7 * F.col("o.gap"))
    long = long.select(key, "o.option", "o.p", "o.cost", "o.harm", "o.flagged", pw.alias("p_wrong"), benefit.alias("benefit"))
    ev = F.col("p") * F.col("benefit") - 0.6 * F.col("p_wrong") * F.col("harm") - 0.6 * F.col("cost")
    gain = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 62.5 * F.col("p") * F.col("benefit") * (1 - 0.5 * F.col("p_wrong"))))
    confidence = F.when((F.col("p_wrong") >= 0.5) | (F.col("p") < 0.35) | F.col("flagged"), "Low").when((F.col("p_wrong") <= 0.22) & (F.col("p") >= 0.55), "High").otherwise("Medium")
    out = long.select(key, "option", "flagged", F.round(ev, 4).alias("ev"), F.round(gain, 4).alias("gain"), confidence.alias("confidence"))
    last = F.when(F.col("flagged") | (F.col("option") == "telehealth"), 1).otherwise(0)
    return rank_within(out, [key], [last, F.desc("ev"), F.asc("option")], "rank")


def what_if(df: DataFrame, key: str, need: Column, trust: Column, mobile: int = 1, capacity: float = 20.0, adoption: float = 0.3) -> DataFrame:
    """Five options per district under three levers, best first, cheaper first among equals."""
    deficit = stats.clip01(need * (1 - trust))
    options = [
        ("mobile_clinic", deficit * min(1.5, 0.6 + 0.4 * max(1, mobile)), 2), ("new_capacity", deficit * 0.90 * (0.5 + min(1.0, max(0.0, capacity / 50))), 3),
        ("telehealth", deficit * 0.35 * (0.4 + 0.6 * adoption) * (0.5 + 0.5 * trust), 1), ("transport_vouchers", deficit * 0.55 * (0.4 + 0.6 * trust), 1),
        ("pharmacy_screening", deficit * 0.50 * 0.8, 1),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("option"), F.round(stats.clip01(s), 3).alias("score"), F.lit(c).cast("long").alias("cost")) for k, s, c in options))
    long = df.select(key, F.explode(rows).alias("o")).select(key, "o.*").withColumn("band", stats.band(F.col("score"), [(0.55, "High"), (0.30, "Medium")], "Low"))
    return rank_within(long, [key], [F.desc("score"), F.asc("cost"), F.asc("option")], "rank")


def evidence(df: DataFrame) -> DataFrame:
    """tier, posture, action, abstain reason and confidence of each record: a proxy label never counts as truth."""
    conflict, review = F.col("contradicted"), F.col("needs_review")
    confidence = 0.42 * F.col("readiness") + 0.30 * F.coalesce("join_confidence", F.lit(0.0)) + 0.28 * F.col("semantic_quality")
    confidence = confidence * F.when(conflict, 0.45).otherwise(1.0) * F.when(review, 0.75).otherwise(1.0)
    return df.withColumns(
        {
            "tier": F.when(conflict, "conflict").otherwise("bronze"),
            "posture": F.when(conflict, "contradicted_or_geo_invalid").when(F.col("trusted") & ~review, "passed_proxy_checks").when(review, "needs_review").otherwise("unknown"),
            "action": F.when(conflict, "verify_location_before_use").when(review, "source_enrichment_or_manual_review").otherwise("use_as_proxy_only"),
            "abstain": F.when(conflict, "source_or_geography_conflict").otherwise("no_tier_a_or_b_corroborated_label"),
            "confidence": stats.half_up(stats.clip01(confidence), 4),
        }
    )


def geo_review_score(km: Column, state_conflict: Column, city_conflict: Column, ambiguous: Column, pin: Column, priority: Column) -> Column:
    """Points for checking a place."""
    return F.round(
        weighted(
            [(flag(F.col("contradicted")), 50, 0), (flag(F.col("geo_quality") == "outside"), 35, 0), (flag(F.col("geo_quality") == "far"), 25, 0),
             (flag(F.col("geo_quality") == "moderate"), 12, 0), (flag(state_conflict), 25, 0), (flag(city_conflict), 10, 0), (flag(ambiguous), 8, 0), (flag(pin.isNull()), 12, 0),
             (flag(F.col("join_confidence") < 0.8), 6, 0), (F.least(F.greatest(km, F.lit(0.0)), F.lit(5000.0)) / 100.0, 1, 0), (priority, 8, 0)]
        ),
        4,
    )


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def geocode_matches(formatted: Column, pin: Column, state: Column, city: Column) -> dict[str, Column]:
    """Which expected parts stand in a geocoder's formatted address: the PIN as it is, names by letters and digits."""
    found = F.coalesce(formatted, F.lit(""))
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    named = lambda c: said(c) & F.contains(_letters(found), _letters(c))
    return {"pin_match": said(pin) & F.contains(found, F.trim(F.coalesce(pin, F.lit("")))), "state_match": named(state), "city_match": named(city)}


def geocode_outcome(status: Column, results: Column, location_type: Column, partial: Column, pin_match: Column, state_match: Column) -> Column:
    """What a geocoder's answer (an input table here) is worth; the first rule that holds decides."""
    return (
        F.when(status == "ZERO_RESULTS", "zero_results_review")
        .when((status != "OK") | (results == 0), F.concat(F.lit("api_"), F.coalesce(F.nullif(F.lower(status), F.lit("")), F.lit("unknown")), F.lit("_review")))
        .when(F.coalesce(partial, F.lit(False)), "partial_match_review").when(~state_match, "state_mismatch_review").when(~pin_match, "pincode_mismatch_review")
        .when(location_type.isin("ROOFTOP", "RANGE_INTERPOLATED"), "accept_coordinate_candidate").when(location_type == "GEOMETRIC_CENTER", "neighborhood_candidate_h3_only")
        .when(location_type == "APPROXIMATE", "approximate_review").otherwise("provider_metadata_review")
    )


# What an outcome leads to, with the note that goes with it; other outcomes stay in review.
CORRECTIONS = {
    "accept_coordinate_candidate": ("propose_replace_coordinate", "Precise Google result with admin/PIN checks; review before canonical overwrite."),
    "neighborhood_candidate_h3_only": ("store_h3_neighborhood_candidate", "Coarse Google result; use for H3/neighborhood planning only."),
}


def corrections(geocoded: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, outcome, action, note, km): accepted geocodes beside the records they would move; nothing is overwritten."""
    kept = geocoded.where(F.col("outcome").isin(list(CORRECTIONS)))
    out = kept.join(records.select(key, "lat", "lon"), key, "left")
    pick = lambda k: F.coalesce(*(F.when(F.col("outcome") == o, F.lit(v[k])) for o, v in CORRECTIONS.items()))
    km = stats.haversine_km(F.col("lat"), F.col("lon"), F.col("found_lat"), F.col("found_lon"))
    return out.select(key, "outcome", pick(0).alias("action"), pick(1).alias("note"), F.round(km, 3).alias("km"))


def place_match(name: Column, state: Column, city: Column, place_name: Column, address: Column) -> Column:
    """struct(score, label) of a found place: .70 its name, .18 the state, .12 the city in its address."""
    spaced = lambda c: text.key_spaced(c)
    holds = lambda whole, part: (spaced(part) != "") & F.contains(spaced(whole), spaced(part))
    words = lambda c: F.array_distinct(F.filter(F.split(spaced(c), " "), lambda x: x != ""))
    shared = F.size(F.array_intersect(words(name), words(place_name))) / F.greatest(F.size(words(name)), F.lit(1))
    score = 0.70 * F.when(holds(place_name, name), 1.0).otherwise(shared) + 0.18 * flag(holds(address, state)) + 0.12 * flag(holds(address, city))
    return F.struct(stats.half_up(score, 3).alias("score"), stats.band(score, [(0.82, "high"), (0.62, "medium")], "low").alias("label"))
