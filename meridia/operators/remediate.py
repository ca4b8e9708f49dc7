"""What would mend a record: issue masks, remediation actions with reasons, and the score that picks records for people to label.

Codes, weights and orders are fixed values of the remediation policy. All of it reads the columns that
``evidence.derive`` adds, and the district's priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators.scores import flag, weighted

HIGH_IMPACT = {"maternity": "maternity", "emergency": "emergency", "diagnostic": "diagnostic", "chronic": "ncd"}  # column -> label
WEAK_JOINS = ["pincode_only_no_health_match", "facility_city_state_fallback", "no_valid_pincode", "pincode_district_state_fuzzy", "unjoined"]


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _any(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = out | m
    return out


def issue_masks() -> dict[str, Column]:
    """Every reusable issue as a boolean column that is never null; low_risk is the gate of records without any."""
    m: dict[str, Column] = {}
    for name, c in (("capacity", "capacity"), ("doctor", "doctors")):
        status, estimated = F.col(f"{c}_status"), F.col(f"{c}_status") != "observed_valid"
        m[f"{name}_incomplete"] = estimated
        m[f"{name}_parse_or_outlier"] = status.isin("present_unparseable", "observed_extreme_outlier") | _true(f"{c}_outlier")
        m[f"{name}_low_confidence"] = F.col(f"{c}_confidence").isin("low", "low_medium") | (estimated & (F.coalesce(F.col(f"{c}_peers"), F.lit(0)) < 10))
    m["recency_missing"] = F.coalesce(F.col("recency") == "missing", F.lit(True))
    m["recency_stale_or_invalid"] = F.coalesce(F.col("recency").isin("stale", "future", "invalid"), F.lit(False))
    m["recency_problem"] = m["recency_missing"] | m["recency_stale_or_invalid"]
    m["coords_missing"] = F.col("lat").isNull() | F.col("lon").isNull() | (F.col("geo_quality") == "missing")
    m["geo_far_or_outside"] = F.col("geo_quality").isin("far", "outside")
    m["geo_moderate"] = F.col("geo_quality") == "moderate"
    m["severe_geo"] = m["coords_missing"] | m["geo_far_or_outside"]
    m["geo_issue"] = m["severe_geo"] | m["geo_moderate"]
    m["source_missing"] = ~_true("has_source") | (F.coalesce(F.col("sources"), F.lit(0)) == 0)
    m["official_website_missing"] = ~_true("has_website")
    m["contact_evidence_missing"] = ~_true("has_contact")
    m["phone_or_email_missing"] = ~_true("has_phone") | ~_true("has_mail")
    for c in ("specialties", "procedure", "equipment", "capability"):
        m[f"{c}_missing"] = ~_true(f"has_{c}")
    m["missing_service_claim_fields"] = _any(*(m[f"{c}_missing"] for c in ("specialties", "procedure", "equipment", "capability")))
    m["low_join_confidence"] = F.coalesce(F.col("join_confidence") < 0.80, F.lit(True))
    m["fuzzy_or_fallback_join"] = F.col("join_strategy").isin(WEAK_JOINS)
    m["missing_health_district"] = F.col("match_score").isNull()
    m["join_issue"] = m["low_join_confidence"] | m["fuzzy_or_fallback_join"] | m["missing_health_district"]
    m["pincode_missing"] = F.col("pin").isNull()
    m["pincode_ambiguous"] = _true("pin_ambiguous")
    m["pin_issue"] = m["pincode_missing"] | m["pincode_ambiguous"]
    m["high_impact_claim"] = high_impact_count() > 0
    m["needs_human_review"], m["contradicted"] = _true("needs_review"), _true("contradicted")
    m["outlier_or_conflict"] = _any(m["contradicted"], m["capacity_parse_or_outlier"], m["doctor_parse_or_outlier"], m["geo_far_or_outside"])
    m["high_impact_claim_needs_review"] = m["high_impact_claim"] & _any(
        *(m[k] for k in ("needs_human_review", "outlier_or_conflict", "source_missing", "recency_problem", "join_issue", "missing_service_claim_fields"))
    )
    m["critical_missing_high"] = F.coalesce(F.col("gaps"), F.lit(0)) >= 3
    m["critical_supply_gap"] = _true("critical_gap")
    issues = ("needs_human_review", "contradicted", "official_website_missing", "phone_or_email_missing", "contact_evidence_missing", "recency_problem", "capacity_incomplete",
              "doctor_incomplete", "missing_service_claim_fields", "pincode_ambiguous", "low_join_confidence")
    m["low_risk"] = ~_any(*(m[k] for k in issues)) & (F.col("geo_quality") == "plausible") & _true("has_source")
    return m


MASKS = [
    "capacity_incomplete", "capacity_parse_or_outlier", "capacity_low_confidence", "doctor_incomplete", "doctor_parse_or_outlier", "doctor_low_confidence", "recency_missing",
    "recency_stale_or_invalid", "recency_problem", "coords_missing", "geo_far_or_outside", "geo_moderate", "severe_geo", "geo_issue", "source_missing", "official_website_missing",
    "contact_evidence_missing", "phone_or_email_missing", "specialties_missing", "procedure_missing", "equipment_missing", "capability_missing", "missing_service_claim_fields",
    "low_join_confidence", "fuzzy_or_fallback_join", "missing_health_district", "join_issue", "pincode_missing", "pincode_ambiguous", "pin_issue", "high_impact_claim",
    "high_impact_claim_needs_review", "needs_human_review", "contradicted", "outlier_or_conflict", "critical_missing_high", "critical_supply_gap", "low_risk",
]


def high_impact_count() -> Column:
    return sum((_true(c).cast("long") for c in HIGH_IMPACT), F.lit(0).cast("long"))


def actions(m: dict[str, Column]) -> Column:
    """What to do, in fixed order; records without any get the code for that."""
    wanted = text.codes(
        {
            "geocode": m["geo_issue"], "claims_verification": m["outlier_or_conflict"] | m["high_impact_claim_needs_review"],
            "registry_source_enrichment": _any(
                *(m[k] for k in ("source_missing", "official_website_missing", "recency_problem", "capacity_low_confidence", "doctor_low_confidence",
                                 "missing_service_claim_fields", "join_issue", "pin_issue"))
            ),
            "phone_email_reachability_review": m["contact_evidence_missing"] | m["phone_or_email_missing"],
            "keep_estimate_with_interval": m["capacity_incomplete"] | m["doctor_incomplete"],
        }
    )
    return F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("no_action_low_risk")))


def reasons(m: dict[str, Column], high_priority: Column) -> Column:
    """Why, in fixed order."""
    enriched = F.array_contains(actions(m), "registry_source_enrichment")
    labels = F.array_join(text.codes({label: _true(c) for c, label in HIGH_IMPACT.items()}), ",")
    said = text.codes(
        {
            "missing_coordinates": m["geo_issue"] & m["coords_missing"], "severe_geo_issue": ~m["coords_missing"] & m["geo_far_or_outside"],
            "moderate_geo_precision_issue": ~m["severe_geo"] & m["geo_moderate"], "conflicting_evidence_or_outlier": m["outlier_or_conflict"],
            "high_impact_claims_need_review": m["high_impact_claim_needs_review"], "missing_source_urls": m["source_missing"],
            "missing_stale_or_invalid_recency": m["recency_problem"], "missing_specialty_procedure_equipment_or_capability_evidence": m["missing_service_claim_fields"],
            "low_confidence_or_unjoined_district": m["join_issue"], "pin_missing_or_ambiguous": m["pin_issue"],
            "low_confidence_peer_estimate": enriched & (m["capacity_low_confidence"] | m["doctor_low_confidence"]),
            "contact_evidence_missing_or_incomplete": m["contact_evidence_missing"] | m["phone_or_email_missing"],
            "capacity_missing_or_estimated": m["capacity_incomplete"], "doctor_count_missing_or_estimated": m["doctor_incomplete"],
            "needs_human_review": m["needs_human_review"], "semantic_missing_critical_count_ge_3": m["critical_missing_high"],
            "high_medical_desert_priority": F.coalesce(high_priority, F.lit(False)),
        }
    )
    named = F.when(m["high_impact_claim"], F.array(F.concat(F.lit("high_impact_claims:"), labels))).otherwise(F.array().cast("array<string>"))
    out = F.concat(said, named)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("low_risk_no_missing_data_action")))


# What a primary action asks for.
TASKS = {
    "geocode": "Resolve address, coordinate, PIN, and district alignment before location-sensitive use.",
    "claims_verification": "Corroborate high-impact service, capacity, doctor, or conflict claim from source evidence.",
    "registry_source_enrichment": "Find authoritative or independent source evidence for missing identity, district, recency, or service fields.",
    "phone_email_reachability_review": "Check whether listed phone/email evidence exists and is reachable; blank means unknown.",
    "keep_estimate_with_interval": "Keep estimate visible with interval and avoid treating the estimated field as observed truth.",
}


def remediation(df: DataFrame) -> DataFrame:
    """Add actions, reasons, primary_action and task; the upper quarter of the known priorities counts as high."""
    m = issue_masks()
    cut = df.agg(F.percentile("priority", 0.75).alias("__cut"))  # as many distinct values as districts
    df = df.crossJoin(F.broadcast(cut)).withColumns({"actions": actions(m), "reasons": reasons(m, F.col("priority") >= F.col("__cut"))}).drop("__cut")
    first = F.get("actions", F.lit(0))
    task = F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv))
    return df.withColumns({"primary_action": first, "task": F.coalesce(F.try_element_at(task, first), F.lit("No immediate remediation action; keep row in routine monitoring."))})


def seed_score(df: DataFrame) -> DataFrame:
    """Add seed_score: which records are most worth a person's labels; an unknown priority counts as the middle."""
    m = issue_masks()
    df = stats.pct_ranks(df, {"priority": "priority_pct"})
    geo = F.when(m["geo_far_or_outside"], 1.0).when(m["coords_missing"], 0.95).when(m["geo_moderate"], 0.45).otherwise(0.0)
    gap = F.greatest(flag(m["source_missing"]), flag(m["contact_evidence_missing"]))
    score = weighted(
        [(F.col("priority_pct"), 0.24, 0.5), (flag(m["needs_human_review"]), 0.16, 0), (geo, 0.16, 0), (F.least(F.col("gaps") / 5.0, F.lit(1.0)), 0.16, 0),
         (flag(m["outlier_or_conflict"]), 0.12, 0), (F.least(high_impact_count(), F.lit(4)) / 4.0, 0.10, 0),
         (stats.clip01(1 - F.col("join_confidence")), 0.04, 1), (gap, 0.02, 0)]
    )
    return df.withColumn("seed_score", stats.half_up(score, 6))
