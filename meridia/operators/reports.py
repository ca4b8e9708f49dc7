"""Gold tables and reports: features of districts, recommendation and confidence rows, summaries, queues by focus.

Codes, texts, severities and thresholds are fixed values of the planning policy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators import relational as rel
from meridia.operators import scores

# Domain, issue, mask, action, severity of each line of the remediation summary.
SUMMARY = [
    ("capacity", "capacity_missing_unparseable_or_estimated", "capacity_incomplete", "keep_estimate_with_interval", "medium"),
    ("capacity", "capacity_unparseable_or_extreme_outlier", "capacity_parse_or_outlier", "claims_verification", "high"),
    ("capacity", "capacity_low_confidence_estimate", "capacity_low_confidence", "registry_source_enrichment", "medium"),
    ("doctors", "doctor_count_missing_unparseable_or_estimated", "doctor_incomplete", "keep_estimate_with_interval", "medium"),
    ("doctors", "doctor_count_unparseable_or_extreme_outlier", "doctor_parse_or_outlier", "claims_verification", "high"),
    ("doctors", "doctor_count_low_confidence_estimate", "doctor_low_confidence", "registry_source_enrichment", "medium"),
    ("recency", "source_recency_missing", "recency_missing", "registry_source_enrichment", "medium"),
    ("recency", "source_recency_stale_or_invalid", "recency_stale_or_invalid", "registry_source_enrichment", "medium"),
    ("coordinates", "coordinates_missing", "coords_missing", "geocode", "high"),
    ("coordinates", "coordinates_outside_india_or_far_from_pincode", "geo_far_or_outside", "geocode", "high"),
    ("coordinates", "coordinates_moderate_distance_from_pincode", "geo_moderate", "geocode", "medium"),
    ("contact_evidence", "contact_evidence_missing_or_unknown", "contact_evidence_missing", "phone_email_reachability_review", "medium"),
    ("contact_evidence", "phone_or_email_field_missing", "phone_or_email_missing", "phone_email_reachability_review", "low"),
    ("source_urls", "source_urls_missing_or_unknown", "source_missing", "registry_source_enrichment", "high"),
    ("source_urls", "official_website_missing_or_unknown", "official_website_missing", "registry_source_enrichment", "low"),
    ("specialties", "specialties_missing_or_unknown", "specialties_missing", "registry_source_enrichment", "medium"),
    ("procedures", "procedures_missing_or_unknown", "procedure_missing", "registry_source_enrichment", "medium"),
    ("equipment", "equipment_missing_or_unknown", "equipment_missing", "registry_source_enrichment", "medium"),
    ("capabilities", "capabilities_missing_or_unknown", "capability_missing", "registry_source_enrichment", "medium"),
    ("claims", "high_impact_claims_need_human_review", "high_impact_claim_needs_review", "claims_verification", "high"),
    ("district_join_confidence", "join_confidence_low_or_unknown", "low_join_confidence", "registry_source_enrichment", "high"),
    ("district_join_confidence", "fuzzy_fallback_or_unjoined_district", "fuzzy_or_fallback_join", "registry_source_enrichment", "high"),
    ("district_join_confidence", "health_district_missing", "missing_health_district", "registry_source_enrichment", "high"),
    ("pin_ambiguity", "pincode_missing_or_unparseable", "pincode_missing", "registry_source_enrichment", "high"),
    ("pin_ambiguity", "pincode_maps_to_multiple_admin_areas", "pincode_ambiguous", "registry_source_enrichment", "medium"),
    ("overall", "no_action_low_risk_rows", "low_risk", "no_action_low_risk", "none"),
]
ACTIONS = ["geocode", "claims_verification", "registry_source_enrichment", "phone_email_reachability_review", "keep_estimate_with_interval", "no_action_low_risk"]
SEVERITIES = ["high", "medium", "low", "none"]


def by_list(column: str, order: Sequence[str]) -> Column:
    """Where a code stands in a fixed order; codes that are not in it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column)), F.lit(0)), F.lit(99))


def remediation_summary(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One line an issue: rows, share, action and severity, the gravest first; one pass over the records."""
    counts = df.agg(F.count("*").alias("denominator"), *(F.count_if(masks[m]).alias(m) for _, _, m, _, _ in SUMMARY))
    lines = F.array(
        *(F.struct(F.lit(d).alias("domain"), F.lit(i).alias("issue"), F.col(m).alias("rows"), F.lit(a).alias("action"), F.lit(s).alias("severity")) for d, i, m, a, s in SUMMARY)
    )
    long = counts.select("denominator", F.explode(lines).alias("x")).select("x.*", "denominator")
    long = long.withColumn("share", F.round(stats.share(F.col("rows"), F.col("denominator")), 6))
    return long.orderBy(by_list("severity", SEVERITIES), by_list("action", ACTIONS), F.desc("rows"), "domain", "issue")


def gravest_issues(summary: DataFrame, n: int = 12) -> DataFrame:
    """The largest issues of high or medium severity."""
    return rel.top(summary.where(F.col("severity").isin("high", "medium")), [F.desc("rows"), F.asc("domain"), F.asc("issue")], n, "place")


def access_features(districts: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counts, density proxy, risk of 0 to 100 and its band; districts without counted records count none.

    The density is trusted per observed records, as no population is known.
    """
    names = [c for c in counts.columns if c != key]
    out = districts.join(counts, key, "left").fillna(0, names)
    risk = F.round(F.coalesce(F.col("priority"), F.lit(0.0)) * 100, 2)
    density = F.coalesce(F.col("trusted_n"), F.lit(0)).cast("double") / F.greatest(F.col("observed").cast("double"), F.lit(1.0))
    return out.select(
        key, *names, stats.half_up(density, 4).alias("density"), risk.alias("risk"), stats.band(risk, [(75, "severe"), (50, "high"), (25, "medium")], "low").alias("risk_band")
    )


def conflict_summary() -> Column:
    """The flags of a record as a text people read; empty where nothing is wrong."""
    return F.concat_ws(
        "; ", F.when(F.col("contradicted"), "contradicted/geo-invalid"), F.when(~scores.in_box(F.col("lat"), F.col("lon")), "coordinates outside India bbox"),
        F.when(F.coalesce("pin_ambiguous", F.lit(False)), "ambiguous PIN/region"), F.when(~F.coalesce("has_source", F.lit(False)), "no source URL"),
        F.when(F.col("needs_review"), "flagged for review"),
    )


def confidence_rows(df: DataFrame, key: str, posteriors: DataFrame | None = None) -> DataFrame:
    """Records with confidence, band and conflicts; posterior and action from ``posteriors``, else from the confidence itself."""
    score = scores.provider_confidence()
    base = df.select(key, score.alias("confidence"), conflict_summary().alias("conflicts"))
    base = base.withColumn("band", stats.band(F.col("confidence"), [(0.66, "high"), (0.40, "medium")], "low"))
    if posteriors is not None:
        return base.join(posteriors.select(key, "posterior", "action"), key, "left")
    action = F.when(F.col("band") == "high", "auto-accept").when(F.col("band") == "medium", "merge-or-review").otherwise("human-review")
    return base.withColumns({"posterior": F.col("confidence"), "action": action})


def limitation(option: Column, reason: Column) -> Column:
    """What a recommendation rests on."""
    return F.when(F.lower(option).contains("telehealth"), "Telehealth viability uncertain: broadband / digital-access signal NOT in dataset.").otherwise(
        F.coalesce(reason, F.lit("Scores derived from extracted claims, not verified facility audits."))
    )


def recommendation_summary(ranked: DataFrame, option: str, rank: str, ev: str, confidence: str) -> DataFrame:
    """(kind, name, n, low, middle, high): how often each option leads, how often each stands at all, confidences, and the spread of ev."""
    lead = ranked.where(F.col(rank) == 1).groupBy(F.col(option).alias("name")).agg(F.count("*").alias("n")).select(F.lit("leading").alias("kind"), "name", "n")
    every = ranked.groupBy(F.lit("option").alias("kind"), F.col(option).alias("name")).agg(F.count("*").alias("n"))
    sure = ranked.groupBy(F.lit("confidence").alias("kind"), F.col(confidence).alias("name")).agg(F.count("*").alias("n"))
    q = stats.quantiles(ranked, [], ev, [0.0, 0.5, 1.0])
    spread = q.select(F.lit("ev").alias("kind"), F.lit(ev).alias("name"), "n", *(F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate(("low", "middle", "high"))))
    return lead.unionByName(every).unionByName(sure).unionByName(spread, allowMissingColumns=True)


def focus(df: DataFrame, name: str, n: int) -> DataFrame:
    """The verification queue seen through a focus: positive controls, contradictions, review, or all."""
    by_priority = [F.desc("priority"), F.asc("entity_id")]
    seen = {
        "positive_controls": (F.col("label_seed") == "verified_seed_candidate", [F.desc("readiness"), F.desc("join_confidence"), F.asc("entity_id")]),
        "contradictions": (F.col("label_seed") == "contradicted_seed", by_priority), "review": (F.col("needs_review"), by_priority), "all": (F.lit(True), by_priority),
    }
    test, order = seen[name]
    return rel.top(df.where(test), order, n, "place")


def label_seed() -> Column:
    """What a record may serve as when labels are collected."""
    return F.when(F.col("contradicted"), "contradicted_seed").when(F.col("trusted") & ~F.col("needs_review"), "verified_seed_candidate").when(
        F.col("needs_review"), "review_seed").otherwise("unlabelled_seed")


def confidence_bins(df: DataFrame, column: str) -> DataFrame:
    """(kind, name, n, share): left-closed bands of a confidence, and coverage at and above thresholds; overlapping, so no sum."""
    c = F.col(column)
    bands = [("0.00-0.50", (c < 0.5)), ("0.50-0.70", (c >= 0.5) & (c < 0.7)), ("0.70-0.80", (c >= 0.7) & (c < 0.8)), ("0.80-0.90", (c >= 0.8) & (c < 0.9)), ("0.90-1.00", c >= 0.9)]
    tests = [("band", n, t) for n, t in bands] + [("coverage", f">= {t:.2f}", c >= t) for t in (0.50, 0.70, 0.80, 0.90)]
    counts = df.agg(F.count(column).alias("all"), *(F.count_if(t).alias(f"c{k}") for k, (_, _, t) in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f"c{k}").alias("n")) for k, (kind, name, _) in enumerate(tests)))
    return counts.select("all", F.explode(rows).alias("x")).select("x.*", F.round(stats.share(F.col("x.n"), F.col("all")), 6).alias("share"))


def source_matches(df: DataFrame, key: str) -> DataFrame:
    """One row for each record itself, and one more for its PIN's directory entry where it has a PIN; no match promotes a label."""
    own = F.struct(F.lit("cleaned_records").alias("system"), F.lit("C").alias("tier"), F.col(key).cast("string").alias("record"), F.lit("self_seed").alias("kind"),
                   F.lit(1.0).alias("score"), F.lit("claim_seed").alias("agreement"))
    post = F.struct(F.lit("india_post_pincode_bridge").alias("system"), F.lit("A").alias("tier"), F.col("pin").alias("record"), F.lit("admin_geography_context").alias("kind"),
                    F.col("join_confidence").alias("score"), F.lit("admin_context_only").alias("agreement"))
    both = F.array_compact(F.array(own, F.when(F.coalesce(F.trim("pin"), F.lit("")) != "", post)))
    return df.select(key, F.explode(both).alias("m")).select(key, "m.*", F.lit(False).alias("can_promote"))


# Spellings that stand for another one, of states and of districts within a state.
STATE_ALIASES = {
    "andamannicobarislands": "andamannicobar", "chattisgarh": "chhattisgarh", "dadraandnagarhaveli": "dadranagarhaveli", "damananddiu": "damandiu", "nctofdelhi": "delhi",
    "jammuandkashmir": "jammukashmir", "maharastra": "maharashtra",
}


def with_alias(df: DataFrame, column: str, out: str, aliases: dict[str, str]) -> DataFrame:
    """Add the folded name, put right by an alias table (a constant, so its broadcast is bounded)."""
    table = df.sparkSession.createDataFrame(list(aliases.items()), "__from string, __to string")
    folded = text.key_compact(F.col(column))
    return df.withColumn("__folded", folded).join(F.broadcast(table), F.col("__folded") == F.col("__from"), "left").withColumn(
        out, F.coalesce("__to", "__folded")).drop("__folded", "__from", "__to")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become unknown, in every string column."""
    return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def any_pin(*columns: Column) -> Column:
    """The first PIN that any of several texts holds; a number written with decimals counts as one."""
    found = []
    for c in columns:
        whole = F.regexp_extract(F.trim(c.cast("string")), r"^([1-9][0-9]{5})\.[0-9]*$", 1)
        found += [text.first_pin(c), F.nullif(whole, F.lit(""))]
    return F.coalesce(*found)


def geo_precheck(city: Column, district: Column, state: Column, pin_state: Column) -> dict[str, Column]:
    """What speaks against a place before any geocoder is asked: all reasons, and the first as the status."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    similarity = F.when(said(city) & said(district), F.round(1.0 - F.levenshtein(city, district) / F.greatest(F.length(city), F.length(district), F.lit(1)).cast("double"), 3))
    checks = {
        "missing_or_unparseable_pin": F.col("pin").isNull(), "ambiguous_pin_bridge": F.coalesce("pin_ambiguous", F.lit(False)),
        "state_pin_conflict": said(state) & said(pin_state) & (state != pin_state), "city_pin_district_conflict": F.coalesce(similarity < 0.72, F.lit(False)),
        "weak_health_join": F.coalesce("join_confidence", F.lit(0.0)) < 0.8,
    }
    reasons = text.codes(checks)
    return {"reasons": F.array_join(reasons, ";"), "status": F.coalesce(F.get(reasons, F.lit(0)), F.lit("fuzzy_ok"))}


def queue_summary(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(part, name, n, q): how many rows of a queue each code has, for several columns of codes, and the quantiles of its priority.

    Rows are counted once by all codes and the priority, so that a long queue is neither kept nor read twice.
    """
    counted = rel.pinned(df.groupBy(*by, value).agg(F.count("*").alias("ties")))
    long = counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("name")) for c in by))).alias("x"), "ties").select("x.*", "ties")
    counts = long.groupBy("part", "name").agg(F.sum("ties").alias("n"))
    spread = stats.quantiles(counted, [], value, levels, "ties").select(F.lit(value).alias("part"), F.lit("quantiles").alias("name"), "n", F.transform("q", lambda x: F.round(x, 6)).alias("q"))
    return counts.unionByName(spread, allowMissingColumns=True)


def field_facts(sections: dict[str, Column]) -> Column:
    """array(struct(field, items, length, status)): how much each text field says."""
    facts = []
    for name, c in sections.items():
        items = F.size(text.semantic_items(c)).cast("long")
        facts.append(
            F.struct(F.lit(name).alias("field"), items.alias("items"), F.length(F.coalesce(c, F.lit(""))).cast("long").alias("length"),
                     F.when(items > 0, "observed_claim").otherwise("missing_semantic").alias("status"))
        )
    return F.array(*facts)


def list_facts(c: Column) -> dict[str, Column]:
    """How many values a list written as text has, and its first."""
    values = text.parse_list(c)
    return {"n_values": F.size(values).cast("long"), "first_value": F.get(values, F.lit(0))}


def by_either_key(df: DataFrame, areas: DataFrame, known: Column, first: Column, second: Column, area_key: str, columns: Sequence[str]) -> DataFrame:
    """Left join to ``areas`` by one of two names: the first where it is known, else the second; both folded."""
    folded = areas.select(text.key_compact(F.col(area_key)).alias("__area"), *columns)
    key = text.key_compact(F.when(known, first).otherwise(second))
    return df.withColumn("__area", key).join(folded, "__area", "left").drop("__area")
