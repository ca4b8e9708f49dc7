"""Queries of the scores: need, gaps, categories, confidence, posteriors, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import beta, stats
from meridia.operators import relational as rel
from meridia.operators import scores
from meridia.plans.base import entities, query, regions, table


def _pct(c):
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END"


SCORED = f"""SELECT *, least(1, greatest(0, .55 * need + .25 * (1 - count_pct) + .20 * (1 - trust_rate))) AS care_gap,
  least(1, greatest(0, .65 * need + .35 * (1 - count_pct))) AS priority,
  least(1, greatest(0, .45 * (1 - trust_rate) + .25 * review_rate + .20 * critical_rate + .10 * contradicted_rate)) AS trust_gap,
  least(1, greatest(0, .40 * (1 - need) + .30 * trust_rate + .20 * quality + .10 * count_pct)) AS best_care FROM (
SELECT *, round(.22 * avg_readiness + .20 * avg_semantic + .18 * avg_join + .15 * plausible_rate + .10 * source_rate + .10 * (1 - critical_rate) + .05 * (1 - review_rate), 3) AS quality,
  least(1, greatest(0, (coalesce(ra, 0) + rp + rs + coalesce(1 - ri, 0) + (1 - rb)) / (3 + (ra IS NOT NULL)::INT + (ri IS NOT NULL)::INT))) AS need FROM (
SELECT *, {_pct("anaemia")} AS ra, {_pct("pressure")} AS rp, {_pct("sugar")} AS rs, {_pct("insurance")} AS ri, {_pct("births")} AS rb, {_pct("observed")} AS count_pct,
  trusted_n / observed AS trust_rate, review_n / observed AS review_rate, critical_n / observed AS critical_rate, contradicted_n / observed AS contradicted_rate,
  plausible_n / observed AS plausible_rate, source_n / observed AS source_rate FROM {{regions}} r))"""


def scored(spark, d, e=None):
    r = regions(spark, d, e)
    for name in ("trusted", "review", "critical", "contradicted", "plausible", "source"):
        r = r.withColumn(f"{name if name != 'trusted' else 'trust'}_rate", stats.share(F.col(f"{name}_n"), F.col("observed")))
    indicators = ["anaemia", "pressure", "sugar", "insurance", "births"]
    r = stats.few_pct_ranks(r, {"observed": "count_pct"} | {c: f"{c}_pct" for c in indicators})
    return scores.district_scores(r.withColumn("need", scores.need_score(["anaemia_pct", "pressure_pct", "sugar_pct"], ["insurance_pct", "births_pct"])))


def _six(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("need_score", f"SELECT district, round(need, 6) AS need FROM ({SCORED})")
def need_score(spark, d):
    return scored(spark, d).select("district", *_six("need"))


@query("district_scores", f"SELECT district, round(care_gap, 6) AS care_gap, round(trust_gap, 6) AS trust_gap, round(quality, 6) AS quality, round(best_care, 6) AS best_care, round(priority, 6) AS priority FROM ({SCORED})")
def district_scores(spark, d):
    return scored(spark, d).select("district", *_six("care_gap", "trust_gap", "quality", "best_care", "priority"))


PLANNED = f"""SELECT s.*, CASE WHEN quality >= .85 AND observed >= 5 THEN 'lower' WHEN quality >= .70 AND observed >= 3 THEN 'medium' ELSE 'higher' END AS uncertainty,
 CASE WHEN care_gap >= .70 AND need >= n75 AND trusted_n <= 2 THEN 'real_desert_candidate' WHEN need >= n75 AND observed >= o50 AND trust_rate < .60 THEN 'phantom_desert_or_verification_gap'
 WHEN contradicted_rate >= .25 THEN 'supply_record_quality_problem' WHEN best_care >= b80 AND quality >= .75 THEN 'referral_or_capacity_candidate' ELSE 'mixed_or_monitor' END AS category
FROM ({SCORED}) s, (SELECT quantile_cont(need, .75) AS n75, median(observed) AS o50, quantile_cont(best_care, .8) AS b80 FROM ({SCORED}))"""


@query("planning_category", f"SELECT district, uncertainty, category FROM ({PLANNED})")
def planning_category(spark, d):
    return scores.planning_category(scored(spark, d)).select("district", "uncertainty", "category")


@query("care_gap_breakdown", f"""SELECT district, part, round(points, 6) AS points FROM (SELECT district, 'need' AS part, 55 * need AS points FROM ({SCORED}) UNION ALL
SELECT district, 'few_records', 25 * (1 - count_pct) FROM ({SCORED}) UNION ALL SELECT district, 'low_trust', 20 * (1 - trust_rate) FROM ({SCORED}))""")
def care_gap_breakdown(spark, d):
    s = scored(spark, d).select("district", (55 * F.col("need")).alias("need"), (25 * (1 - F.col("count_pct"))).alias("few_records"), (20 * (1 - F.col("trust_rate"))).alias("low_trust"))
    return rel.unpivot(s, ["district"], ["need", "few_records", "low_trust"], "part", "points").withColumn("points", F.round("points", 6))


@query("condition_burden", """SELECT district, round((coalesce(anaemia, 0) + pressure + coalesce(pressure_men, 0) + sugar + sugar_men + (100 - coalesce(insurance, 0)) + (100 - births)) / 7, 6) AS burden FROM {regions} r""")
def condition_burden(spark, d):
    """Mean of seven burdens: anaemia, both sexes' pressure and sugar, and what lacks in insurance and births; unknown counts as 0."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    burden = sum(map(known, ("anaemia", "pressure", "pressure_men", "sugar", "sugar_men")), F.lit(0.0)) + (100 - known("insurance")) + (100 - known("births"))
    return regions(spark, d).select("district", F.round(burden / 7, 6).alias("burden"))


@query("fit_scores_long", f"""WITH s AS (SELECT district, need, trust_rate AS t, care_gap, coalesce(insurance, 50) / 100 AS ins, coalesce(anaemia, 0) / 100 AS ncd, quality FROM ({SCORED})),
l AS (SELECT district, 'mobile_clinic' AS option, round(least(need * (1 - t) * 1.2, 1), 4) AS fit FROM s UNION ALL SELECT district, 'pharmacy_care', round(least(ncd * 1.5, 1), 4) FROM s UNION ALL
SELECT district, 'centre_upgrade', round(least((1 - t) * need, 1), 4) FROM s UNION ALL SELECT district, 'insurance_enrolment', round(least((1 - ins) * need * 1.3, 1), 4) FROM s UNION ALL
SELECT district, 'partner_clinic', round(least(need * quality, 1), 4) FROM s UNION ALL SELECT district, 'telehealth', round(least(need * .25, .25), 4) FROM s UNION ALL SELECT district, 'transport_voucher', round(least(t * care_gap * 1.5, 1), 4) FROM s)
SELECT district, option, fit, CAST(row_number() OVER (PARTITION BY district ORDER BY CASE option WHEN 'telehealth' THEN 1 ELSE 0 END, fit DESC, option) AS BIGINT) AS rank FROM l""")
def fit_scores_long(spark, d):
    """Seven options per district from one scan, ranked, the unverifiable one always last."""
    need, t = F.col("need"), F.col("trust_rate")
    fits = {
        "mobile_clinic": need * (1 - t) * 1.2, "transport_voucher": t * F.col("care_gap") * 1.5, "pharmacy_care": F.coalesce("anaemia", F.lit(0.0)) / 100 * 1.5,
        "centre_upgrade": (1 - t) * need, "insurance_enrolment": (1 - F.coalesce("insurance", F.lit(50.0)) / 100) * need * 1.3, "partner_clinic": need * F.col("quality"),
        "telehealth": F.least(need * 0.25, F.lit(0.25)),
    }
    wide = scored(spark, d).select("district", *(F.round(F.least(c, F.lit(1.0)), 4).alias(k) for k, c in fits.items()))
    long = rel.unpivot(wide, ["district"], list(fits), "option", "fit")
    return rel.rank_within(long, ["district"], [F.when(F.col("option") == "telehealth", 1).otherwise(0), F.desc("fit"), F.asc("option")], "rank")


_BOX = "coalesce(lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98, false)"
_CONF = f"""round(CAST(least(1, greatest(0, .35 * readiness + .25 * supply_confidence + .10 * semantic_quality + .10 * CAST({_BOX} AS INT) + .05 * CAST(coalesce(has_source, false) AS INT)
  + .05 * CAST(coalesce(has_contact, false) AS INT) + .10 * least(sources / 3.0, 1) - .15 * CAST(recency <> 'valid' AS INT) - .25 * CAST(contradicted AS INT))) AS DECIMAL(24, 8)), 4)::DOUBLE"""


@query("provider_confidence", f"SELECT entity_id, c AS confidence, CASE WHEN c >= .66 THEN 'high' WHEN c >= .40 THEN 'medium' ELSE 'low' END AS band FROM (SELECT entity_id, {_CONF} AS c FROM {{entities}} e)")
def provider_confidence(spark, d):
    out = entities(spark, d).select("entity_id", scores.provider_confidence().alias("confidence"))
    return out.withColumn("band", stats.band(F.col("confidence"), [(0.66, "high"), (0.40, "medium")], "low"))


_PRIORITY = """round(35 * CAST(contradicted AS INT) + 25 * CAST(needs_review AS INT) + 20 * (1 - readiness) + 8 * CAST(NOT coalesce(has_source, false) AS INT)
  + 6 * CAST(NOT coalesce(has_contact, false) AS INT) + 6 * CAST(recency <> 'valid' AS INT), 1)"""


@query("review_queue", f"""SELECT entity_id, {_PRIORITY} AS priority, CASE WHEN contradicted THEN 'Contradicted or invalid geography' WHEN join_confidence IS NULL OR join_confidence < .75 THEN 'Weak district/PIN join'
WHEN NOT coalesce(has_source, false) THEN 'No source URL citation' WHEN NOT coalesce(has_contact, false) THEN 'No contact evidence' WHEN needs_review THEN 'Manual review flag' ELSE 'Positive control candidate' END AS concern
FROM {{entities}} e WHERE {_PRIORITY} > 0""")
def review_queue(spark, d):
    return entities(spark, d).select("entity_id", scores.review_priority().alias("priority"), scores.review_concern().alias("concern")).where("priority > 0")


@query("verification_queue", """SELECT entity_id, p AS priority FROM (SELECT entity_id, contradicted, round(CAST(35 * CAST(contradicted AS INT) + 25 * CAST(needs_review AS INT) + 20 * (1 - readiness) + 15 * (1 - coalesce(join_confidence, 0))
  + 8 * CAST(NOT coalesce(has_contact, false) AS INT) + 6 * CAST(NOT coalesce(has_source, false) AS INT) + 10 * CAST(capacity_outlier OR doctors_outlier AS INT) AS DECIMAL(24, 8)), 1)::DOUBLE AS p FROM {entities} e)
WHERE contradicted ORDER BY p DESC, entity_id LIMIT 50""")
def verification_queue(spark, d):
    q = entities(spark, d).where("contradicted").select("entity_id", scores.app_priority().alias("priority"))
    return rel.top(q, [F.desc("priority"), F.asc("entity_id")], 50)


_POST = f"""1 / (1 + exp(-(ln(pr / (1 - pr)) + CASE WHEN ok THEN .85 ELSE 0 END + CASE WHEN geo_quality = 'moderate' THEN .10 ELSE 0 END
 + CASE WHEN join_confidence >= .85 THEN .70 WHEN join_confidence >= .65 THEN .20 WHEN join_confidence < .65 THEN -.55 ELSE 0 END + CASE WHEN src THEN .55 ELSE -.55 END + CASE WHEN con THEN .35 ELSE -.20 END
 + CASE recency WHEN 'valid' THEN .45 WHEN 'stale' THEN -.45 WHEN 'missing' THEN 0 ELSE -.55 END + CASE WHEN trusted THEN .60 ELSE 0 END + CASE WHEN gaps = 0 THEN .40 WHEN gaps = 1 THEN .10 WHEN gaps >= 3 THEN -.45 ELSE 0 END
 + CASE WHEN capacity IS NOT NULL THEN .20 ELSE 0 END + CASE WHEN doctors IS NOT NULL THEN .20 ELSE 0 END + CASE WHEN contradicted THEN -1.40 ELSE 0 END
 + CASE WHEN NOT ok AND (geo_quality = 'outside' OR (NOT box AND geo_quality <> 'missing')) THEN -1.20 ELSE 0 END + CASE geo_quality WHEN 'missing' THEN -.55 WHEN 'far' THEN -.45 ELSE 0 END
 + CASE WHEN needs_review THEN -.40 ELSE 0 END + CASE WHEN capacity_outlier THEN -.70 ELSE 0 END + CASE WHEN doctors_outlier THEN -.70 ELSE 0 END)))"""
POSTERIORS = f"""SELECT *, {_POST} AS posterior FROM (SELECT *, .56 + CASE WHEN src THEN .06 ELSE 0 END AS pr, geo_quality = 'plausible' AND box AS ok FROM (
  SELECT *, {_BOX} AS box, coalesce(has_source, false) AS src, coalesce(has_contact, false) AS con FROM {{entities}} e))"""


@query("validity_posterior", f"SELECT entity_id, round(posterior, 6) AS posterior, CASE WHEN posterior >= .85 THEN 'likely valid' WHEN posterior >= .60 THEN 'plausible' ELSE 'weak' END AS label FROM ({POSTERIORS})")
def validity_posterior(spark, d):
    p = entities(spark, d).select("entity_id", scores.validity_posterior().alias("posterior"))
    return p.select("entity_id", F.round("posterior", 6).alias("posterior"), stats.band(F.col("posterior"), [(0.85, "likely valid"), (0.60, "plausible")], "weak").alias("label"))


@query("posterior_histogram", f"SELECT CAST(least(floor(posterior * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM ({POSTERIORS}) GROUP BY 1")
def posterior_histogram(spark, d):
    p = entities(spark, d).select(stats.equal_width_bin(scores.validity_posterior(), 10).alias("bin"))
    return rel.value_counts(p, ["bin"])


_GEO_OUT = f"geo_quality = 'outside' OR (NOT {_BOX} AND geo_quality <> 'missing')"


@query("trust_decomposition", f"""SELECT entity_id, u.dimension AS dimension, u.points AS points, u.most AS most, u.reason AS reason FROM (SELECT entity_id, unnest([
 CASE WHEN gaps <= 0 THEN {{'dimension': 'Data completeness', 'points': 18, 'most': 18, 'reason': 'All critical supply fields present (capacity, doctors, equipment, specialties, procedure).'}}
  WHEN gaps = 1 THEN {{'dimension': 'Data completeness', 'points': 13, 'most': 18, 'reason': '1 critical supply field missing or estimated.'}}
  WHEN gaps = 2 THEN {{'dimension': 'Data completeness', 'points': 8, 'most': 18, 'reason': '2 critical supply fields missing or estimated.'}}
  ELSE {{'dimension': 'Data completeness', 'points': 2, 'most': 18, 'reason': gaps || ' critical supply fields missing or estimated.'}} END,
 CASE WHEN trusted THEN {{'dimension': 'Evidence support', 'points': 16, 'most': 16, 'reason': 'Passed the pipeline''s proxy supply checks; claim is corroborated by available evidence.'}}
  WHEN readiness >= .6 THEN {{'dimension': 'Evidence support', 'points': 10, 'most': 16, 'reason': 'Partial evidence support; data readiness is moderate but proxy checks not fully passed.'}}
  ELSE {{'dimension': 'Evidence support', 'points': 4, 'most': 16, 'reason': 'Weak evidence support; claims are largely unverified.'}} END,
 CASE WHEN contradicted THEN {{'dimension': 'Cross-field consistency', 'points': 0, 'most': 14, 'reason': 'Cross-source contradiction or invalid-geo flag set.'}}
  WHEN capacity_outlier AND doctors_outlier THEN {{'dimension': 'Cross-field consistency', 'points': 2, 'most': 14, 'reason': 'Both capacity and doctor-count are implausible outliers.'}}
  WHEN capacity_outlier OR doctors_outlier THEN {{'dimension': 'Cross-field consistency', 'points': 7, 'most': 14, 'reason': 'One operational field (capacity or doctor count) is an implausible outlier.'}}
  ELSE {{'dimension': 'Cross-field consistency', 'points': 14, 'most': 14, 'reason': 'No contradictions; capacity/doctor/type signals are mutually plausible.'}} END,
 CASE WHEN {_GEO_OUT} THEN {{'dimension': 'Geographic validity', 'points': 0, 'most': 16, 'reason': 'Coordinates fall outside India.'}}
  WHEN geo_quality = 'missing' THEN {{'dimension': 'Geographic validity', 'points': 5, 'most': 16, 'reason': 'Coordinates missing; geography unverified.'}}
  WHEN geo_quality = 'far' THEN {{'dimension': 'Geographic validity', 'points': 6, 'most': 16, 'reason': 'Coordinates far from the PIN centroid.'}}
  WHEN geo_quality = 'moderate' THEN {{'dimension': 'Geographic validity', 'points': 11, 'most': 16, 'reason': 'Coordinates a moderate distance from the PIN centroid.'}}
  ELSE {{'dimension': 'Geographic validity', 'points': 16, 'most': 16, 'reason': 'Coordinates plausible and inside India.'}} END,
 CASE recency WHEN 'valid' THEN {{'dimension': 'Temporal validity', 'points': 10, 'most': 10, 'reason': 'Source page recency observed and valid.'}}
  WHEN 'stale' THEN {{'dimension': 'Temporal validity', 'points': 4, 'most': 10, 'reason': 'Source last updated over 2 years ago.'}}
  WHEN 'missing' THEN {{'dimension': 'Temporal validity', 'points': 5, 'most': 10, 'reason': 'Recency unknown; freshness could not be established.'}}
  ELSE {{'dimension': 'Temporal validity', 'points': 2, 'most': 10, 'reason': 'Recency value is invalid or a future date (extraction artifact).'}} END,
 CASE WHEN coalesce(has_source, false) AND join_confidence >= .85 THEN {{'dimension': 'Provenance quality', 'points': 12, 'most': 12, 'reason': 'Cited source URL and a high-confidence district/PIN join.'}}
  WHEN coalesce(has_source, false) THEN {{'dimension': 'Provenance quality', 'points': 8, 'most': 12, 'reason': 'Cited source URL present, but join confidence is moderate or low.'}}
  ELSE {{'dimension': 'Provenance quality', 'points': 2, 'most': 12, 'reason': 'No source URL citation.'}} END,
 CASE WHEN coalesce(has_contact, false) THEN {{'dimension': 'Digital trust signals', 'points': 6, 'most': 6, 'reason': 'Phone/email/website present (weak supporting signal only).'}}
  ELSE {{'dimension': 'Digital trust signals', 'points': 1, 'most': 6, 'reason': 'No contact evidence (phone/email/site).'}} END,
 CASE WHEN needs_review THEN {{'dimension': 'Human review status', 'points': 2, 'most': 8, 'reason': 'Flagged for human review (weak join, geo, missingness, or contradiction).'}}
  ELSE {{'dimension': 'Human review status', 'points': 8, 'most': 8, 'reason': 'Not flagged for manual review by the pipeline.'}} END]) AS u FROM {{entities}} e)""")
def trust_decomposition(spark, d):
    return entities(spark, d).select("entity_id", F.explode(scores.trust_parts()).alias("p")).select("entity_id", "p.*")


@query("provider_trust", f"""WITH p AS ({POSTERIORS}), g AS (SELECT avg(CAST(trusted AS INT)) AS prior FROM p)
SELECT district, count(*) AS n, CAST(sum(CAST(trusted AS INT)) AS BIGINT) AS x, round(.75 * avg(posterior) + .25 * (sum(CAST(trusted AS INT)) + 2 * prior) / (count(*) + 2), 6) AS trust FROM p, g GROUP BY district, prior""")
def provider_trust(spark, d):
    return scores.shrunk_trust(entities(spark, d).withColumn("posterior", scores.validity_posterior()), "district", "posterior", "trusted")


_CALIBRATION = f"""WITH s AS (SELECT 1 - posterior AS s, ('0x' || substr(md5(CAST(entity_id AS VARCHAR)), 1, 1))::INT % 2 AS half FROM ({POSTERIORS}) WHERE trusted),
c AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM s WHERE half = 0),
q AS (SELECT max(n) AS n, least(.95, greatest(.05, min(s) FILTER (k >= ceil(least(1, ceil((n + 1) * .9) / n) * (n - 1)) + 1))) AS q, min(s) FILTER (k >= ceil(least(1, ceil((n + 1) * .95) / n) * (n - 1)) + 1) AS h FROM c)
SELECT q, least(.99, greatest(h, q + .05)) AS stale_q, avg((s <= q)::INT) AS coverage, n AS n_calibration, count(*) AS n_evaluation FROM s, q WHERE half = 1 GROUP BY q, h, n"""


def _calibrated(spark, d):
    p = entities(spark, d).withColumn("posterior", scores.validity_posterior())
    return p, scores.conformal(p, "entity_id", "posterior", "trusted")


@query("conformal_calibration", f"SELECT round(q, 6) AS q, round(stale_q, 6) AS stale_q, round(coverage, 6) AS coverage, n_calibration, n_evaluation FROM ({_CALIBRATION})")
def conformal_calibration(spark, d):
    return _calibrated(spark, d)[1].select(*_six("q", "stale_q", "coverage"), "n_calibration", "n_evaluation")


@query("conformal_sets", f"""SELECT entity_id, CASE WHEN round(s - q / 2, 9) <= 0 AND NOT contradicted THEN '{{valid}}' WHEN round(s - q, 9) <= 0 AND NOT contradicted THEN '{{valid, uncertain}}'
 ELSE '{{' || concat_ws(', ', CASE WHEN NOT contradicted THEN 'valid' END, CASE WHEN recency IN ('stale', 'invalid', 'future') OR round(s - stale_q, 9) >= 0 THEN 'stale' END, 'uncertain') || '}}' END AS labels,
 CASE WHEN round(s - q / 2, 9) <= 0 AND NOT contradicted THEN 'auto-accept' WHEN round(s - q, 9) <= 0 AND NOT contradicted THEN 'review' ELSE 'low-confidence' END AS decision
FROM (SELECT *, 1 - posterior AS s FROM ({POSTERIORS})), ({_CALIBRATION}) c""")
def conformal_sets(spark, d):
    """Sets by the half-widths that the same records calibrate."""
    p, q = _calibrated(spark, d)
    q = q.select(F.col("q").alias("q"), "stale_q")
    s = scores.conformal_set(F.col("posterior"), F.col("contradicted"), F.col("recency"), F.col("q") + 5e-10, F.col("stale_q") - 5e-10)
    return p.crossJoin(F.broadcast(q)).select("entity_id", s["labels"].alias("labels"), s["decision"].alias("decision"))


GEO_BAND = """SELECT *, CASE geo_quality WHEN 'outside' THEN 50 WHEN 'far' THEN 10 WHEN 'moderate' THEN 2 WHEN 'missing' THEN 10 ELSE CASE WHEN contradicted THEN 5 ELSE .1 END END::DOUBLE AS geo_low,
  CASE geo_quality WHEN 'outside' THEN least(greatest(km0, 250), 5000) WHEN 'far' THEN least(greatest(km0, 50), 2500) WHEN 'moderate' THEN least(greatest(km0, 10), 250) WHEN 'missing' THEN 250 ELSE CASE WHEN contradicted THEN least(greatest(km0, 25), 1000) ELSE 5 END END::DOUBLE AS geo_high,
  round(CAST(least(1, greatest(0, .68 * CASE geo_quality WHEN 'outside' THEN 1 WHEN 'missing' THEN 1 WHEN 'far' THEN .75 WHEN 'moderate' THEN .35 ELSE CASE WHEN contradicted THEN .65 ELSE 0 END END + .32 * least(km0, 250) / 250)) AS DECIMAL(24, 8)), 4)::DOUBLE AS geo_score
FROM (SELECT *, greatest(coalesce(km, 0), 0) AS km0 FROM {entities} e)"""


@query("geo_uncertainty", f"SELECT entity_id, geo_low AS low_km, geo_high AS high_km, geo_score AS score FROM ({GEO_BAND})")
def geo_uncertainty(spark, d):
    b = scores.geo_band(F.col("geo_quality"), F.col("km"), F.col("contradicted"))
    return entities(spark, d).select("entity_id", b["low"].alias("low_km"), b["high"].alias("high_km"), b["score"].alias("score"))


@query("wilson_by_district", """SELECT district, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + .9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low,
 round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + .9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high, round((trusted_n + .5) / (n + 1), 6) AS jeffreys FROM (SELECT *, CAST(observed AS DOUBLE) AS n, trusted_n / observed AS p FROM {regions} r)""")
def wilson_by_district(spark, d):
    w = stats.wilson(F.col("trusted_n"), F.col("observed"))
    return regions(spark, d).select("district", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.round(stats.jeffreys_mean(F.col("trusted_n"), F.col("observed")), 6).alias("jeffreys"))


@query("haversine_buckets", """SELECT CASE WHEN km IS NULL THEN 'plausible' WHEN km > 250 THEN 'far' WHEN km > 50 THEN 'moderate' ELSE 'plausible' END AS bucket, count(*) AS n, round(max(km), 3) AS farthest FROM (
 SELECT CASE WHEN lat IS NOT NULL THEN 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) END AS km
 FROM (SELECT *, median(lat) OVER (PARTITION BY district) AS clat, median(lon) OVER (PARTITION BY district) AS clon FROM {entities} e)) GROUP BY 1""")
def haversine_buckets(spark, d):
    """Records by distance from their district's robust centre."""
    e = entities(spark, d)
    lat, lon = (stats.quantiles(e, ["district"], c, [0.5]).select("district", F.col("q")[0].alias(f"c{c}")) for c in ("lat", "lon"))
    centre = lat.join(lon, "district")
    km = stats.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    far = e.join(centre, "district").withColumn("km", km)
    bucket = F.when(F.col("km") > 250, "far").when(F.col("km") > 50, "moderate").otherwise("plausible")
    return far.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.max("km"), 3).alias("farthest"))


@query("grid_cells", """SELECT CAST(floor(lat / 2) AS BIGINT) || '_' || CAST(floor(lon / 2) AS BIGINT) AS cell, count(*) AS n, round(avg(readiness), 6) AS readiness,
 round((count(*) - min(count(*)) OVER ()) / (max(count(*)) OVER () - min(count(*)) OVER ()), 6) AS scaled FROM {entities} e WHERE lat IS NOT NULL GROUP BY 1""")
def grid_cells(spark, d):
    cells = entities(spark, d).where("lat is not null").groupBy(stats.grid_cell(F.col("lat"), F.col("lon"), 2).alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("readiness"), 6).alias("readiness"))
    return stats.min_max(cells, "n", "scaled").withColumn("scaled", F.round("scaled", 6))


@query("scenario_rows", """SELECT district, round(100 * trusted_n / observed, 4) AS before, round(least(20 * (1 - trusted_n / observed), 18), 4) AS improvement,
 round(greatest(100 * trusted_n / observed - least(20 * (1 - trusted_n / observed), 18), 0), 4) AS after FROM {regions} r ORDER BY trusted_n DESC, district LIMIT 25""")
def scenario_rows(spark, d):
    t = stats.share(F.col("trusted_n"), F.col("observed"))
    top = rel.top(regions(spark, d), [F.desc("trusted_n"), F.asc("district")], 25)
    gain = F.least(20 * (1 - t), F.lit(18.0))
    return top.select("district", F.round(100 * t, 4).alias("before"), F.round(gain, 4).alias("improvement"), F.round(F.greatest(100 * t - gain, F.lit(0.0)), 4).alias("after"))


@query("whatif_function", """SELECT district, round(greatest(b - least(u * 6 * (1 - t), b / 2), 0), 6) AS after FROM (SELECT district, CAST(pressure AS DOUBLE) AS b, trusted_n / observed AS t, district_key % 4 AS u FROM {regions} r)""")
def whatif_function(spark, d):
    """A SQL function with a default: points per unit are scaled by missing trust, at most half the risk goes."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION risk_after(before DOUBLE, trust DOUBLE, units INT, points DOUBLE DEFAULT 6.0) RETURNS DOUBLE
      RETURN greatest(before - least(units * points * (1 - trust), before / 2), 0D)""")
    t = stats.share(F.col("trusted_n"), F.col("observed")).alias("t")
    return regions(spark, d).select("district", "pressure", t, "district_key").selectExpr("district", "round(risk_after(pressure, t, CAST(district_key % 4 AS INT)), 6) AS after")


@query("supply_bands", """SELECT district, 'best' AS scenario, observed AS facilities, round(capacity_sum, 1) AS capacity FROM {regions} r UNION ALL
SELECT district, 'likely', CAST(least(observed, greatest(trusted_n, round(observed * (trusted_n / observed)))) AS BIGINT), round((capacity_sum + capacity_sum * trusted_n / observed) / 2, 1) FROM {regions} r UNION ALL
SELECT district, 'worst', trusted_n, round(capacity_sum * trusted_n / observed, 1) FROM {regions} r""")
def supply_bands(spark, d):
    """Best, likely and worst supply of each district, from one pass."""
    t = stats.share(F.col("trusted_n"), F.col("observed"))
    best, worst = F.col("capacity_sum"), F.col("capacity_sum") * t
    likely_n = F.least(F.col("observed"), F.greatest(F.col("trusted_n"), F.round(F.col("observed") * t).cast("long")))
    bands = F.array(
        *(F.struct(F.lit(n).alias("scenario"), c.cast("long").alias("facilities"), F.round(k, 1).alias("capacity"))
          for n, c, k in (("best", F.col("observed"), best), ("likely", likely_n, (best + worst) / 2), ("worst", F.col("trusted_n"), worst)))
    )
    return regions(spark, d).select("district", F.explode(bands).alias("b")).select("district", "b.*")


def cohort_sql(c):
    """A value's estimate and interval for every record: its own, else its narrowest cohort's."""
    cohort = "SELECT {k}, count(*) AS n, median({c}) AS m, quantile_cont({c}, .1) AS lo, quantile_cont({c}, .9) AS hi FROM k WHERE {w} GROUP BY ALL HAVING count(*) >= {n}"
    own = lambda k, w, n: cohort.format(k=k, w=w, n=n, c=c)
    return f"""WITH e AS (SELECT *, {c} IS NOT NULL AND NOT {c}_outlier AS ok FROM {{entities}} x), k AS (SELECT * FROM e WHERE ok),
a AS ({own('kind, operator, state', 'operator IS NOT NULL', 5)}), b AS ({own('kind, operator', 'operator IS NOT NULL', 10)}), c AS ({own('kind', 'true', 10)}), o AS ({own('operator', 'operator IS NOT NULL', 10)}),
g AS (SELECT count(*) AS n, median({c}) AS m, quantile_cont({c}, .1) AS lo, quantile_cont({c}, .9) AS hi FROM k)
SELECT entity_id, CASE WHEN ok THEN {c} ELSE coalesce(a.m, b.m, c.m, o.m, g.m) END AS estimate, CASE WHEN ok THEN {c} ELSE coalesce(a.lo, b.lo, c.lo, o.lo, g.lo) END AS low, CASE WHEN ok THEN {c} ELSE coalesce(a.hi, b.hi, c.hi, o.hi, g.hi) END AS high,
 CASE WHEN ok THEN 'observed' WHEN a.n IS NOT NULL THEN 'kind_operator_state' WHEN b.n IS NOT NULL THEN 'kind_operator' WHEN c.n IS NOT NULL THEN 'kind' WHEN o.n IS NOT NULL THEN 'operator' ELSE 'global' END AS level,
 CASE WHEN ok THEN 'observed' WHEN coalesce(a.n, b.n, c.n, o.n, g.n) >= 50 THEN 'medium' WHEN coalesce(a.n, b.n, c.n, o.n, g.n) >= 10 THEN 'low_medium' ELSE 'low' END AS confidence
FROM e LEFT JOIN a USING (kind, operator, state) LEFT JOIN b ON e.kind = b.kind AND e.operator = b.operator LEFT JOIN c ON e.kind = c.kind LEFT JOIN o ON e.operator = o.operator, g"""


# Records beside their district's need and priority; records without a district join have no priority.
PLACED = f"SELECT e.*, s.need, CASE WHEN e.match_score IS NOT NULL THEN s.priority END AS priority FROM {{entities}} e JOIN ({SCORED}) s USING (district)"


def placed(spark, d, dealt=False):
    """Records beside their districts' scores; ``dealt``: over tasks by number, where much is made of each record."""
    e = rel.pinned(entities(spark, d))  # derived once; both branches read it
    s = scored(spark, d, e).select("district", "need", "priority")  # a row a district; dealt by district, records would meet in few tasks
    e = rel.spread(e, "entity_id") if dealt else e  # few tasks read the table
    return e.join(F.broadcast(s), "district").withColumn("priority", F.when(F.col("match_score").isNotNull(), F.col("priority")))


_WIDTH = "coalesce(CASE WHEN estimate <> 0 THEN ((high - low) / abs(estimate)) / (1 + (high - low) / abs(estimate)) END, 0)"
_RECORDS = f"""SELECT *, least(1, greatest(0, .22 * (1 - semantic_quality) + .15 * (capacity_status <> 'observed_valid')::INT + .15 * (doctors_status <> 'observed_valid')::INT + .12 * cw + .12 * dw + .10 * critical_gap::INT + .08 * (join_confidence < .8)::INT
   + .06 * (recency IN ('invalid', 'future', 'missing'))::INT)) AS u, least(1, greatest(0, .35 * geo_score + .25 * (capacity_outlier OR doctors_outlier)::INT + .15 * coalesce(pin_ambiguous, false)::INT + .15 * (join_confidence < .8)::INT + .10 * (recency IN ('invalid', 'future', 'missing'))::INT)) AS c,
  least(1, greatest(0, .45 * coalesce(priority, .5) + .25 * coalesce(need, .5) + .20 * (1 - supply_confidence) + .10 * needs_review::INT)) AS l, 1 - least(segment, 50) / 50 AS r
FROM (SELECT g.*, need, CASE WHEN match_score IS NOT NULL THEN priority END AS priority, {_WIDTH.replace('estimate', 'a.estimate').replace('high', 'a.high').replace('low', 'a.low')} AS cw, {_WIDTH.replace('estimate', 'b.estimate').replace('high', 'b.high').replace('low', 'b.low')} AS dw, count(*) OVER (PARTITION BY kind, operator, state) AS segment
  FROM ({GEO_BAND}) g JOIN (SELECT district, need, priority FROM ({SCORED})) USING (district) JOIN ({cohort_sql('capacity')}) a USING (entity_id) JOIN ({cohort_sql('doctors')}) b USING (entity_id))"""


UNCERTAIN = f"""SELECT entity_id, s AS score, round(u, 6) AS uncertainty, round(c, 6) AS contradiction, round(l, 6) AS leverage, action, check_outside, CAST(row_number() OVER (ORDER BY s DESC, entity_id) AS BIGINT) AS queue_rank FROM (
SELECT *, round(CAST(least(1, greatest(0, .30 * coalesce(need, .5) + .30 * u + .18 * c + .14 * l + .08 * r)) AS DECIMAL(24, 8)), 4)::DOUBLE AS s,
 CASE WHEN capacity_outlier OR doctors_outlier OR geo_quality IN ('outside', 'far') THEN 'contradiction_audit' WHEN critical_gap THEN 'semantic_missingness_enrichment' WHEN join_confidence < .8 OR coalesce(pin_ambiguous, false) THEN 'join_bridge_enrichment'
  WHEN need >= .75 AND u >= .45 THEN 'high_impact_uncertainty_reduction' WHEN r >= .75 THEN 'sparse_segment_coverage' ELSE 'uncertainty_monitor' END AS action,
 CASE geo_quality WHEN 'outside' THEN 'replace_coordinate_with_external_geocode' WHEN 'missing' THEN 'geocode_missing_coordinate' WHEN 'far' THEN 'geocode_and_compare_pincode_district'
  WHEN 'moderate' THEN CASE WHEN coalesce(priority, .5) >= .6 THEN 'high_impact_geocode_precision_check' ELSE 'batch_geocode_precision_check' END ELSE CASE WHEN contradicted THEN 'external_source_contradiction_check' ELSE 'no_external_geocode_required' END END AS check_outside
FROM ({_RECORDS}))"""


@query("uncertainty_queue", f"{UNCERTAIN} ORDER BY queue_rank LIMIT 500")
def uncertainty_queue(spark, d):
    """The 500 records where more evidence would reduce planning uncertainty most."""
    return rel.top(uncertain_records(spark, d), [F.desc("score"), F.asc("entity_id")], 500, "queue_rank")


def uncertain_records(spark, d):
    """How much more evidence would tell, and what to do, for every record."""
    from meridia.operators import impute

    e = rel.pinned(placed(spark, d))
    for c in ("capacity", "doctors"):  # estimated apart, from the few columns it takes
        known = e.select("entity_id", "kind", "operator", "state", c, f"{c}_outlier")
        width = stats.relative_width(F.col("low"), F.col("high"), F.col("estimate"))
        e = e.join(impute.hierarchical(known, c, ~F.col(f"{c}_outlier")).select("entity_id", width.alias(f"{c}_width")), "entity_id")
    segment = e.groupBy("kind", "operator", "state").agg(F.count("*").alias("segment_n")).select(*(F.col(k).alias(f"s_{k}") for k in ("kind", "operator", "state")), "segment_n")
    match = F.lit(True)
    for k in ("kind", "operator", "state"):
        match = match & e[k].eqNullSafe(F.col(f"s_{k}"))
    out = scores.record_uncertainty(e.join(segment, match))
    check = scores.external_check(F.col("geo_quality"), F.col("priority"), F.col("contradicted"))
    return out.select(
        "entity_id", F.col("active_score").alias("score"), F.round("uncertainty_score", 6).alias("uncertainty"), F.round("contradiction_score", 6).alias("contradiction"),
        F.round("leverage_score", 6).alias("leverage"), F.col("learning_action").alias("action"), check.alias("check_outside"),
    )


_CI = lambda x: f"(2 * 1.96 * sqrt({x} / observed * (1 - {x} / observed) / observed + .9604 / (observed * observed)) / (1 + 3.8416 / observed))"


@query("district_uncertainty_queue", f"""SELECT district, score, width, CAST(row_number() OVER (ORDER BY score DESC, district) AS BIGINT) AS queue_rank FROM (SELECT district, round(CAST(w AS DECIMAL(24, 8)), 4)::DOUBLE AS width,
 round(CAST(least(1, greatest(0, .24 * care_gap + .22 * trust_gap + .18 * need + .14 * w + .12 * CASE WHEN quality >= .85 AND observed >= 5 THEN .1 WHEN quality >= .70 AND observed >= 3 THEN .55 ELSE 1 END + .10 * (1 - least(observed, 20) / 20))) AS DECIMAL(24, 8)), 4)::DOUBLE AS score
 FROM (SELECT *, ({_CI('review_n')} + {_CI('critical_n')} + {_CI('trusted_n')} + {_CI('capacity_ok_n')} + {_CI('doctors_ok_n')}) / 5 AS w FROM (SELECT *, CAST(observed AS DOUBLE) AS obs FROM ({SCORED})) JOIN (SELECT district,
  count(*) FILTER (capacity_status = 'observed_valid') AS capacity_ok_n, count(*) FILTER (doctors_status = 'observed_valid') AS doctors_ok_n FROM {{entities}} e GROUP BY 1) USING (district))) ORDER BY score DESC, district LIMIT 250""")
def district_uncertainty_queue(spark, d):
    seen = entities(spark, d).groupBy("district").agg(*(F.count_if(F.col(f"{c}_status") == "observed_valid").alias(f"{c}_ok_n") for c in ("capacity", "doctors")))
    s = scores.planning_category(scored(spark, d)).join(seen, "district")
    score, width = scores.district_uncertainty([(c, "observed") for c in ("review_n", "critical_n", "trusted_n", "capacity_ok_n", "doctors_ok_n")])
    return rel.top(s.select("district", score.alias("score"), width.alias("width")), [F.desc("score"), F.asc("district")], 250, "queue_rank")


@query("evidence_scores", "SELECT entity_id, gaps, supply_confidence, semantic_quality, readiness, capacity_confidence, doctors_confidence FROM {entities} e")
def evidence_scores(spark, d):
    """Critical gaps, supply confidence, semantic quality and readiness of every record, from its raw fields."""
    return entities(spark, d).select("entity_id", "gaps", "supply_confidence", "semantic_quality", "readiness", "capacity_confidence", "doctors_confidence")


@query("quality_gates", "SELECT entity_id, trusted, needs_review, contradicted, critical_gap, capacity_outlier, doctors_outlier FROM {entities} e")
def quality_gates(spark, d):
    return entities(spark, d).select("entity_id", "trusted", "needs_review", "contradicted", "critical_gap", "capacity_outlier", "doctors_outlier")


@query("parse_statuses", "SELECT entity_id, capacity, capacity_status, doctors, doctors_status, CAST(year AS BIGINT) AS year, year_status, recency FROM {entities} e")
def parse_statuses(spark, d):
    return entities(spark, d).select("entity_id", "capacity", "capacity_status", "doctors", "doctors_status", "year", "year_status", "recency")


@query("join_quality", """SELECT entity_id, join_strategy, join_confidence, CASE WHEN join_strategy = 'no_valid_pincode' THEN 'No parseable six-digit Indian PIN code.' WHEN join_strategy = 'pincode_only_no_health_match' THEN 'PIN code matched India Post but no district/state match in NFHS.'
 WHEN coalesce(pin_ambiguous, false) THEN 'PIN code maps to multiple districts or states in India Post.' WHEN join_strategy = 'pincode_district_state_fuzzy' THEN 'District spelling required fuzzy matching within the same state.'
 WHEN join_strategy = 'facility_city_state_fallback' THEN 'No PIN bridge; used facility city/state as district/state proxy.' ELSE 'Exact PIN-to-district-to-health join.' END AS reason, geo_quality FROM {entities} e""")
def join_quality(spark, d):
    from meridia.operators import evidence

    reason = evidence.join_reason(F.col("join_strategy"), F.col("pin_ambiguous"))
    return entities(spark, d).select("entity_id", "join_strategy", "join_confidence", reason.alias("reason"), "geo_quality")


@query("label_agreement", "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def label_agreement(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("jeffreys_interval")
def jeffreys_interval(spark, d):
    """95 % Jeffreys intervals of the districts' trust rates; quantiles come from numpy in Arrow batches."""
    j = beta.jeffreys(F.col("trusted_n"), F.col("observed"))
    return regions(spark, d).select("district", j.alias("j")).select("district", F.round("j.low", 6).alias("low"), F.round("j.high", 6).alias("high"))
