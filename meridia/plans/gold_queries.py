"""Queries of gold tables, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import relational as rel
from meridia.operators import remediate, reports, scores
from meridia.plans.base import ORACLES, entities, query, table
from meridia.plans.decision_queries import _LOW_RISK, CLAIMS, MASKED, TIERED, _tiered, claim_rules, ev_recommender
from meridia.plans.measures import MEASURES
from meridia.plans.score_queries import _CONF, _PRIORITY, PLANNED, POSTERIORS, SCORED, placed, scored

_SUMMARY_CASES = ", ".join(f"('{d}', '{i}', '{m}', '{a}', '{s}')" for d, i, m, a, s in reports.SUMMARY)
_SUMMARY_SQL = (
    "WITH m AS (SELECT *, needs_review AS needs_human_review, critical_gap AS critical_supply_gap, " + _LOW_RISK + " AS low_risk FROM (" + MASKED + ")), c AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mask, count(*) FILTER ({m}) AS rows, count(*) AS denominator FROM m" for _, _, m, _, _ in reports.SUMMARY)
    + f") SELECT domain, issue, rows, action, severity, denominator, round(rows / denominator, 6) AS share FROM c JOIN (VALUES {_SUMMARY_CASES}) s(domain, issue, mask, action, severity) USING (mask)"
)


@query("remediation_summary", _SUMMARY_SQL)
def remediation_summary(spark, d):
    """Twenty-six issues with rows, share, action and severity."""
    return reports.remediation_summary(placed(spark, d), remediate.issue_masks())


@query("gravest_issues", f"SELECT *, CAST(row_number() OVER (ORDER BY rows DESC, domain, issue) AS BIGINT) AS place FROM ({_SUMMARY_SQL}) WHERE severity IN ('high', 'medium') ORDER BY rows DESC, domain, issue LIMIT 12")
def gravest_issues(spark, d):
    return reports.gravest_issues(reports.remediation_summary(placed(spark, d), remediate.issue_masks()))


@query("access_features", f"""SELECT district, coalesce(maternity_count, 0) AS maternity_count, coalesce(emergency_count, 0) AS emergency_count, coalesce(diagnostic_count, 0) AS diagnostic_count, coalesce(chronic_count, 0) AS chronic_count,
 round(CAST(trusted_n / greatest(observed, 1) AS DECIMAL(24, 8)), 4)::DOUBLE AS density, risk, CASE WHEN risk >= 75 THEN 'severe' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS risk_band
FROM (SELECT *, round(coalesce(priority, 0) * 100, 2) AS risk FROM ({SCORED})) LEFT JOIN (SELECT district, count(*) FILTER (maternity) AS maternity_count, count(*) FILTER (emergency) AS emergency_count, count(*) FILTER (diagnostic) AS diagnostic_count,
 count(*) FILTER (chronic) AS chronic_count FROM {{entities}} e GROUP BY 1) USING (district)""")
def access_features(spark, d):
    signals = ("maternity", "emergency", "diagnostic", "chronic")
    counts = entities(spark, d).groupBy("district").agg(*(F.count_if(F.col(s)).alias(f"{s}_count") for s in signals))
    return reports.access_features(scored(spark, d), counts, "district")


_CONFLICTS = f"""concat_ws('; ', CASE WHEN contradicted THEN 'contradicted/geo-invalid' END, CASE WHEN NOT coalesce(lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98, false) THEN 'coordinates outside India bbox' END,
 CASE WHEN coalesce(pin_ambiguous, false) THEN 'ambiguous PIN/region' END, CASE WHEN NOT coalesce(has_source, false) THEN 'no source URL' END, CASE WHEN needs_review THEN 'flagged for review' END)"""


@query("confidence_rows", f"""SELECT entity_id, {_CONF} AS confidence, {_CONFLICTS} AS conflicts, CASE WHEN {_CONF} >= .66 THEN 'high' WHEN {_CONF} >= .40 THEN 'medium' ELSE 'low' END AS band, round(posterior, 6) AS posterior,
 CASE WHEN posterior >= .85 THEN 'auto-accept' WHEN posterior >= .60 THEN 'merge-or-review' ELSE 'human-review' END AS action FROM ({POSTERIORS})""")
def confidence_rows(spark, d):
    """Gold rows of records, beside their posteriors."""
    e = rel.pinned(entities(spark, d))
    p = e.select("entity_id", scores.validity_posterior().alias("p"))
    p = p.select("entity_id", F.round("p", 6).alias("posterior"), stats.band(F.col("p"), [(0.85, "auto-accept"), (0.60, "merge-or-review")], "human-review").alias("action"))
    return reports.confidence_rows(e, "entity_id", p)


@query("confidence_fallback", f"""SELECT entity_id, c AS confidence, {_CONFLICTS} AS conflicts, CASE WHEN c >= .66 THEN 'high' WHEN c >= .40 THEN 'medium' ELSE 'low' END AS band, c AS posterior,
 CASE WHEN c >= .66 THEN 'auto-accept' WHEN c >= .40 THEN 'merge-or-review' ELSE 'human-review' END AS action FROM (SELECT *, {_CONF} AS c FROM {{entities}} e)""")
def confidence_fallback(spark, d):
    """The same where no posteriors are at hand."""
    return reports.confidence_rows(entities(spark, d), "entity_id")


@query("recommendation_summary", f"""WITH r AS ({ORACLES["ev_recommender"]}), n AS (SELECT NULL::DOUBLE AS low, NULL::DOUBLE AS middle, NULL::DOUBLE AS high)
SELECT 'leading' AS kind, option AS name, count(*) AS n, low, middle, high FROM r, n WHERE rank = 1 GROUP BY ALL UNION ALL SELECT 'option', option, count(*), low, middle, high FROM r, n GROUP BY ALL
UNION ALL SELECT 'confidence', confidence, count(*), low, middle, high FROM r, n GROUP BY ALL UNION ALL SELECT 'ev', 'ev', count(*), round(min(ev), 6), round(median(ev), 6), round(max(ev), 6) FROM r""")
def recommendation_summary(spark, d):
    ranked = rel.pinned(ev_recommender(spark, d))
    return reports.recommendation_summary(ranked, "option", "rank", "ev", "confidence")


_FOCUS = f"""SELECT entity_id, readiness, join_confidence, needs_review, {_PRIORITY} AS priority, CASE WHEN contradicted THEN 'contradicted_seed' WHEN trusted AND NOT needs_review THEN 'verified_seed_candidate' WHEN needs_review THEN 'review_seed' ELSE 'unlabelled_seed' END AS label_seed FROM {{entities}} e"""
_PLACED = lambda f, w, o: f"(SELECT '{f}' AS focus, entity_id, CAST(row_number() OVER (ORDER BY {o}) AS BIGINT) AS place FROM f WHERE {w} ORDER BY {o} LIMIT 40)"
_BY = "priority DESC, entity_id"


@query("queue_focuses", f"WITH f AS ({_FOCUS}) " + " UNION ALL ".join([
    _PLACED("positive_controls", "label_seed = 'verified_seed_candidate'", "readiness DESC, join_confidence DESC, entity_id"), _PLACED("contradictions", "label_seed = 'contradicted_seed'", _BY),
    _PLACED("review", "needs_review", _BY), _PLACED("all", "true", _BY)]))
def queue_focuses(spark, d):
    """The verification queue through each of its four focuses."""
    q = entities(spark, d).select("entity_id", "readiness", "join_confidence", "needs_review", scores.review_priority().alias("priority"), reports.label_seed().alias("label_seed"))
    q = rel.pinned(q)
    parts = [reports.focus(q, f, 40).select(F.lit(f).alias("focus"), "entity_id", "place") for f in ("positive_controls", "contradictions", "review", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("confidence_bins", """WITH c AS (SELECT readiness AS c FROM {entities} e), n AS (SELECT count(*) AS a, count(*) FILTER (c < .5) AS b0, count(*) FILTER (c >= .5 AND c < .7) AS b1, count(*) FILTER (c >= .7 AND c < .8) AS b2, count(*) FILTER (c >= .8 AND c < .9) AS b3,
 count(*) FILTER (c >= .9) AS b4, count(*) FILTER (c >= .5) AS t0, count(*) FILTER (c >= .7) AS t1, count(*) FILTER (c >= .8) AS t2 FROM c)
SELECT kind, name, x AS n, round(x / a, 6) AS share FROM n, LATERAL (SELECT * FROM (VALUES ('band', '0.00-0.50', b0), ('band', '0.50-0.70', b1), ('band', '0.70-0.80', b2), ('band', '0.80-0.90', b3), ('band', '0.90-1.00', b4), ('coverage', '>= 0.50', t0), ('coverage', '>= 0.70', t1),
 ('coverage', '>= 0.80', t2), ('coverage', '>= 0.90', b4)) v(kind, name, x))""")
def confidence_bins(spark, d):
    return reports.confidence_bins(entities(spark, d), "readiness")


@query("source_matches", """SELECT entity_id, 'cleaned_records' AS system, 'C' AS tier, CAST(entity_id AS VARCHAR) AS record, 'self_seed' AS kind, 1.0::DOUBLE AS score, 'claim_seed' AS agreement, false AS can_promote FROM {entities} e
UNION ALL SELECT entity_id, 'india_post_pincode_bridge', 'A', pin, 'admin_geography_context', join_confidence, 'admin_context_only', false FROM {entities} e WHERE pin IS NOT NULL""")
def source_matches(spark, d):
    """Each record's own seed row, and one for its PIN, from one scan."""
    return reports.source_matches(entities(spark, d), "entity_id")


@query("zero_trust_worst", f"""SELECT count(*) FILTER (trusted_n <= 3) AS low_trust, count(*) FILTER (trusted_n = 0) AS zero_trust, count(*) AS n FROM (SELECT trusted_n FROM ({SCORED}) ORDER BY care_gap DESC, district LIMIT 10)""")
def zero_trust_worst(spark, d):
    """Among the districts of the widest gaps: how many have few or no records that pass the checks."""
    worst = rel.top(scored(spark, d).select("district", "care_gap", "trusted_n"), [F.desc("care_gap"), F.asc("district")], 10)
    return worst.agg(F.count_if(F.col("trusted_n") <= 3).alias("low_trust"), F.count_if(F.col("trusted_n") == 0).alias("zero_trust"), F.count("*").alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in MEASURES.items())
_RATES = ", ".join(f"round({n} / observed, 6) AS {n}_rate" for n in MEASURES)


@query("district_measures", f"SELECT *, {_RATES} FROM (SELECT district, state, count(*) AS observed, {_COUNTS}, round(CAST(avg(readiness) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_readiness, round(CAST(avg(supply_confidence) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_supply, round(CAST(avg(semantic_quality) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_semantic, round(CAST(avg(join_confidence) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_join, round(CAST(avg(gaps) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_gaps, max(gaps) AS most_gaps, round(CAST(avg(km) AS DECIMAL(24, 8)), 6)::DOUBLE AS mean_km, count(DISTINCT pin) AS n_pins, count(DISTINCT kind) AS n_kinds FROM {{entities}} e GROUP BY 1, 2)")
def district_measures(spark, d):
    """Counts of all conditions on records, their rates, and means, of every district, from one aggregation."""
    mean = lambda c, n: stats.half_up(F.avg(c), 6).alias(n)
    out = entities(spark, d).groupBy("district", "state").agg(
        F.count("*").alias("observed"), *(F.count_if(F.expr(c)).alias(n) for n, c in MEASURES.items()), mean("readiness", "mean_readiness"), mean("supply_confidence", "mean_supply"),
        mean("semantic_quality", "mean_semantic"), mean("join_confidence", "mean_join"), mean("gaps", "mean_gaps"), F.max("gaps").alias("most_gaps"), mean("km", "mean_km"),
        F.count_distinct("pin").alias("n_pins"), F.count_distinct("kind").alias("n_kinds"),
    )
    return rel.rates(out, list(MEASURES), "observed")


@query("aliased_states", """SELECT k AS name, coalesce(t, f) AS folded FROM (SELECT k, regexp_replace(lower(replace(trim(k), '&', 'and')), '[^a-z0-9]+', '', 'g') AS f FROM (SELECT r_name AS k FROM region UNION ALL SELECT * FROM (VALUES ('NCT of Delhi'), ('Jammu & Kashmir'), ('Maharastra'), ('Goa')) v(k)))
 LEFT JOIN (VALUES ('nctofdelhi', 'delhi'), ('jammuandkashmir', 'jammukashmir'), ('maharastra', 'maharashtra')) a(s, t) ON f = s""")
def aliased_states(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    names = names.unionByName(spark.createDataFrame([("NCT of Delhi",), ("Jammu & Kashmir",), ("Maharastra",), ("Goa",)], "name string"))
    return reports.with_alias(names, "name", "folded", reports.STATE_ALIASES)


@query("pin_variants", r"""SELECT entity_id, coalesce(nullif(regexp_extract(a, '(^|[^0-9])([1-9][0-9]{5})([^0-9]|$)', 2), ''), nullif(regexp_extract(b, '(^|[^0-9])([1-9][0-9]{5})([^0-9]|$)', 2), '')) AS pin FROM (
 SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'PIN-' || pin || ',' WHEN 1 THEN pin || '.0' WHEN 2 THEN '0' || pin ELSE '' END AS a, CASE WHEN entity_id % 3 = 0 THEN 'Road 7, ' || (600000 + entity_id % 1000) ELSE 'Road 1234567' END AS b FROM {entities} e)""")
def pin_variants(spark, d):
    """The first PIN in any of two texts of a record."""
    k = F.col("entity_id")
    a = F.when(k % 4 == 0, F.concat(F.lit("PIN-"), "pin", F.lit(","))).when(k % 4 == 1, F.concat("pin", F.lit(".0"))).when(k % 4 == 2, F.concat(F.lit("0"), "pin")).otherwise("")
    b = F.when(k % 3 == 0, F.concat(F.lit("Road 7, "), (600000 + k % 1000).cast("string"))).otherwise("Road 1234567")
    return entities(spark, d).select("entity_id", reports.any_pin(a, b).alias("pin"))


@query("geo_precheck", """SELECT entity_id, concat_ws(';', CASE WHEN pin IS NULL THEN 'missing_or_unparseable_pin' END, CASE WHEN coalesce(pin_ambiguous, false) THEN 'ambiguous_pin_bridge' END, CASE WHEN state <> ps THEN 'state_pin_conflict' END, CASE WHEN s < .72 THEN 'city_pin_district_conflict' END,
  CASE WHEN coalesce(join_confidence, 0) < .8 THEN 'weak_health_join' END) AS reasons, CASE WHEN pin IS NULL THEN 'missing_or_unparseable_pin' WHEN coalesce(pin_ambiguous, false) THEN 'ambiguous_pin_bridge' WHEN state <> ps THEN 'state_pin_conflict' WHEN s < .72 THEN 'city_pin_district_conflict'
  WHEN coalesce(join_confidence, 0) < .8 THEN 'weak_health_join' ELSE 'fuzzy_ok' END AS status FROM (SELECT *, round(1.0 - levenshtein(district, city) / greatest(length(district), length(city), 1), 3) AS s FROM (
  SELECT *, CASE WHEN entity_id % 11 = 3 THEN 'EUROPE' ELSE state END AS ps, CASE WHEN entity_id % 9 = 4 THEN 'elsewhere' WHEN entity_id % 9 = 5 THEN district || 'X' ELSE district END AS city FROM {entities} e))""")
def geo_precheck(spark, d):
    """What speaks against a record's place before any geocoder is asked."""
    k = F.col("entity_id")
    city = F.when(k % 9 == 4, "elsewhere").when(k % 9 == 5, F.concat("district", F.lit("X"))).otherwise(F.col("district"))
    pin_state = F.when(k % 11 == 3, "EUROPE").otherwise(F.col("state"))
    checks = reports.geo_precheck(city, F.col("district"), F.col("state"), pin_state)
    return entities(spark, d).select("entity_id", *(c.alias(n) for n, c in checks.items()))


@query("geo_candidates", """SELECT entity_id, CAST(row_number() OVER (ORDER BY contradicted::INT DESC, coalesce(km, 0) DESC, entity_id) AS BIGINT) AS place FROM {entities} e WHERE contradicted OR geo_quality IN ('outside', 'far', 'moderate', 'missing') OR lat IS NULL OR lon IS NULL
 ORDER BY contradicted::INT DESC, coalesce(km, 0) DESC, entity_id LIMIT 250""")
def geo_candidates(spark, d):
    """Which places to check first, stated in SQL."""
    chosen = spark.sql("""SELECT entity_id, contradicted, coalesce(km, 0) AS km FROM {e} WHERE contradicted OR geo_quality RLIKE 'outside|far|moderate|missing' OR lat IS NULL OR lon IS NULL""", e=entities(spark, d))
    return rel.top(chosen, [F.desc("contradicted"), F.desc("km"), F.asc("entity_id")], 250, "place").select("entity_id", "place")


@query("blank_to_null", """SELECT count(*) AS n, count(description) AS described FROM (SELECT nullif(split_part(claim_text, ' | ', 1), '') AS description FROM {entities} e)""")
def blank_to_null(spark, d):
    e = entities(spark, d).select("entity_id", F.split("claim_text", r" \| ")[0].alias("description"))
    return reports.blank_to_null(e).agg(F.count("*").alias("n"), F.count("description").alias("described"))


@query("claim_summary", f"""WITH q AS (SELECT * FROM ({CLAIMS})) SELECT 'status' AS part, status AS name, count(*) AS n, NULL::DOUBLE[] AS q FROM q GROUP BY 2 UNION ALL SELECT 'action', action, count(*), NULL FROM q GROUP BY 2 UNION ALL SELECT 'level', level, count(*), NULL FROM q GROUP BY 2
 UNION ALL SELECT 'priority', 'quantiles', count(*), list_transform(quantile_cont(priority, [0, .25, .5, .75, 1]), lambda x: round(x, 6)) FROM q""")
def claim_summary(spark, d):
    """Counts by status, action and level of the claim queue, and the spread of its priorities."""
    return reports.queue_summary(claim_rules(spark, d), ["status", "action", "level"], "priority")


@query("field_facts", r"""SELECT entity_id, u.field AS field, CAST(u.t <> '' AS INT)::BIGINT AS items, length(u.t) AS length, CASE WHEN u.t <> '' THEN 'observed_claim' ELSE 'missing_semantic' END AS status FROM (
 SELECT entity_id, unnest([{'field': 'description', 't': p[1]}, {'field': 'specialties', 't': p[2]}, {'field': 'equipment', 't': p[4]}]) AS u FROM (SELECT entity_id, string_split(claim_text, ' | ') AS p FROM {entities} e))""")
def field_facts(spark, d):
    part = lambda k: F.get(F.split("claim_text", r" \| "), F.lit(k))
    facts = reports.field_facts({"description": part(0), "specialties": part(1), "equipment": part(3)})
    return entities(spark, d).select("entity_id", F.explode(facts).alias("f")).select("entity_id", "f.*")


@query("list_facts", """SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END::BIGINT AS n_values, CASE entity_id % 3 WHEN 0 THEN kind WHEN 1 THEN 'a' END AS first_value FROM {entities} e""")
def list_facts(spark, d):
    k = F.col("entity_id")
    written = F.when(k % 3 == 0, F.concat(F.lit('["'), "kind", F.lit('", "b"]'))).when(k % 3 == 1, "a, b; 'c'").otherwise("")
    return entities(spark, d).select("entity_id", *(c.alias(n) for n, c in reports.list_facts(written).items()))


@query("coalesced_join", """SELECT entity_id, n_nationkey AS area_key FROM (SELECT entity_id, CASE WHEN pin_known THEN district ELSE CASE WHEN entity_id % 2 = 0 THEN upper(replace(district, '_', ' ')) ELSE 'nowhere' END END AS k FROM {entities} e)
 LEFT JOIN nation ON regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(k), '[^a-z0-9]+', '', 'g')""")
def coalesced_join(spark, d):
    """Records joined to their area by the PIN's name where the PIN is known, else by the address's, and back to rows."""
    address = F.when(F.col("entity_id") % 2 == 0, F.upper(F.replace("district", F.lit("_"), F.lit(" ")))).otherwise("nowhere")
    areas = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("area_key"))
    return reports.by_either_key(entities(spark, d), areas, F.col("pin_known"), F.col("district"), address, "n_name", ["area_key"]).select("entity_id", "area_key")


@query("verifiable_deserts", f"""WITH p AS (SELECT *, CASE WHEN category = 'real_desert_candidate' THEN 'deploy' WHEN category IN ('phantom_desert_or_verification_gap', 'supply_record_quality_problem') THEN 'verify' ELSE 'other' END AS subset FROM ({PLANNED}))
SELECT subset, district, round(care_gap, 6) AS care_gap, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY care_gap DESC, district) AS place FROM p) WHERE place <= 5""")
def verifiable_deserts(spark, d):
    """The five widest gaps of districts to deploy in, to verify first, and of the rest."""
    category = F.col("category")
    subset = F.when(category == "real_desert_candidate", "deploy").when(category.isin("phantom_desert_or_verification_gap", "supply_record_quality_problem"), "verify").otherwise("other")
    p = scores.planning_category(scored(spark, d)).select(subset.alias("subset"), "district", "care_gap")
    placed_rows = rel.rank_within(p, ["subset"], [F.desc("care_gap"), F.asc("district")], "place").where("place <= 5")
    return placed_rows.select("subset", "district", F.round("care_gap", 6).alias("care_gap"), "place")


@query("monitoring_rates", f"""SELECT round(avg(needs_review::INT), 6) AS review_rate, round(avg((c < .4)::INT), 6) AS low_confidence_rate, round(avg(trusted::INT), 6) AS passed_rate FROM (SELECT needs_review, trusted, {_CONF} AS c FROM {{entities}} e)""")
def monitoring_rates(spark, d):
    rate = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return entities(spark, d).agg(rate(F.col("needs_review"), "review_rate"), rate(scores.provider_confidence() < 0.4, "low_confidence_rate"), rate(F.col("trusted"), "passed_rate"))


@query("tiered_pairs", f"SELECT l AS left, r AS right, tier, score, CAST(row_number() OVER (ORDER BY tier, score DESC, l, r) AS BIGINT) AS place FROM ({TIERED}) WHERE tier IS NOT NULL ORDER BY tier, score DESC, l, r LIMIT 100")
def tiered_pairs(spark, d):
    """The surest candidate pairs: tier first, then score, then ids."""
    pairs = _tiered(spark, d).where("tier is not null").select("left", "right", "tier", "score")
    return rel.top(pairs, [F.asc("tier"), F.desc("score"), F.asc("left"), F.asc("right")], 100, "place")
