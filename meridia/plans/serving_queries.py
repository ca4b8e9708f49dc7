"""Queries of the serving side: tiers, points, cells, explanations, catalogues and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import relational as rel
from meridia.operators import serve
from meridia.plans.base import entities, query, regions, table
from meridia.plans.score_queries import SCORED, scored


@query("gap_is_real", f"""SELECT district, CASE WHEN real AND need >= .6 THEN 'High' WHEN real AND need >= .45 THEN 'Medium-High' WHEN need >= .5 THEN 'Medium' ELSE 'Low' END AS tier
FROM (SELECT *, district_key % 2 = 0 AND observed * 10 >= 500 AS real FROM ({SCORED}))""")
def gap_is_real(spark, d):
    category = F.when(F.col("district_key") % 2 == 0, "real_desert_candidate").otherwise("mixed_or_monitor")
    return scored(spark, d).select("district", serve.gap_is_real(category, F.col("need"), F.col("observed") * 10).alias("tier"))


@query("supply_evidence", """SELECT district, 'Observed: ' || observed || ' records, ' || CAST(round(trusted_n / observed * 100) AS INT) || '% pass checks' AS evidence FROM {regions} r WHERE observed >= 8
UNION ALL SELECT district, 'Thin: ' || observed || CASE WHEN observed = 1 THEN ' record, ' ELSE ' records, ' END || CAST(round(trusted_n / observed * 100) AS INT) || '% pass checks' FROM {regions} r WHERE observed < 8""")
def supply_evidence(spark, d):
    return regions(spark, d).select("district", serve.supply_evidence(F.col("observed"), stats.share(F.col("trusted_n"), F.col("observed"))).alias("evidence"))


@query("trust_tiers", """SELECT tier, count(*) AS n FROM (SELECT CASE WHEN trusted THEN 'High' WHEN readiness >= .65 AND join_confidence >= .80 AND geo_quality = 'plausible' THEN 'Medium' ELSE 'Verify' END AS tier FROM {entities} e) GROUP BY 1""")
def trust_tiers(spark, d):
    return rel.value_counts(entities(spark, d).select(serve.trust_tier().alias("tier")), ["tier"])


@query("map_points", """SELECT entity_id, lat, lon, CASE WHEN contradicted THEN 'Contradicted / geo-invalid' WHEN needs_review THEN 'Needs review' WHEN trusted THEN 'Passed checks' ELSE 'Unknown' END AS status, coalesce(operator, '-') AS operator
FROM {entities} e WHERE lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98""")
def map_points(spark, d):
    e = entities(spark, d).where(F.col("lat").between(6, 38) & F.col("lon").between(68, 98))
    return e.select("entity_id", "lat", "lon", serve.point_status().alias("status"), F.coalesce("operator", F.lit("-")).alias("operator"))


@query("worst_per_cell", """WITH c AS (SELECT *, CAST(floor(lat / 4) AS BIGINT) || '_' || CAST(floor(lon / 4) AS BIGINT) AS cell FROM {entities} e WHERE lat IS NOT NULL), w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY gaps DESC, entity_id) = 1)
SELECT cell, entity_id, gaps, round(CASE WHEN max(gaps) OVER () > min(gaps) OVER () THEN (gaps - min(gaps) OVER ()) / (max(gaps) OVER () - min(gaps) OVER ()) ELSE .5 END, 6) AS shade FROM w""")
def worst_per_cell(spark, d):
    e = entities(spark, d).where("lat is not null")
    return serve.worst_per_cell(e, stats.grid_cell(F.col("lat"), F.col("lon"), 4), "gaps", "entity_id").select("cell", "entity_id", "gaps", "shade")


@query("centre_fallback", """WITH p AS (SELECT * FROM {entities} e WHERE lat IS NOT NULL AND district <> 'NATION_3' AND state <> 'EUROPE')
SELECT n_name AS district, round(coalesce(a.lat, b.lat, c.lat), 6) AS lat, round(coalesce(a.lon, b.lon, c.lon), 6) AS lon, CASE WHEN a.lat IS NOT NULL THEN 'own' WHEN b.lat IS NOT NULL THEN 'wide' ELSE 'all' END AS centre_source
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT district, median(lat) AS lat, median(lon) AS lon FROM p GROUP BY 1) a ON a.district = n_name LEFT JOIN (SELECT state, median(lat) AS lat, median(lon) AS lon FROM p GROUP BY 1) b ON b.state = r_name,
 (SELECT median(lat) AS lat, median(lon) AS lon FROM p) c""")
def centre_fallback(spark, d):
    p = entities(spark, d).where("lat is not null and district <> 'NATION_3' and state <> 'EUROPE'")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    areas = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    return serve.centre_fallback(areas, p, "district", "state").select("district", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "centre_source")


@query("explanations", """SELECT district, signal, value, text FROM (SELECT district, 'need' AS signal, anaemia AS value, 'Anaemia in ' || CAST(CAST(anaemia AS INT) AS VARCHAR) || ' of 100' AS text FROM {regions} r WHERE anaemia IS NOT NULL
 UNION ALL SELECT district, 'records', observed, CAST(observed AS VARCHAR) || ' records seen' FROM {regions} r UNION ALL SELECT district, 'contradicted', contradicted_n, CAST(contradicted_n AS VARCHAR) || ' contradict' FROM {regions} r)""")
def explanations(spark, d):
    told = lambda c, t: F.concat(F.col(c).cast("string"), F.lit(t))
    return serve.explain(
        regions(spark, d), "district",
        {"need": (F.col("anaemia"), F.concat(F.lit("Anaemia in "), F.col("anaemia").cast("int").cast("string"), F.lit(" of 100"))), "records": (F.col("observed"), told("observed", " records seen")),
         "contradicted": (F.col("contradicted_n"), told("contradicted_n", " contradict"))},
    )


@query("competing_values", """WITH l AS (UNPIVOT (SELECT entity_id, lower(kind) AS a, CASE WHEN entity_id % 10 = 0 THEN 'other' ELSE lower(kind) END AS b, operator AS c FROM {entities} e) ON a, b, c INTO NAME source VALUE value)
SELECT entity_id, source, value FROM l WHERE value IS NOT NULL AND entity_id IN (SELECT entity_id FROM l WHERE source <> 'c' GROUP BY 1 HAVING count(DISTINCT value) > 1) AND source <> 'c'""")
def competing_values(spark, d):
    e = entities(spark, d).select("entity_id", F.lower("kind").alias("a"), F.when(F.col("entity_id") % 10 == 0, "other").otherwise(F.lower("kind")).alias("b"))
    return serve.competing_values(e, "entity_id", {"a": "a", "b": "b"})


_PRIORS = ", ".join(f"('{s}', '{t}', {str(p).lower()}, {lo}e0, {hi}e0, {'NULL' if r is None else f'{r}e0'}, '{a}')" for s, t, p, lo, hi, r, a in [
    ("OK", "ROOFTOP", False, 0.86, 0.96, 0.1, "accept_if_admin_and_pincode_match"), ("OK", "RANGE_INTERPOLATED", False, 0.68, 0.84, 0.5, "accept_for_planning_if_boundary_checks_pass"),
    ("OK", "GEOMETRIC_CENTER", False, 0.48, 0.68, 3.0, "use_for_neighborhood_only_or_retry_with_landmark"), ("OK", "APPROXIMATE", False, 0.2, 0.48, 25.0, "retry_with_landmark_or_alternate_provider"),
    ("OK", "ANY", True, 0.18, 0.6, 15.0, "compare_name_admin_pincode_then_queue_if_high_impact"), ("ZERO_RESULTS", "NONE", False, 0.0, 0.18, None, "search_hfr_pmjay_mappls_osm_or_mark_unknown")])


@query("geocoder_priors", f"""SELECT status, location_type, partial, n, low, high, radius_km, action AS prior_action FROM (SELECT CASE entity_id % 13 WHEN 0 THEN 'ZERO_RESULTS' WHEN 1 THEN 'REQUEST_DENIED' ELSE 'OK' END AS status,
  CASE entity_id % 4 WHEN 0 THEN 'ROOFTOP' WHEN 1 THEN 'GEOMETRIC_CENTER' WHEN 2 THEN 'RANGE_INTERPOLATED' ELSE 'APPROXIMATE' END AS location_type, contradicted AS partial, count(*) AS n FROM {{entities}} e GROUP BY ALL) x
 LEFT JOIN (VALUES {_PRIORS}) p(s, t, q, low, high, radius_km, action) ON s = status AND ((status = 'OK' AND q = partial AND (q OR t = location_type)) OR status = 'ZERO_RESULTS')""")
def geocoder_priors(spark, d):
    k = F.col("entity_id")
    status = F.when(k % 13 == 0, "ZERO_RESULTS").when(k % 13 == 1, "REQUEST_DENIED").otherwise("OK")
    kind = F.when(k % 4 == 0, "ROOFTOP").when(k % 4 == 1, "GEOMETRIC_CENTER").when(k % 4 == 2, "RANGE_INTERPOLATED").otherwise("APPROXIMATE")
    e = rel.value_counts(entities(spark, d).select(status.alias("status"), kind.alias("location_type"), F.col("contradicted").alias("partial")), ["status", "location_type", "partial"])
    return serve.with_prior(e, "status", "location_type", "partial")


@query("reconciliation_status", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN operator IS NULL OR match_score IS NULL THEN 'llm_parse_missing' WHEN entity_id % 7 = 0 THEN 'parsed_pin_conflict' WHEN entity_id % 8 = 1 THEN 'parsed_state_conflict' WHEN readiness < .3 THEN 'parsed_city_district_conflict'
 WHEN match_score * join_confidence < .65 THEN 'low_llm_parse_confidence' WHEN needs_review THEN 'pre_geocoder_review' ELSE 'ready_for_geocoder' END AS status FROM {entities} e) GROUP BY 1""")
def reconciliation_status(spark, d):
    conflict = lambda c: F.when(c, "conflict").otherwise("match")
    adjusted = F.when(F.col("readiness") < 0.3, 0.5).otherwise(0.9)
    s = serve.reconciliation(
        F.col("operator").isNotNull(), conflict(F.col("entity_id") % 7 == 0), conflict(F.col("entity_id") % 8 == 1), adjusted, F.col("match_score") * F.col("join_confidence"),
        F.when(F.col("needs_review"), "conflict").otherwise("fuzzy_ok"),
    )
    return rel.value_counts(entities(spark, d).select(s.alias("status")), ["status"])


@query("geo_quality_summary", "SELECT geo_quality, state, count(*) AS n, round(avg(readiness), 6) AS mean, max(gaps) AS most FROM {entities} e GROUP BY 1, 2")
def geo_quality_summary(spark, d):
    return entities(spark, d).groupBy("geo_quality", "state").agg(F.count("*").alias("n"), F.round(F.avg("readiness"), 6).alias("mean"), F.max("gaps").alias("most"))


@query("scope_filter", "SELECT scope, count(*) AS n FROM (SELECT 'all' AS scope FROM {regions} r UNION ALL SELECT 'with_rows' FROM {regions} r WHERE observed > 0) GROUP BY 1")
def scope_filter(spark, d):
    r = regions(spark, d)
    both = [serve.scope(r, s).select(F.lit(s).alias("scope")) for s in ("all", "with_rows", "zero_rows")]
    return rel.value_counts(both[0].unionByName(both[1]).unionByName(both[2]), ["scope"])


@query("serving_view", "SELECT district, observed, trusted_n FROM {regions} r")
def serving_view(spark, d):
    from meridia.sources import io

    io.serving_view(regions(spark, d), "district_serving", ["district", "observed", "trusted_n"])
    return spark.table("district_serving")


@query("provider_candidates", """SELECT district, entity_id, place FROM (SELECT district, entity_id, CAST(row_number() OVER (PARTITION BY district ORDER BY trusted DESC, (join_confidence >= .8) DESC NULLS LAST, sources DESC, semantic_quality DESC, entity_id) AS BIGINT) AS place FROM {entities} e WHERE NOT contradicted) WHERE place <= 3""")
def provider_candidates(spark, d):
    e = entities(spark, d).where("not contradicted")
    order = [F.desc("trusted"), F.desc_nulls_last(F.col("join_confidence") >= 0.8), F.desc("sources"), F.desc("semantic_quality"), F.asc("entity_id")]
    return rel.rank_within(e, ["district"], order, "place").where("place <= 3").select("district", "entity_id", "place")


@query("weighted_policy", """SELECT entity_id, s AS score, CASE WHEN s >= .70 THEN 'high' WHEN s >= .40 THEN 'medium' ELSE 'low' END AS band FROM (SELECT entity_id, round(CAST(least(1, greatest(0, .25 * trusted::INT + .20 * coalesce(has_source, false)::INT + .15 * coalesce(has_contact, false)::INT
 + .15 * (geo_quality = 'plausible')::INT + .10 * least(sources / 3.0, 1) - .10 * (recency <> 'valid')::INT - .05 * contradicted::INT)) AS DECIMAL(24, 8)), 4)::DOUBLE AS s FROM {entities} e)""")
def weighted_policy(spark, d):
    """A versioned rule policy: weights as data, evaluated by the same function as every score."""
    from meridia.operators.scores import flag, weighted

    s = weighted(
        [(flag(F.col("trusted")), 0.25, 0), (flag(F.col("has_source")), 0.20, 0), (flag(F.col("has_contact")), 0.15, 0), (flag(F.col("geo_quality") == "plausible"), 0.15, 0),
         (F.least(F.col("sources") / 3.0, F.lit(1.0)), 0.10, 0), ((F.col("recency") != "valid").cast("double"), -0.10, 1), (flag(F.col("contradicted")), -0.05, 0)]
    )
    out = entities(spark, d).select("entity_id", stats.half_up(stats.clip01(s), 4).alias("score"))
    return out.withColumn("band", stats.band(F.col("score"), [(0.70, "high"), (0.40, "medium")], "low"))


@query("quality_snapshot", """SELECT count(*) AS n, count(*) FILTER (trusted) AS trusted, count(*) FILTER (needs_review) AS review, count(*) FILTER (contradicted) AS contradicted, count(*) FILTER (lat IS NULL) AS unplaced, count(*) FILTER (coalesce(has_source, false)) AS sourced,
 count(DISTINCT district) AS districts, round(avg(readiness), 6) AS readiness FROM {entities} e""")
def quality_snapshot(spark, d):
    c = F.count_if
    return entities(spark, d).agg(
        F.count("*").alias("n"), c("trusted").alias("trusted"), c("needs_review").alias("review"), c("contradicted").alias("contradicted"), c(F.col("lat").isNull()).alias("unplaced"),
        c(F.coalesce("has_source", F.lit(False))).alias("sourced"), F.count_distinct("district").alias("districts"), F.round(F.avg("readiness"), 6).alias("readiness"),
    )
