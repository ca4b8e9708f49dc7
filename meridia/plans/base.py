"""The tables that queries start from, and the decorator that registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.functions import text
from meridia.operators import evidence
from meridia.operators import relational as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that states it; {entities} and {regions} stand for those tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("{regions}", f"({REGIONS})").replace("{entities}", f"({ENTITIES})")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Raw records of one provider each: texts, flags and coordinates made from customer keys, with unknowns. Shared by both sides.
RAW = """
SELECT c_custkey AS entity_id, n_name AS district, r_name AS state, c_name AS name, c_mktsegment AS kind,
  CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'trust' END AS operator,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 6e0 + CAST(c_custkey % 320 AS DOUBLE) / 10e0 END AS lat,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 47 = 0 THEN 102e0 ELSE 68e0 + CAST((c_custkey * 7) % 300 AS DOUBLE) / 10e0 END AS lon,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 14 = 3 THEN 251e0 + CAST(c_custkey % 500 AS DOUBLE) WHEN c_custkey % 11 = 4 THEN 50.5e0 + CAST(c_custkey % 190 AS DOUBLE) ELSE CAST(c_custkey % 51 AS DOUBLE) END AS km,
  CASE WHEN c_custkey % 26 = 0 THEN NULL ELSE CAST(500000 + c_custkey % 400 AS STRING) END AS pin, c_custkey % 26 <> 0 AND c_custkey % 33 <> 1 AS pin_known,
  CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_custkey % 16 = 3 END AS pin_ambiguous,
  CASE WHEN c_custkey % 28 = 5 THEN NULL WHEN c_custkey % 12 = 7 THEN 0.94e0 ELSE 1e0 END AS match_score,
  CASE WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 31 = 0 THEN 'several beds' WHEN c_custkey % 37 = 0 THEN '6000 beds' ELSE CAST(CAST(round(abs(c_acctbal) / 4) AS BIGINT) AS STRING) || ' beds' END AS capacity_raw,
  CASE WHEN c_custkey % 3 = 0 THEN 'n/a' WHEN c_custkey % 41 = 0 THEN 'a team' WHEN c_custkey % 43 = 0 THEN '5600' ELSE CAST(c_custkey % 97 AS STRING) END AS doctors_raw,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'long ago' ELSE 'since ' || CAST(1950 + c_custkey % 70 AS STRING) END AS year_raw,
  CASE c_custkey % 8 WHEN 0 THEN '2020-03-01' WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN c_custkey % 16 = 2 THEN 'soon' ELSE '2031-05-05' END ELSE '2026-01-15' END AS page_date,
  c_custkey % 10 <> 5 AS has_description, c_custkey % 5 <> 1 AS has_specialties, c_custkey % 7 <> 2 AS has_procedure, c_custkey % 8 <> 3 AS has_equipment, c_custkey % 9 <> 4 AS has_capability,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 13 <> 4 END AS has_source, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 6 <> 0 END AS has_contact,
  c_custkey % 6 <> 1 AS has_website, c_custkey % 15 <> 2 AS has_phone, c_custkey % 12 <> 5 AS has_mail,
  CASE WHEN c_custkey % 10 = 5 THEN '' ELSE CASE c_custkey % 6 WHEN 0 THEN 'Listed among top hospitals of the district' WHEN 1 THEN 'Complete range of medical services' WHEN 2 THEN 'A clinic with casualty and ambulance'
      WHEN 3 THEN 'Affiliated with a medical college' WHEN 4 THEN 'Eye care; cataract camp' ELSE 'Village dispensary' END END
    || ' | ' || CASE WHEN c_custkey % 5 = 1 THEN '' ELSE CASE c_custkey % 8 WHEN 0 THEN 'gynecologyAndObstetrics' WHEN 1 THEN 'cardiology, internalMedicine' WHEN 2 THEN 'internalMedicine' WHEN 3 THEN 'dentistry' WHEN 4 THEN 'medicalOncology'
      WHEN 5 THEN 'criticalCareMedicine' WHEN 6 THEN 'generalSurgery' ELSE 'ophthalmology' END END
    || ' | ' || CASE WHEN c_custkey % 7 = 2 THEN '' ELSE CASE c_custkey % 9 WHEN 0 THEN 'Normal delivery; C-section' WHEN 1 THEN 'X-ray' WHEN 2 THEN 'screening' WHEN 3 THEN 'Hernia repair' WHEN 4 THEN 'ECG and echo' WHEN 5 THEN 'blood transfusion' WHEN 6 THEN 'surgery'
      ELSE 'vaccination' END END
    || ' | ' || CASE WHEN c_custkey % 8 = 3 THEN '' ELSE CASE c_custkey % 7 WHEN 0 THEN 'CT scan, MRI/PET CT' WHEN 1 THEN 'ventilator' WHEN 2 THEN 'ICU+HDU beds' WHEN 3 THEN 'lab' WHEN 4 THEN 'medicines' ELSE 'dental chair' END END
    || ' | ' || CASE WHEN c_custkey % 9 = 4 THEN '' ELSE CASE c_custkey % 5 WHEN 0 THEN '24x7 emergency' WHEN 1 THEN 'all specialty services' WHEN 2 THEN 'pharmacy' WHEN 3 THEN 'imaging; multi specialty' ELSE 'trauma centre' END END AS claim_text,
  CAST(1 AS BIGINT) AS description_items, CASE WHEN c_custkey % 20 = 3 THEN 55 ELSE CAST(c_custkey % 9 AS BIGINT) END AS specialties_items, CAST(c_custkey % 12 AS BIGINT) AS procedure_items, CAST(c_custkey % 5 AS BIGINT) AS equipment_items,
  CASE WHEN c_custkey % 25 = 7 THEN 60 ELSE CAST(c_custkey % 11 AS BIGINT) END AS capability_items,
  CAST(c_custkey % 4 AS BIGINT) AS sources
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

_STATUS = "CASE WHEN coalesce({c} > 5000, false) THEN 'observed_extreme_outlier' WHEN {c}_raw IS NULL OR {c}_raw = 'n/a' THEN 'missing_semantic' WHEN {c} IS NULL THEN 'present_unparseable' ELSE 'observed_valid' END AS {c}_status"
_PEERS = """coalesce(CASE WHEN operator IS NOT NULL AND count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind, operator, state) >= 5 THEN count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind, operator, state) END,
  CASE WHEN operator IS NOT NULL AND count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind, operator) >= 10 THEN count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind, operator) END,
  CASE WHEN count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind) >= 10 THEN count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY kind) END,
  CASE WHEN operator IS NOT NULL AND count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY operator) >= 10 THEN count(*) FILTER ({c}_status = 'observed_valid') OVER (PARTITION BY operator) END,
  count(*) FILTER ({c}_status = 'observed_valid') OVER ()) AS {c}_peers"""
_SURE = "CASE WHEN {c}_status = 'observed_valid' THEN 'observed' WHEN {c}_peers >= 50 THEN 'medium' WHEN {c}_peers >= 10 THEN 'low_medium' ELSE 'low' END AS {c}_confidence"
_UP = "round(CAST({} AS DECIMAL(24, 8)), 3)::DOUBLE"
_TRUE = "CAST(coalesce({}, false) AS INT)"

_SIGNALS = ", ".join(f"regexp_matches(lower(claim_text), '{p}') AS {k}" for k, p in text.SERVICE_SIGNALS.items())

# Oracle side: what the raw records are worth. The engine's side is operators.evidence.derive.
ENTITIES = f"""
SELECT *, readiness >= .8 AND join_confidence >= .8 AND geo_quality = 'plausible' AND coalesce(has_source, false) AND claim_fields >= 3 AND supply_confidence >= .65 AND NOT capacity_outlier AND NOT doctors_outlier AND recency NOT IN ('invalid', 'future') AS trusted,
  readiness < .65 OR semantic_quality < .45 OR critical_gap OR join_confidence < .8 OR geo_quality <> 'plausible' OR claim_fields < 2 AS needs_review, geo_quality IN ('outside', 'far') OR capacity_outlier OR doctors_outlier AS contradicted
FROM (SELECT *, {_UP.format("0.70 * ready + 0.30 * semantic_quality")} AS readiness, gaps >= 3 OR capacity_outlier OR doctors_outlier OR recency IN ('invalid', 'future') AS critical_gap
FROM (SELECT *, {_UP.format(f"least(1, greatest(0, .45 * supply_confidence + .25 * (1 - gaps / 5) + .15 * {_TRUE.format('has_source')} + .15 * {_TRUE.format('has_contact')}))")} AS semantic_quality
FROM (SELECT *, {_UP.format(f"0.24e0 * (capacity_confidence IN ('observed', 'medium'))::INT + 0.24e0 * (doctors_confidence IN ('observed', 'medium'))::INT + 0.18e0 * has_equipment::INT + 0.14e0 * (recency IN ('valid', 'stale'))::INT + 0.10e0 * (year_status = 'observed_valid')::INT + 0.10e0 * {_TRUE.format('has_source')}")} AS supply_confidence,
  {_UP.format(f"0.18e0 * (pin IS NOT NULL)::INT + 0.22e0 * (match_score IS NOT NULL)::INT + 0.14e0 * coalesce(lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98, false)::INT + 0.08e0 * (NOT coalesce(pin_ambiguous, true))::INT + 0.12e0 * {_TRUE.format('has_source')} + 0.16e0 * (claim_fields >= 3)::INT + 0.10e0 * {_TRUE.format('has_contact')}")} AS ready
FROM (SELECT *, {_SURE.format(c="capacity")}, {_SURE.format(c="doctors")}
FROM (SELECT *, CASE join_strategy WHEN 'pincode_district_state_exact' THEN CASE WHEN coalesce(pin_ambiguous, false) THEN .82e0 ELSE .95e0 END WHEN 'pincode_district_state_fuzzy' THEN .72e0 WHEN 'facility_city_state_fallback' THEN .55e0 ELSE 0e0 END AS join_confidence,
  CAST((capacity_status <> 'observed_valid')::INT + (doctors_status <> 'observed_valid')::INT + (year_status <> 'observed_valid')::INT + (recency <> 'valid')::INT + (NOT has_equipment)::INT AS BIGINT) AS gaps, {_PEERS.format(c="capacity")}, {_PEERS.format(c="doctors")}
FROM (SELECT *, {_STATUS.format(c="capacity")}, {_STATUS.format(c="doctors")}, CASE WHEN year_raw IS NULL THEN 'missing_semantic' WHEN year IS NULL THEN 'present_unparseable' ELSE 'observed_valid' END AS year_status,
  coalesce(capacity > 5000, false) AS capacity_outlier, coalesce(doctors > 5000, false) AS doctors_outlier,
  CASE WHEN page_date IS NULL THEN 'missing' WHEN TRY_CAST(page_date AS DATE) IS NULL THEN 'invalid' WHEN page_date > '2026-06-16' THEN 'future' WHEN CAST(TRY_CAST(page_date AS DATE) AS DATE) <= DATE '2026-06-16' - 730 THEN 'stale' ELSE 'valid' END AS recency,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN NOT (lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98) THEN 'outside' WHEN km > 250 THEN 'far' WHEN km > 50 THEN 'moderate' ELSE 'plausible' END AS geo_quality,
  CASE WHEN match_score = 1 AND pin_known THEN 'pincode_district_state_exact' WHEN match_score < 1 AND pin_known THEN 'pincode_district_state_fuzzy' WHEN match_score IS NOT NULL THEN 'facility_city_state_fallback' WHEN pin_known THEN 'pincode_only_no_health_match'
    WHEN pin IS NULL THEN 'no_valid_pincode' ELSE 'unjoined' END AS join_strategy, CAST(has_description::INT + has_specialties::INT + has_procedure::INT + has_equipment::INT + has_capability::INT AS BIGINT) AS claim_fields
FROM (SELECT *, TRY_CAST(regexp_extract(capacity_raw, '[0-9]+') AS DOUBLE) AS capacity, TRY_CAST(regexp_extract(doctors_raw, '[0-9]+') AS DOUBLE) AS doctors, TRY_CAST(regexp_extract(year_raw, '[0-9]{{4}}') AS INT) AS year, {_SIGNALS} FROM ({RAW}))))))))
"""

# One row per district: supply counts of its records, and need indicators derived from its key.
REGIONS = f"""
SELECT state, district, n_nationkey AS district_key,
  count(*) AS observed, CAST(sum(CASE WHEN trusted THEN 1 ELSE 0 END) AS BIGINT) AS trusted_n,
  CAST(sum(CASE WHEN needs_review THEN 1 ELSE 0 END) AS BIGINT) AS review_n,
  CAST(sum(CASE WHEN contradicted THEN 1 ELSE 0 END) AS BIGINT) AS contradicted_n,
  CAST(sum(CASE WHEN critical_gap THEN 1 ELSE 0 END) AS BIGINT) AS critical_n,
  CAST(sum(CASE WHEN has_source THEN 1 ELSE 0 END) AS BIGINT) AS source_n,
  CAST(sum(CASE WHEN has_contact THEN 1 ELSE 0 END) AS BIGINT) AS contact_n,
  CAST(sum(CASE WHEN geo_quality = 'plausible' THEN 1 ELSE 0 END) AS BIGINT) AS plausible_n,
  round(avg(readiness), 6) AS avg_readiness, round(avg(semantic_quality), 6) AS avg_semantic, round(avg(join_confidence), 6) AS avg_join,
  round(sum(CASE WHEN capacity_status = 'observed_valid' THEN capacity ELSE 0e0 END), 2) AS capacity_sum, CAST(sum(CASE WHEN capacity_status = 'observed_valid' THEN 1 ELSE 0 END) AS BIGINT) AS capacity_n,
  CAST(sum(CASE WHEN maternity THEN 1 ELSE 0 END) AS BIGINT) AS maternity_n, CAST(sum(CASE WHEN diagnostic THEN 1 ELSE 0 END) AS BIGINT) AS diagnostic_n, CAST(sum(CASE WHEN chronic THEN 1 ELSE 0 END) AS BIGINT) AS chronic_n,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST((n_nationkey * 37) % 100 AS DOUBLE) END AS anaemia,
  CAST((n_nationkey * 53) % 100 AS DOUBLE) AS pressure, CAST((n_nationkey * 29) % 60 AS DOUBLE) AS sugar,
  CASE WHEN n_nationkey % 11 = 4 THEN NULL ELSE CAST((n_nationkey * 31) % 90 AS DOUBLE) END AS pressure_men, CAST((n_nationkey * 23) % 55 AS DOUBLE) AS sugar_men,
  CASE WHEN n_nationkey % 9 = 5 THEN NULL ELSE CAST((n_nationkey * 71) % 100 AS DOUBLE) END AS insurance,
  CAST(20 + (n_nationkey * 43) % 80 AS DOUBLE) AS births
FROM ({ENTITIES}) e JOIN nation ON e.district = n_name GROUP BY state, district, n_nationkey
"""


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")}


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = RAW.replace("FROM customer JOIN nation ", "FROM {customer} JOIN {nation} ").replace("JOIN region ", "JOIN {region} ")
    views = _views(spark, sf_dir)
    return spark.sql(raw, **views | {"customer": rel.spread(views["customer"], "c_custkey")})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.derive(raw_entities(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """One row per district; ``e``: the derived records, where a query has them already."""
    e, nation = e if e is not None else entities(spark, sf_dir), table(spark, sf_dir, "nation")
    sql = REGIONS.replace(f"({ENTITIES})", "{entities}").replace("e JOIN nation ON", "e JOIN {nation} ON")
    return spark.sql(sql, entities=e, nation=nation)
