"""Queries of fitted models: imputed numbers with intervals, and eight supervised tasks with their report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meridia.operators import models
from meridia.operators import relational as rel
from meridia.plans.base import entities, query, table

CATEGORICAL = ["kind", "operator", "state", "geo_quality", "year_status", "has_equipment", "has_capability", "has_procedure", "has_source"]
NUMERIC = ["lat", "lon", "km", "year", "claim_fields", "specialties_items", "procedure_items", "equipment_items", "capability_items", "sources"]
TREES = 5  # of the imputers in these queries


def _records(spark, d):
    e = entities(spark, d)
    keys = ["entity_id", "capacity", "doctors", "capacity_status", "doctors_status", *CATEGORICAL, *NUMERIC]
    return rel.pinned(e.select(*keys).withColumns({c: F.col(c).cast("string") for c in CATEGORICAL} | {c: F.col(c).cast("double") for c in NUMERIC}))


def _fitted(e, target):
    usable = F.col(f"{target}_status") == "observed_valid"
    return models.fit_imputer(e, "entity_id", target, usable, CATEGORICAL, NUMERIC, trees=TREES)


@query("imputer_report")
def imputer_report(spark, d):
    """Five-fold errors of capacity's and doctors' imputers against medians of cohorts, and the coverage of their bands."""
    e = _records(spark, d)
    parts = [models.imputer_report(_fitted(e, t)[1], t) for t in ("capacity", "doctors")]
    return parts[0].unionByName(parts[1])


@query("model_imputation")
def model_imputation(spark, d):
    """Every record's capacity: as observed, else estimated with an interval by a model that was saved and read again."""
    e = _records(spark, d)
    path = f"{rel.scratch_folder(e)}/meridia-imputer-{uuid.uuid4().hex}"
    _fitted(e, "capacity")[0].save(path)
    out = models.Imputer.load(path).apply(e, (F.col("capacity_status") == "observed_valid") & (F.col("capacity") > 0))
    return out.select("entity_id", *(F.round(c, 6).alias(c) for c in ("estimate", "estimate_low", "estimate_high")), "estimated")


# Labels of customers from their orders, as JSON, some of it broken; both sides read this. No label is a rule of a feature.
LABELLED = """SELECT c_custkey AS entity_id, CASE WHEN n IS NULL THEN NULL WHEN c_custkey % 19 = 4 THEN chr(123) || '"trust_posture": ' ELSE chr(123) || '"trust_posture": "' || CASE status WHEN 'F' THEN 'passed_proxy_checks' WHEN 'O' THEN 'needs_review' ELSE 'unknown' END || '"'
  || CASE WHEN c_acctbal > 9900 THEN ', "facility_type": "' || lower(c_mktsegment) || '"' ELSE '' END || ', "capacity_band": "' || CASE WHEN total < 1000000 THEN 'small' WHEN total < 2000000 THEN 'medium' ELSE 'large' END || '", "doctor_count_band": "' ||
  CASE WHEN n <= 5 THEN 'solo_or_small_team' WHEN n <= 10 THEN 'medium_team' ELSE 'large_team' END || '", "other": "x"' || chr(125) END AS labels,
  CASE WHEN n IS NULL THEN '[]' WHEN c_custkey % 23 = 4 THEN 'none' ELSE '[' || CASE WHEN urgent > 0 THEN '"Maternity"' ELSE '"misc"' END || CASE WHEN high > 1 THEN ', "emergency"' ELSE '' END || CASE WHEN low > 2 THEN ', "DIAGNOSTIC"' ELSE '' END || ']' END AS services
FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, min(o_orderstatus) AS status, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high,
  sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low FROM {orders} o GROUP BY o_custkey) x ON c_custkey = o_custkey"""
ALL_TASKS = [*models.TASKS, *(f"service_{s}" for s in models.SERVICES)]


def _labels(spark, d):
    given = spark.sql(LABELLED, customer=table(spark, d, "customer"), orders=table(spark, d, "orders"))
    return models.long_labels(given, "entity_id", "labels", "services")


_GIVEN = LABELLED.replace("{customer}", "customer").replace("{orders}", "orders")


@query("task_labels", f"""WITH g AS ({_GIVEN})
SELECT entity_id, task, label FROM (SELECT entity_id, unnest({list(models.TASKS)}) AS task, json_extract_string(TRY_CAST(labels AS JSON), '$.' || task) AS label FROM g) WHERE label IS NOT NULL
UNION ALL SELECT entity_id, 'service_' || s, CAST(coalesce(list_contains(list_transform(json_extract_string(TRY_CAST(services AS JSON), '$[*]'), lambda x: lower(x)), s), false) AS VARCHAR) FROM (SELECT entity_id, services, unnest({list(models.SERVICES)}) AS s FROM g)""")
def task_labels(spark, d):
    """One row per record and supervised task, from its JSON labels and its JSON list of services."""
    return _labels(spark, d)


FEATURES = ["lat", "lon", "km", "claim_fields", "sources", "year", "n_lines", "quantity", "returned"]


def _fit(spark, d):
    e = entities(spark, d).select("entity_id", "operator", "geo_quality", "join_strategy", *(F.col(c).cast("double").alias(c) for c in FEATURES[:6]))
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").cast("double").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned")
    )
    features = e.join(bought, F.col("entity_id") == F.col("o_custkey"), "left").drop("o_custkey")
    return models.fit_tasks(features, rel.pinned(_labels(spark, d)), "entity_id", ["operator", "geo_quality", "join_strategy"], FEATURES, ALL_TASKS)


@query("task_report")
def task_report(spark, d):
    """One row for each of the eight tasks: trained, with errors of the held-out rows, or skipped with its reason."""
    return _fit(spark, d)[0]


@query("task_predictions")
def task_predictions(spark, d):
    """Every record's label and confidence in every task that could be learned."""
    _, fitted, prepared = _fit(spark, d)
    return models.predict_tasks(prepared, fitted, "entity_id")
