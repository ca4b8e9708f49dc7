"""The job from raw tables to serving tables: bronze with provenance, silver contracts, features, gold. Each step is a saved table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import evidence, remediate, reports, scores
from meridia.operators import relational as rel
from meridia.plans.base import raw_entities, regions
from meridia.plans.decision_queries import ev_recommender
from meridia.plans.score_queries import scored
from meridia.sources import io

# The silver contracts, as their column and the record's.
PROVIDERS = {"canonical_provider_id": "entity_id", "geography_id": "geography_id", "facility_name": "name", "facility_type": "kind", "operator_type": "operator", "state_ut": "state", "district_name": "district"}
LOCATIONS = {"canonical_provider_id": "entity_id", "latitude": "lat", "longitude": "lon", "pincode": "pin", "geo_quality": "geo_quality", "geo_distance_km": "km"}
QUALITY = {
    "canonical_provider_id": "entity_id", "data_readiness_score": "readiness", "supply_data_confidence_score": "supply_confidence", "semantic_data_quality_score": "semantic_quality",
    "semantic_missing_critical_count": "gaps", "recency_status": "recency", "join_confidence": "join_confidence", "trustworthy_supply_signal": "trusted", "needs_human_review": "needs_review",
    "contradicted_flag": "contradicted", "has_source_urls": "has_source", "has_contact_evidence": "has_contact", "source_count": "sources",
}


def contract(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(name) for name, c in columns.items()))


def run(spark: SparkSession, sf_dir: str, prefix: str = "meridia_", run_id: str = "run-1") -> dict[str, DataFrame]:
    """Write and return the tables by name; steps whose inputs are missing raise before anything is overwritten."""
    name = lambda t: f"{prefix}{t}"
    out = {}

    def save(df: DataFrame, table: str, keys: list[str], comment: str) -> DataFrame:
        out[table] = io.save_keyed(df, name(table), keys, comment)
        return out[table]

    out["bronze_entities"] = io.ingest(raw_entities(spark, sf_dir), name("bronze_entities"), "entities", sf_dir, run_id)
    out["bronze_regions"] = io.ingest(regions(spark, sf_dir), name("bronze_regions"), "regions", sf_dir, run_id)
    bronze = spark.table(io.first_existing(spark, name("bronze_entities")))

    geography = F.concat_ws("|", "state", "district")
    clean = reports.blank_to_null(bronze.drop("ingested_at", "ingestion_run_id"))
    silver = save(evidence.derive(clean).withColumn("geography_id", geography), "silver_entities", ["entity_id"], "one row per record")
    save(contract(silver, PROVIDERS), "silver_providers", ["canonical_provider_id"], "who a record is")
    save(contract(silver, LOCATIONS).withColumn("geo_valid_flag", scores.in_box(F.col("latitude"), F.col("longitude"))), "silver_locations", ["canonical_provider_id"], "where it is")
    save(contract(silver, QUALITY), "silver_quality", ["canonical_provider_id"], "what its evidence is worth")
    places = bronze.select(geography.alias("geography_id"), "state", "district", F.concat_ws(", ", "district", "state").alias("geography_name")).distinct()
    save(places, "silver_geographies", ["geography_id"], "districts")

    districts = scores.planning_category(scored(spark, sf_dir)).withColumn("geography_id", geography)
    districts = save(districts, "features_districts", ["geography_id"], "scores of districts")
    ranked = districts.select("geography_id", "need", "priority")
    placed = silver.join(ranked, "geography_id").withColumn("priority", F.when(F.col("match_score").isNotNull(), F.col("priority")))
    features = remediate.remediation(placed).select(
        "entity_id", "geography_id", scores.provider_confidence().alias("confidence"), scores.review_priority().alias("review_priority"), scores.review_concern().alias("concern"),
        F.round(scores.validity_posterior(), 6).alias("posterior"), F.to_json("actions").alias("actions"), F.to_json("reasons").alias("reasons"), "task",
    )
    features = save(features, "features_entities", ["entity_id"], "scores of records")

    queue = features.where("review_priority > 0").select("entity_id", "geography_id", F.col("review_priority").alias("priority"), "concern", "confidence")
    save(queue, "gold_review_queue", ["entity_id"], "records to look at, unsorted")
    act = stats.band(F.col("posterior"), [(0.85, "auto-accept"), (0.60, "merge-or-review")], "human-review")
    save(reports.confidence_rows(silver, "entity_id", features.select("entity_id", "posterior", act.alias("action"))), "gold_confidence", ["entity_id"], "confidence and posterior of records")
    board = rel.top(districts, [F.desc("care_gap"), F.asc("geography_id")], 25, "gap_rank")
    drivers = F.to_json(F.array(*(F.struct(F.lit(c).alias("driver"), F.round(c, 6).alias("value")) for c in ("need", "trust_gap", "quality"))))
    gold = board.select("geography_id", "gap_rank", F.round("care_gap", 6).alias("care_gap"), "category", "uncertainty", drivers.alias("drivers_json"))
    save(gold, "gold_gap_board", ["geography_id"], "worst districts")
    options = ev_recommender(spark, sf_dir).withColumn("data_limitations", reports.limitation(F.col("option"), F.lit(None).cast("string")))
    save(options, "gold_recommendations", ["district", "option"], "interventions of districts, ranked")
    io.create_logs(spark, prefix)
    io.serving_view(out["gold_gap_board"], name("v_gap_board"), ["geography_id", "gap_rank", "care_gap", "category"])
    return out
