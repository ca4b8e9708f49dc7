"""Queries that rank whole tables: every row gets its place, no task sees all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import claims, ranks, remediate
from meridia.plans.base import query, table
from meridia.plans.decision_queries import CLAIMS, MASKED, TIERED, _tiered
from meridia.plans.score_queries import UNCERTAIN, placed, uncertain_records


@query("claim_queue_ranks", f"""SELECT entity_id, category, priority, CAST(row_number() OVER (ORDER BY priority DESC, verify DESC, level IN ('critical', 'high') DESC, name, category, entity_id) AS BIGINT) AS queue_rank
FROM ({CLAIMS}) c JOIN (SELECT entity_id, name FROM {{entities}} e) USING (entity_id)""")
def claim_queue_ranks(spark, d):
    """The whole claim queue in the order of review: priority, need of verification, impact, name, category."""
    queue = claims.claim_queue(placed(spark, d, dealt=True), "entity_id", ["name"]).select(
        "entity_id", "category", "priority", "verify", "name", F.col("level").isin("critical", "high").alias("high_impact")
    )
    order = [F.desc("priority"), F.desc("verify"), F.desc("high_impact"), F.asc("name"), F.asc("category"), F.asc("entity_id")]
    return ranks.global_ranks(queue, order, "queue_rank").select("entity_id", "category", "priority", "queue_rank")


@query("uncertainty_ranks", f"SELECT entity_id, score, queue_rank AS uncertainty_rank FROM ({UNCERTAIN})")
def uncertainty_ranks(spark, d):
    """Every record's place by active uncertainty, ties by id."""
    scored = uncertain_records(spark, d).select("entity_id", "score")
    return ranks.global_ranks(scored, [F.desc("score"), F.asc("entity_id")], "uncertainty_rank")


@query("pair_ids", f"SELECT l AS left, r AS right, tier, score, CAST(row_number() OVER (ORDER BY tier, score DESC, l, r) AS BIGINT) AS pair_id FROM ({TIERED}) WHERE tier IS NOT NULL")
def pair_ids(spark, d):
    """All candidate pairs numbered from the surest tier down."""
    pairs = _tiered(spark, d).where("tier is not null").select("left", "right", "tier", "score")
    return ranks.global_ranks(pairs, [F.asc("tier"), F.desc("score"), F.asc("left"), F.asc("right")], "pair_id")


@query("seed_ranks", f"""SELECT entity_id, s AS score, CAST(row_number() OVER (ORDER BY s DESC, entity_id) AS BIGINT) AS seed_rank FROM (SELECT entity_id, round(CAST(.24 * coalesce(pct, .5) + .16 * needs_review::INT + .16 * CASE WHEN geo_far_or_outside THEN 1 WHEN coords_missing THEN .95 WHEN geo_moderate THEN .45 ELSE 0 END
 + .16 * least(gaps / 5, 1) + .12 * outlier_or_conflict::INT + .10 * (maternity::INT + emergency::INT + diagnostic::INT + chronic::INT) / 4 + .04 * (1 - join_confidence) + .02 * (source_missing OR contact_evidence_missing)::INT AS DECIMAL(24, 8)), 6)::DOUBLE AS s
 FROM (SELECT *, CASE WHEN priority IS NOT NULL THEN (rank() OVER (PARTITION BY priority IS NULL ORDER BY priority) + (count(*) OVER (PARTITION BY priority) - 1) / 2.0) / count(priority) OVER () END AS pct FROM ({MASKED})))""")
def seed_ranks(spark, d):
    """Every record's place as a seed for human labels."""
    scored = remediate.seed_score(placed(spark, d)).select("entity_id", F.col("seed_score").alias("score"))
    return ranks.global_ranks(scored, [F.desc("score"), F.asc("entity_id")], "seed_rank")


@query("order_ranks", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS price_rank, CAST(dense_rank() OVER (ORDER BY o_orderdate DESC) AS BIGINT) AS day_rank FROM orders""")
def order_ranks(spark, d):
    """A large table ranked by value, and densely by day."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    placed_rows = ranks.global_ranks(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], "price_rank")
    return ranks.global_dense_ranks(placed_rows, "o_orderdate", "day_rank").select("o_orderkey", "price_rank", "day_rank")
