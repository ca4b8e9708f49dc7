"""Queries of the relational core: scans, joins, aggregates, windows, rankings, set operations and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators import relational as rel
from meridia.plans.base import entities, query, regions, table
from meridia.sources import io

_WILSON = "({x} / n + 1.9208 / n {s} 1.96 * sqrt({x} / n * (1 - {x} / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@query("region_gap_leaderboard", """
WITH d AS (SELECT *, CAST(observed AS DOUBLE) AS n, CAST(trusted_n AS DOUBLE) AS x, (observed_rank + (ties - 1) / 2.0) / total AS count_pct,
    (need_rank + (need_ties - 1) / 2.0) / total AS need FROM (
  SELECT *, rank() OVER (ORDER BY observed) AS observed_rank, count(*) OVER (PARTITION BY observed) AS ties, count(*) OVER () AS total,
    rank() OVER (ORDER BY pressure) AS need_rank, count(*) OVER (PARTITION BY pressure) AS need_ties FROM {regions} r) q),
s AS (SELECT *, x / n AS rate, least(1, greatest(0, .55 * need + .25 * (1 - count_pct) + .20 * (1 - x / n))) AS gap,
    (x / n + 1.9208 / n - 1.96 * sqrt(x / n * (1 - x / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS low,
    (x / n + 1.9208 / n + 1.96 * sqrt(x / n * (1 - x / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS high FROM d)
SELECT state, district, observed, trusted_n, round(rate, 6) AS trust_rate, round(low, 6) AS ci_low, round(high, 6) AS ci_high,
  round(need, 6) AS need, round(gap, 6) AS care_gap,
  CASE WHEN avg_readiness >= .85 AND observed >= 5 THEN 'lower' WHEN avg_readiness >= .5 AND observed >= 3 THEN 'medium' ELSE 'higher' END AS uncertainty,
  CAST(row_number() OVER (ORDER BY round(gap, 6) DESC, district) AS BIGINT) AS gap_rank
FROM s ORDER BY round(gap, 6) DESC, district LIMIT 15""")
def region_gap_leaderboard(spark, d):
    """Supply, its trust rate with an interval, need and gap of the worst districts."""
    r = stats.few_pct_ranks(regions(spark, d), {"observed": "count_pct", "pressure": "need"})
    rate = stats.share(F.col("trusted_n"), F.col("observed"))
    ci = stats.wilson(F.col("trusted_n"), F.col("observed"))
    gap = stats.clip01(0.55 * F.col("need") + 0.25 * (1 - F.col("count_pct")) + 0.20 * (1 - F.coalesce(rate, F.lit(0.0))))
    level = (
        F.when((F.col("avg_readiness") >= 0.85) & (F.col("observed") >= 5), "lower")
        .when((F.col("avg_readiness") >= 0.5) & (F.col("observed") >= 3), "medium").otherwise("higher")
    )
    out = r.select(
        "state", "district", "observed", "trusted_n", F.round(rate, 6).alias("trust_rate"), F.round(ci["low"], 6).alias("ci_low"),
        F.round(ci["high"], 6).alias("ci_high"), F.round("need", 6).alias("need"), F.round(gap, 6).alias("care_gap"), level.alias("uncertainty"),
    )
    return rel.top(out, [F.desc("care_gap"), F.asc("district")], 15, "gap_rank")


@query("provenance_hash", """SELECT n_nationkey, n_name, n_regionkey,
  sha256(concat_ws('||', CAST(n_nationkey AS VARCHAR), coalesce(n_name, '∅'), CAST(n_regionkey AS VARCHAR))) AS record_hash,
  'nations' AS source_name FROM nation""")
def provenance_hash(spark, d):
    out = io.add_provenance(table(spark, d, "nation"), "nations", "file", "run-1")
    return out.drop("ingested_at", "ingestion_run_id", "source_url")


@query("tolerant_projection", """SELECT c_custkey AS id, CAST(c_acctbal AS BIGINT) AS balance, CAST(NULL AS VARCHAR) AS phone, upper(c_name) AS label
FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal, c_name FROM customer) t""")
def tolerant_projection(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    out = io.tolerant_select(df, {"c_custkey": "bigint", "c_acctbal": "bigint", "phone": "string", "label": "string"}, {"label": "upper(c_name)"})
    return out.withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance"})


@query("key_report", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_null_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated_keys
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def key_report(spark, d):
    return io.key_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("n_null_keys", F.col("n_null_keys").cast("long"))


@query("dedup_keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def dedup_keep_first(spark, d):
    df = table(spark, d, "lineitem")
    out = rel.keep_first(df, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("group_size_flag", """SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_same,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate_key FROM lineitem""")
def group_size_flag(spark, d):
    df = rel.with_group_size(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "n_same")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "n_same", (F.col("n_same") > 1).alias("duplicate_key"))


@query("dominant_key", """SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1""")
def dominant_key(spark, d):
    return rel.dominant(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("modal_bridge", """WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT l_partkey, l_suppkey AS modal_l_suppkey FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1)
SELECT a.*, modal_l_suppkey, greatest(n_l_suppkey, n_l_returnflag) > 1 AS ambiguous FROM (
  SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_returnflag) AS n_l_returnflag,
    round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY 1) a JOIN m USING (l_partkey)""")
def modal_bridge(spark, d):
    return rel.bridge(table(spark, d, "lineitem"), "l_partkey", ["l_suppkey"], ["l_suppkey", "l_returnflag"], ["l_quantity"])


@query("left_star_join", """SELECT c_custkey, n_name, r_name, coalesce(n_orders, 0) AS n_orders, coalesce(total, 0) AS total
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def left_star_join(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(orders, c.c_custkey == orders.o_custkey, "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("anti_zero_supply", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def anti_zero_supply(spark, d):
    supply = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.zero_supply(table(spark, d, "customer"), supply, "c_custkey").select("c_custkey", "c_name")


@query("semi_scope", """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey < 2)""")
def semi_scope(spark, d):
    n = table(spark, d, "nation")
    df = table(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey).select("c_custkey", "n_name")
    return rel.semi_scope(df, n.where("n_regionkey < 2").select(F.concat(F.lit(" "), F.lower("n_name")).alias("n_name")), ["n_name"])


@query("anti_then_union_defaults", """SELECT r.r_name || '/' || s.seg AS cohort, count(c_custkey) AS observed FROM region r CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer UNION ALL SELECT 'NONE') s
 LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.seg GROUP BY 1""")
def anti_then_union_defaults(spark, d):
    """Cohorts without any record join those with, counts 0."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    name = lambda seg: F.concat_ws("/", "r_name", seg).alias("cohort")
    placed = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    some = placed.groupBy(name("c_mktsegment")).agg(F.count("*").alias("observed"))
    segments = c.select("c_mktsegment").distinct().unionByName(spark.createDataFrame([("NONE",)], "c_mktsegment string"))
    every = r.crossJoin(F.broadcast(segments)).select(name("c_mktsegment"))  # as many rows as regions and segments
    return some.unionByName(rel.zero_supply(every, some, "cohort"), allowMissingColumns=True).fillna(0, ["observed"])


@query("coalesce_override_join", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier""")
def coalesce_override_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    better = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.round(F.col("s_acctbal") * 2, 2)).alias("s_acctbal"))
    return rel.override(s, better, "s_suppkey", ["s_acctbal"])


@query("conditional_counts", """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(*) FILTER (o_totalprice > 200000) AS n_large,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS n_final_rate FROM orders GROUP BY 1""")
def conditional_counts(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large")
    )
    return rel.rates(out, ["n_final"], "n")


@query("many_measure_agg", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, round(sum(l_quantity), 2) AS quantity,
  round(avg(l_extendedprice), 4) AS mean_price, round(median(l_extendedprice), 4) AS median_price, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95_price,
  max(l_discount) AS max_discount, round(count(*) FILTER (l_discount > .05) / count(*), 6) AS discounted_rate FROM lineitem GROUP BY 1, 2""")
def many_measure_agg(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, d, "lineitem").select(*keys, "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    measures = lines.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.max("l_discount").alias("max_discount"),
        F.round(stats.share(F.count_if(F.col("l_discount") > 0.05), F.count("*")), 6).alias("discounted_rate"),
    )
    q = stats.quantiles(lines, keys, "l_extendedprice", (0.5, 0.95))
    return measures.join(q.select(*keys, F.round(F.col("q")[0], 4).alias("median_price"), F.round(F.col("q")[1], 4).alias("p95_price")), keys)


@query("distinct_sample", """SELECT c_nationkey, substr(string_agg(c_mktsegment, '; ' ORDER BY o), 1, 40) AS sample FROM (
  SELECT c_nationkey, c_mktsegment, min(c_custkey) AS o FROM customer GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey)) <= 4) GROUP BY 1""")
def distinct_sample(spark, d):
    return rel.distinct_sample(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey", 4, 40)


@query("first_non_null", """SELECT source, min(quality) AS quality, min(lang) AS lang, count(*) AS n, count(quality) AS n_labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def first_non_null(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(
        F.min("quality").alias("quality"), F.min("lang").alias("lang"), F.count("*").alias("n"), F.count("quality").alias("n_labelled")
    )


@query("unmatched_groups", """SELECT lang, source, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL GROUP BY 1, 2""")
def unmatched_groups(spark, d):
    labels = table(spark, d, "labels").select("doc_id")
    return rel.value_counts(table(spark, d, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left_anti"), ["lang", "source"])


@query("cohort_stats", """SELECT lang, source, count(*) AS n, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.9), 6) AS p90
FROM documents GROUP BY 1, 2 HAVING count(*) >= 5""")
def cohort_stats(spark, d):
    df = table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("double"))
    out = rel.cohort_stats(df, "n_chars", ["lang", "source"], 5)
    return out.select("lang", "source", "n", *(F.round(c, 6).alias(c) for c in ("median", "p10", "p90")))


@query("pct_rank_ties", """SELECT c_custkey, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER (), 9) AS pct
FROM (SELECT c_custkey, round(c_acctbal / 100) AS v FROM customer)""")
def pct_rank_ties(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 100).alias("v"))
    return stats.pct_rank(df, "v", "pct").select("c_custkey", F.round("pct", 9).alias("pct"))


@query("wide_to_long_ranked", """SELECT district, measure, value, CAST(row_number() OVER (PARTITION BY district ORDER BY value DESC, measure) AS BIGINT) AS rank FROM (
  UNPIVOT (SELECT district, trusted_n, review_n, contradicted_n, critical_n FROM {regions} r) ON trusted_n, review_n, contradicted_n, critical_n INTO NAME measure VALUE value)""")
def wide_to_long_ranked(spark, d):
    long = rel.unpivot(regions(spark, d), ["district"], ["trusted_n", "review_n", "contradicted_n", "critical_n"], "measure", "value")
    return rel.rank_within(long, ["district"], [F.desc("value"), F.asc("measure")], "rank")


@query("demoting_rank", """SELECT state, district, critical_n, CAST(row_number() OVER (PARTITION BY state ORDER BY CASE WHEN contradicted_n > 7 THEN 1 ELSE 0 END, critical_n DESC, district) AS BIGINT) AS rank FROM {regions} r""")
def demoting_rank(spark, d):
    flagged = F.when(F.col("contradicted_n") > 7, 1).otherwise(0)
    return rel.rank_within(regions(spark, d), ["state"], [flagged, F.desc("critical_n"), F.asc("district")], "rank").select("state", "district", "critical_n", "rank")


@query("queue_top_k", """SELECT c_custkey, score, CAST(row_number() OVER (ORDER BY score DESC, c_custkey) AS BIGINT) AS queue_rank FROM (
  SELECT c_custkey, round(c_acctbal / 1000 + c_custkey % 7, 3) AS score FROM customer) ORDER BY score DESC, c_custkey LIMIT 250""")
def queue_top_k(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 1000 + F.col("c_custkey") % 7, 3).alias("score"))
    return rel.top(df, [F.desc("score"), F.asc("c_custkey")], 250, "queue_rank")


@query("four_rankings", """SELECT * FROM (
SELECT 'critical' AS ranking, district, critical_n AS value FROM {regions} r ORDER BY critical_n DESC, district LIMIT 5) UNION ALL SELECT * FROM (
SELECT 'review' AS ranking, district, review_n AS value FROM {regions} r ORDER BY review_n DESC, district LIMIT 5) UNION ALL SELECT * FROM (
SELECT 'contradicted' AS ranking, district, contradicted_n AS value FROM {regions} r ORDER BY contradicted_n DESC, district LIMIT 5) UNION ALL SELECT * FROM (
SELECT 'trusted' AS ranking, district, trusted_n AS value FROM {regions} r ORDER BY trusted_n DESC, district LIMIT 5)""")
def four_rankings(spark, d):
    r = regions(spark, d)
    out = None
    for name in ("critical", "review", "contradicted", "trusted"):
        part = rel.top(r.select(F.lit(name).alias("ranking"), "district", F.col(f"{name}_n").alias("value")), [F.desc("value"), F.asc("district")], 5)
        out = part if out is None else out.unionByName(part)
    return out


@query("nulls_last_sort_cap", """SELECT entity_id, kind, capacity, doctors FROM {entities} e ORDER BY capacity DESC NULLS LAST, doctors DESC NULLS LAST, readiness DESC, entity_id LIMIT 200""")
def nulls_last_sort_cap(spark, d):
    order = [F.desc_nulls_last("capacity"), F.desc_nulls_last("doctors"), F.desc("readiness"), F.asc("entity_id")]
    return rel.top(entities(spark, d), order, 200).select("entity_id", "kind", "capacity", "doctors")


@query("canonical_member", """SELECT kind, district, entity_id FROM {entities} e QUALIFY row_number() OVER (PARTITION BY kind, district ORDER BY trusted DESC, sources DESC, readiness DESC, entity_id) = 1""")
def canonical_member(spark, d):
    return rel.keep_first(entities(spark, d), ["kind", "district"], [F.desc("trusted"), F.desc("sources"), F.desc("readiness"), F.asc("entity_id")]).select("kind", "district", "entity_id")


@query("worst_district", """SELECT state, arg_max(district, critical_n * 1000 - district_key) AS worst, max(critical_n) AS critical_n, count(*) FILTER (critical_n > 30) AS n_critical FROM {regions} r GROUP BY 1""")
def worst_district(spark, d):
    return regions(spark, d).groupBy("state").agg(
        F.max_by("district", F.col("critical_n") * 1000 - F.col("district_key")).alias("worst"), F.max("critical_n").alias("critical_n"),
        F.count_if(F.col("critical_n") > 30).alias("n_critical"),
    )


@query("reasons_exploded", """SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contradicted THEN 'contradicted' END, CASE WHEN needs_review THEN 'review' END,
  CASE WHEN coalesce(has_contact, false) THEN NULL ELSE 'no_contact' END], lambda x: x IS NOT NULL)) AS reason FROM {entities} e) GROUP BY 1""")
def reasons_exploded(spark, d):
    flags = {"contradicted": F.col("contradicted"), "review": F.col("needs_review"), "no_contact": ~F.coalesce("has_contact", F.lit(False))}
    return rel.explode_counts(entities(spark, d), text.codes(flags), "reason")


@query("log_latest_upsert", """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def log_latest_upsert(spark, d):
    return io.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("log_tombstones", """SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""")
def log_tombstones(spark, d):
    return io.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("log_union_dedup", """SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def log_union_dedup(spark, d):
    """Two logs that overlap and hold all events together: the newest row of each key once."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return io.union_logs(e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0"), key=["user_id", "event_type"], order="event_id")


@query("toggle_membership", """SELECT user_id, count(*) AS n_toggles, count(*) % 2 = 1 AS listed FROM events WHERE event_type = 'click' GROUP BY 1""")
def toggle_membership(spark, d):
    clicks = table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n_toggles"))
    return clicks.withColumn("listed", F.col("n_toggles") % 2 == 1)


@query("log_proposals", """WITH c AS (SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click' AND value > 50) AS strong, count(*) FILTER (regexp_matches(props, '"k": 9')) AS nines FROM events)
SELECT * FROM (SELECT 'review_errors' AS proposal, errors AS support FROM c WHERE errors >= 3 UNION ALL SELECT 'raise_weight', strong FROM c WHERE strong >= 2 UNION ALL SELECT 'inspect_nines', nines FROM c WHERE nines >= 2)""")
def log_proposals(spark, d):
    c = table(spark, d, "events").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 50)).alias("strong"),
        F.count_if(F.col("props").rlike('"k": 9')).alias("nines"),
    )
    rules = [("review_errors", "errors", 3), ("raise_weight", "strong", 2), ("inspect_nines", "nines", 2)]
    found = F.array(*(F.when(F.col(c_) >= n, F.struct(F.lit(p).alias("proposal"), F.col(c_).alias("support"))) for p, c_, n in rules))
    return c.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("p.*")


@query("metadata_index", """SELECT k AS lookup_key, max(s_suppkey) AS s_suppkey FROM (SELECT s_suppkey, unnest(list_distinct([regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), CAST(s_nationkey AS VARCHAR)])) AS k FROM supplier) GROUP BY 1""")
def metadata_index(spark, d):
    return io.metadata_index(table(spark, d, "supplier"), ["s_name", "s_nationkey"], "s_suppkey").select("lookup_key", "s_suppkey")


@query("policy_agreement", """SELECT b AS boost, round(avg(CASE WHEN others > own + b THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n_groups FROM (
  SELECT o_custkey, max(CASE WHEN o_orderpriority <> '5-LOW' THEN s END) AS others, max(CASE WHEN o_orderpriority = '5-LOW' THEN s END) AS own
  FROM (SELECT *, o_totalprice / 1000000 AS s FROM orders) GROUP BY 1) CROSS JOIN (SELECT 0.33 AS b UNION ALL SELECT 0.10) WHERE others IS NOT NULL AND own IS NOT NULL GROUP BY 1""")
def policy_agreement(spark, d):
    """How often one option is not on top, under two versions of a boost."""
    df = table(spark, d, "orders").withColumn("s", F.col("o_totalprice") / 1000000)
    both = df.groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "5-LOW").alias("a"), F.count("*").alias("b")).where("a > 0 and a < b")
    df = df.join(both.select("o_custkey"), "o_custkey", "left_semi")
    out = None
    for boost in (0.33, 0.10):
        part = rel.threshold_share(df, "o_custkey", "o_orderpriority", "s", "5-LOW", boost).withColumn("boost", F.lit(boost))
        out = part if out is None else out.unionByName(part)
    return out
