"""Queries of matching, imputation, profiles, audits and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators import claims, decide, impute, matching, profile, remediate, scores, serve
from meridia.operators import relational as rel
from meridia.plans.base import entities, query, regions, table
from meridia.plans.score_queries import PLACED, PLANNED, cohort_sql, placed, scored

# ------------------------------------------------------------------- matching


@query("exact_then_fuzzy_join", """WITH w AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE n_name || 'X' END AS n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT w.n_regionkey, w.n_name, n_nationkey, round(1 - levenshtein(w.n_name, n.n_name) / greatest(length(w.n_name), length(n.n_name), 1), 6) AS s,
  row_number() OVER (PARTITION BY w.n_regionkey, w.n_name ORDER BY round(1 - levenshtein(w.n_name, n.n_name) / greatest(length(w.n_name), length(n.n_name), 1), 6) DESC, n.n_name) AS k FROM w JOIN nation n USING (n_regionkey))
SELECT n_regionkey, n_name, CASE WHEN s >= .88 THEN n_nationkey END AS match_id, s AS score, s >= .88 AS matched FROM c WHERE k = 1""")
def exact_then_fuzzy_join(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey)
    wanted = s.select("n_regionkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("X"))).alias("n_name"))
    return matching.fuzzy_join(wanted, n, "n_regionkey", "n_name", "n_nationkey", 0.88)


@query("fuzzy_join_sequence_ratio")
def fuzzy_join_sequence_ratio(spark, d):
    """The same with the order-sensitive sequence ratio, in Arrow batches over distinct names."""
    n = table(spark, d, "nation")
    wanted = n.select("n_regionkey", F.concat("n_name", F.lit(" district")).alias("n_name"))
    return matching.fuzzy_join(wanted, n, "n_regionkey", "n_name", "n_nationkey", 0.6, matching.sequence_ratio)


_BLOCKS = """SELECT s_suppkey AS id, unnest(['nation:' || s_nationkey, 'money:' || CAST(floor(s_acctbal / 500) AS BIGINT)]) AS block FROM supplier"""


def _supplier_blocks():
    return matching.block_keys({"nation": F.col("s_nationkey").cast("string"), "money": F.floor(F.col("s_acctbal") / 500).cast("string")})


@query("blocked_pairs", f"""WITH b AS ({_BLOCKS}), k AS (SELECT block FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 250)
SELECT l.id AS left, r.id AS right, list_sort(list(DISTINCT split_part(block, ':', 1))) AS methods FROM b l JOIN k USING (block) JOIN b r USING (block) WHERE l.id < r.id GROUP BY 1, 2""")
def blocked_pairs(spark, d):
    return matching.blocked_pairs(table(spark, d, "supplier"), "s_suppkey", _supplier_blocks())


@query("block_report", f"""SELECT count(*) AS n_blocks, count(*) FILTER (n BETWEEN 2 AND 5) AS n_used, count(*) FILTER (n > 5) AS n_too_large, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n BETWEEN 2 AND 5), 0) AS BIGINT) AS n_mentions
FROM (SELECT block, count(*) AS n FROM ({_BLOCKS}) GROUP BY 1)""")
def block_report(spark, d):
    return matching.block_report(table(spark, d, "supplier"), _supplier_blocks(), 5)


@query("shared_contacts", r"""WITH c AS (SELECT doc_id AS id, lower(unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1))) AS contact FROM documents UNION
 SELECT -entity_id, CASE WHEN entity_id % 7 = 0 THEN 'info@registry.example' ELSE 'desk' || entity_id // 3 || '@clinic.example' END FROM {entities} e)
SELECT id, contact FROM c WHERE contact IN (SELECT contact FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)""")
def shared_contacts(spark, d):
    """Mail addresses in texts and of records that a few share; one that many share says nothing."""
    k = F.col("entity_id")
    mail = F.when(k % 7 == 0, "Write to Info@registry.example").otherwise(F.concat(F.lit("Desk"), F.floor(k / 3).cast("string"), F.lit("@clinic.example")))
    told = table(spark, d, "documents").select("doc_id", "text").unionByName(entities(spark, d).select((-k).alias("doc_id"), mail.alias("text")))
    return matching.shared_contacts(told, "doc_id", text.emails(F.col("text")))


def _pairs(spark, d):
    """Suppliers of one nation and money block, with similarities of names, balances as addresses and derived signals."""
    s = table(spark, d, "supplier")
    pairs = matching.blocked_pairs(s, "s_suppkey", _supplier_blocks())
    side = lambda k: s.select(F.col("s_suppkey").alias(k), F.col("s_name").alias(f"{k}_name"), F.col("s_nationkey").alias(f"{k}_nation"), F.col("s_acctbal").alias(f"{k}_money"))
    p = pairs.join(side("left"), "left").join(side("right"), "right")
    return p.select(
        "left", "right", text.edit_similarity(F.col("left_name"), F.col("right_name")).alias("name"),
        stats.round_scaled(1 - F.least(F.abs(F.col("left_money") - F.col("right_money")) / 1000, F.lit(1.0)), 3).alias("address"), ((F.col("left") + F.col("right")) % 7 == 0).alias("phone"),
        ((F.col("left") + F.col("right")) % 11 == 0).alias("mail"), (F.col("left_nation") == F.col("right_nation")).alias("pin"),
        (F.floor(F.col("left_money") / 500) == F.floor(F.col("right_money") / 500)).alias("city"), F.when((F.col("left") * F.col("right")) % 3 != 0, ((F.col("left") + F.col("right")) % 30) / 3.0).alias("km"),
    )


PAIRS = f"""SELECT p.*, round(1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name), 1), 3) AS name, round(1 - least(abs(a.s_acctbal - b.s_acctbal) / 1000, 1), 3) AS address, (l + r) % 7 = 0 AS phone,
  (l + r) % 11 = 0 AS mail, a.s_nationkey = b.s_nationkey AS pin, floor(a.s_acctbal / 500) = floor(b.s_acctbal / 500) AS city, CASE WHEN (l * r) % 3 <> 0 THEN ((l + r) % 30) / 3.0 END AS km
FROM (WITH b AS ({_BLOCKS}), k AS (SELECT block FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 250) SELECT DISTINCT x.id AS l, y.id AS r FROM b x JOIN k USING (block) JOIN b y USING (block) WHERE x.id < y.id) p
JOIN supplier a ON l = a.s_suppkey JOIN supplier b ON r = b.s_suppkey"""
_SIGNS = ("name", "address", "phone", "mail", "pin", "city", "km")
_TIER = """CASE WHEN (phone AND mail AND name >= .70 AND (address >= .82 OR n05 OR (close AND address >= .45))) OR (mail AND name >= .80 AND (address >= .82 OR n05 OR (close AND address >= .45)))
 OR (phone AND name >= .84 AND (address >= .82 OR n05 OR (close AND address >= .50))) OR (name >= .94 AND address >= .82 AND local) OR (name >= .92 AND n02 AND (address >= .50 OR pin OR city)) THEN 1
 WHEN ((phone OR mail) AND name >= .70 AND (address >= .35 OR pin OR city OR n10)) OR (name >= .88 AND address >= .65 AND local) OR (name >= .86 AND n05 AND (pin OR city OR address >= .45)) OR (name >= .88 AND pin AND address >= .55) THEN 2
 WHEN (name >= .78 AND address >= .50 AND (pin OR city)) OR (name >= .80 AND n1) OR ((phone OR mail) AND name >= .55 AND address >= .30) THEN 3 END"""
TIERED = f"""SELECT *, {_TIER} AS tier, round(least(1, .42 * name + .24 * address + .12 * phone::INT + .12 * mail::INT + .04 * pin::INT + .03 * city::INT + .03 * CASE WHEN km <= .2 THEN 1 WHEN km <= 1 THEN .85 WHEN km <= 5 THEN .65 WHEN km <= 10 THEN .4 ELSE 0 END), 6) AS score
FROM (SELECT *, pin OR city OR coalesce(km <= 5, false) AS local, pin OR city OR coalesce(km <= 1, false) AS close, coalesce(km <= .2, false) AS n02, coalesce(km <= .5, false) AS n05, coalesce(km <= 1, false) AS n1, coalesce(km <= 10, false) AS n10 FROM ({PAIRS}))"""


def _tiered(spark, d):
    return _pairs(spark, d).withColumn("tier", matching.pair_tier(*map(F.col, _SIGNS))).withColumn("score", matching.pair_score(*map(F.col, _SIGNS)))


@query("pair_tiers", f"SELECT l AS left, r AS right, tier, score FROM ({TIERED}) WHERE tier IS NOT NULL")
def pair_tiers(spark, d):
    return _tiered(spark, d).where("tier is not null").select("left", "right", "tier", "score")


@query("duplicate_clusters", """WITH RECURSIVE e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id), walk AS (SELECT x, y FROM e UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x)
SELECT x AS node, least(x, min(y)) AS cluster FROM walk GROUP BY x""")
def duplicate_clusters(spark, d):
    """Clusters of documents of equal text, from a chain of links between neighbours in each group."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("left"))
    edges = docs.join(first, "digest").where("doc_id <> left").select("left", F.col("doc_id").alias("right"))
    return matching.clusters(edges)


@query("cluster_support", """WITH l AS (SELECT c_custkey AS a, (c_custkey // 3) * 3 AS b, c_acctbal AS s FROM customer WHERE c_custkey % 3 <> 0) SELECT b AS cluster, count(*) + 1 AS n_members, count(*) AS n_links, round(min(s), 6) AS least_score, round(avg(s), 6) AS mean_score FROM l GROUP BY 1""")
def cluster_support(spark, d):
    edges = table(spark, d, "customer").where("c_custkey % 3 <> 0").select((F.floor(F.col("c_custkey") / 3) * 3).alias("left"), F.col("c_custkey").alias("right"), F.col("c_acctbal").alias("s"))
    labels = matching.clusters(edges.select("left", "right"))
    return matching.cluster_support(labels, edges, "s")


# ------------------------------------------------------------------- imputation and models

@query("hierarchical_impute", f"SELECT entity_id, round(estimate, 4) AS estimate, round(low, 4) AS low, round(high, 4) AS high, level, confidence FROM ({cohort_sql('capacity')})")
def hierarchical_impute(spark, d):
    out = impute.hierarchical(entities(spark, d), "capacity", ~F.col("capacity_outlier"))
    return out.select("entity_id", *(F.round(c, 4).alias(c) for c in ("estimate", "low", "high")), "level", "confidence")


@query("imputer_regression")
def imputer_regression(spark, d):
    """Out-of-fold error of boosted trees against the median of the training folds."""
    parts = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double")).select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    oof = rel.pinned(impute.out_of_fold(parts, "p_partkey", "p_retailprice", ["p_brand", "p_type"], ["p_size"]))
    a = impute.regression_metrics(oof, "p_retailprice", "predicted").withColumn("model", F.lit("boosted_trees"))
    return a.unionByName(impute.regression_metrics(oof, "p_retailprice", "baseline").withColumn("model", F.lit("fold_median")))


@query("calibrated_classifier")
def calibrated_classifier(spark, d):
    e = entities(spark, d).select("entity_id", "kind", "operator", F.col("sources").cast("double").alias("sources"), "km", F.col("gaps").cast("double").alias("gaps"), F.col("trusted").cast("int").alias("label"))
    out = impute.fit_classifier(e, "entity_id", "label", ["kind", "operator"], ["sources", "km", "gaps"])
    return impute.classification_metrics(out, "label", "score")


@query("regression_metrics", """SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / sum(pow(y - m, 2)), 6) AS r2, round(median(abs(e)), 6) AS median_ae
FROM (SELECT p_retailprice AS y, p_retailprice - (900 + p_partkey % 1000) AS e, avg(p_retailprice) OVER () AS m FROM part)""")
def regression_metrics(spark, d):
    p = table(spark, d, "part").select("p_retailprice", (900.0 + F.col("p_partkey") % 1000).alias("guess"))
    return impute.regression_metrics(p, "p_retailprice", "guess")


@query("classification_metrics", """SELECT count(*) AS n, round(avg((h = y)::INT), 6) AS accuracy, round(sum(h * y) / sum(h), 6) AS precision, round(sum(h * y) / sum(y), 6) AS recall, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss,
 round(avg(pow(y - p, 2)), 6) AS brier, round(avg((greatest(p, 1 - p) >= .8)::INT), 6) AS coverage_80 FROM (SELECT trusted::INT AS y, (readiness >= .5)::INT AS h, greatest(1e-6, least(1 - 1e-6, readiness)) AS p FROM {entities} e)""")
def classification_metrics(spark, d):
    return impute.classification_metrics(entities(spark, d), "trusted", "readiness")


# ------------------------------------------------------------------- profiles and audits


@query("quality_profile", """SELECT 'o_totalprice' AS column, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS least, quantile_cont(x, .25) AS p25, median(x) AS median, quantile_cont(x, .75) AS p75, quantile_cont(x, .95) AS p95, max(x) AS most,
 round(avg(pow((x - m) / s, 3)), 4) AS skew, round(avg(pow((x - m) / s, 4)) - 3, 4) AS kurtosis FROM (SELECT o_totalprice AS x, avg(o_totalprice) OVER () AS m, stddev_pop(o_totalprice) OVER () AS s FROM orders)""")
def quality_profile(spark, d):
    return profile.distribution(table(spark, d, "orders"), ["o_totalprice"])


def _coverage_sql(c):
    ci = lambda s: f"round((x / n + 1.9208 / n {s} 1.96 * sqrt(x / n * (1 - x / n) / n + .9604 / (n * n))) / (1 + 3.8416 / n), 6)"
    return f"SELECT '{c}' AS column, x::BIGINT AS filled, n::BIGINT AS n, round(x / n, 6) AS share, greatest(0, {ci('-')}) AS low, least(1, {ci('+')}) AS high FROM (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (coalesce(trim({c}::VARCHAR), '') <> ''))::DOUBLE AS x FROM {{entities}} e)"


@query("coverage_profile", " UNION ALL ".join(_coverage_sql(c) for c in ("operator", "capacity", "doctors", "has_contact")))
def coverage_profile(spark, d):
    return profile.coverage(entities(spark, d), ["operator", "capacity", "doctors", "has_contact"])


@query("data_dictionary", """SELECT * FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double')) t("column", "type"), (SELECT count(*) AS filled FROM supplier)""")
def data_dictionary(spark, d):
    return profile.dictionary(table(spark, d, "supplier"))


@query("category_shares", """SELECT 'operator' AS column, category, x, n, round(x / n, 6) AS share, round((x / n + 1.9208 / n - 1.96 * sqrt(x / n * (1 - x / n) / n + .9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low,
 round((x / n + 1.9208 / n + 1.96 * sqrt(x / n * (1 - x / n) / n + .9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high, round((x + .5) / (n + 1), 6) AS jeffreys FROM (SELECT coalesce(operator, 'missing') AS category, count(*) AS x, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM {entities} e GROUP BY 1)""")
def category_shares(spark, d):
    return profile.category_shares(entities(spark, d), "operator")


@query("flag_shares", """SELECT flag, x, n, round(x / n, 6) AS share FROM (SELECT count(*) AS n, count(*) FILTER (contradicted) AS c, count(*) FILTER (needs_review) AS r, count(*) FILTER (has_contact) AS h FROM {entities} e) t,
 LATERAL (SELECT 'contradicted' AS flag, c AS x UNION ALL SELECT 'needs_review', r UNION ALL SELECT 'has_contact', h)""")
def flag_shares(spark, d):
    return profile.flag_shares(entities(spark, d), {c: F.col(c) for c in ("contradicted", "needs_review", "has_contact")})


@query("audit_expectations", """SELECT 'lineitem' AS table, check_name AS check, severity, failed, failed = 0 AS passed FROM (SELECT count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1)) AS a, count(*) FILTER (l_quantity <= 0) AS b, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS c FROM lineitem) t,
 LATERAL (SELECT 'discount in [0, 1]' AS check_name, 'error' AS severity, a AS failed UNION ALL SELECT 'quantity above 0', 'error', b UNION ALL SELECT 'shipped since 1998', 'warning', c)""")
def audit_expectations(spark, d):
    return profile.expectations(
        table(spark, d, "lineitem"), "lineitem",
        {"discount in [0, 1]": (F.col("l_discount").between(0, 1), "error"), "quantity above 0": (F.col("l_quantity") > 0, "error"),
         "shipped since 1998": (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"), "warning")},
    )


@query("boolean_masks", """SELECT count(*) FILTER (l_discount >= .09) AS deep_discount, count(*) FILTER (l_quantity > 45 OR l_extendedprice > 90000) AS extreme, count(*) FILTER (l_returnflag = 'R' AND l_tax = 0) AS returned_untaxed,
 count(*) FILTER (NOT (l_discount >= .09 OR l_quantity > 45 OR l_extendedprice > 90000 OR (l_returnflag = 'R' AND l_tax = 0))) AS low_risk FROM lineitem""")
def boolean_masks(spark, d):
    masks = {
        "deep_discount": F.col("l_discount") >= 0.09, "extreme": (F.col("l_quantity") > 45) | (F.col("l_extendedprice") > 90000),
        "returned_untaxed": (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0),
    }
    sound = ~(masks["deep_discount"] | masks["extreme"] | masks["returned_untaxed"])
    return table(spark, d, "lineitem").agg(*(F.count_if(c).alias(k) for k, c in masks.items()), F.count_if(sound).alias("low_risk"))


@query("volume_report", """SELECT 'documents' AS table, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys FROM documents UNION ALL SELECT 'pages', count(*), count(DISTINCT page_id) FROM pages UNION ALL SELECT 'events', count(*), count(DISTINCT event_id) FROM events""")
def volume_report(spark, d):
    out = None
    for t, k in (("documents", "doc_id"), ("pages", "page_id"), ("events", "event_id")):
        part = table(spark, d, t).agg(F.lit(t).alias("table"), F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"))
        out = part if out is None else out.unionByName(part)
    return out


@query("missingness", """SELECT field, count(*) FILTER (status = 'observed') AS observed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'outlier') AS outlier FROM (
 SELECT 'capacity' AS field, CASE WHEN capacity_outlier THEN 'outlier' WHEN capacity IS NULL THEN 'missing' ELSE 'observed' END AS status FROM {entities} e UNION ALL SELECT 'doctors', CASE WHEN doctors_outlier THEN 'outlier' WHEN doctors IS NULL THEN 'missing' ELSE 'observed' END FROM {entities} e) GROUP BY 1""")
def missingness(spark, d):
    status = lambda c: F.when(F.col(f"{c}_outlier"), "outlier").when(F.col(c).isNull(), "missing").otherwise("observed")
    long = entities(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), status(c).alias("status")) for c in ("capacity", "doctors")))).alias("s")).select("s.*")
    return long.groupBy("field").agg(*(F.count_if(F.col("status") == k).alias(k) for k in ("observed", "missing", "outlier")))


# ------------------------------------------------------------------- decisions


def _rates(spark, d):
    r = scores.planning_category(scored(spark, d))
    share = lambda c: stats.share(F.col(c), F.col("observed"))
    return r.withColumns(
        {"trust": share("trusted_n"), "review": share("review_n"), "critical": share("critical_n"), "contact": share("contact_n"), "source": share("source_n"), "maternity": share("maternity_n"),
         "chronic": share("chronic_n"), "diagnostic": share("diagnostic_n"), "capacity_rate": share("capacity_n"), "level": F.col("uncertainty")}
    )


_WRONG = """greatest(.05, least(.85, CASE uncertainty WHEN 'lower' THEN .12 WHEN 'medium' THEN .25 ELSE .42 END + CASE WHEN observed < 8 THEN .15 ELSE 0 END + CASE WHEN review_n / observed >= .85 THEN .12 ELSE 0 END
 + CASE WHEN critical_n / observed >= .75 THEN .08 ELSE 0 END + CASE WHEN 2 * 1.96 * sqrt(trusted_n / observed * (1 - trusted_n / observed) / observed + .9604 / (observed * observed)) / (1 + 3.8416 / observed) >= .5 THEN .06 ELSE 0 END))"""


@query("ev_recommender", f"""WITH r AS (SELECT *, trusted_n / observed AS trust, review_n / observed AS review, critical_n / observed AS critical, contact_n / observed AS contact, source_n / observed AS source, capacity_n / observed AS cap, maternity_n / observed AS mat,
  greatest(chronic_n, diagnostic_n) / observed AS signal, coalesce(anaemia, 0) / 100 AS ana, pressure / 100 AS bp, sugar / 100 AS sug, coalesce(1 - insurance / 100, 0) AS ins_gap, births / 100 AS bir, {_WRONG} AS pw,
  category IN ('phantom_desert_or_verification_gap', 'supply_record_quality_problem') AS fits FROM (SELECT *, CAST(observed AS DOUBLE) AS obs FROM ({PLANNED}))),
g AS (SELECT *, review >= .7 OR uncertainty = 'higher' AS shaky, .6 * (1 - trust) + .4 * (1 - cap) AS g1, .5 * (1 - bir) + .3 * ana + .2 * (1 - mat) AS g2, .4 * bp + .4 * sug + .2 * (1 - signal) AS g3, ins_gap AS g4, .5 * review + .4 * (1 - contact) + .1 * (1 - source) AS g5,
  (.5 * review + .5 * critical) * CASE WHEN fits OR review >= .9 THEN 1 ELSE .45 END AS g6, 1 - trust AS g7 FROM r),
o AS (SELECT district, need, pw, 'mobile_clinic' AS option, g1 AS gap, least(.95, .35 + .4 * g1 + CASE WHEN category = 'real_desert_candidate' THEN .2 ELSE 0 END) AS p, .55 AS cost, .60 AS harm, false AS flagged FROM g
  UNION ALL SELECT district, need, pw, 'maternal_outreach', g2, least(.95, .3 + .5 * g2), .42, .45, false FROM g UNION ALL SELECT district, need, pw, 'chronic_care', g3, least(.95, .3 + .5 * g3), .22, .30, false FROM g
  UNION ALL SELECT district, need, pw, 'insurance', g4, least(.95, .25 + .55 * g4 + CASE WHEN category = 'referral_or_capacity_candidate' THEN .15 ELSE 0 END), .18, .25, false FROM g
  UNION ALL SELECT district, need, pw, 'contact_outreach', g5, least(.95, .3 + .45 * g5), .30, .25, false FROM g
  UNION ALL SELECT district, need, pw, 'verify_first', g6, least(.95, .35 + .45 * g6 + CASE WHEN fits THEN .15 ELSE 0 END), .12, .10, false FROM g UNION ALL SELECT district, need, pw, 'telehealth', g7, least(.7, .18 + .25 * g7), .20, .40, shaky FROM g),
e AS (SELECT district, option, flagged, p, cost, harm, least(.95, pw + CASE WHEN flagged THEN .15 ELSE 0 END) AS pw, 1.6 * least(1, .35 + .65 * coalesce(need, .5)) * least(1, .3 + .7 * gap) AS b FROM o),
f AS (SELECT district, option, flagged, round(CAST(p * b - .6 * pw * harm - .6 * cost AS DECIMAL(24, 8)), 4)::DOUBLE AS ev, round(CAST(greatest(0, least(100, 62.5 * p * b * (1 - .5 * pw))) AS DECIMAL(24, 8)), 4)::DOUBLE AS gain,
  CASE WHEN round(pw, 9) >= .5 OR round(p, 9) < .35 OR flagged THEN 'Low' WHEN round(pw, 9) <= .22 AND round(p, 9) >= .55 THEN 'High' ELSE 'Medium' END AS confidence FROM e)
SELECT *, CAST(row_number() OVER (PARTITION BY district ORDER BY (flagged OR option = 'telehealth')::INT, ev DESC, option) AS BIGINT) AS rank FROM f""")
def ev_recommender(spark, d):
    r = _rates(spark, d)
    c = {k: F.col(k) for k in ("trust", "review", "critical", "contact", "source", "maternity", "chronic", "diagnostic", "capacity_rate", "level")}
    c |= {k: F.col(k) / 100 for k in ("anaemia", "pressure", "sugar", "insurance", "births")}
    category = F.col("category")
    c |= {"verify_fits": category.isin("phantom_desert_or_verification_gap", "supply_record_quality_problem"), "deploy_fits": category == "real_desert_candidate", "refer_fits": category == "referral_or_capacity_candidate"}
    ci = stats.wilson(F.col("trusted_n"), F.col("observed"))
    pw = decide.wrong_chance(c["level"], F.col("observed"), c["review"], c["critical"], ci["high"] - ci["low"])
    return decide.recommend(r, "district", F.col("need"), decide.candidates(c), pw)


@query("wrong_chance", f"SELECT district, round({_WRONG}, 6) AS p_wrong FROM ({PLANNED})")
def wrong_chance(spark, d):
    ci = stats.wilson(F.col("trusted_n"), F.col("observed"))
    wrong = decide.wrong_chance(F.col("level"), F.col("observed"), F.col("review"), F.col("critical"), ci["high"] - ci["low"])
    return _rates(spark, d).select("district", F.round(wrong, 6).alias("p_wrong"))


@query("whatif_comparison", f"""WITH b AS (SELECT district, least(1, greatest(0, need * (1 - trusted_n / observed))) AS f, trusted_n / observed AS t FROM ({PLANNED})),
o AS (SELECT district, 'mobile_clinic' AS option, least(1, f * 1.4) AS s, 2 AS cost FROM b UNION ALL SELECT district, 'new_capacity', f * .90 * .9, 3 FROM b UNION ALL SELECT district, 'telehealth', f * .35 * .58 * (.5 + .5 * t), 1 FROM b UNION ALL
 SELECT district, 'transport_vouchers', f * .55 * (.4 + .6 * t), 1 FROM b UNION ALL SELECT district, 'pharmacy_screening', f * .50 * .8, 1 FROM b),
u AS (SELECT district, option, round(CAST(s AS DECIMAL(24, 8)), 3)::DOUBLE AS score, CAST(cost AS BIGINT) AS cost FROM o)
SELECT *, CASE WHEN score >= .55 THEN 'High' WHEN score >= .30 THEN 'Medium' ELSE 'Low' END AS band, CAST(row_number() OVER (PARTITION BY district ORDER BY score DESC, cost, option) AS BIGINT) AS rank FROM u""")
def whatif_comparison(spark, d):
    r = _rates(spark, d)
    return decide.what_if(r, "district", F.col("need"), F.col("trust"), mobile=2, capacity=20.0, adoption=0.3)


def _strings(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


_RULES = ", ".join(f"('{r.category}', '{r.level}', {r.weight}e0, {_strings(r.fields)}, {_strings(r.terms)}, {_strings(r.generic)})" for r in claims.RULES)
_BROAD = ", ".join("CASE WHEN regexp_matches(whole, '" + p.replace("'", "''") + f"') THEN '{k}' END" for k, p in claims.BROAD)
_NORMAL = r"trim(regexp_replace(lower(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9/+]+', ' ', 'g'))"
_SECTIONS = _strings(claims.SECTIONS)
_NOT_NULL = "list_filter([{}], lambda x: x IS NOT NULL)"


CLAIMS = rf"""WITH p AS ({PLACED}), rules AS (SELECT * FROM (VALUES {_RULES}) t(category, level, weight, fields, terms, generic)),
s AS (SELECT *, list_transform(range(5), lambda k: coalesce({_NORMAL.format("string_split(trim(claim_text), ' | ')[k + 1]")}, '')) AS found, coalesce(need, 0) AS n0, coalesce(priority, 0) AS p0, coalesce(has_source, false) AS src, coalesce(has_contact, false) AS con FROM p),
b AS (SELECT entity_id, {_NOT_NULL.format(_BROAD)} AS broad FROM (SELECT entity_id, array_to_string(list_filter(found, lambda x: x <> ''), ' ') AS whole FROM s)),
sec AS (SELECT entity_id, unnest(range(5)) AS k, unnest(found) AS t FROM s), m AS (SELECT t, category, term FROM (SELECT DISTINCT t FROM sec), (SELECT category, unnest(terms) AS term FROM rules) WHERE regexp_matches(t, '\b' || term || '\b')),
hit AS (SELECT entity_id, category, list_sort(list_distinct(list(term))) AS keywords, list_transform(list_sort(list_distinct(list(k))), lambda k: ({_SECTIONS})[k + 1]) AS matched FROM sec JOIN m USING (t) GROUP BY 1, 2),
a AS (SELECT s.*, r.*, broad, coalesce(keywords, []) AS keywords, coalesce(matched, []) AS matched, {_NOT_NULL.format(", ".join(f"CASE WHEN has_{c} THEN '{c}' END" for c in claims.SECTIONS))} AS said, {_NOT_NULL.format(", ".join(f"CASE WHEN {c}_items >= 50 THEN '{c}' END" for c in claims.SECTIONS))} AS capped
  FROM s CROSS JOIN rules r JOIN b USING (entity_id) LEFT JOIN hit ON hit.entity_id = s.entity_id AND hit.category = r.category),
st AS (SELECT *, CASE WHEN len(keywords) = 0 THEN 'missing' WHEN list_has_all(generic, keywords) OR (len(broad) > 0 AND list_has_all(['description', 'capability'], matched)) OR (list_has_any(capped, fields) AND (needs_review OR NOT trusted) AND len(broad) > 0) THEN 'broad_or_ambiguous' ELSE 'observed' END AS status,
  level IN ('critical', 'high') AS high FROM a),
w AS (SELECT *, list_sort(list_distinct({_NOT_NULL.format("""CASE WHEN status = 'missing' THEN 'category_not_observed_in_local_claim_text' END, CASE WHEN status = 'broad_or_ambiguous' THEN 'broad_or_ambiguous_claim_language' END, CASE WHEN needs_review THEN 'source_row_needs_human_review' END,
  CASE WHEN NOT trusted THEN 'not_trustworthy_supply_signal' END, CASE WHEN NOT src THEN 'missing_source_url' END, CASE WHEN NOT has_website THEN 'missing_official_website' END, CASE WHEN NOT con THEN 'missing_contact_evidence' END, CASE WHEN semantic_quality < .6 THEN 'low_semantic_quality' END,
  CASE WHEN high AND status <> 'missing' THEN 'high_impact_observed_claim_requires_verification' END, CASE WHEN high AND status = 'missing' AND (p0 >= .5 OR n0 >= .6) THEN 'high_impact_missing_in_high_need_context' END, CASE WHEN p0 >= .5 THEN 'high_medical_desert_priority' END,
  CASE WHEN n0 >= .6 THEN 'high_health_need' END""")} || list_transform(broad[1:3], lambda x: 'broad_source:' || x) || list_transform(list_filter(fields, lambda f: NOT list_contains(said, f)), lambda f: 'missing_' || f || '_claim_field'))) AS reasons FROM st),
v AS (SELECT *, list_contains(reasons, 'high_impact_missing_in_high_need_context') AS urgent, status = 'broad_or_ambiguous' OR (high AND status <> 'missing') OR list_contains(reasons, 'high_impact_missing_in_high_need_context')
  OR list_has_any(reasons, ['source_row_needs_human_review', 'not_trustworthy_supply_signal', 'missing_source_url', 'missing_official_website', 'missing_contact_evidence', 'low_semantic_quality']) AS verify FROM w)
SELECT entity_id, category, level, status, verify, CASE WHEN status = 'broad_or_ambiguous' THEN 'resolve_broad_or_ambiguous_claim' WHEN urgent THEN 'verify_or_fill_missing_high_impact_claim' WHEN verify AND high AND status <> 'missing' THEN 'verify_observed_high_impact_claim'
  WHEN verify THEN 'verify_source_evidence' WHEN status = 'missing' THEN 'monitor_missing_local_evidence' ELSE 'accept_observed_proxy' END AS action,
 round(CAST(least(100, greatest(0, 8 + 7 * (status <> 'missing')::INT + 10 * (status = 'broad_or_ambiguous')::INT + 20 * weight + 12 * verify::INT + 8 * needs_review::INT + 7 * (NOT trusted)::INT + 6 * (NOT src)::INT + 4 * (NOT has_website)::INT + 4 * (NOT con)::INT + 14 * p0 + 12 * n0
  + 8 * greatest(0, 1 - semantic_quality) + 12 * urgent::INT)) AS DECIMAL(24, 8)), 3)::DOUBLE AS priority,
 array_to_string(reasons, '|') AS reasons, array_to_string(matched, '|') AS fields, array_to_string(keywords, '|') AS keywords, array_to_string(broad, '|') AS broad FROM v"""


@query("claim_rules", CLAIMS)
def claim_rules(spark, d):
    """Twelve service categories against five sections of every record's claims."""
    return claims.claim_queue(placed(spark, d, dealt=True), "entity_id")


_WEAK_JOINS = ", ".join(f"'{x}'" for x in remediate.WEAK_JOINS)
_M = """SELECT *, capacity_status <> 'observed_valid' AS capacity_incomplete, capacity_status IN ('present_unparseable', 'observed_extreme_outlier') OR capacity_outlier AS capacity_parse_or_outlier,
  capacity_confidence IN ('low', 'low_medium') OR (capacity_status <> 'observed_valid' AND capacity_peers < 10) AS capacity_low_confidence, doctors_status <> 'observed_valid' AS doctor_incomplete,
  doctors_status IN ('present_unparseable', 'observed_extreme_outlier') OR doctors_outlier AS doctor_parse_or_outlier, doctors_confidence IN ('low', 'low_medium') OR (doctors_status <> 'observed_valid' AND doctors_peers < 10) AS doctor_low_confidence,
  recency = 'missing' AS recency_missing, recency IN ('stale', 'future', 'invalid') AS recency_stale_or_invalid, recency <> 'valid' AS recency_problem, lat IS NULL OR lon IS NULL OR geo_quality = 'missing' AS coords_missing,
  geo_quality IN ('far', 'outside') AS geo_far_or_outside, geo_quality = 'moderate' AS geo_moderate, geo_quality IN ('far', 'outside', 'missing') AS severe_geo, geo_quality <> 'plausible' AS geo_issue,
  NOT coalesce(has_source, false) OR sources = 0 AS source_missing, NOT has_website AS official_website_missing, NOT coalesce(has_contact, false) AS contact_evidence_missing, NOT has_phone OR NOT has_mail AS phone_or_email_missing,
  NOT has_specialties AS specialties_missing, NOT has_procedure AS procedure_missing, NOT has_equipment AS equipment_missing, NOT has_capability AS capability_missing, NOT (has_specialties AND has_procedure AND has_equipment AND has_capability) AS missing_service_claim_fields,
  join_confidence < .8 AS low_join_confidence, join_strategy IN (__WEAK__) AS fuzzy_or_fallback_join, match_score IS NULL AS missing_health_district, join_confidence < .8 OR join_strategy IN (__WEAK__) OR match_score IS NULL AS join_issue,
  pin IS NULL AS pincode_missing, coalesce(pin_ambiguous, false) AS pincode_ambiguous, pin IS NULL OR coalesce(pin_ambiguous, false) AS pin_issue, maternity OR emergency OR diagnostic OR chronic AS high_impact_claim,
  contradicted OR capacity_status IN ('present_unparseable', 'observed_extreme_outlier') OR doctors_status IN ('present_unparseable', 'observed_extreme_outlier') AS outlier_or_conflict, gaps >= 3 AS critical_missing_high FROM ({placed}) x"""
MASKED = "SELECT *, high_impact_claim AND (needs_review OR outlier_or_conflict OR source_missing OR recency_problem OR join_issue OR missing_service_claim_fields) AS high_impact_claim_needs_review FROM (" + _M.replace("__WEAK__", _WEAK_JOINS).replace("{placed}", PLACED) + ")"
_LOW_RISK = """NOT (needs_review OR contradicted OR official_website_missing OR phone_or_email_missing OR contact_evidence_missing OR recency <> 'valid' OR capacity_incomplete OR doctor_incomplete OR missing_service_claim_fields OR pincode_ambiguous) AND join_confidence >= .8
 AND geo_quality = 'plausible' AND coalesce(has_source, false)"""


@query("issue_masks", "WITH m AS (SELECT *, needs_review AS needs_human_review, critical_gap AS critical_supply_gap, " + _LOW_RISK + " AS low_risk FROM (" + MASKED + ")) " + " UNION ALL ".join(f"SELECT '{k}' AS mask, count(*) FILTER ({k}) AS n FROM m" for k in remediate.MASKS))
def issue_masks(spark, d):
    """How many records each of the reusable issue masks holds, from one pass."""
    m = remediate.issue_masks()
    e = placed(spark, d)
    counts = e.agg(*(F.count_if(c).alias(k) for k, c in m.items()))
    return rel.unpivot(counts, [], list(m), "mask", "n")


_ACTIONS = _NOT_NULL.format("""CASE WHEN geo_issue THEN 'geocode' END, CASE WHEN outlier_or_conflict OR high_impact_claim_needs_review THEN 'claims_verification' END,
 CASE WHEN source_missing OR official_website_missing OR recency_problem OR capacity_low_confidence OR doctor_low_confidence OR missing_service_claim_fields OR join_issue OR pin_issue THEN 'registry_source_enrichment' END,
 CASE WHEN contact_evidence_missing OR phone_or_email_missing THEN 'phone_email_reachability_review' END, CASE WHEN capacity_incomplete OR doctor_incomplete THEN 'keep_estimate_with_interval' END""")
_REASONS = _NOT_NULL.format("""CASE WHEN geo_issue THEN CASE WHEN coords_missing THEN 'missing_coordinates' WHEN geo_far_or_outside THEN 'severe_geo_issue' ELSE 'moderate_geo_precision_issue' END END, CASE WHEN outlier_or_conflict THEN 'conflicting_evidence_or_outlier' END,
 CASE WHEN high_impact_claim_needs_review THEN 'high_impact_claims_need_review' END, CASE WHEN source_missing THEN 'missing_source_urls' END, CASE WHEN recency_problem THEN 'missing_stale_or_invalid_recency' END,
 CASE WHEN missing_service_claim_fields THEN 'missing_specialty_procedure_equipment_or_capability_evidence' END, CASE WHEN join_issue THEN 'low_confidence_or_unjoined_district' END, CASE WHEN pin_issue THEN 'pin_missing_or_ambiguous' END,
 CASE WHEN capacity_low_confidence OR doctor_low_confidence THEN 'low_confidence_peer_estimate' END, CASE WHEN contact_evidence_missing OR phone_or_email_missing THEN 'contact_evidence_missing_or_incomplete' END, CASE WHEN capacity_incomplete THEN 'capacity_missing_or_estimated' END,
 CASE WHEN doctor_incomplete THEN 'doctor_count_missing_or_estimated' END, CASE WHEN needs_review THEN 'needs_human_review' END, CASE WHEN critical_missing_high THEN 'semantic_missing_critical_count_ge_3' END, CASE WHEN priority >= cut THEN 'high_medical_desert_priority' END,
 CASE WHEN high_impact_claim THEN 'high_impact_claims:' || concat_ws(',', CASE WHEN maternity THEN 'maternity' END, CASE WHEN emergency THEN 'emergency' END, CASE WHEN diagnostic THEN 'diagnostic' END, CASE WHEN chronic THEN 'ncd' END) END""")


@query("remediation_actions", f"""SELECT entity_id, CASE WHEN len(a) = 0 THEN 'no_action_low_risk' ELSE array_to_string(a, ',') END AS actions, CASE WHEN len(r) = 0 THEN 'low_risk_no_missing_data_action' ELSE array_to_string(r, ',') END AS reasons, coalesce(a[1], 'no_action_low_risk') AS first_action
FROM (SELECT entity_id, {_ACTIONS} AS a, {_REASONS} AS r FROM (SELECT *, quantile_cont(priority, .75) OVER () AS cut FROM ({MASKED})))""")
def remediation_actions(spark, d):
    out = remediate.remediation(placed(spark, d))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("entity_id", joined("actions"), joined("reasons"), F.col("primary_action").alias("first_action"))


@query("seed_queue", f"""SELECT entity_id, s AS score, CAST(row_number() OVER (ORDER BY s DESC, entity_id) AS BIGINT) AS seed_rank FROM (SELECT entity_id, round(CAST(.24 * coalesce(pct, .5) + .16 * needs_review::INT + .16 * CASE WHEN geo_far_or_outside THEN 1 WHEN coords_missing THEN .95 WHEN geo_moderate THEN .45 ELSE 0 END
 + .16 * least(gaps / 5, 1) + .12 * outlier_or_conflict::INT + .10 * (maternity::INT + emergency::INT + diagnostic::INT + chronic::INT) / 4 + .04 * (1 - join_confidence) + .02 * (source_missing OR contact_evidence_missing)::INT AS DECIMAL(24, 8)), 6)::DOUBLE AS s
 FROM (SELECT *, CASE WHEN priority IS NOT NULL THEN (rank() OVER (PARTITION BY priority IS NULL ORDER BY priority) + (count(*) OVER (PARTITION BY priority) - 1) / 2.0) / count(priority) OVER () END AS pct FROM ({MASKED}))) ORDER BY s DESC, entity_id LIMIT 150""")
def seed_queue(spark, d):
    return rel.top(remediate.seed_score(placed(spark, d)).select("entity_id", F.col("seed_score").alias("score")), [F.desc("score"), F.asc("entity_id")], 150, "seed_rank")


@query("evidence_labels", """SELECT entity_id, CASE WHEN contradicted THEN 'conflict' ELSE 'bronze' END AS tier, CASE WHEN contradicted THEN 'contradicted_or_geo_invalid' WHEN trusted AND NOT needs_review THEN 'passed_proxy_checks' WHEN needs_review THEN 'needs_review' ELSE 'unknown' END AS posture,
 CASE WHEN contradicted THEN 'verify_location_before_use' WHEN needs_review THEN 'source_enrichment_or_manual_review' ELSE 'use_as_proxy_only' END AS action, CASE WHEN contradicted THEN 'source_or_geography_conflict' ELSE 'no_tier_a_or_b_corroborated_label' END AS abstain,
 round(CAST(least(1, greatest(0, (.42 * readiness + .30 * coalesce(join_confidence, 0) + .28 * semantic_quality) * CASE WHEN contradicted THEN .45 ELSE 1 END * CASE WHEN needs_review THEN .75 ELSE 1 END)) AS DECIMAL(24, 8)), 4)::DOUBLE AS confidence FROM {entities} e""")
def evidence_labels(spark, d):
    return decide.evidence(entities(spark, d)).select("entity_id", "tier", "posture", "action", "abstain", "confidence")


@query("geo_review_queue", """SELECT entity_id, s AS score FROM (SELECT entity_id, round(50 * contradicted::INT + CASE geo_quality WHEN 'outside' THEN 35 WHEN 'far' THEN 25 WHEN 'moderate' THEN 12 ELSE 0 END + 10 * (kind = 'BUILDING')::INT + 12 * (operator IS NULL)::INT + 6 * coalesce(join_confidence < .8, false)::INT + gaps + 8 * readiness, 4) AS s FROM {entities} e)
ORDER BY s DESC, entity_id LIMIT 250""")
def geo_review_queue(spark, d):
    s = decide.geo_review_score(F.col("gaps") * 100.0, F.lit(False), F.col("kind") == "BUILDING", F.lit(False), F.col("operator"), F.col("readiness"))
    return rel.top(entities(spark, d).select("entity_id", s.alias("score")), [F.desc("score"), F.asc("entity_id")], 250)


# Answers of a geocoder to every record, made from its key: some fail, some name another place or PIN.
GEOCODED = """SELECT entity_id, CASE entity_id % 13 WHEN 0 THEN 'ZERO_RESULTS' WHEN 1 THEN 'REQUEST_DENIED' ELSE 'OK' END AS status, CASE WHEN entity_id % 13 > 1 AND entity_id % 51 > 0 THEN 1 ELSE 0 END AS results,
  CASE entity_id % 5 WHEN 0 THEN 'ROOFTOP' WHEN 1 THEN 'GEOMETRIC_CENTER' WHEN 2 THEN 'RANGE_INTERPOLATED' WHEN 3 THEN 'APPROXIMATE' ELSE '' END AS location_type, entity_id % 8 = 5 AS partial, pin, state, district,
  name || ', ' || CASE WHEN entity_id % 9 = 2 THEN 'Elsewhere' ELSE district END || ', ' || CASE WHEN entity_id % 10 = 1 THEN 'Other State' ELSE lower(state) END || ' ' || CASE WHEN entity_id % 8 = 3 THEN '' ELSE coalesce(pin, '') END AS formatted,
  lat + CAST(entity_id % 7 AS DOUBLE) / 10 AS found_lat, lon + CAST(entity_id % 4 AS DOUBLE) / 10 AS found_lon FROM {}"""
_ALNUM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
CLASSIFIED = f"""SELECT *, CASE WHEN status = 'ZERO_RESULTS' THEN 'zero_results_review' WHEN status <> 'OK' OR results = 0 THEN 'api_' || lower(status) || '_review' WHEN partial THEN 'partial_match_review' WHEN NOT state_match THEN 'state_mismatch_review'
  WHEN NOT pin_match THEN 'pincode_mismatch_review' WHEN location_type IN ('ROOFTOP', 'RANGE_INTERPOLATED') THEN 'accept_coordinate_candidate' WHEN location_type = 'GEOMETRIC_CENTER' THEN 'neighborhood_candidate_h3_only' WHEN location_type = 'APPROXIMATE' THEN 'approximate_review'
  ELSE 'provider_metadata_review' END AS outcome FROM (SELECT *, pin IS NOT NULL AND contains(formatted, coalesce(pin, '')) AS pin_match, contains({_ALNUM.format('formatted')}, {_ALNUM.format('state')}) AS state_match, contains({_ALNUM.format('formatted')}, {_ALNUM.format('district')}) AS city_match
  FROM ({GEOCODED.format('{entities} e')}))"""


def _geocoded(spark, d):
    g = spark.sql(GEOCODED.format("{e}"), e=entities(spark, d))
    g = g.withColumns(decide.geocode_matches(F.col("formatted"), F.col("pin"), F.col("state"), F.col("district")))
    return g.withColumn("outcome", decide.geocode_outcome(F.col("status"), F.col("results"), F.col("location_type"), F.col("partial"), F.col("pin_match"), F.col("state_match")))


@query("geocode_outcomes", f"SELECT entity_id, pin_match, state_match, city_match, outcome FROM ({CLASSIFIED})")
def geocode_outcomes(spark, d):
    return _geocoded(spark, d).select("entity_id", "pin_match", "state_match", "city_match", "outcome")


@query("coordinate_corrections", f"""SELECT entity_id, outcome, CASE outcome WHEN 'accept_coordinate_candidate' THEN 'propose_replace_coordinate' ELSE 'store_h3_neighborhood_candidate' END AS action,
 CASE outcome WHEN 'accept_coordinate_candidate' THEN 'Precise Google result with admin/PIN checks; review before canonical overwrite.' ELSE 'Coarse Google result; use for H3/neighborhood planning only.' END AS note,
 round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(found_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(found_lat)) * pow(sin(radians(found_lon - lon) / 2), 2))), 3) AS km
FROM ({CLASSIFIED}) g JOIN (SELECT entity_id, lat, lon FROM {{entities}} e) USING (entity_id) WHERE outcome IN ('accept_coordinate_candidate', 'neighborhood_candidate_h3_only')""")
def coordinate_corrections(spark, d):
    """Accepted geocodes of all records, each with what it would change."""
    return decide.corrections(_geocoded(spark, d), entities(spark, d), "entity_id")


@query("place_match", """SELECT entity_id, round(CAST(s AS DECIMAL(24, 8)), 3)::DOUBLE AS score, CASE WHEN round(s, 9) >= .82 THEN 'high' WHEN round(s, 9) >= .62 THEN 'medium' ELSE 'low' END AS label FROM (SELECT entity_id, .70 * CASE WHEN entity_id % 3 = 0 THEN 1.0 WHEN entity_id % 3 = 1 THEN .5 ELSE 0 END
 + .18 * (entity_id % 4 > 0)::INT + .12 * (entity_id % 5 > 0)::INT AS s FROM {entities} e)""")
def place_match(spark, d):
    """A found place's name and address against the record's."""
    k = F.col("entity_id")
    number = F.regexp_extract("name", "#(.*)$", 1)
    place = F.when(k % 3 == 0, F.concat(F.lit("The "), F.lower("name"), F.lit(" annex"))).when(k % 3 == 1, F.concat(F.lit("Clinic "), number)).otherwise("Something else")
    address = F.concat_ws(", ", F.when(k % 5 > 0, F.lower("district")), F.when(k % 4 > 0, F.col("state")), F.lit("000"))
    m = decide.place_match(F.col("name"), F.col("state"), F.col("district"), place, address)
    return entities(spark, d).select("entity_id", m.alias("m")).select("entity_id", "m.score", "m.label")


@query("specialty_rerank", """SELECT district, kind, n, CAST(row_number() OVER (PARTITION BY district ORDER BY (kind = 'MACHINERY') DESC, n DESC, kind) AS BIGINT) AS rank FROM (SELECT district, kind, count(*) AS n FROM {entities} e GROUP BY 1, 2)""")
def specialty_rerank(spark, d):
    return rel.rank_within(rel.value_counts(entities(spark, d), ["district", "kind"]), ["district"], [F.desc(F.col("kind") == "MACHINERY"), F.desc("n"), F.asc("kind")], "rank")


@query("national_medians", "SELECT median(anaemia) AS anaemia, median(pressure) AS pressure, median(insurance) AS insurance FROM {regions} r")
def national_medians(spark, d):
    return regions(spark, d).agg(*(F.median(c).alias(c) for c in ("anaemia", "pressure", "insurance")))


@query("top_conditions", """SELECT district, condition, excess, CAST(row_number() OVER (PARTITION BY district ORDER BY excess DESC, condition) AS BIGINT) AS rank FROM (SELECT district, 'pressure' AS condition, pressure - median(pressure) OVER () AS excess FROM {regions} r UNION ALL
 SELECT district, 'sugar', sugar - median(sugar) OVER () FROM {regions} r UNION ALL SELECT district, 'births', births - median(births) OVER () FROM {regions} r) QUALIFY row_number() OVER (PARTITION BY district ORDER BY excess DESC, condition) <= 2""")
def top_conditions(spark, d):
    """Each district's two indicators farthest above the national median."""
    r = regions(spark, d)
    medians = r.agg(*(F.median(c).alias(f"m_{c}") for c in ("pressure", "sugar", "births")))
    wide = r.crossJoin(F.broadcast(medians)).select("district", *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("pressure", "sugar", "births")))
    long = rel.unpivot(wide, ["district"], ["pressure", "sugar", "births"], "condition", "excess")
    return rel.rank_within(long, ["district"], [F.desc("excess"), F.asc("condition")], "rank").where("rank <= 2")


@query("reference_cross_check", r"""WITH e AS (SELECT entity_id, district, state, 'Serves ' || CASE WHEN entity_id % 3 = 0 THEN lower(o.n_name) ELSE 'the area' END || CASE WHEN entity_id % 6 = 0 THEN ' and NATION_1' ELSE '' END || CASE WHEN entity_id % 7 = 0 THEN ' x' || o.n_name ELSE '' END || '.' AS evidence
  FROM {entities} e JOIN nation o ON o.n_nationkey = entity_id % 25), n AS (SELECT n_name AS other, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT entity_id, arg_max(other, (length(other), other)) AS other FROM e JOIN n USING (state) WHERE other <> district AND regexp_matches(trim(regexp_replace(lower(evidence), '[^a-z0-9]+', ' ', 'g')), '(^| )' || trim(regexp_replace(lower(other), '[^a-z0-9]+', ' ', 'g')) || '($| )')
GROUP BY 1""")
def reference_cross_check(spark, d):
    """Which other district of its own state a record's evidence text names as a phrase; of several the longest name."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("other"), F.col("r_name").alias("state"))
    e, o = entities(spark, d), n.select(F.col("n_nationkey").alias("key"), "n_name")
    k = F.col("entity_id")
    told = e.join(o, k % 25 == F.col("key")).select(
        "entity_id", "district", "state",
        F.concat(F.lit("Serves "), F.when(k % 3 == 0, F.lower("n_name")).otherwise("the area"), F.when(k % 6 == 0, " and NATION_1").otherwise(""), F.when(k % 7 == 0, F.concat(F.lit(" x"), "n_name")).otherwise(""), F.lit(".")).alias("evidence"),
    )
    return serve.other_area_named(told, names, "entity_id", "state", "district", "evidence", "other")
