"""Queries of places and scopes: hexagonal cells, candidates with fallback, supply with intervals, lookups, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.functions.hexcells import hex_cell
from meridia.operators import impute, profile, serve
from meridia.operators.profile import Check
from meridia.plans.base import entities, query, table
from meridia.plans.score_queries import cohort_sql
from meridia.sources import io


@query("hex_cells")
def hex_cells(spark, d):
    """Every record's hexagonal cells at three resolutions; empty without coordinates."""
    return entities(spark, d).select("entity_id", *(hex_cell(F.col("lat"), F.col("lon"), r).alias(f"cell_{r}") for r in (5, 7, 9)))


@query("hex_supply")
def hex_supply(spark, d):
    """Records, trusted ones and mean readiness of each hexagonal cell; cells without a readiness get the median of all."""
    e = entities(spark, d).where("lat is not null and lon is not null").withColumn("cell", hex_cell(F.col("lat"), F.col("lon"), 3))
    cells = e.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("trusted").alias("trusted"), F.avg(F.when(F.col("claim_fields") > 2, F.col("readiness"))).alias("own"))
    middle = stats.quantiles(cells, [], "own", [0.5]).select(F.col("q")[0].alias("middle"))
    return cells.join(F.broadcast(middle), F.lit(True), "left").select("cell", "n", "trusted", F.round(F.coalesce("own", "middle"), 6).alias("readiness"))


@query("ascii_folded", r"""SELECT doc_id, md5(regexp_replace(translate(strip_accents(coalesce(text, '')), '²³¹ªº', '231ao'), '[^\x00-\x7F]', '', 'g')) AS folded FROM documents""")
def ascii_folded(spark, d):
    """Texts folded to ASCII by compatibility decomposition."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("folded"))


_MOMENTS = """SELECT '{c}' AS "column", '{s}' AS scale, count(x) AS n, count(DISTINCT x) AS d, round(avg(pow((x - m) / s, 3)), 4) AS g1, round(avg(pow((x - m) / s, 4)) - 3, 4) AS g2 FROM (SELECT x, avg(x) OVER () AS m, stddev_pop(x) OVER () AS s FROM (SELECT {x} AS x FROM {t}) WHERE x IS NOT NULL)"""


def _normal_sql(source, columns):
    moments = " UNION ALL ".join(_MOMENTS.format(c=c, s=s, x=x.format(c=c), t=source) for c in columns for s, x in (("raw", "{c}::DOUBLE"), ("log1p", "CASE WHEN {c} > 0 THEN ln(1 + {c}::DOUBLE) END")))
    return f"""WITH m AS (SELECT *, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b, 3.0 * (n - 1) / (n + 1) AS e,
  24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5)) AS v, 6.0 * (n * n - 5.0 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS t FROM ({moments})),
z AS (SELECT *, sqrt(2 * (b - 1)) - 1 AS w, 6 + 8 / t * (2 / t + sqrt(1 + 4 / (t * t))) AS a FROM m),
k AS (SELECT *, asinh(y / sqrt(2 / (w - 1))) / sqrt(ln(w) / 2) AS z1, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + (g2 + 3 - e) / sqrt(v) * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM z)
SELECT "column", scale, n, g1 AS skew, g2 AS kurtosis, CASE WHEN n >= 20 AND d >= 8 THEN round(z1 * z1 + z2 * z2, 4) END AS k2, CASE WHEN n >= 20 AND d >= 8 THEN round(exp(-(z1 * z1 + z2 * z2) / 2), 4) END AS p FROM k"""


@query("normality", _normal_sql("customer", ["c_acctbal", "c_nationkey"]))
def normality(spark, d):
    """Whether columns are normally distributed, as they are and as log1p."""
    return profile.normality_report(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


# Few records are both contradicted and of an ambiguous PIN, so some districts have none and look to their state or the nation.
_SCOPED = """WITH r AS (SELECT entity_id, district, state, readiness, coalesce(emergency, false) AS wanted FROM {entities} e WHERE contradicted AND coalesce(pin_ambiguous, false) AND kind = 'BUILDING'),
asked AS (SELECT n_name AS district, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
met AS (SELECT a.district, a.state, 0 AS level, r.* EXCLUDE (district, state) FROM asked a JOIN r ON a.district = r.district AND a.state = r.state UNION ALL SELECT a.district, a.state, 1, r.* EXCLUDE (district, state) FROM asked a JOIN r ON a.state = r.state
  UNION ALL SELECT a.district, a.state, 2, r.* EXCLUDE (district, state) FROM asked a CROSS JOIN r),
first AS (SELECT * FROM met QUALIFY level = min(level) OVER (PARTITION BY district, state)), liked AS (SELECT * FROM first QUALIFY wanted = bool_or(wanted) OVER (PARTITION BY district, state))
SELECT district, state, ['district', 'state', 'all'][level + 1] AS scope, entity_id, CAST(row_number() OVER (PARTITION BY district, state ORDER BY readiness DESC, entity_id) AS BIGINT) AS place FROM liked QUALIFY place <= 2"""


@query("scoped_examples", _SCOPED)
def scoped_examples(spark, d):
    """Two doubtful buildings for every district, from its state or the nation where it has none; emergency services first."""
    r = entities(spark, d).where("contradicted and coalesce(pin_ambiguous, false) and kind = 'BUILDING'").select("entity_id", "district", "state", "readiness", "emergency")
    asked = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    return serve.scoped_examples(asked, r, ["district", "state"], "entity_id", [F.desc("readiness"), F.asc("entity_id")], 2, F.col("emergency"))


@query("supply_intervals", f"""WITH s AS (SELECT e.district, trusted, CASE WHEN capacity IS NOT NULL AND NOT capacity_outlier THEN capacity END AS seen, estimate, low, high FROM {{entities}} e JOIN ({cohort_sql('capacity')}) c USING (entity_id)),
a AS (SELECT district, count(*) AS n, count(*) FILTER (trusted) AS sure, coalesce(sum(seen), 0) AS seen, coalesce(sum(estimate), 0) AS mid, coalesce(sum(high), 0) AS top, coalesce(sum(low), 0) AS bottom, coalesce(sum(low) FILTER (trusted), 0) AS sure_bottom FROM s GROUP BY district),
b AS (SELECT *, greatest(seen, mid, top) AS best, least(CASE WHEN sure_bottom > 0 THEN sure_bottom ELSE bottom * sure / n END, greatest(seen, mid, top)) AS worst FROM a)
SELECT district, 'best' AS scenario, n AS facilities, round(CAST(best AS DECIMAL(24, 8)), 1)::DOUBLE AS capacity, round(CAST(worst AS DECIMAL(24, 8)), 1)::DOUBLE AS low, round(CAST(best AS DECIMAL(24, 8)), 1)::DOUBLE AS high FROM b UNION ALL
SELECT district, 'likely', CAST(least(n, greatest(sure, round(n * (sure / n)))) AS BIGINT), round(CAST((best + worst) / 2 AS DECIMAL(24, 8)), 1)::DOUBLE, round(CAST(worst AS DECIMAL(24, 8)), 1)::DOUBLE, round(CAST(best AS DECIMAL(24, 8)), 1)::DOUBLE FROM b UNION ALL SELECT district, 'worst', sure, round(CAST(worst AS DECIMAL(24, 8)), 1)::DOUBLE, round(CAST(worst AS DECIMAL(24, 8)), 1)::DOUBLE, round(CAST(worst AS DECIMAL(24, 8)), 1)::DOUBLE FROM b""")
def supply_intervals(spark, d):
    """Best, likely and worst supply of each district, from observed numbers and estimates with their intervals."""
    e = impute.hierarchical(entities(spark, d), "capacity", ~F.col("capacity_outlier"))
    seen = F.when(F.col("level") == "observed", F.col("capacity"))
    return serve.supply_intervals(e.withColumn("seen", seen), "district", "trusted", "seen", "estimate", "low", "high")


_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_TRIES = ["c_mktsegment", "'supplier ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')", "CAST(c_nationkey AS VARCHAR)", "c_name"]


@query("lookup_any", f"""WITH i AS (SELECT k AS lookup_key, max(s_suppkey) AS s_suppkey FROM (SELECT s_suppkey, unnest(list_distinct([{_FOLD.format('replace(s_name, chr(35), chr(32))')}, CAST(s_nationkey + 3 AS VARCHAR)])) AS k FROM supplier) GROUP BY 1),
t AS (SELECT c_custkey, {', '.join(f"{_FOLD.format(x)} AS t{n}" for n, x in enumerate(_TRIES))} FROM customer),
l AS (SELECT c_custkey, unnest(range({len(_TRIES)})) AS place, unnest([{', '.join(f't{n}' for n in range(len(_TRIES)))}]) AS lookup_key FROM t)
SELECT c_custkey, CAST(place AS INT) AS place, s_suppkey FROM l JOIN i USING (lookup_key) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY place) = 1""")
def lookup_any(spark, d):
    """Each customer's supplier by the first of four keys that the suppliers' index knows; keys of suppliers clash."""
    s = table(spark, d, "supplier").withColumn("place_key", F.col("s_nationkey") + 3)
    index = io.metadata_index(s, ["s_name", "place_key"], "s_suppkey")
    tries = [F.col("c_mktsegment"), F.concat(F.lit("supplier "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.col("c_nationkey"), F.col("c_name")]
    return io.lookup_any(table(spark, d, "customer"), "c_custkey", tries, index, ["s_suppkey"])


CHECKS = [
    Check("orders in expected size", "error", "rows", "orders", low=1, high=1e12), Check("few orders", "warning", "rows", "orders", low=0, high=100),
    Check("columns of orders", "error", "columns", "orders", ("o_orderkey", "o_custkey", "o_totalprice")), Check("columns of lineitem", "error", "columns", "lineitem", ("l_orderkey", "l_weight")),
    Check("orders once each", "error", "unique", "orders", ("o_orderkey",)), Check("one line an order", "warning", "unique", "lineitem", ("l_orderkey",)), Check("keys of orders", "error", "not_null", "orders", ("o_orderkey", "o_custkey")),
    Check("coordinates known", "warning", "not_null", "records", ("lat", "lon")), Check("readiness in [0, 1]", "error", "bounds", "records", ("readiness",), 0, 1), Check("distance up to 250", "warning", "bounds", "records", ("km",), 0, 250),
    Check("lines counted from 1", "error", "at_most", "lines", ("first", "last")), Check("as many records sure as seen", "error", "at_most", "records", ("claim_fields", "sources")), Check("known statuses", "error", "domain", "orders", ("o_orderstatus",), values=("F", "O", "P")),
    Check("two flags only", "warning", "domain", "lineitem", ("l_returnflag",), values=("A", "N")), Check("all kinds there", "warning", "presence", "records", ("kind",), values=("BUILDING", "MACHINERY", "FURNITURE")),
    Check("palaces there", "warning", "presence", "records", ("kind",), values=("BUILDING", "PALACE")), Check("orders of customers", "error", "foreign", "orders", ("o_custkey",), other="customer", other_columns=("c_custkey",)),
    Check("customers who ordered", "warning", "foreign", "customer", ("c_custkey",), other="orders", other_columns=("o_custkey",)), Check("weight known", "error", "not_null", "lineitem", ("l_weight",)),
]


@query("relational_audit", """WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (o_orderkey IS NULL OR o_custkey IS NULL) AS nulls, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS odd FROM orders),
l AS (SELECT count(*) - count(DISTINCT l_orderkey) AS more, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS odd FROM lineitem), e AS (SELECT count(*) FILTER (lat IS NULL OR lon IS NULL) AS unplaced, count(*) FILTER (NOT readiness BETWEEN 0 AND 1) AS wild, count(*) FILTER (km > 250 OR km < 0) AS far,
 count(*) FILTER (claim_fields > sources) AS above, 3 - count(DISTINCT kind) FILTER (kind IN ('BUILDING', 'MACHINERY', 'FURNITURE')) AS kinds, 2 - count(DISTINCT kind) FILTER (kind IN ('BUILDING', 'PALACE')) AS palaces FROM {entities} x),
p AS (SELECT count(*) AS n FROM (SELECT min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey) WHERE a > b), f AS (SELECT count(*) AS n FROM orders ANTI JOIN customer ON o_custkey = c_custkey), g AS (SELECT count(*) AS n FROM customer ANTI JOIN orders ON o_custkey = c_custkey),
c AS (SELECT unnest([
 {'c': 'orders in expected size', 's': 'error', 'k': 'rows', 'f': greatest(1 - o.n, 0)}, {'c': 'few orders', 's': 'warning', 'k': 'rows', 'f': greatest(o.n - 100, 0)}, {'c': 'columns of orders', 's': 'error', 'k': 'columns', 'f': 0}, {'c': 'columns of lineitem', 's': 'error', 'k': 'columns', 'f': 1},
 {'c': 'orders once each', 's': 'error', 'k': 'unique', 'f': o.n - o.keys}, {'c': 'one line an order', 's': 'warning', 'k': 'unique', 'f': l.more}, {'c': 'keys of orders', 's': 'error', 'k': 'not_null', 'f': o.nulls}, {'c': 'coordinates known', 's': 'warning', 'k': 'not_null', 'f': e.unplaced},
 {'c': 'readiness in [0, 1]', 's': 'error', 'k': 'bounds', 'f': e.wild}, {'c': 'distance up to 250', 's': 'warning', 'k': 'bounds', 'f': e.far}, {'c': 'lines counted from 1', 's': 'error', 'k': 'at_most', 'f': p.n}, {'c': 'as many records sure as seen', 's': 'error', 'k': 'at_most', 'f': e.above},
 {'c': 'known statuses', 's': 'error', 'k': 'domain', 'f': o.odd}, {'c': 'two flags only', 's': 'warning', 'k': 'domain', 'f': l.odd}, {'c': 'all kinds there', 's': 'warning', 'k': 'presence', 'f': e.kinds}, {'c': 'palaces there', 's': 'warning', 'k': 'presence', 'f': e.palaces},
 {'c': 'orders of customers', 's': 'error', 'k': 'foreign', 'f': f.n}, {'c': 'customers who ordered', 's': 'warning', 'k': 'foreign', 'f': g.n}, {'c': 'weight known', 's': 'error', 'k': 'not_null', 'f': 1}]) AS r FROM o, l, e, p, f, g)
SELECT r.c AS check, r.s AS severity, r.k AS kind, CAST(r.f AS BIGINT) AS failed, r.f = 0 AS passed FROM c""")
def relational_audit(spark, d):
    """Sizes, columns, keys, bounds, domains and references of four tables, in one report."""
    lineitem = table(spark, d, "lineitem")
    lines = lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))
    tables = {"orders": table(spark, d, "orders"), "lineitem": lineitem, "customer": table(spark, d, "customer"), "records": entities(spark, d), "lines": lines}
    return profile.audit(tables, CHECKS)
