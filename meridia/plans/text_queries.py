"""Queries of the text library: keys, numbers, contacts, lists and JSON, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import text
from meridia.plans.base import entities, query, table

_WS = "trim(regexp_replace(coalesce({c}, ''), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("normalise_keys", r"""SELECT p_partkey, regexp_replace(lower(replace(trim(p_name), '&', 'and')), '[^a-z0-9]+', '', 'g') AS compact,
  trim(regexp_replace(lower(replace(trim(p_brand), '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS spaced, regexp_replace(lower(p_type), '[^\p{L}\p{N}]', '', 'g') AS folded FROM part""")
def normalise_keys(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", text.key_compact(F.col("p_name")).alias("compact"), text.key_spaced(F.col("p_brand")).alias("spaced"), text.key_unicode(F.col("p_type")).alias("folded")
    )


@query("normalise_documents", r"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))) AS collapsed,
  md5(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9/+]+', ' ', 'g'))) AS matched FROM documents""")
def normalise_documents(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse(t)).alias("collapsed"), F.md5(text.match_text(t)).alias("matched"))


@query("fold_accents", """SELECT doc_id, md5(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS folded FROM documents""")
def fold_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


@query("pin_extract", r"""SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?:^|[^0-9])([1-9][0-9]{5})(?:[^0-9]|$)', 1), '') AS pin FROM documents""")
def pin_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_pin(F.col("text")).alias("pin"))


@query("first_int_and_year", r"""SELECT page_id, CASE WHEN i <= 500 THEN i END AS small, i AS first_number, y AS year FROM (
  SELECT page_id, TRY_CAST(nullif(regexp_extract(replace(url, ',', ''), '(?:^|[^0-9])([0-9]{1,7})(?:[^0-9]|$)', 1), '') AS BIGINT) AS i,
    TRY_CAST(nullif(regexp_extract(html, '\b(18[0-9]{2}|19[0-9]{2}|20[0-2][0-9])\b', 1), '') AS BIGINT) AS y FROM pages)""")
def first_int_and_year(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.first_int(F.col("url"), 500).alias("small"), text.first_int(F.col("url")).alias("first_number"), text.year(F.col("html"), 2029).alias("year")
    )


@query("numeric_strings", r"""SELECT p_partkey, TRY_CAST(nullif(regexp_replace(p_brand, '[^0-9.]+', '', 'g'), '') AS DOUBLE) AS brand_number,
  CASE WHEN p_retailprice <= 1000 THEN p_retailprice END AS capped FROM part""")
def numeric_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", text.number(F.col("p_brand")).alias("brand_number"), text.number(F.col("p_retailprice"), 1000).alias("capped"))


@query("emails", r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1), lambda x: lower(x)))) AS emails FROM documents""")
def emails(spark, d):
    return table(spark, d, "documents").select("doc_id", text.emails(F.col("text")).alias("emails"))


@query("phones", r"""WITH raw AS (SELECT doc_id, regexp_extract_all(text, '(\+?[0-9(][0-9 ().-]{6,}[0-9])', 1) AS r FROM documents),
  digits AS (SELECT doc_id, list_transform(r, lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^00', '')) AS r FROM raw)
SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(r, lambda x: CASE WHEN length(x) > 10 THEN right(x, 10) ELSE x END),
  lambda x: length(x) >= 8 AND len(list_distinct(string_split(x, ''))) >= 3))) AS phones FROM digits""")
def phones(spark, d):
    return table(spark, d, "documents").select("doc_id", text.phones(F.col("text")).alias("phones"))


@query("url_parts", r"""SELECT page_id, regexp_replace(lower(nullif(regexp_extract(url, '^https?://([^/?#:]+)', 1), '')), '^www\.', '') AS domain,
  len(regexp_extract_all(html, '(https?://[^ \t\r\n"''<>\]]+)', 1)) AS n_urls, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.domain(F.col("url")).alias("domain"), F.size(text.urls(F.col("html"))).cast("long").alias("n_urls"),
        F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page"),
    )


@query("nullish_and_evidence", """SELECT entity_id, v IS NULL OR lower(trim(v)) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'nil', '-', '--', 'unknown', 'not available', '[]', '{}') AS nullish,
  coalesce(lower(v) LIKE 'no equipment details provided%', false) AS no_evidence FROM (
  SELECT entity_id, CASE entity_id % 6 WHEN 0 THEN 'NA' WHEN 1 THEN ' null ' WHEN 2 THEN 'No equipment details provided' WHEN 3 THEN NULL WHEN 4 THEN '[]' ELSE name END AS v FROM {entities} e)""")
def nullish_and_evidence(spark, d):
    v = F.expr("CASE entity_id % 6 WHEN 0 THEN 'NA' WHEN 1 THEN ' null ' WHEN 2 THEN 'No equipment details provided' WHEN 3 THEN NULL WHEN 4 THEN '[]' ELSE name END")
    return entities(spark, d).select("entity_id", text.nullish(v).alias("nullish"), text.no_evidence(v).alias("no_evidence"))


@query("semantic_items", """SELECT entity_id, CASE entity_id % 5 WHEN 0 THEN ['X-ray', name] WHEN 1 THEN ['MRI'] WHEN 2 THEN [] WHEN 3 THEN [] ELSE [name] END AS items FROM {entities} e""")
def semantic_items(spark, d):
    v = F.expr("""CASE entity_id % 5 WHEN 0 THEN concat('["null","X-ray","', name, '",""]') WHEN 1 THEN '{"a":"MRI","b":"none"}' WHEN 2 THEN '[]' WHEN 3 THEN NULL ELSE name END""")
    return entities(spark, d).select("entity_id", text.semantic_items(v).alias("items"))


@query("list_parse", """SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN ['a', name] WHEN 1 THEN ['b', 'c d', district] ELSE ['x'] END AS items FROM {entities} e""")
def list_parse(spark, d):
    v = F.expr("""CASE entity_id % 3 WHEN 0 THEN concat('["a","', name, '"]') WHEN 1 THEN concat("['b'; c d, ", district, "]") ELSE 'x' END""")
    return entities(spark, d).select("entity_id", text.parse_list(v).alias("items"))


@query("json_struct_roundtrip", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"' || event_type || '"}' AS packed FROM events""")
def json_struct_roundtrip(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("packed"))


@query("embedded_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def embedded_json(spark, d):
    reply = F.concat(F.lit("Answer:\n"), F.col("props"), F.lit("\nthanks"))
    return table(spark, d, "events").select("event_id", text.embedded_json(reply, "k bigint")["k"].alias("k"))


@query("three_valued", """SELECT entity_id, CASE v WHEN 'YES' THEN true WHEN '1' THEN true WHEN ' no' THEN false WHEN '0' THEN false END AS value, coalesce(v IN ('YES', '1'), false) AS is_true,
  NOT coalesce(v IN ('YES', '1'), false) AS false_or_unknown FROM (SELECT entity_id, CASE entity_id % 6 WHEN 0 THEN 'YES' WHEN 1 THEN '1' WHEN 2 THEN ' no' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' END AS v FROM {entities} e)""")
def three_valued(spark, d):
    v = text.boolish(F.expr("CASE entity_id % 6 WHEN 0 THEN 'YES' WHEN 1 THEN '1' WHEN 2 THEN ' no' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' END"))
    return entities(spark, d).select("entity_id", v.alias("value"), F.coalesce(v, F.lit(False)).alias("is_true"), (~F.coalesce(v, F.lit(False))).alias("false_or_unknown"))


@query("recency_status", """SELECT o_orderkey, CASE WHEN d > DATE '1998-06-15' THEN 'future' WHEN d <= DATE '1998-06-15' - INTERVAL 730 DAY THEN 'stale' ELSE 'valid' END AS status,
  CASE WHEN d > DATE '1998-06-15' THEN 'low' WHEN d <= DATE '1998-06-15' - INTERVAL 730 DAY THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def recency_status(spark, d):
    r = text.recency(F.date_format("o_orderdate", "yyyy-MM-dd"), "1998-06-15")
    return table(spark, d, "orders").select("o_orderkey", r["status"].alias("status"), r["confidence"].alias("confidence"))


@query("claim_sections", """SELECT doc_id, s[1] AS head, len(s) AS n_sections, length(array_to_string(s[5:], ' | ')) AS rest_length FROM (SELECT doc_id, string_split(text, ' | ') AS s FROM documents)""")
def claim_sections(spark, d):
    parts = F.split("text", r" \| ", -1)
    rest = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1))), " | ")
    return table(spark, d, "documents").select("doc_id", parts[0].alias("head"), F.size(parts).cast("long").alias("n_sections"), F.length(rest).cast("long").alias("rest_length"))


@query("claim_text", r"""SELECT s_suppkey, substr(trim(regexp_replace(concat_ws(' ', s_name, CAST(s_nationkey AS VARCHAR), ''), '[ \t\r\n]+', ' ', 'g')), 1, 15) AS claim, length(s_name) AS name_length FROM supplier""")
def claim_text(spark, d):
    joined = text.collapse(F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string"), F.lit("")))
    return table(spark, d, "supplier").select("s_suppkey", F.substring(joined, 1, 15).alias("claim"), F.length("s_name").cast("long").alias("name_length"))


@query("ellipsis", """SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN rtrim(substr(p_name, 1, 7)) || '...' ELSE p_name END AS short FROM part""")
def ellipsis(spark, d):
    return table(spark, d, "part").select("p_partkey", text.ellipsis(F.col("p_name"), 10).alias("short"))


@query("service_signals", "SELECT entity_id, maternity, emergency, diagnostic, chronic FROM {entities} e UNION ALL SELECT -doc_id - 1, " + ", ".join(f"regexp_matches(lower(text), '{p}')" for p in text.SERVICE_SIGNALS.values()) + " FROM documents")
def service_signals(spark, d):
    """Four service signals in the claims of every record, and in every text."""
    signals = text.service_signals(F.col("text"))
    docs = table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("entity_id"), *(c.alias(k) for k, c in signals.items()))
    return entities(spark, d).select("entity_id", *signals).unionByName(docs)


@query("token_block_keys", r"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('red', 'small'))[1:2], ' ') AS block FROM part""")
def token_block_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(text.tokens(F.col("p_name"), ["red", "small"]), 1, 2), " ").alias("block"))


@query("name_similarity", """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name), 1), 3) AS edit,
  CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0 ELSE round(.65 / 2 + .35 / 3, 6) END AS tokens FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def name_similarity(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in "ab")
    sim = text.token_similarity(text.tokens(F.col("name_a")), text.tokens(F.col("name_b")))
    return a.join(b, "n_regionkey").select("a", "b", text.edit_similarity(F.col("name_a"), F.col("name_b")).alias("edit"), F.round(sim, 6).alias("tokens"))


@query("reason_codes_json", """SELECT entity_id, '[' || array_to_string(list_filter([CASE WHEN contradicted THEN '"contradicted"' END, CASE WHEN needs_review THEN '"needs_review"' END,
  CASE WHEN gaps >= 3 THEN '"critical_gaps"' END], lambda x: x IS NOT NULL), ',') || ']' AS reasons,
  concat_ws('; ', CASE WHEN contradicted THEN 'geography contradicts' END, CASE WHEN gaps >= 3 THEN 'critical fields missing' END) AS conflict FROM {entities} e""")
def reason_codes_json(spark, d):
    flags = {"contradicted": F.col("contradicted"), "needs_review": F.col("needs_review"), "critical_gaps": F.col("gaps") >= 3}
    conflict = F.concat_ws("; ", F.when(F.col("contradicted"), "geography contradicts"), F.when(F.col("gaps") >= 3, "critical fields missing"))
    return entities(spark, d).select("entity_id", F.to_json(text.codes(flags)).alias("reasons"), conflict.alias("conflict"))


@query("reason_labels", """SELECT DISTINCT geo_quality, CASE geo_quality WHEN 'far' THEN 'Far from its district' WHEN 'outside' THEN 'Outside the country' ELSE upper(substr(geo_quality, 1, 1)) || substr(geo_quality, 2) END AS label FROM {entities} e""")
def reason_labels(spark, d):
    labels = {"far": "Far from its district", "outside": "Outside the country"}
    return entities(spark, d).select("geo_quality", text.label_of(F.col("geo_quality"), labels).alias("label")).distinct()


@query("address_line", """SELECT entity_id, array_to_string(list_filter([name, CASE WHEN district <> name THEN district END, state, 'Country'], lambda x: x IS NOT NULL AND x <> ''), ', ') AS address FROM {entities} e""")
def address_line(spark, d):
    return entities(spark, d).select("entity_id", text.ordered_parts([F.col("name"), F.col("district"), F.col("state"), F.col("district"), F.lit("Country")]).alias("address"))


@query("encoded_urls", """SELECT s_suppkey, 'https://maps.example/search?q=' || replace(url_encode(s_name), '%20', '+') AS url FROM supplier""")
def encoded_urls(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://maps.example/search?q="), F.url_encode("s_name")).alias("url"))


@query("phrase_containment", """SELECT p_partkey, ' ' || p_name || ' ' LIKE '% ring %' AS has_ring FROM part""")
def phrase_containment(spark, d):
    return table(spark, d, "part").select("p_partkey", text.phrase_in(F.col("p_name"), F.lit("Ring")).alias("has_ring"))


@query("formatting", """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'n/a' ELSE printf('%.1f%%', round((s_suppkey % 8) / 8.0 * 100, 1)) END AS share FROM supplier""")
def formatting(spark, d):
    p = F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey") % 8 / 8.0)
    return table(spark, d, "supplier").select("s_suppkey", text.percent(p).alias("share"))


@query("route_intent", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'compare|versus') THEN 'compare' WHEN regexp_matches(lower(text), 'where|ou ') THEN 'locate' WHEN regexp_matches(lower(text), 'the|que') THEN 'explain' ELSE 'other' END AS intent FROM conversations""")
def route_intent(spark, d):
    low = F.lower("text")
    intent = F.when(low.rlike("compare|versus"), "compare").when(low.rlike("where|ou "), "locate").when(low.rlike("the|que"), "explain").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", intent.alias("intent"))


@query("type_recognised", r"""SELECT entity_id, NOT regexp_matches(coalesce(v, ''), '^\s*$|^https?://|^[0-9.]+$') AS recognised FROM (SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'http://x' WHEN 2 THEN NULL ELSE kind END AS v FROM {entities} e)""")
def type_recognised(spark, d):
    v = F.expr("CASE entity_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'http://x' WHEN 2 THEN NULL ELSE kind END")
    return entities(spark, d).select("entity_id", (~F.coalesce(v, F.lit("")).rlike(r"^\s*$|^https?://|^[0-9.]+$")).alias("recognised"))
