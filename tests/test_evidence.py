"""Values worked out by hand for the evidence scores, gates, bands, claims and remediation."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators import claims, decide, evidence, impute, matching, remediate, scores, serve
from meridia.operators import relational as rel
from meridia.plans import base, registry

RAW = """entity_id long, kind string, operator string, state string, lat double, lon double, km double, pin string, pin_known boolean, pin_ambiguous boolean, match_score double,
capacity_raw string, doctors_raw string, year_raw string, page_date string, has_description boolean, has_specialties boolean, has_procedure boolean, has_equipment boolean, has_capability boolean,
has_source boolean, has_contact boolean, has_website boolean, has_phone boolean, has_mail boolean, claim_text string, sources long,
description_items long, specialties_items long, procedure_items long, equipment_items long, capability_items long, need double, priority double"""
GOOD = (1, "clinic", "private", "S", 20.0, 75.0, 3.0, "560001", True, False, 1.0, "1,200 beds", "12", "Est. 1987.", "2026-01-01", True, True, True, True, True, True, True, True, True, True,
        "desc | gynecologyAndObstetrics | C-section | MRI/PET CT | 24x7 emergency", 2, 1, 3, 3, 3, 3, 0.7, 0.6)
NAMES = [c.split()[0] for c in RAW.replace("\n", " ").split(",")]


def records(spark, *changes):
    rows = []
    for k, change in enumerate(changes):
        r = dict(zip(NAMES, GOOD, strict=True)) | {"entity_id": k} | change
        rows.append(tuple(r[n] for n in NAMES))
    return evidence.derive(spark.createDataFrame(rows, RAW))


def test_scores_and_gates_of_records(spark):
    out = records(
        spark, {}, {"capacity_raw": None, "doctors_raw": "many", "has_source": None}, {"capacity_raw": "6000", "page_date": "not a date"}, {"lat": 5.0}, {"km": 250.01},
        {"pin": None, "pin_known": False, "match_score": None, "pin_ambiguous": None}, {"km": 50.0}, {"km": None, "lat": None},
    ).collect()
    r = {x.entity_id: x for x in sorted(out, key=lambda x: x.entity_id)}
    good = r[0]  # all of D3 but nothing estimated: .24 + .24 + .18 + .14 + .10 + .10
    assert (good.gaps, good.supply_confidence, good.semantic_quality, good.readiness) == (0, 1.0, 1.0, 1.0)
    assert good.trusted and not good.needs_review and not good.contradicted and good.year == 1987 and good.capacity == 1200
    assert (r[1].capacity_status, r[1].doctors_status, r[1].gaps) == ("missing_semantic", "present_unparseable", 2)
    # six others have a capacity, below the ten that a cohort needs, so "low"; no source either
    assert r[1].capacity_confidence == "low" and r[1].supply_confidence == pytest.approx(0.18 + 0.14 + 0.10)
    assert r[1].semantic_quality == pytest.approx(round(0.45 * 0.42 + 0.25 * 0.6 + 0.15, 3)) and not r[1].trusted
    assert r[2].capacity_status == "observed_extreme_outlier" and r[2].recency == "invalid" and r[2].critical_gap and r[2].contradicted
    assert (r[3].geo_quality, r[4].geo_quality, r[6].geo_quality, r[7].geo_quality) == ("outside", "far", "plausible", "missing") and r[4].contradicted and not r[7].contradicted
    assert (r[5].join_strategy, r[5].join_confidence) == ("no_valid_pincode", 0.0)
    # without PIN, join and known ambiguity: .14 + .12 + .16 + .10 = .52; .7 * .52 + .3 * 1
    assert r[5].readiness == pytest.approx(0.664)


@pytest.mark.parametrize(
    ("pin", "known", "score", "ambiguous", "want"),
    [("1", True, 1.0, False, ("pincode_district_state_exact", 0.95)), ("1", True, 1.0, True, ("pincode_district_state_exact", 0.82)), ("1", True, 0.94, None, ("pincode_district_state_fuzzy", 0.72)),
     ("1", False, 1.0, None, ("facility_city_state_fallback", 0.55)), ("1", True, None, None, ("pincode_only_no_health_match", 0.0)), (None, False, None, None, ("no_valid_pincode", 0.0)),
     ("1", False, None, None, ("unjoined", 0.0))],
)
def test_join_strategies(spark, pin, known, score, ambiguous, want):
    df = spark.createDataFrame([(pin, known, score, ambiguous)], "pin string, known boolean, score double, ambiguous boolean")
    s = evidence.join_strategy(F.col("pin"), F.col("known"), F.col("score"))
    assert tuple(df.select(s, evidence.join_confidence(s, F.col("ambiguous"))).first()) == want


def test_trust_points_add_up(spark):
    df = records(spark, {}, {"capacity_raw": "6000", "doctors_raw": "7000", "km": 300.0, "page_date": None, "has_source": False, "has_contact": False})
    totals = {r.entity_id: r.t for r in df.select("entity_id", F.aggregate(scores.trust_parts(), F.lit(0), lambda a, p: a + p["points"]).alias("t")).collect()}
    assert totals[0] == 100  # 18 + 16 + 14 + 16 + 10 + 12 + 6 + 8
    assert totals[1] == 2 + 10 + 0 + 6 + 5 + 2 + 1 + 2  # three gaps, readiness .6 and more, contradicted, far, unknown date, no source, no contact, review


def test_geo_bands(spark):
    rows = [("plausible", 3.0, False), ("plausible", 3.0, True), ("moderate", 60.0, False), ("far", 300.0, True), ("outside", 6000.0, True), ("missing", None, False)]
    df = spark.createDataFrame(rows, "q string, km double, c boolean")
    b = scores.geo_band(F.col("q"), F.col("km"), F.col("c"))
    got = [(r.low, r.high, r.score) for r in df.select(b.alias("b")).select("b.*").collect()]
    assert got == [(0.1, 5.0, 0.0038), (5.0, 25.0, 0.4458), (2.0, 60.0, 0.3148), (10.0, 300.0, 0.83), (50.0, 5000.0, 1.0), (10.0, 250.0, 0.68)]


def test_conformal_uses_proxy_valid_rows_only(spark):
    rows = [(i, 0.99 - i / 400, i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, p double, y boolean")
    r = scores.conformal(df, "k", "p", "y").first()
    import hashlib

    half = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[0], 16) % 2
    cal, held = (np.array([1 - p for i, p, y in rows if y and half(i) == h]) for h in (0, 1))
    level = lambda a: min(1.0, np.ceil((len(cal) + 1) * (1 - a)) / len(cal))
    q = float(np.clip(np.quantile(cal, level(0.1), method="higher"), 0.05, 0.95))
    stale = float(np.clip(max(np.quantile(cal, level(0.05), method="higher"), q + 0.05), q, 0.99))
    assert (r.n_calibration, r.n_evaluation) == (len(cal), len(held)) and r.q == pytest.approx(q) and r.stale_q == pytest.approx(stale)
    assert r.coverage == pytest.approx((held <= q).mean())
    nothing = scores.conformal(df.where("not y"), "k", "p", "y").first()
    assert (nothing.q, nothing.n_calibration, nothing.n_evaluation) == (0.40, 0, 0)


def test_conformal_sets_count_bad_dates_as_stale(spark):
    rows = [(0.95, False, "valid"), (0.85, False, "valid"), (0.7, False, "future"), (0.7, False, "valid"), (0.95, True, "invalid"), (None, False, "missing")]
    df = spark.createDataFrame(rows, "p double, c boolean, r string")
    s = scores.conformal_set(F.col("p"), F.col("c"), F.col("r"), F.lit(0.2), F.lit(0.5))
    got = [tuple(r) for r in df.select(s["labels"], s["decision"]).collect()]
    assert got == [("{valid}", "auto-accept"), ("{valid, uncertain}", "review"), ("{valid, stale, uncertain}", "low-confidence"), ("{valid, uncertain}", "low-confidence"),
                   ("{stale, uncertain}", "low-confidence"), ("{valid, stale, uncertain}", "low-confidence")]


def test_claims_of_a_record(spark):
    df = records(spark, {}, {"claim_text": "Listed among top hospitals | | screening | | all specialty services", "page_date": None}, {"claim_text": None})
    rows = {(r.entity_id, r.category): r for r in claims.claim_queue(df, "entity_id").collect()}
    assert len(rows) == 36
    m = rows[0, "maternity"]
    assert (m.status, m.fields, m.keywords, m.action) == ("observed", "specialties|procedure", "c section|gynecology|obstetrics", "verify_observed_high_impact_claim")
    # 8 + 7 + 20 * 1 + 12 + 14 * .6 + 12 * .7, nothing else is wrong with the record
    assert m.priority == pytest.approx(63.8) and m.verify
    assert rows[0, "lab/imaging"].keywords == "mri|pet ct" and rows[0, "dental"].status == "missing" and rows[0, "dental"].action == "monitor_missing_local_evidence"
    assert rows[0, "blood bank"].action == "verify_or_fill_missing_high_impact_claim"
    d = rows[1, "diagnostic"]  # only a generic word, and broad phrases
    assert d.status == "broad_or_ambiguous" and d.broad == "all_specialty_services|directory_listing" and d.action == "resolve_broad_or_ambiguous_claim"
    assert all(rows[2, c.category].status == "missing" for c in claims.RULES)


def test_claim_excerpts_and_contacts(spark):
    df = spark.createDataFrame([(["X-ray", "ward", "MRI 3T"], ["mri", "x ray"], "na", '["+91 1"]', "a@b.in")], "i array<string>, k array<string>, p string, n string, m string")
    r = df.select(claims.excerpt(F.col("i"), F.col("k")).alias("x"), claims.excerpt(F.col("i"), F.array(F.lit("icu"))).alias("y"), claims.contact_types(F.col("p"), F.col("n"), F.col("m")).alias("c")).first()
    assert (r.x, r.y, r.c) == ("X-ray; MRI 3T", "X-ray; ward; MRI 3T", "phone_numbers|email")


def test_remediation_of_records(spark):
    df = records(spark, {"claim_text": "", "priority": 0.1}, {"km": 60.0, "has_mail": False, "capacity_raw": None, "claim_text": "", "priority": 0.2}, {"lat": None, "priority": 0.9})
    out = {r.entity_id: r for r in remediate.remediation(df).collect()}
    assert out[0].actions == ["no_action_low_risk"] and out[0].reasons == ["low_risk_no_missing_data_action"]
    assert out[1].actions == ["geocode", "registry_source_enrichment", "phone_email_reachability_review", "keep_estimate_with_interval"]
    assert "moderate_geo_precision_issue" in out[1].reasons and "low_confidence_peer_estimate" in out[1].reasons
    assert out[2].actions[0] == "geocode" and out[2].reasons[0] == "missing_coordinates" and "high_medical_desert_priority" in out[2].reasons
    assert out[2].reasons[-1] == "high_impact_claims:maternity,emergency,diagnostic"
    assert set(remediate.MASKS) == set(remediate.issue_masks()) and len(remediate.MASKS) == 38
    seeds = {r.entity_id: r.seed_score for r in remediate.seed_score(df).collect()}
    assert seeds[0] == pytest.approx(0.24 / 3 + 0.04 * 0.05)
    # percentile 1, review, missing place, no critical gap, no conflict, three of four high-impact claims
    assert seeds[2] == pytest.approx(0.24 + 0.16 + 0.16 * 0.95 + 0.10 * 0.75 + 0.04 * 0.05)


def test_geocodes(spark):
    rows = [("OK", 1, "ROOFTOP", False, "12 Road, PUNE, Maha-rashtra 411001"), ("OK", 1, "GEOMETRIC_CENTER", False, "Pune Maharashtra 411001"), ("OK", 1, "ROOFTOP", True, "Pune Maharashtra 411001"),
            ("OK", 1, "ROOFTOP", False, "Pune 411001"), ("OK", 1, "ROOFTOP", False, "Pune, Maharashtra"), ("OK", 0, "ROOFTOP", False, ""), ("ZERO_RESULTS", 0, "", False, ""), ("DENIED", 0, "", False, "")]
    df = spark.createDataFrame(rows, "s string, n int, t string, p boolean, f string")
    m = decide.geocode_matches(F.col("f"), F.lit("411001"), F.lit("Maharashtra"), F.lit("Pune"))
    out = df.select(decide.geocode_outcome(F.col("s"), F.col("n"), F.col("t"), F.col("p"), m["pin_match"], m["state_match"])).collect()
    assert [r[0] for r in out] == ["accept_coordinate_candidate", "neighborhood_candidate_h3_only", "partial_match_review", "state_mismatch_review", "pincode_mismatch_review", "api_ok_review",
                                   "zero_results_review", "api_denied_review"]
    found = spark.createDataFrame([(1, "accept_coordinate_candidate", 20.1, 75.0), (2, "approximate_review", 1.0, 1.0), (3, "neighborhood_candidate_h3_only", 20.0, 75.0)], "k int, outcome string, found_lat double, found_lon double")
    kept = {r.k: (r.action, r.km) for r in decide.corrections(found, spark.createDataFrame([(1, 20.0, 75.0), (3, None, None)], "k int, lat double, lon double"), "k").collect()}
    assert kept == {1: ("propose_replace_coordinate", 11.12), 3: ("store_h3_neighborhood_candidate", None)}


def test_priors_and_place_match(spark):
    df = spark.createDataFrame([("OK", "APPROXIMATE", False), ("OK", "ROOFTOP", True), ("ZERO_RESULTS", "", False), ("DENIED", "", False)], "s string, t string, p boolean")
    got = {(r.s, r.t): (r.low, r.high, r.radius_km) for r in serve.with_prior(df, "s", "t", "p").collect()}
    assert got == {("OK", "APPROXIMATE"): (0.2, 0.48, 25.0), ("OK", "ROOFTOP"): (0.18, 0.6, 15.0), ("ZERO_RESULTS", ""): (0.0, 0.18, None), ("DENIED", ""): (None, None, None)}
    m = decide.place_match(F.lit("City Care Hospital"), F.lit("Goa"), F.lit("Panaji"), F.lit("Care Hospital"), F.lit("Panaji, Goa"))
    assert tuple(spark.range(1).select(m["score"], m["label"]).first()) == (0.767, "medium")  # .7 * 2/3 + .18 + .12


def test_other_areas_named(spark):
    names = spark.createDataFrame([("Pune", "M"), ("Nashik", "M"), ("Nashik Rural", "M"), ("Surat", "G")], "area string, state string")
    rows = [(1, "M", "Pune", "a clinic of Nashik-Rural"), (2, "M", "Nashik", "in nashik town"), (3, "M", "Pune", "Surat and Punes"), (4, "M", "Nashik", None)]
    df = spark.createDataFrame(rows, "k int, state string, own string, t string")
    assert {r.k: r.area for r in serve.other_area_named(df, names, "k", "state", "own", "t", "area").collect()} == {1: "Nashik Rural"}


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_and_ranks_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.standard_normal(400) * 10.0 ** rng.integers(-3, 4, 400), rng.integers(-3, 4, 200)])
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(values)] + [("b", 5.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    levels = (0.0, 0.1, 0.5, 0.75, 1.0)
    got = {r.k: (r.n, list(r.q)) for r in stats.quantiles(df, ["k"], "x", levels).collect()}
    for key in ("a", None, "b"):
        own = [x for k, x in rows if k == key and x is not None]
        assert got[key][0] == len(own) and np.allclose(got[key][1], np.quantile(own, levels))
    assert set(got) == {"a", None, "b"}
    known = np.array([x for _, x in rows if x is not None])
    ranks = {r.x: r.p for r in stats.pct_rank(df, "x", "p").where("x is not null").collect()}
    assert all(abs(p - ((known < x).sum() + ((known == x).sum() + 1) / 2) / len(known)) < 1e-9 for x, p in ranks.items())


def test_small_tables_of_the_statistics(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert stats.quantiles(empty, ["k"], "x", [0.5]).collect() == [] and stats.quantiles(empty, [], "x", [0.5]).collect() == []
    assert [r.s for r in stats.min_max(spark.createDataFrame([(1,), (3,), (2,)], "x int"), "x", "s").orderBy("x").collect()] == [0.0, 0.5, 1.0]
    assert stats.min_max(spark.createDataFrame([(4,)], "x int"), "x", "s", 0.5).first().s == 0.5
    km = spark.range(1).select(stats.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("km")).first().km
    assert km is None
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, " ", 0), (1, "c", 9), (2, None, 1)], "k int, v string, o int")
    assert [tuple(r) for r in rel.distinct_sample(df, "k", "v", "o", 2, 40).collect()] == [(1, "b; a")]
    assert impute.hierarchical(spark.createDataFrame([("a", "b", "c", None)], "kind string, operator string, state string, x double"), "x", F.lit(True)).first().estimate is None


def test_text_similarity_takes_the_best(spark):
    df = spark.createDataFrame([("city hospital", "hospital city"), ("abc", "abd"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(matching.text_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(0.666667), 0.0, 0.0]


def test_clusters_that_do_not_settle_say_so(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "left int, right int")
    with pytest.raises(RuntimeError):
        matching.clusters(chain, most=1)
    assert {r.cluster for r in matching.clusters(chain).collect()} == {0}


def test_service_signals(spark):
    got = spark.createDataFrame([("Maternity and NICU ward",), ("24x7 casualty; CT scan",), (None,)], "t string").select(*(c.alias(k) for k, c in text.service_signals(F.col("t")).items())).collect()
    assert [tuple(r) for r in got] == [(True, True, False, False), (False, True, True, False), (False, False, False, False)]  # "nicu" holds "icu"
    assert datetime.date.fromisoformat(evidence.AS_OF)


def test_records_are_dealt_over_tasks(spark, tmp_path):
    from meridia.plans import base

    small = "/root/testdata/sf0.001"
    many = spark.range(25_000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "1e0 AS c_acctbal", "'k' AS c_mktsegment")
    many.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    sizes = base.raw_entities(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == 25_000 and max(r["count"] for r in sizes) < 10_000


def test_terms_are_those_of_their_section(spark):
    """Against a plain search; all terms are looked for once in the whole text, so sections must not join to make one."""
    texts = [
        "x | blood | bank | normal | delivery", "blood bank | c | section, C-section | MRI/PET CT; x-ray | heart | beat", "eye", "pet | ct scan | ct | labour | room",
        "a | critical care | ICU+HDU; pediatric emergency medicine | blood products | imaging (lab)", None, "a|b| | lab | |  |", " ".join(t for r in claims.RULES for t in r.terms),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, claim_text string")
    flags = ["needs_review", "trusted", "has_source", "has_website", "has_contact", *(f"has_{s}" for s in claims.SECTIONS)]
    df = df.withColumns({f: F.lit(True) for f in flags} | {f"{s}_items": F.lit(1) for s in claims.SECTIONS} | {c: F.lit(0.5) for c in ("semantic_quality", "need", "priority")})
    queue = claims.claim_queue(df, "id")
    found = {r.id: list(r.s) for r in df.select("id", claims.sections(F.col("claim_text")).alias("s")).collect()}
    padded = lambda s: " " + s.replace("/", " / ").replace("+", " + ") + " "
    for r in queue.collect():
        rule = next(x for x in claims.RULES if x.category == r.category)
        hits = [(t, n) for t in rule.terms for n, s in zip(claims.SECTIONS, found[r.id], strict=True) if f" {t} " in padded(s)]
        assert r.keywords == "|".join(sorted({t for t, _ in hits})) and r.fields == "|".join(n for n in claims.SECTIONS if n in {m for _, m in hits})
    exploded = [line for line in queue._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in line and "hits" in line]
    assert exploded and all("found" not in line for line in exploded)  # rows of a rule go on without the sections


def test_claim_summary_counts_the_queue_once(spark, monkeypatch):
    """The queue is neither kept nor read again: what is written has each status, action, level and priority once, and no reasons are made."""
    kept, pinned = [], rel.pinned
    monkeypatch.setattr(rel, "pinned", lambda d: kept.append((d, pinned(d))) or kept[-1][1])
    got = registry.queries()["claim_summary"](spark, "/root/testdata/sf0.001").collect()
    n = sum(r.n for r in got if r.part == "level")
    assert n == 12 * base.table(spark, "/root/testdata/sf0.001", "customer").count()
    plan, counted = kept[-1]
    assert counted.columns == ["status", "action", "level", "priority", "ties"] and counted.agg(F.sum("ties")).first()[0] == n
    assert counted.count() == counted.select("status", "action", "level", "priority").distinct().count() < n
    assert "broad_source:" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_dealt_over_tasks_by_number(spark, monkeypatch):
    """What few tasks wrote is dealt anew before each record meets twelve rules."""
    monkeypatch.setattr(rel, "PART_ROWS", 10)
    n = base.table(spark, "/root/testdata/sf0.001", "customer").count()
    sizes = registry.queries()["claim_rules"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 12 * n and max(r["count"] for r in sizes) < 12 * 30
