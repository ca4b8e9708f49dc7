"""Claims that records make about services: twelve categories looked for in five sections, judged and put in a queue.

The categories, terms, weights and codes are fixed values of the review policy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators.scores import flag, weighted

SECTIONS = ("description", "specialties", "procedure", "equipment", "capability")


@dataclass(frozen=True)
class Rule:
    category: str
    level: str
    weight: float
    fields: tuple[str, ...]
    terms: tuple[str, ...]
    generic: tuple[str, ...] = ()  # terms that say too little by themselves


_ALL = ("specialties", "procedure", "equipment", "capability")

# The rules, in order.
RULES = [
    Rule("maternity", "critical", 1.0, ("specialties", "procedure", "capability"),
         ("maternity", "maternal", "obstetrics", "obstetric", "gynecology", "gynaecology", "normal delivery", "caesarean", "cesarean", "c section",
          "labour room", "labor room", "neonatology", "neonatal", "perinatal", "fetal", "foetal", "ivf", "infertility", "reproductive")),
    Rule("emergency", "critical", 1.0, _ALL,
         ("emergency", "emergency medicine", "pediatric emergency", "paediatric emergency", "trauma", "casualty", "urgent care", "accident", "ambulance",
          "disaster response")),
    Rule("diagnostic", "high", 0.85, _ALL,
         ("diagnostic", "diagnostics", "screening", "ct scan", "mri", "pet ct", "ultrasound", "sonography", "x ray", "xray", "endoscopy", "biopsy", "echo",
          "tmt", "ecg", "ekg"),
         ("diagnostic", "diagnostics", "screening")),
    Rule("surgery", "high", 0.85, ("specialties", "procedure", "capability"),
         ("surgery", "surgical", "operating theatre", "operation theatre", "operating room", "ot", "laparoscopic", "robotic surgery", "transplant",
          "reconstruction", "hysterectomy", "cholecystectomy", "hernia repair", "craniotomy", "laminectomy", "angioplasty"), ("surgery", "surgical", "ot")),
    Rule("cardiology", "high", 0.8, _ALL,
         ("cardiology", "cardiac", "cardiothoracic", "heart", "coronary", "angioplasty", "angiogram", "cath lab", "echocardiography", "echo", "tmt", "ecg",
          "ekg")),
    Rule("oncology", "high", 0.82, _ALL,
         ("oncology", "oncological", "onco", "cancer", "tumor", "tumour", "radiotherapy", "radiation therapy", "chemotherapy", "bone marrow transplant", "bmt",
          "hematology oncology", "haematology oncology")),
    Rule("ophthalmology", "standard", 0.55, _ALL,
         ("ophthalmology", "eye", "cataract", "cornea", "retina", "vitreoretinal", "glaucoma", "oculoplastics", "orbital surgery")),
    Rule("dental", "standard", 0.5, _ALL,
         ("dental", "dentistry", "dentist", "oral medicine", "oral and maxillofacial", "orthodontics", "periodontics", "endodontics", "prosthodontics",
          "implantology")),
    Rule("pharmacy", "standard", 0.5, ("equipment", "capability"),
         ("pharmacy", "pharmaceutical", "drug store", "dispensary", "medicines", "medication", "drug dispensing"), ("medicines", "medication")),
    Rule("lab/imaging", "high", 0.8, _ALL,
         ("laboratory", "lab", "pathology", "radiology", "imaging", "diagnostic radiology", "ct scan", "mri", "pet ct", "ultrasound", "sonography", "x ray",
          "xray", "nuclear medicine", "histopathology", "microbiology", "biochemistry"), ("lab", "laboratory", "imaging")),
    Rule("blood bank", "critical", 0.95, ("procedure", "equipment", "capability"),
         ("blood bank", "blood storage", "blood transfusion", "transfusion medicine", "blood product", "blood products")),
    Rule("ICU/critical care", "critical", 1.0, ("specialties", "equipment", "capability"),
         ("icu", "intensive care", "critical care", "ccu", "nicu", "picu", "hdu", "ventilator", "ventilation")),
]

# Language that promises much or speaks of others.
BROAD = [
    ("all_specialty_services", r"\ball (specialty|speciality|specialties|specialities) services?\b"),
    ("multi_specialty_generic", r"\b(multi\s*super\s*specialty|multi\s*specialty|multispecialty|multi\s*speciality|super\s*specialty|quaternary care)\b"),
    ("directory_listing", r"\b(listed among|listed as|top hospitals?|top clinics?|hospital in .{0,80} offering)\b"),
    ("indirect_affiliation", r"\b(affiliated (with|organization|to)|mentioned as|outside the state listed|referral hospital)\b"),
    ("academic_or_article_context", r"\b(mbbs|medical college|approved and recognized|journal article|pubmed article|article '|research collaboration)\b"),
    ("generic_full_service", r"\b(complete|comprehensive|full range|wide range)\b.{0,40}\b(services?|care|specialties|specialities|facilities)\b"),
]
CAPPED_ITEMS = 50  # a list this long was cut by whoever extracted it
HIGH_NEED, HIGH_PRIORITY = 0.60, 0.50
INDIRECT = ("description", "capability")  # what stands only here, beside broad language, says too little


def sections(claim_text: Column) -> Column:
    """Five sections between " | ", normalised for matching; what is beyond the fifth stays in the fifth."""
    whole = F.regexp_replace(F.coalesce(claim_text, F.lit("")), r"^\s+|\s+$", "")
    parts = F.split(F.when(F.lower(whole).isin("nan", "none", "null", "[]"), "").otherwise(whole), r" \| ", len(SECTIONS))
    return F.array(*(F.coalesce(text.match_text(F.trim(F.get(parts, F.lit(k)))), F.lit("")) for k in range(len(SECTIONS))))


def _padded(section: Column) -> Column:
    apart = F.replace(F.replace(section, F.lit("/"), F.lit(" / ")), F.lit("+"), F.lit(" + "))
    return F.concat(F.lit(" "), apart, F.lit(" "))


def _strings(xs: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def term_hits(padded: Column) -> Column:
    """array(struct(term, at)): terms of all rules that stand in a record's sections, each once, and in which of them.

    A term can stand only where its first word does: the words of a record are looked up among first words, and only
    terms that begin with one of those found are looked for.
    """
    heads: dict[str, list[str]] = {}
    for t in sorted({t for r in RULES for t in r.terms}):
        heads.setdefault(t.split(" ")[0], []).append(t)
    begin = F.create_map(*(x for h, ts in heads.items() for x in (F.lit(h), _strings(ts))))
    words = F.array_distinct(F.filter(F.split(F.array_join(padded, ""), " "), lambda w: w.isin(list(heads))))
    some = F.flatten(F.transform(words, lambda w: F.element_at(begin, w)))
    at = lambda t: F.transform(padded, lambda s: F.contains(s, F.concat(F.lit(" "), t, F.lit(" "))))
    hits = F.transform(some, lambda t: F.struct(t.alias("term"), at(t).alias("at")))
    return F.filter(hits, lambda h: F.array_contains(h["at"], True))


def ruled(hits: Column) -> Column:
    """All rules, each with those of a record's hits that are terms of its own."""
    own = lambda r: F.filter(hits, lambda h: h["term"].isin(list(r.terms)))
    return F.array(
        *(F.struct(F.lit(r.category).alias("category"), F.lit(r.level).alias("level"), F.lit(r.weight).alias("weight"), _strings(r.fields).alias("fields"),
                   _strings(r.generic).alias("generic"), own(r).alias("hits")) for r in RULES)
    )


def broad_labels(found: Column) -> Column:
    """Which broad phrases stand in all sections together."""
    whole = F.array_join(F.filter(found, lambda s: s != ""), " ")
    return text.codes({k: whole.rlike(p) for k, p in BROAD})


def claim_queue(df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every record against every rule: status, evidence, reasons, priority and action; one scan, the rules are a literal.

    ``df`` has claim_text, has_<section> and <section>_items of the five sections, needs_review, trusted, has_source,
    has_website, has_contact, semantic_quality, and need and priority of the record's district. Null flags are false.
    Columns of ``keep`` are passed on.
    """
    known = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("needs_review", "trusted", "has_source", "has_website", "has_contact")}
    observed = F.array(*(F.when(F.col(f"has_{s}"), F.lit(s)) for s in SECTIONS))
    capped = F.array(*(F.when(F.col(f"{s}_items") >= CAPPED_ITEMS, F.lit(s)) for s in SECTIONS))
    base = df.select(
        key, *keep, sections(F.col("claim_text")).alias("found"), F.array_compact(observed).alias("observed_fields"), F.array_compact(capped).alias("capped"),
        *(c.alias(f) for f, c in known.items()), F.coalesce("semantic_quality", F.lit(1.0)).alias("quality"), F.coalesce("need", F.lit(0.0)).alias("need"),
        F.coalesce("priority", F.lit(0.0)).alias("desert"),
    ).withColumns({"broad": broad_labels(F.col("found")), "padded": F.transform("found", _padded)}).drop("found")
    base = base.withColumn("hits", term_hits(F.col("padded"))).drop("padded")  # texts are read once a record; rows of a rule go on without them
    long = base.select(*(c for c in base.columns if c != "hits"), F.inline(ruled(F.col("hits"))))
    some_broad, weak = F.size("broad") > 0, F.col("needs_review") | ~F.col("trusted")
    only_generic = F.forall("hits", lambda h: F.array_contains("generic", h["term"]))
    indirect = some_broad & F.forall("hits", lambda h: ~reduce(or_, (F.get(h["at"], F.lit(k)) for k, s in enumerate(SECTIONS) if s not in INDIRECT)))
    cut_list = weak & some_broad & F.arrays_overlap("capped", "fields")
    status = F.when(F.size("hits") == 0, "missing").when(only_generic | indirect | cut_list, "broad_or_ambiguous").otherwise("observed")
    long = long.withColumn("status", status)
    matched = F.filter(_strings(SECTIONS), lambda s, k: F.exists("hits", lambda h: F.get(h["at"], k)))
    missing, high = F.col("status") == "missing", F.col("level").isin("critical", "high")
    high_need = (F.col("desert") >= HIGH_PRIORITY) | (F.col("need") >= HIGH_NEED)
    urgent, broad_status = high & missing & high_need, F.col("status") == "broad_or_ambiguous"
    told = text.codes(
        {
            "category_not_observed_in_local_claim_text": missing, "broad_or_ambiguous_claim_language": broad_status,
            "source_row_needs_human_review": F.col("needs_review"), "not_trustworthy_supply_signal": ~F.col("trusted"), "missing_source_url": ~F.col("has_source"),
            "missing_official_website": ~F.col("has_website"), "missing_contact_evidence": ~F.col("has_contact"), "low_semantic_quality": F.col("quality") < 0.60,
            "high_impact_observed_claim_requires_verification": high & ~missing, "high_impact_missing_in_high_need_context": urgent,
            "high_medical_desert_priority": F.col("desert") >= HIGH_PRIORITY, "high_health_need": F.col("need") >= HIGH_NEED,
        }
    )
    sources = F.transform(F.slice("broad", 1, 3), lambda b: F.concat(F.lit("broad_source:"), b))
    unsaid = F.transform(F.array_except("fields", "observed_fields"), lambda f: F.concat(F.lit("missing_"), f, F.lit("_claim_field")))
    reasons = F.sort_array(F.array_distinct(F.concat(told, sources, unsaid)))
    doubts = F.col("needs_review") | ~F.col("trusted") | ~F.col("has_source") | ~F.col("has_website") | ~F.col("has_contact") | (F.col("quality") < 0.60)
    long = long.withColumns({"reasons": reasons, "verify": broad_status | (high & ~missing) | urgent | doubts})  # reasons are built only where they are read
    points = 8.0 + weighted(
        [(flag(~missing), 7, 0), (flag(broad_status), 10, 0), (F.col("weight"), 20, 0), (flag(F.col("verify")), 12, 0), (flag(F.col("needs_review")), 8, 0),
         (flag(~F.col("trusted")), 7, 0), (flag(~F.col("has_source")), 6, 0), (flag(~F.col("has_website")), 4, 0), (flag(~F.col("has_contact")), 4, 0),
         (F.col("desert"), 14, 0), (F.col("need"), 12, 0), (F.greatest(F.lit(0.0), 1 - F.col("quality")), 8, 0), (flag(urgent), 12, 0)]
    )
    action = (
        F.when(broad_status, "resolve_broad_or_ambiguous_claim").when(urgent, "verify_or_fill_missing_high_impact_claim")
        .when(F.col("verify") & high & ~missing, "verify_observed_high_impact_claim").when(F.col("verify"), "verify_source_evidence")
        .when(missing, "monitor_missing_local_evidence").otherwise("accept_observed_proxy")
    )
    joined = lambda c: F.array_join(c, "|")
    return long.select(
        key, *keep, "category", "level", "status", "verify", action.alias("action"),
        stats.half_up(F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0)), 3).alias("priority"), joined("reasons").alias("reasons"),
        joined(matched).alias("fields"), joined(F.sort_array(F.transform("hits", lambda h: h["term"]))).alias("keywords"), joined("broad").alias("broad"),
    )


def excerpt(items: Column, keywords: Column, most: int = 8, length: int = 500) -> Column:
    """The list's items that hold a keyword, or all where none does, joined and cut."""
    holds = lambda x: F.exists(keywords, lambda k: F.contains(_padded(text.match_text(x)), F.concat(F.lit(" "), k, F.lit(" "))))
    matched = F.filter(items, holds)
    return text.ellipsis(F.array_join(F.slice(F.when(F.size(matched) > 0, matched).otherwise(items), 1, most), "; "), length)


def contact_types(phone: Column, phones: Column, mail: Column) -> Column:
    """Which kinds of contact evidence there are."""
    said = lambda c: ~text.nullish(c)
    return F.array_join(text.codes({"officialPhone": said(phone), "phone_numbers": F.size(text.parse_list(phones)) > 0, "email": said(mail)}), "|")
