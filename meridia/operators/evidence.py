"""What a raw record's fields are worth: statuses, join and place quality, gap counts, evidence scores and the gates on them.

Weights, cut-offs and names of codes are fixed values of the scoring policy. ``derive`` adds everything in one pass
over the records, beside one small table of cohort sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators.impute import with_peers
from meridia.operators.scores import flag, in_box, weighted

AS_OF = "2026-06-16"
MOST = {"capacity": 5000, "doctors": 5000, "followers": 1_000_000, "posts": 100_000}  # beyond these a number is an outlier


def outlier(value: Column, most: float) -> Column:
    return F.coalesce(value > most, F.lit(False))


def parse_status(raw: Column, value: Column, is_outlier: Column) -> Column:
    """Status of a parsed number; an outlier counts before an unparsed text, that before an empty one."""
    said = F.size(text.semantic_items(raw)) > 0
    return (
        F.when(F.coalesce(is_outlier, F.lit(False)), "observed_extreme_outlier").when(~said, "missing_semantic")
        .when(value.isNull(), "present_unparseable").otherwise("observed_valid")
    )


def join_strategy(pin: Column, pin_known: Column, score: Column) -> Column:
    """How a record came to its district; ``score`` is that of the district match, null without one."""
    joined = score.isNotNull()
    return (
        F.when(joined & pin_known & (score == 1), "pincode_district_state_exact").when(joined & pin_known, "pincode_district_state_fuzzy")
        .when(joined, "facility_city_state_fallback").when(pin_known, "pincode_only_no_health_match").when(pin.isNull(), "no_valid_pincode").otherwise("unjoined")
    )


def join_confidence(strategy: Column, ambiguous: Column) -> Column:
    exact = F.when(F.coalesce(ambiguous, F.lit(False)), 0.82).otherwise(0.95)
    return (
        F.when(strategy == "pincode_district_state_exact", exact).when(strategy == "pincode_district_state_fuzzy", 0.72)
        .when(strategy == "facility_city_state_fallback", 0.55).otherwise(0.0)
    )


def join_reason(strategy: Column, ambiguous: Column) -> Column:
    return (
        F.when(strategy == "no_valid_pincode", "No parseable six-digit Indian PIN code.")
        .when(strategy == "pincode_only_no_health_match", "PIN code matched India Post but no district/state match in NFHS.")
        .when(F.coalesce(ambiguous, F.lit(False)), "PIN code maps to multiple districts or states in India Post.")
        .when(strategy == "pincode_district_state_fuzzy", "District spelling required fuzzy matching within the same state.")
        .when(strategy == "facility_city_state_fallback", "No PIN bridge; used facility city/state as district/state proxy.")
        .otherwise("Exact PIN-to-district-to-health join.")
    )


def geo_quality(lat: Column, lon: Column, km: Column) -> Column:
    """missing, outside the box, far (over 250 km from the PIN's centre), moderate (over 50), else plausible."""
    return (
        F.when(lat.isNull() | lon.isNull(), "missing").when(~in_box(lat, lon), "outside").when(km > 250, "far").when(km > 50, "moderate").otherwise("plausible")
    )


def gap_count() -> Column:
    """How many of capacity, doctors, year, recency and equipment are not observed."""
    gaps = [F.col("capacity_status") != "observed_valid", F.col("doctors_status") != "observed_valid", F.col("year_status") != "observed_valid",
            F.col("recency") != "valid", ~F.col("has_equipment")]
    return sum((g.cast("long") for g in gaps), F.lit(0).cast("long"))


def supply_confidence() -> Column:
    sure = lambda c: F.col(c).isin("observed", "medium")
    return stats.half_up(
        weighted(
            [(flag(sure("capacity_confidence")), 0.24, 0), (flag(sure("doctors_confidence")), 0.24, 0), (flag(F.col("has_equipment")), 0.18, 0),
             (flag(F.col("recency").isin("valid", "stale")), 0.14, 0), (flag(F.col("year_status") == "observed_valid"), 0.10, 0), (flag(F.col("has_source")), 0.10, 0)]
        ),
        3,
    )


def semantic_quality() -> Column:
    score = weighted([(F.col("supply_confidence"), 0.45, 0), (1 - F.col("gaps") / 5.0, 0.25, 0), (flag(F.col("has_source")), 0.15, 0), (flag(F.col("has_contact")), 0.15, 0)])
    return stats.half_up(stats.clip01(score), 3)


def readiness() -> Column:
    """.70 of what can be located, joined, cited and reached, .30 of the semantic quality; an unknown ambiguity counts as one."""
    first = weighted(
        [(flag(F.col("pin").isNotNull()), 0.18, 0), (flag(F.col("match_score").isNotNull()), 0.22, 0), (flag(in_box(F.col("lat"), F.col("lon"))), 0.14, 0),
         (1 - F.coalesce(F.col("pin_ambiguous"), F.lit(True)).cast("double"), 0.08, 0), (flag(F.col("has_source")), 0.12, 0), (flag(F.col("claim_fields") >= 3), 0.16, 0),
         (flag(F.col("has_contact")), 0.10, 0)]
    )
    return stats.half_up(0.70 * stats.half_up(first, 3) + 0.30 * F.col("semantic_quality"), 3)


def gates() -> dict[str, Column]:
    """critical_gap, needs_review, trusted and contradicted, from the scores of a record."""
    extreme = F.col("capacity_outlier") | F.col("doctors_outlier")
    bad_date = F.col("recency").isin("invalid", "future")
    critical = (F.col("gaps") >= 3) | extreme | bad_date
    return {
        "critical_gap": critical,
        "needs_review": (F.col("readiness") < 0.65) | (F.col("semantic_quality") < 0.45) | critical | (F.col("join_confidence") < 0.8)
        | (F.col("geo_quality") != "plausible") | (F.col("claim_fields") < 2),
        "trusted": (F.col("readiness") >= 0.8) & (F.col("join_confidence") >= 0.8) & (F.col("geo_quality") == "plausible") & F.coalesce("has_source", F.lit(False))
        & (F.col("claim_fields") >= 3) & (F.col("supply_confidence") >= 0.65) & ~extreme & ~bad_date,
        "contradicted": F.col("geo_quality").isin("outside", "far") | extreme,
    }


def derive(raw: DataFrame) -> DataFrame:
    """Add to raw records all that this module knows of them, in the order in which the parts depend on each other."""
    claims = ("description", "specialties", "procedure", "equipment", "capability")
    df = raw.withColumns({"capacity": text.first_int(F.col("capacity_raw")).cast("double"), "doctors": text.first_int(F.col("doctors_raw")).cast("double"), "year": text.year(F.col("year_raw"))} | text.service_signals(F.col("claim_text")))
    df = df.withColumns({f"{c}_outlier": outlier(F.col(c), MOST[c]) for c in ("capacity", "doctors")})
    df = df.withColumns(
        {f"{c}_status": parse_status(F.col(f"{c}_raw"), F.col(c), F.col(f"{c}_outlier")) for c in ("capacity", "doctors")}
        | {
            "year_status": parse_status(F.col("year_raw"), F.col("year"), F.lit(False)), "recency": text.recency(F.col("page_date"), AS_OF)["status"],
            "claim_fields": sum((F.col(f"has_{c}").cast("long") for c in claims), F.lit(0).cast("long")), "geo_quality": geo_quality(F.col("lat"), F.col("lon"), F.col("km")),
            "join_strategy": join_strategy(F.col("pin"), F.col("pin_known"), F.col("match_score")),
        }
    )
    df = df.withColumn("join_confidence", join_confidence(F.col("join_strategy"), F.col("pin_ambiguous"))).withColumn("gaps", gap_count())
    df = with_peers(df, {c: F.col(f"{c}_status") == "observed_valid" for c in ("capacity", "doctors")})
    for name, score in (("supply_confidence", supply_confidence()), ("semantic_quality", semantic_quality()), ("readiness", readiness())):
        df = df.withColumn(name, score)
    return df.withColumns(gates())
