"""The serving side: tiers and labels people read, explanations as rows, map points and cells, centre fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import stats, text
from meridia.operators.relational import keep_first


def gap_is_real(category: Column, need: Column, surveyed: Column) -> Column:
    """How surely a care gap exists, from the need side alone: no record of supply is evidence, not its absence."""
    real = (category == "real_desert_candidate") & F.coalesce(surveyed >= 500, F.lit(False))
    need = F.coalesce(need, F.lit(0.0))
    return F.when(real & (need >= 0.6), "High").when(real & (need >= 0.45), "Medium-High").when(need >= 0.5, "Medium").otherwise("Low")


def supply_evidence(n: Column, rate: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    told = F.concat(n.cast("string"), F.when(n == 1, " record, ").otherwise(" records, "), F.round(F.coalesce(rate, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("% pass checks"))
    return F.when(n == 0, "None: no records").when(n < 8, F.concat(F.lit("Thin: "), told)).otherwise(F.concat(F.lit("Observed: "), told))


def trust_tier() -> Column:
    medium = (F.col("readiness") >= 0.65) & (F.col("join_confidence") >= 0.80) & (F.col("geo_quality") == "plausible")
    return F.when(F.col("trusted"), "High").when(medium, "Medium").otherwise("Verify")


def point_status() -> Column:
    return F.when(F.col("contradicted"), "Contradicted / geo-invalid").when(F.col("needs_review"), "Needs review").when(F.col("trusted"), "Passed checks").otherwise("Unknown")


def explain(df: DataFrame, key: str, signals: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, signal, value, text): one row per signal that is known."""
    rows = F.array(*(F.struct(F.lit(k).alias("signal"), v.cast("double").alias("value"), t.alias("text")) for k, (v, t) in signals.items()))
    return df.select(key, F.explode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.*")


def worst_per_cell(df: DataFrame, cell: Column, worst: str, key: str) -> DataFrame:
    """Where several rows fall into one cell the worst stays; ``shade`` scales it over all cells."""
    out = keep_first(df.withColumn("cell", cell), ["cell"], [F.desc_nulls_last(worst), F.asc(key)])
    return stats.min_max(out, worst, "shade", 0.5).withColumn("shade", F.round("shade", 6))


def centre_fallback(df: DataFrame, points: DataFrame, narrow: str, wide: str) -> DataFrame:
    """Each narrow area's robust centre; of its wide area, else of everything, where it has no points."""
    def middle(keys: list[str], k: str) -> DataFrame:
        lat, lon = (stats.quantiles(points, keys, c, [0.5]).select(*keys, F.col("q")[0].alias(f"{c}_{k}")) for c in ("lat", "lon"))
        return lat.join(lon, keys) if keys else lat.crossJoin(lon)  # one row each without keys

    out = df.join(middle([narrow], "a"), narrow, "left").join(middle([wide], "b"), wide, "left").join(F.broadcast(middle([], "c")), F.lit(True), "left")
    source = F.when(F.col("lat_a").isNotNull(), "own").when(F.col("lat_b").isNotNull(), "wide").otherwise("all")
    return out.withColumn("lat", F.coalesce("lat_a", "lat_b", "lat_c")).withColumn("lon", F.coalesce("lon_a", "lon_b", "lon_c")).withColumn("centre_source", source).drop(
        *(f"{x}_{k}" for x in ("lat", "lon") for k in "abc")
    )


def competing_values(df: DataFrame, key: str, sources: dict[str, str]) -> DataFrame:
    """(key, source, value) for keys whose sources disagree."""
    long = df.unpivot([key], list(sources), "source", "value").where("value is not null")
    split = long.groupBy(key).agg(F.count_distinct("value").alias("n")).where("n > 1").select(key)
    return long.join(split, key, "left_semi")


# What a geocoder's answer is worth a priori, as status, kind, partial, confidence low and high, radius in km, action.
GEOCODER_PRIORS = [
    ("OK", "ROOFTOP", False, 0.86, 0.96, 0.1, "accept_if_admin_and_pincode_match"),
    ("OK", "RANGE_INTERPOLATED", False, 0.68, 0.84, 0.5, "accept_for_planning_if_boundary_checks_pass"),
    ("OK", "GEOMETRIC_CENTER", False, 0.48, 0.68, 3.0, "use_for_neighborhood_only_or_retry_with_landmark"),
    ("OK", "APPROXIMATE", False, 0.2, 0.48, 25.0, "retry_with_landmark_or_alternate_provider"),
    ("OK", "ANY", True, 0.18, 0.6, 15.0, "compare_name_admin_pincode_then_queue_if_high_impact"),
    ("ZERO_RESULTS", "NONE", False, 0.0, 0.18, None, "search_hfr_pmjay_mappls_osm_or_mark_unknown"),
]


def with_prior(df: DataFrame, status: str, location_type: str, partial: str) -> DataFrame:
    """Add low, high, radius_km and prior_action of the six-row prior table (a constant, so its broadcast is bounded)."""
    priors = df.sparkSession.createDataFrame(
        GEOCODER_PRIORS, "__s string, __t string, __p boolean, low double, high double, radius_km double, prior_action string"
    )
    kind = F.when(F.col(status) != "OK", "NONE").when(F.col(partial), "ANY").otherwise(F.col(location_type))
    match = (F.col(status) == F.col("__s")) & (kind == F.col("__t")) & (F.when(F.col(status) == "OK", F.col(partial)).otherwise(F.lit(False)) == F.col("__p"))
    return df.join(F.broadcast(priors), match, "left").drop("__s", "__t", "__p")


def reconciliation(parsed: Column, pin: Column, state: Column, similarity: Column, confidence: Column, precheck: Column) -> Column:
    """First rule that holds decides whether a parsed address may go to a geocoder; a parse without confidence is none."""
    return (
        F.when(~parsed | confidence.isNull(), "llm_parse_missing").when(pin == "conflict", "parsed_pin_conflict").when(state == "conflict", "parsed_state_conflict").when(similarity < 0.72, "parsed_city_district_conflict")
        .when(confidence < 0.65, "low_llm_parse_confidence").when(precheck != "fuzzy_ok", "pre_geocoder_review").otherwise("ready_for_geocoder")
    )


def scope(df: DataFrame, which: str, observed: str = "observed") -> DataFrame:
    """all, with_rows or zero_rows."""
    return {"all": df, "with_rows": df.where(F.col(observed) > 0), "zero_rows": df.where(F.coalesce(F.col(observed), F.lit(0)) == 0)}[which]


def other_area_named(df: DataFrame, names: DataFrame, key: str, block: str, own: str, evidence: str, name: str) -> DataFrame:
    """(key, name): an area of the record's own block, but not its own, that its text names as a phrase; the longest name wins.

    Names meet records by their block, so a record is held against its own block's names only; shorter names than five
    letters prove nothing.
    """
    long_enough = F.length(F.replace(text.key_spaced(F.col(name)), F.lit(" "), F.lit(""))) >= 5
    said = df.join(names.where(long_enough), block).where((text.key_spaced(F.col(name)) != text.key_spaced(F.col(own))) & text.phrase_in(F.col(evidence), F.col(name)))
    return said.groupBy(key).agg(F.max_by(name, F.struct(F.length(name), name)).alias(name))


def scoped_examples(asked: DataFrame, records: DataFrame, scopes: Sequence[str], key: str, order: Sequence[Column], n: int, prefer: Column | None = None, narrow_only: Column | None = None) -> DataFrame:
    """(asked columns, scope, key, place): the first ``n`` records of each asked area's narrowest scope that has any.

    ``scopes`` are columns from narrow to wide (a district and its state: ["district", "state"]), a scope being equal in
    a column and all wider ones; beyond the last there is the whole table. Where a scope has records that ``prefer``
    holds for, only these count there. ``narrow_only``: records it holds for are not used in the narrowest scope.
    Each scope keeps n records before areas meet it, so an area costs n rows a scope however many records there are.
    """
    prefer = F.lit(True) if prefer is None else F.coalesce(prefer, F.lit(False))
    barred = F.lit(False) if narrow_only is None else F.coalesce(narrow_only, F.lit(False))
    marked = records.withColumns({"__prefer": prefer, "__barred": barred})
    order = [F.desc("__prefer"), *order]
    out = None
    for level in range(len(scopes) + 1):
        keys = list(scopes[level:])
        own = marked.where("not __barred") if level == 0 else marked
        if keys:
            own = own.dropna(subset=keys).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)
        else:
            first = own.orderBy(*order).limit(n)
            own = first.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # of n rows
        own = own.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(key).alias("__key"), "__n", "__prefer")
        match = reduce(lambda a, k: a & (F.col(k) == F.col(f"__{k}")), keys, F.lit(True))
        part = asked.join(own if keys else F.broadcast(own), match).select(*asked.columns, F.lit(level).alias("__level"), "__key", "__n", "__prefer")
        out = part if out is None else out.unionByName(part)
    area = Window.partitionBy(*asked.columns)
    kept = out.withColumn("__first", F.min("__level").over(area)).where("__level = __first").withColumn("__some", F.max("__prefer").over(area)).where("__prefer = __some")
    names = F.element_at(F.array(*(F.lit(x) for x in (*scopes, "all"))), F.col("__level") + 1)
    return kept.select(*asked.columns, names.alias("scope"), F.col("__key").alias(key), F.col("__n").cast("long").alias("place"))


def supply_intervals(records: DataFrame, area: str, trusted: str, observed: str, estimate: str, low: str, high: str) -> DataFrame:
    """(area, scenario, facilities, capacity, low, high): best, likely and worst supply of each area, from its records.

    best: all records, and the largest of observed numbers, estimates and upper ends summed. worst: trusted records
    only and their lower ends; where these sum to nothing, the trusted share of all lower ends; never above best.
    likely: between the two in numbers, midway in capacity. ``observed`` is null where a number is not observed.
    """
    known = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0.0))), F.lit(0.0))
    sums = records.groupBy(area).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(trusted, F.lit(False))).alias("sure"), known(observed).alias("seen"), known(estimate).alias("mid"), known(high).alias("top"), known(low).alias("bottom"),
        F.coalesce(F.sum(F.when(F.col(trusted), F.greatest(F.col(low), F.lit(0.0)))), F.lit(0.0)).alias("sure_bottom"),
    )
    best = F.greatest("seen", "mid", "top")
    share = F.col("sure") / F.col("n")
    worst = F.least(F.when(F.col("sure_bottom") > 0, F.col("sure_bottom")).otherwise(F.col("bottom") * share), best)
    likely_n = F.least(F.col("n"), F.greatest(F.col("sure"), F.round(F.col("n") * share).cast("long")))
    rows = F.array(*(
        F.struct(F.lit(name).alias("scenario"), count.cast("long").alias("facilities"), stats.half_up(capacity, 1).alias("capacity"), stats.half_up(lo, 1).alias("low"), stats.half_up(hi, 1).alias("high"))
        for name, count, capacity, lo, hi in (
            ("best", F.col("n"), best, worst, best), ("likely", likely_n, (best + worst) / 2, worst, best), ("worst", F.col("sure"), worst, worst, worst))
    ))
    return sums.select(area, F.explode(rows).alias("x")).select(area, "x.*")
