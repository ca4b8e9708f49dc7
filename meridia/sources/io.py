"""Tables in and out: probing, tolerant reads, provenance, keys, views, and append-only logs with latest-row views."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


SMALL = 10_000  # rows that a table written as one text may have


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def first_existing(spark: SparkSession, *names: str) -> str:
    for n in names:
        if table_exists(spark, n):
            return n
    raise LookupError(f"none of these tables exists: {', '.join(names)}")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_available(spark: SparkSession, candidates: Sequence[str], schema: T.StructType) -> DataFrame:
    """The first view, table or Parquet/CSV path that exists, else an empty frame of the schema; never raises."""
    for c in candidates:
        if "/" in c:
            if path_exists(spark, c):
                return read_csv(spark, c, schema) if c.endswith(".csv") else spark.read.parquet(c)
        elif table_exists(spark, c):
            return spark.table(c)
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header, quoted newlines and doubled quotes; all columns text where no schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def optional_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """The CSV at a path, None where there is none or it cannot be read: its first row is read here and now."""
    if not path_exists(spark, path):
        return None
    try:
        df = read_csv(spark, path)
        df.take(1)
    except Exception:  # unreadable counts as missing
        return None
    return df


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The Parquet table at the path; computed and written first where there is none."""
    if not path_exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def tolerant_select(df: DataFrame, wanted: dict[str, str], fallback: dict[str, str] | None = None) -> DataFrame:
    """Columns by name and type: the real one (cast without raising), else a SQL expression, else a typed null."""
    fallback = fallback or {}
    out = []
    for name, kind in wanted.items():
        if name in df.columns:
            out.append(F.col(name).try_cast(kind).alias(name))
        else:
            out.append(F.expr(fallback.get(name, "NULL")).cast(kind).alias(name))
    return df.select(*out)


def record_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 over all columns as text, nulls as ∅, parts joined by ||."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns or df.columns)), 256)


def add_provenance(df: DataFrame, source_name: str, source_url: str, run_id: str) -> DataFrame:
    return df.withColumns(
        {
            "record_hash": record_hash(df), "source_name": F.lit(source_name), "source_url": F.lit(source_url),
            "ingested_at": F.current_timestamp(), "ingestion_run_id": F.lit(run_id),
        }
    )


def ingest(df: DataFrame, table: str, source_name: str, source_url: str, run_id: str) -> DataFrame:
    add_provenance(df, source_name, source_url, run_id).write.mode("overwrite").option("overwriteSchema", True).saveAsTable(table)
    return df.sparkSession.table(table)


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a null key, keys that repeat."""
    null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(null).alias("null_key"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("null_key") == 1, F.col("n")).otherwise(0)).alias("n_null_keys"),
        F.count_if((F.col("n") > 1) & (F.col("null_key") == 0)).alias("n_repeated_keys"),
    )


def assert_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = key_report(df, keys).first()
    if (r.n_null_keys or 0) or r.n_repeated_keys:
        raise ValueError(f"{', '.join(keys)} is no key: {r.n_null_keys} rows without it, {r.n_repeated_keys} repeated")
    return df


def save_keyed(df: DataFrame, table: str, keys: Sequence[str], comment: str = "") -> DataFrame:
    """Write a table whose keys are unique and not null, and describe it."""
    assert_key(df, keys).write.mode("overwrite").option("overwriteSchema", True).saveAsTable(table)
    if comment:
        df.sparkSession.sql(f"COMMENT ON TABLE {table} IS :text", args={"text": comment})
    return df.sparkSession.table(table)


# What each serving view shows of its gold table.
VIEWS = {
    "v_risk_map": (
        "geography_id", "geography_name", "state", "district", "medical_desert_risk_score", "risk_band", "top_risk_drivers", "provider_gap_score", "travel_burden_score",
        "vulnerability_score", "confidence_score", "provider_count_total", "trustworthy_provider_count", "district_uncertainty_level", "planning_category", "model_version",
        "scored_at",
    ),
    "v_intervention_recommender": (
        "geography_id", "state", "district", "rank", "intervention_type", "expected_impact_score", "expected_access_gain", "implementation_complexity_score",
        "recommendation_confidence", "p_addresses_need", "p_wrong", "trigger_signals", "why_recommended", "data_limitations", "not_recommended_flag", "not_recommended_reason",
        "model_version", "created_at",
    ),
    "v_provider_confidence": (
        "canonical_provider_id", "provider_name", "facility_type", "state", "district", "latitude", "longitude", "source_count", "has_source_urls", "has_contact_evidence",
        "geo_valid_flag", "pin_district_consistent_flag", "contradicted_flag", "needs_human_review", "provider_confidence_score", "confidence_band", "validity_posterior",
        "validity_action", "conformal_set", "conformal_decision", "conflict_summary", "last_verified_or_seen", "source_urls",
    ),
    "v_scenario_simulator": (
        "scenario_id", "geography_id", "state", "district", "intervention_type", "assumptions_json", "risk_score_before", "risk_score_after", "access_improvement_score",
        "estimated_population_helped", "confidence_band", "model_version", "created_at",
    ),
    "v_review_queue": (
        "canonical_provider_id", "facility_name", "facility_type", "state", "district", "review_priority", "primary_concern", "confidence_band", "provider_confidence_score",
        "geo_quality", "officialPhone", "email", "officialWebsite", "source_urls", "model_version", "created_at",
    ),
}
VIEW_ORDER = {"v_review_queue": "review_priority"}


def create_views(spark: SparkSession, gold: dict[str, DataFrame]) -> list[str]:
    """The serving views over gold frames that are at hand (view -> frame); columns that a frame lacks are null."""
    made = []
    for name, df in gold.items():
        columns = VIEWS[name]
        out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
        if name in VIEW_ORDER:
            out = out.orderBy(F.desc(VIEW_ORDER[name]))
        out.createOrReplaceTempView(name)
        made.append(name)
    return made


def serving_view(df: DataFrame, name: str, columns: Sequence[str]) -> None:
    df.select(*columns).createOrReplaceTempView(name)


# ------------------------------------------------------------------- logs


# The columns of the append-only logs, which their writers and readers share.
_REVIEW = "notes string, reviewer string, status string, policy_version string, created_at string"
LOGS = {
    "reviewer_feedback": f"feedback_id string, geography_id string, feedback_type string, payload string, {_REVIEW}",
    "recommendation_overrides": f"override_id string, geography_id string, original_intervention string, chosen_intervention string, {_REVIEW}",
    "scenario_decisions": f"scenario_id string, geography_id string, assumptions string, {_REVIEW}",
    "provider_corrections": f"correction_id string, canonical_provider_id string, geography_id string, field string, corrected_value string, {_REVIEW}",
    "intervention_outcomes": f"outcome_id string, geography_id string, intervention_type string, outcome_metric string, outcome_value double, observed_at string, {_REVIEW}",
    "decisions": "decision_id string, unique_id string, decision_type string, field_name string, old_value string, new_value string, note string, reviewer string, created_at string",
    "shortlist": "event_id string, unique_id string, facility_name string, reason string, removed boolean, created_at string",
}
DEFAULTS = {"status": "pending"}  # of columns that a writer may leave out


def create_logs(spark: SparkSession, prefix: str = "") -> list[str]:
    names = []
    for name, columns in LOGS.items():
        names.append(prefix + name)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {names[-1]} ({columns}) USING parquet")
    return names


def append_row(spark: SparkSession, table: str, values: dict) -> bool:
    """Append one row and say whether it was taken: an unknown column is refused, a missing one gets its default or null.

    created_at defaults to now in ISO form, the log's own id (its first column) to a new one.
    """
    schema = spark.table(table).schema
    if not set(values) <= set(schema.names):
        return False
    filled = {schema.names[0]: str(uuid.uuid4())} | {k: v for k, v in DEFAULTS.items() if k in schema.names} | {k: v for k, v in values.items() if v is not None}
    row = spark.createDataFrame([tuple(filled.get(f.name) for f in schema)], schema)
    if "created_at" in schema.names and not values.get("created_at"):
        row = row.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    row.write.mode("append").insertInto(table)
    return True


def remove(spark: SparkSession, table: str, key: str, value: str, deleted: str = "removed") -> bool:
    """Delete a key by a tombstone: its newest row says it is gone, older ones stay for the record."""
    return append_row(spark, table, {key: value, deleted: True})


def list_current(spark: SparkSession, table: str, key: str, deleted: str = "removed") -> DataFrame:
    """The newest row of each key that is not gone, newest first."""
    log = spark.table(table)
    return latest(log, key, ["created_at"], F.col(deleted)).orderBy(F.desc("created_at"))


def query_table(spark: SparkSession, sql: str, empty: T.StructType | None = None, **args) -> DataFrame:
    """An ad-hoc query with named parameters; where ``empty`` is given, an empty frame of it instead of a failed analysis."""
    from pyspark.errors import AnalysisException

    try:
        return spark.sql(sql, args=args or None)
    except AnalysisException:
        if empty is None:
            raise
        return spark.createDataFrame([], empty)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind, n): tables and views with their row counts, by name."""
    rows = [(t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table", spark.table(t.name if t.isTemporary else f"{database}.{t.name}" if database else t.name).count())
            for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, n long").orderBy("name")


def sql_literal(value) -> str:
    """A value as a SQL literal: quotes doubled, backslashes kept, nothing as NULL."""
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_sql(rows: Sequence[Sequence], names: Sequence[str]) -> str:
    """A literal table as SQL text."""
    body = ",\n  ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)
    return f"SELECT * FROM VALUES\n  {body}\nAS t({', '.join(names)})"


PARSED = "house string, road string, city string, district string, state string, pin string, confidence double"


def with_parsed(candidates: DataFrame, parsed: DataFrame | None, key: str) -> DataFrame:
    """Candidates beside a table of parsed addresses, whoever made it; a frame of nulls where there is none yet.

    Columns that the table lacks are null, numbers that do not parse are null, and of several answers the surest counts.
    """
    wanted = {c.split()[0]: c.split()[1] for c in PARSED.split(", ")}
    if parsed is None:
        return candidates.withColumns({f"parsed_{k}": F.lit(None).cast(t) for k, t in wanted.items()})
    answers = tolerant_select(parsed, {key: candidates.schema[key].dataType.simpleString()} | wanted)
    best = Window.partitionBy(key).orderBy(F.desc_nulls_last("confidence"), *(F.asc_nulls_last(k) for k in wanted if k != "confidence"))
    answers = answers.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(key, *(F.col(k).alias(f"parsed_{k}") for k in wanted))
    return candidates.join(answers, key, "left")


def read_log(log: DataFrame, **equal) -> DataFrame:
    """Rows that match, newest first."""
    for k, v in equal.items():
        log = log.where(F.col(k) == v)
    return log.orderBy(F.desc("created_at"))


def latest(log: DataFrame, key: str, order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """Upsert view: the newest row of each key; keys whose newest row is a tombstone are gone."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    out = log.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    return out.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else out


def union_logs(*logs: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Several logs as one, rows of equal key once (the newest), newest first."""
    whole = logs[0]
    for x in logs[1:]:
        whole = whole.unionByName(x, allowMissingColumns=True)
    newest = Window.partitionBy(*key).orderBy(F.desc(order))
    return whole.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n").orderBy(F.desc(order))


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]", "")


def metadata_index(records: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(key, record columns): records by any of their alternate keys, folded; of equal keys the last record wins."""
    folded = F.array(*(_folded(F.col(k)) for k in keys))
    long = records.withColumn("lookup_key", F.explode(F.array_distinct(F.filter(folded, lambda x: F.coalesce(x, F.lit("")) != ""))))
    last = Window.partitionBy("lookup_key").orderBy(F.desc(order))
    return long.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def lookup_any(df: DataFrame, key: str, tries: Sequence[Column], index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key, place, columns): what ``index`` (of ``lookup_key``) holds for the first of a row's keys that it knows.

    ``tries`` are the row's alternate keys, the best first; ``place`` tells which one met. All keys of all rows meet the
    index in one equality join and the smallest place wins, so there is no join by "or". Rows that meet nothing are
    left out; blank and null keys meet nothing.
    """
    told = F.array(*(F.struct(F.lit(i).alias("place"), _folded(c).alias("lookup_key")) for i, c in enumerate(tries)))
    long = df.select(key, F.explode(F.filter(told, lambda x: F.coalesce(x["lookup_key"], F.lit("")) != "")).alias("t")).select(key, "t.*")
    met = long.join(index.select("lookup_key", *columns), "lookup_key")
    return met.groupBy(key).agg(F.min(F.struct("place", *columns)).alias("m")).select(key, "m.*")


# ------------------------------------------------------------------- sinks


def write(df: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """Parquet, ORC, CSV (header, doubled quotes), JSON lines or one text column, as many files as there are tasks.

    ``pretty`` and ``sql`` are for small tables: one indented JSON list, or a literal table as SQL text, in one file.
    """
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind in ("parquet", "json", "text", "orc"):
        getattr(writer, kind)(path)
    elif kind in ("pretty", "sql"):
        rows = [r.asDict() for r in df.limit(SMALL + 1).collect()]
        if len(rows) > SMALL:
            raise ValueError(f"more than {SMALL} rows are no {kind} table")
        text = json.dumps(rows, indent=2, default=str, ensure_ascii=False) if kind == "pretty" else values_sql([list(r.values()) for r in rows], df.columns)
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(path)
    else:
        raise ValueError(f"no sink for {kind}")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, a JSON list, one object, or {"records": [...]}: one row per record."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    inner = kind if kind.startswith("struct<") else T._parse_datatype_string(kind).simpleString()
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    whole = F.when(F.col("v").startswith("["), F.from_json("v", f"array<{inner}>"))
    nested = F.from_json("v", f"struct<records:array<{inner}>>")["records"]
    lines = F.transform(F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, inner))
    one = F.array(F.from_json("v", inner))
    many = F.when(F.col("v").rlike(r"\}\s*\r?\n\s*\{"), lines)
    return text.select(F.explode(F.coalesce(whole, nested, many, one)).alias("r")).select("r.*")


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small report table as Markdown; at most ``most`` rows come to the driver."""
    rows = [[str(v) if v is not None else "" for v in r] for r in df.limit(most).collect()]
    lines = [df.columns, ["-"] * len(df.columns), *rows]
    return "\n".join("|" + "|".join(x) + "|" for x in lines)
