"""Logs with tombstones, views, small sinks, literals, parsed addresses and ad-hoc queries."""

import json

import pytest
from pyspark.sql import types as T

from meridia.sources import io


def test_every_log_takes_rows_and_refuses_unknown_columns(spark):
    names = io.create_logs(spark, "all_")
    assert len(names) == 7
    for n in names:
        assert io.append_row(spark, n, {"reviewer": "r"} if "reviewer" in spark.table(n).columns else {"unique_id": "u"})
        row = spark.table(n).first()
        assert row[0] and row.created_at and (row.asDict().get("status", "pending") == "pending")
    assert not io.append_row(spark, names[0], {"no_such_column": 1})
    assert spark.table(names[0]).count() == 1


def test_removed_rows_are_listed_no_more(spark):
    io.create_logs(spark, "one_")
    for k, at in (("a", "2026-01-01"), ("b", "2026-01-02")):
        io.append_row(spark, "one_shortlist", {"unique_id": k, "removed": False, "created_at": at})
    assert [r.unique_id for r in io.list_current(spark, "one_shortlist", "unique_id").collect()] == ["b", "a"]
    assert io.remove(spark, "one_shortlist", "unique_id", "b")
    assert [r.unique_id for r in io.list_current(spark, "one_shortlist", "unique_id").collect()] == ["a"]
    assert {r.name for r in io.list_tables(spark).collect()} >= {"one_shortlist"}


def test_views_show_their_columns(spark):
    df = spark.createDataFrame([(1, 3.0, "x"), (2, 9.0, "y")], "canonical_provider_id int, review_priority double, extra string")
    assert io.create_views(spark, {"v_review_queue": df}) == ["v_review_queue"]
    out = spark.table("v_review_queue")
    assert out.columns == list(io.VIEWS["v_review_queue"]) and [r.canonical_provider_id for r in out.collect()] == [2, 1]
    assert len(io.VIEWS) == 5


def test_small_sinks_and_literals(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's \\ so", None, 2.5, True)], "a int, b string, c string, d double, e boolean")
    io.write(df, f"{tmp_path}/j", "pretty")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/j").collect())) == [{"a": 1, "b": "it's \\ so", "c": None, "d": 2.5, "e": True}]
    io.write(df, f"{tmp_path}/s", "sql")
    sql = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/s").collect())
    assert tuple(spark.sql(sql).first())[:4] == (1, "it's \\ so", None, 2.5)
    with pytest.raises(ValueError):
        io.write(df, f"{tmp_path}/x", "xml")


def test_parsed_addresses_are_pluggable(spark):
    c = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.parsed_city for r in io.with_parsed(c, None, "id").collect()] == [None, None]
    p = spark.createDataFrame([("1", "Pune", "0.4"), ("1", "Nashik", "0.9"), ("x", "Goa", "1")], "id string, city string, confidence string")
    assert sorted((r.id, r.parsed_city, r.parsed_confidence, r.parsed_pin) for r in io.with_parsed(c, p, "id").collect()) == [(1, "Nashik", 0.9, None), (2, None, None, None)]


def test_queries_and_optional_files(spark, tmp_path):
    assert io.query_table(spark, "SELECT :n + 1 AS m", n=4).first().m == 5
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert io.query_table(spark, "SELECT a FROM no_such_table", empty=schema).collect() == []
    assert io.optional_csv(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "some.csv").write_text("a,b\n1,\"x\ny\"\n")
    assert [tuple(r) for r in io.optional_csv(spark, f"{tmp_path}/some.csv").collect()] == [("1", "x\ny")]
