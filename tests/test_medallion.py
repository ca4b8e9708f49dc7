import json

from meridia.plans import medallion


def test_medallion_job(spark):
    out = medallion.run(spark, "/root/testdata/sf0.001", "m_")
    n = out["silver_entities"].count()
    assert n == out["bronze_entities"].count() == out["features_entities"].count() > 0
    assert 0 < out["gold_review_queue"].count() <= n
    board = out["gold_gap_board"].orderBy("gap_rank").collect()
    assert [r.gap_rank for r in board] == list(range(1, len(board) + 1))
    assert [r.care_gap for r in board] == sorted((r.care_gap for r in board), reverse=True)
    assert {x["driver"] for x in json.loads(board[0].drivers_json)} == {"need", "trust_gap", "quality"}
    assert spark.table("m_v_gap_board").count() == len(board)
    for table in ("silver_providers", "silver_locations", "silver_quality", "gold_confidence"):
        assert out[table].count() == n
    assert out["silver_geographies"].count() == out["features_districts"].count()
    assert out["gold_recommendations"].count() == 7 * out["features_districts"].count()
    medallion.run(spark, "/root/testdata/sf0.001", "m_")  # runs again over its own tables
