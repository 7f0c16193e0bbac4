from __future__ import annotations

from weftwork.plans import board_plans


def test_relation_by_the_same_person(spark, tmp_path):
    who = "struct<id string, name string>"
    spark.createDataFrame([
        (1, "w", "i1", ("u1", "A"), "see TEAM-7"), (2, "w", None, ("u2", "B"), "x"), (3, "v", "gone", ("u1", "A"), None), (4, "w", "i2", None, "x"),
    ], f"row_id long, workspace_id string, item_id string, author {who}, body string").write.parquet(f"{tmp_path}/comments.parquet")
    spark.createDataFrame([
        (1, "i1", "w", ("u1", "A"), ("u1", "A"), None), (2, "i2", "w", ("u1", "A"), None, None), (3, "i7", "w", None, ("u2", "B"), None), (4, "i9", "v", None, ("u2", "B"), None),
    ], f"row_id long, item_id string, workspace_id string, assignee {who}, reporter {who}, updated_at timestamp").write.parquet(f"{tmp_path}/service.parquet")
    spark.createDataFrame([("TEAM-7", "i7")], "key string, id string").write.parquet(f"{tmp_path}/sample_jira_tickets.parquet")
    # own: 1-i1, 4-i2; named: 1-i7; same person: 1-i2, 2-i7, while 1-i1 keeps the stronger reason and workspaces stay apart
    assert {r["p"]: r["n"] for r in board_plans.jn23_strongest_relation(spark, str(tmp_path)).collect()} == {0: 2, 1: 1, 2: 2}
