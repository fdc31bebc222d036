"""The titles of history_matches are told apart at size: no other document's post is as near to a target as the SQL takes for granted."""

from __future__ import annotations

from granary import source_queries as Q


def test_no_target_is_nearer_to_another_document(spark, tmp_path):
    """Targets that a title of 16 letters made nearer to the other's post than to their own, or near to it alone."""
    pairs = [(47205, 14301), (50356, 29764), (50518, 33922), (32661, 27693)]
    spark.createDataFrame([(i,) for x in pairs for i in x], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r._ord: r.url for r in Q.history_matches(spark, str(tmp_path)).collect()}
    assert len(got) > 3 and all(u.startswith(f"https://h.example.com/{k}-") for k, u in got.items())
