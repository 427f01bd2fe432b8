"""The fold of histories over batches of rows."""

from __future__ import annotations

from sessionlake.operators import messages


def test_sessions_longer_than_a_batch_and_many_in_one(spark):
    rows = [(f"s{i}", n, "message", None, None, "user", [f"{i}-{n}"], True, True, False, 0) for i in range(40) for n in range(1 + 30 * (i == 7))]
    rows += [("s3", 5, "undo", None, None, None, None, None, None, None, 1), ("s4", None, "undo", None, None, None, None, None, None, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        folded = messages.fold_history(spark.createDataFrame(rows, messages.HISTORY_EVENTS))
        found = {(r.session_id, r.place, *r.texts) for r in folded.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(r[0], r[1], r[6][0]) for r in rows if r[2] == "message" and r[0] != "s3"}
    assert "FlatMapGroupsInPandas" not in folded._jdf.queryExecution().executedPlan().toString()
