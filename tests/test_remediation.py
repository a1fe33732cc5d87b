"""Recommended actions are dealt to tasks by the number of their rows."""

from functools import partial

from lantern.operators import remediation as E
from lantern.runtime import dealt_by


def test_tasks_follow_the_rows(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100)
    assert dealt_by(rows, "id", rows=100, task_rows=10).rdd.getNumPartitions() == 10
    # No fewer tasks than the session's own number.
    assert dealt_by(rows, "id", rows=100, task_rows=100 // own + 1) is rows


def test_recommended_as_when_no_row_is_dealt(spark, monkeypatch):
    actions = spark.createDataFrame([("a", "service", 2, 1), ("b", "service", 1, 2), ("c", "node", 0, 3)], "action_id string, target_type string, risk_level int, lib_seq int")
    states = spark.createDataFrame([(i, f"t{i % 3}", ["service/1", "node/2"] if i % 4 == 0 else ["service/1"]) for i in range(60)], "state_id long, issue_type string, affected_services array<string>")
    learnt = spark.createDataFrame([("t0", "a", 0.9), ("t1", "b", 0.6), ("t2", "c", 0.8)], "issue_type string, action_id string, confidence double")

    def found():
        available = E.available_actions(states, actions)
        predicted = E.predict_action(available, learnt).selectExpr("state_id", "action_id", "confidence", "'rules' as learner", "0 as learner_seq").where("state_id % 5 > 0")
        return E.recommend_action(predicted, available)

    want = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(E, "dealt_by", partial(dealt_by, task_rows=5))
    out = found()
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString() and sorted(map(tuple, out.collect())) == want
    assert want[0] == (0, "c", 0.5, "default") and (3, "a", 0.9, "rules") in want and (4, "c", 0.5, "rules") in want and len(want) == 60
