import json

import pytest
from cohortlab.operators import responders as R


def test_registry():
    assert {"echo", "neutral"} <= set(R.backends()) and json.loads(R.backend("neutral", items=2)("x")) == {"answers": [3, 3]}
    R.register("loud", lambda mark: lambda request: request.upper() + mark)
    assert R.backend("loud", mark="!")("a") == "A!"
    with pytest.raises(ValueError, match="no backend"):
        R.backend("nobody")


def test_retry_waits_longer_each_time():
    calls, waits = [], []

    def flaky(request):
        calls.append(request)
        if len(calls) < 3:
            raise TimeoutError("timed out")
        return "done"

    assert R.Retry(3, 0.5).call(flaky, "q", waits.append) == ("done", 3) and waits == [0.5, 1.0]
    with pytest.raises(ValueError, match="bad key"):
        R.Retry(3).call(lambda r: (_ for _ in ()).throw(ValueError("bad key")), "q", waits.append)
    assert len(waits) == 2  # no wait for an error that stays


@pytest.mark.parametrize("reply", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} as asked', '{"a": 1,}'])
def test_repair(reply):
    assert R.repaired(reply) == {"a": 1}


def test_failures_are_rows(spark):
    def responder(request):
        if request == "bad":
            raise ValueError("no way")
        if request.startswith("odd"):
            return '{"n": 2}' if "The last reply was wrong" in request else '{"n": 1}'
        return '{"n": 2, "text": "%s"}' % request

    rows = [(i, t, "x") for i, t in enumerate(["fine", "bad", None, "odd", "fine"])]
    df = spark.createDataFrame(rows, "request_no bigint, request string, status string").repartition(3)
    even = lambda d: None if d["n"] % 2 == 0 else "n must be even"
    got = {r["request_no"]: r for r in R.run(df, responder, check=even, retry=R.Retry(1)).collect()}
    assert [got[i]["status"] for i in range(5)] == ["ok", "failed", "failed", "ok", "ok"]
    assert "no way" in got[1]["error"] and "no request" in got[2]["error"] and json.loads(got[3]["reply"]) == {"n": 2} and got[3]["tries"] == 2
    back = {r["request_no"]: r for r in R.run(df, responder, check=even, fallback=lambda q: '{"n": 0}', retry=R.Retry(1)).collect()}
    assert back[1]["fallback"] and back[1]["status"] == "ok" and "no way" in back[1]["error"] and back[2]["status"] == "failed"
    log = {(r["status"], r["fallback"]): r["n"] for r in R.call_log(R.run(df, responder, retry=R.Retry(1))).collect()}
    assert log == {("ok", False): 3, ("failed", False): 2}
    assert R.run(df.limit(0), responder).count() == 0


def test_stages_see_what_came_before(spark):
    first = lambda q: json.dumps({"seen": sorted(json.loads(q)["before"])})
    last = lambda q: json.dumps({"seen": sorted(json.loads(q)["before"])}) if json.loads(q)["request"] != "b" else "nothing"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "request_no bigint, request string")
    got = {r["request_no"]: r for r in R.staged(df, [("core", first), ("social", last)]).collect()}
    assert json.loads(got[1]["reply"]) == {"core": {"seen": []}, "social": {"seen": ["core"]}}
    assert got[2]["status"] == "failed" and got[2]["stage"] == "social"


def test_student_answers(spark):
    df = spark.createDataFrame([(0.9, 0.8, 0.0, 0.0, 0.3), (None, 0.0, 0.0, 0.0, 0.3)], "t double, extremity_preference double, fatigue_compression double, uncertainty_preference double, acquiescence double")
    assert [r["answer"] for r in R.student_answers(df, "t").collect()] == [5, 3]
