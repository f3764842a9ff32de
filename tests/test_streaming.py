import datetime as dt

from cohortlab.streaming import elites

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "candidate_id string, island_id int, fitness double, evaluated boolean, recorded_at timestamp, operator_id string, reward double"


def run(spark, tmp_path, batches, make, mode):
    """Feeds the batches one after the other, each in a run of its own that goes on from the last checkpoint."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))

        def keep(batch, _):
            if mode == "complete":
                out.clear()
            out.extend(batch.collect())

        make(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def row(c, i, f, e=True, d=0, op="a", r=0.0):
    return (c, i, f, e, T0 + dt.timedelta(days=d), op, r)


def test_island_elites(spark, tmp_path):
    got = run(spark, tmp_path, [[row("x", 1, 0.2), row("y", 1, float("nan")), row("z", 2, 0.1, False)], [row("w", 1, 0.3), row("v", 1, 0.3)]], elites.island_elites, "complete")
    assert {(r["island_id"], r["candidate_id"], r["fitness"], r["n"]) for r in got} == {(1, "v", 0.3, 3)}


def test_windows_and_late_rows(spark, tmp_path):
    got = run(spark, tmp_path, [[row("a", 1, 0.2)], [row("b", 1, 0.4, d=9)], [row("late", 1, 0.9)], [row("c", 1, 0.1, d=20)]], lambda s: elites.windowed(s, "recorded_at"), "append")
    assert (T0, 1, 1) in {(r["day"], r["island_id"], r["n"]) for r in got}  # the late row isn't in it


def test_first_deliveries(spark, tmp_path):
    got = run(spark, tmp_path, [[row("a", 1, 0.2), row("a", 1, 0.2)], [row("a", 1, 0.2, d=1)]], lambda s: elites.first_deliveries(s, ["candidate_id"], "recorded_at"), "append")
    assert len(got) == 1


def test_running_rewards(spark, tmp_path):
    got = run(spark, tmp_path, [[row("a", 1, 0.0, r=0.1), row("b", 1, 0.0, r=0.3)], [row("c", 1, 0.0, r=-0.2)]], elites.running_rewards, "update")
    last = max(got, key=lambda r: r["n"])
    assert last["n"] == 3 and abs(last["mean"] - 0.2 / 3) < 1e-9
