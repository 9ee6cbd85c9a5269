import json
import os

import pytest

from plenaria.streaming.states import ResponseStates
from plenaria.streaming.tail import GrowingFile, TailCount, complete_lines


def test_tail_counts_complete_lines_only(tmp_path):
    path = str(tmp_path / "x.jsonl")
    tail = TailCount("s-\\d+")
    assert tail.update(path) == 0
    with open(path, "w") as f:
        f.write('{"id": "s-1"}\n{"id": "s-')
    assert tail.update(path) == 1 and tail.last_id == "s-1"
    with open(path, "a") as f:
        f.write('2"}\n')
    assert tail.update(path) == 2 and tail.last_id == "s-2"
    os.rename(path, path + "2")
    assert tail.update(path + "2") == 2
    with open(path, "w") as f:
        f.write("{}\n")
    assert tail.update(path) == 1 and tail.last_id is None


def test_long_lines(tmp_path):
    path = str(tmp_path / "x")
    open(path, "w").write("a" * 100 + "\nb\n")
    lines, end = complete_lines(path, {"inode": -1, "byte": 0}, 8)
    assert lines == ["a" * 100, "b"] and complete_lines(path, end, 8)[0] == []


def test_growing_file_stream(spark, tmp_path):
    path, out = str(tmp_path / "x.jsonl"), []
    spark.dataSource.register(GrowingFile)
    start = lambda: spark.readStream.format("growing_file").option("path", path).load().writeStream.foreachBatch(lambda b, _: out.extend(r.value for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    open(path, "w").write("one\n\ntwo\nthr")
    query = start()
    query.processAllAvailable()
    assert sorted(out) == ["one", "two"]
    open(path, "a").write("ee\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(out) == ["one", "three", "two"]


def requests(spark, *keys):
    return spark.createDataFrame([(k, f"text {k}") for k in keys], "fingerprint string, text string")


def test_a_request_is_sent_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    states = ResponseStates(spark, str(tmp_path / "states"))

    def send(key, text):
        with open(calls, "a") as f:
            f.write(key + "\n")
        if key == "bad":
            raise OSError("broken")
        return {"task_id": "t-" + key} if key == "slow" else {"response": json.dumps({"of": text})}

    states.submit(requests(spark, "a", "a", "slow", "bad"), send)
    states.submit(requests(spark, "a", "slow", "bad", "b"), send)
    assert sorted(open(calls).read().split()) == ["a", "b", "bad", "slow"]
    got = {r.fingerprint: r for r in states.latest().collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "complete", "b": "complete", "slow": "pending", "bad": "submission_unknown"} and "broken" in got["bad"].error
    states.poll(lambda key, task: {})
    states.poll(lambda key, task: {"response": task})
    assert states.responses(requests(spark, "slow", "bad")).select("fingerprint", "response").collect() == [("slow", "t-slow")]
    states.reset(["bad", "a"])
    states.submit(requests(spark, "bad", "a"), lambda key, text: {"response": "ok"})
    assert {r.fingerprint: r.response for r in states.latest().collect()}["bad"] == "ok" and states.latest().where("status = 'complete'").count() == 4


def test_two_writers_and_tried_tasks_send_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    one, two = ResponseStates(spark, str(tmp_path / "states")), ResponseStates(spark, str(tmp_path / "states"))

    def send(key, text):
        with open(calls, "a") as f:
            f.write(key + "\n")
        if key == "b":  # the other writer comes in while this one sends
            raise OSError("broken: pipe")
        return {"response": text}

    # a claim of another writer, whose send is under way, is left alone
    two.claims.take("c")
    one.submit(requests(spark, "a", "b", "c"), send)
    two.submit(requests(spark, "a", "b", "c", "d"), send)
    assert sorted(open(calls).read().split()) == ["a", "b", "d"]
    assert [tuple(r)[1:] for r in one.errors().collect()] == [("b", "OSError", "broken: pipe")]
    assert {r.fingerprint: r.status for r in two.latest().collect()} == {"a": "complete", "b": "submission_unknown", "c": "submission_unknown", "d": "complete"}
    one.reset(["b"])
    with pytest.raises(RuntimeError, match="b: OSError"):
        one.submit(requests(spark, "b"), send, strict=True)
    assert one.poll(lambda key, task: {}, rounds=3, sleep=lambda s: None) == 0


@pytest.mark.parametrize("name", ["stream_distinct_events", "stream_daily_events"])
def test_queries_run_again(spark, name):
    from plenaria.streaming import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    a, b = queries.QUERIES[name](spark, folder), queries.QUERIES[name](spark, folder)
    assert sorted(a.collect()) == sorted(b.collect())
