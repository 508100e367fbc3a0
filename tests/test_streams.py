"""Streams against the batch forms that share their steps."""

import json

from pyspark.sql import functions as F

from millrace.operators import upsert
from millrace.operators.sequential import sequential
from millrace.streaming import live, steps


def drained(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / f"cp-{name}")).start().awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_payload_lines_as_they_land(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        good = json.dumps({"source": "s", "url": f"u{i}", "content": "c", "timestamp": 1_700_000_000 + 60 * i})
        (folder / f"{i}.jsonl").write_text(good + "\nbroken\n")
    got = drained(live.payload_stream(spark, str(folder), 1), "landed", tmp_path)
    assert sorted(r.url for r in got if r.error is None) == ["u0", "u1", "u2"] and sum(r.error is not None for r in got) == 3
    timed = live.payload_stream(spark, str(folder)).where("error IS NULL").withColumn("at", F.timestamp_seconds("timestamp"))
    counts = drained(live.windowed_counts(timed, "at", F.col("source"), "2 minutes", "1 minute"), "counted", tmp_path, "complete")
    assert sum(r.n for r in counts) == 3 and all(r.key == "s" for r in counts)


def test_repeated_content_in_batch_and_stream(spark, tmp_path):
    rows = [(k, i, "abc"[i // 2 % 3] if k else "x") for k in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, text string")
    by_window = {(r.k, r.i) for r in upsert.unrepeated(df, ["k"], ["i"], "text").collect()}
    by_step = {(r.k, r.i) for r in sequential(df, ["k"], ["i"], steps.unrepeated_step(), "passed boolean").where("passed").collect()}
    assert by_window == by_step == {(0, 0), *((1, i) for i in range(0, 12, 2))}
    df.coalesce(1).write.json(str(tmp_path / "rows"))
    stream = live.keyed(spark.readStream.schema(df.schema).json(str(tmp_path / "rows")), ["k"], ["i"], steps.unrepeated_step(), "passed boolean")
    assert {(r.k, r.i) for r in drained(stream, "passed", tmp_path) if r.passed} == by_window


def test_appended_text_in_a_stream(spark, tmp_path):
    texts = ["first line of the text that is kept here", "first line of the text that is kept here", "an entirely different sentence with many unseen expressions in it"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, text string")
    want = [(r.i, r.action, r.stored_hash) for r in sequential(df, ["k"], ["i"], steps.append_step(), "action string, n_added long, stored_hash string").orderBy("i").collect()]
    assert [w[1] for w in want] == ["created", "skipped", "updated"]
    for i in range(3):  # a batch a row, so that the state is kept between them
        df.where(F.col("i") == i).coalesce(1).write.mode("append").json(str(tmp_path / "rows"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "rows"))
    got = drained(live.keyed(source, ["k"], ["i"], steps.append_step(keep=True), "action string, n_added long, stored_hash string"), "appended", tmp_path)
    assert sorted((r.i, r.action, r.stored_hash) for r in got) == want


def test_waits():
    tab = steps.tab_step()
    state, out = tab(None, {"tab": 1, "url": "u", "at": 0, "wait": 5})
    assert out["accepted"] and not tab(state, {"tab": 1, "url": "u", "at": 4, "wait": 5})[1]["accepted"] and tab(state, {"tab": 2, "url": "u", "at": 1, "wait": 5})[1]["accepted"]
    export = steps.export_step(10, 30)
    state, out = export(None, {"at": 0, "limited": True})
    assert out == {"start": 0, "waited": 0} and export(state, {"at": 5, "limited": False})[1] == {"start": 40, "waited": 35}
    back = steps.backoff_step(30)
    state, out = back(None, {"at": 0, "ok": False})
    assert out["tried"] and not back(state, {"at": 29, "ok": True})[1]["tried"] and back(back(state, {"at": 30, "ok": True})[0], {"at": 31, "ok": True})[1]["tried"]
