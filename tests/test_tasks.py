import random

from pyspark.sql import functions as F

from loomkit.operators import tasks
from loomkit.schemas import TASK_COMMAND
from loomkit.streaming.tasks import queue_answers

STATUSES = ["pending", " Completed ", "BLOCKED", "in_progress", "done", None]


def model(log):
    """One command after the other over a dict."""
    store, out = {}, {}
    for c in sorted(log, key=lambda c: c["seq"]):
        q = store.get(c["queue_id"])
        if c["op"] == "create":
            steps = [s.strip() for s in c["steps"] or [] if s and s.strip()]
            if not steps:
                out[c["seq"]] = tasks.NO_STEPS
                continue
            if q:
                out[c["seq"]] = f"Task queue exists: {c['queue_id']}"
                continue
            q = store[c["queue_id"]] = {"title": (c["title"] or "").strip() or "Untitled task queue", "steps": [[s, "pending", ""] for s in steps]}
        elif c["op"] == "list":
            lines = [f"{i}: {x['title']} ({sum(s[1] == 'completed' for s in x['steps'])}/{len(x['steps'])} completed)" for i, x in store.items()]
            out[c["seq"]] = "\n".join(lines) or tasks.NO_QUEUES
            continue
        elif not q:
            out[c["seq"]] = f"Task queue not found: {c['queue_id']}"
            continue
        elif c["op"] == "update":
            status = (c["status"] or "").strip().lower()
            if status not in tasks.STATUSES:
                out[c["seq"]] = "Invalid status. Use one of: blocked, completed, in_progress, pending."
                continue
            if not 1 <= (c["step_index"] or 0) <= len(q["steps"]):
                out[c["seq"]] = f"Invalid step_index. Use a value from 1 to {len(q['steps'])}."
                continue
            q["steps"][c["step_index"] - 1][1:] = [status, (c["note"] or "").strip()]
        lines = [f"{i}. [{s}] {d}" + (f" | note: {n}" if n else "") for i, (d, s, n) in enumerate(q["steps"], 1)]
        out[c["seq"]] = "\n".join([f"Queue {c['queue_id']}: {q['title']}", "Created: 2024-01-02T03:04:05+00:00", *lines])
    return out


def random_log(seed, n=150):
    r = random.Random(seed)
    log = []
    for seq in range(n):
        op = r.choice(["create", "update", "update", "update", "get", "list"])
        c = dict.fromkeys(["title", "steps", "step_index", "status", "note"]) | {"seq": seq, "op": op, "queue_id": f"q{r.randrange(6)}"}
        if op == "create":
            c |= {"title": r.choice([" A ", "", None, "B "]), "steps": r.choice([["a", " ", "b "], [" "], None, ["x", None, "y", "z"]])}
        if op == "update":
            c |= {"step_index": r.choice([0, 1, 2, 3, 4, None]), "status": r.choice(STATUSES), "note": r.choice([None, " n ", "m"])}
        log.append(c)
    return log


def frame(spark, log):
    rows = [(c["seq"], c["op"], c["queue_id"], c["title"], c["steps"], c["step_index"], c["status"], c["note"]) for c in log]
    df = spark.createDataFrame(rows, "seq long, op string, queue_id string, title string, steps array<string>, step_index int, status string, note string")
    return df.withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))


def test_replay_equals_one_by_one(spark):
    for seed in (1, 2):
        log = random_log(seed)
        got = {r.seq: r.output for r in tasks.command_outputs(frame(spark, log)).collect()}
        assert got == model(log)


def test_final_state(spark):
    log = random_log(3)
    expected = model([*log, dict(log[0], seq=999, op="list")])[999]
    assert tasks.listing(frame(spark, log)).first().output == expected
    texts = {r.queue_id: r.output for r in tasks.queue_texts(frame(spark, log)).collect()}
    assert texts == {q: out for q in texts for out in [model([*log, dict(log[0], seq=999, op="get", queue_id=q)])[999]]}


def test_empty_log(spark):
    empty = spark.createDataFrame([], TASK_COMMAND)
    assert tasks.listing(empty).first().output == tasks.NO_QUEUES
    assert tasks.command_outputs(empty).count() == tasks.queue_texts(empty).count() == 0


def test_ids_are_derived(spark):
    log = frame(spark, [dict.fromkeys(["queue_id", "step_index", "status", "note"]) | {"seq": 1, "op": "create", "title": "t", "steps": ["a"]}])
    first = tasks.queues(log).first().queue_id
    assert len(first) == 8 and tasks.queues(log).first().queue_id == first


def test_stream_equals_batch(spark, tmp_path):
    log = [c for c in random_log(5, 80) if c["op"] != "list"]
    source = str(tmp_path / "log")
    for part in (log[:40], log[40:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame(spark, log).schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, seen = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = queue_answers(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {r.seq: r.output for r in spark.read.parquet(out).collect()}
    assert got == model(log)
