"""Task queues as an append-only command log, replayed in sets instead of one call after the other.

A log row is a command (schemas.TASK_COMMAND): op create, update, get or list, in the total order of seq. Nothing is
mutated: a queue's state is its creation and, for each step, the last successful update.

Ids are the log's own, or derived from seq and title where it has none, so that a replay gives the same ones. An id
belongs to its first creation; a later one that claims it is refused, where a keyed store would lose the first queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.functions.strings import or_default, py_strip, utc_seconds
from loomkit.schemas import STEP

# The statuses a step can have.
STATUSES = ["blocked", "completed", "in_progress", "pending"]

NO_STEPS = "Cannot create a task queue without at least one step."
NO_QUEUES = "No task queues exist in this process."


def clean_steps(steps: Column) -> Column:
    """Steps without space around them; blank ones are dropped. A null list has none."""
    stripped = F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s: py_strip(F.coalesce(s, F.lit(""))))
    return F.filter(stripped, lambda s: s != "")


def step_structs(steps: Column) -> Column:
    new = lambda s: F.struct(s.alias("description"), F.lit("pending").alias("status"), F.lit("").alias("note"))
    return F.transform(clean_steps(steps), new).cast(f"array<{STEP}>")


def clean_title(title: Column) -> Column:
    return or_default(py_strip(F.coalesce(title, F.lit(""))), "Untitled task queue")


def clean_status(status: Column) -> Column:
    return F.lower(py_strip(F.coalesce(status, F.lit(""))))


def step_line(index: Column, step: Column) -> Column:
    note = F.when(step["note"] != "", F.concat(F.lit(" | note: "), step["note"])).otherwise("")
    return F.concat(index.cast("string"), F.lit(". ["), step["status"], F.lit("] "), step["description"], note)


def rendered_queue(queue_id: Column, title: Column, created_at: Column, steps: Column) -> Column:
    lines = F.array_join(F.transform(steps, lambda s, i: step_line(i + 1, s)), "\n")
    return F.concat(F.lit("Queue "), queue_id, F.lit(": "), title, F.lit("\nCreated: "), utc_seconds(created_at), F.lit("\n"), lines)


def creations(log: DataFrame) -> DataFrame:
    """Each create command: seq, queue_id, title, steps (new structs), created_at, ok, message."""
    derived = F.substring(F.md5(F.concat_ws("#", F.col("seq").cast("string"), F.col("title")).cast("binary")), 1, 8)
    made = log.filter("op = 'create'").select(
        "seq", F.coalesce("queue_id", derived).alias("queue_id"), clean_title(F.col("title")).alias("title"), step_structs(F.col("steps")).alias("steps"), F.col("ts").alias("created_at")
    )
    first = F.min(F.when(F.size("steps") > 0, F.col("seq"))).over(Window.partitionBy("queue_id"))
    message = F.when(F.size("steps") == 0, F.lit(NO_STEPS)).when(F.col("seq") > first, F.concat(F.lit("Task queue exists: "), F.col("queue_id")))
    return made.withColumn("message", message).withColumn("ok", F.col("message").isNull())


def queues(log: DataFrame) -> DataFrame:
    """The queues a log creates: queue_id, title, steps as created, created_at, created_seq."""
    return creations(log).filter("ok").select("queue_id", "title", "steps", "created_at", F.col("seq").alias("created_seq"))


def checked_updates(log: DataFrame) -> DataFrame:
    """Each update command with its validation: seq, queue_id, step_index, status, note, ok, message.

    Checked in this order: the queue exists by then, the status is one of STATUSES, the step exists. A note that is
    left out is empty, so it clears what was there.
    """
    known = queues(log).select("queue_id", F.size("steps").alias("n_steps"), "created_seq")
    updates = log.filter("op = 'update'").select("seq", "queue_id", "step_index", clean_status(F.col("status")).alias("status"), py_strip(F.coalesce("note", F.lit(""))).alias("note"))
    joined = updates.join(known, "queue_id", "left")
    range_ok = F.coalesce(F.col("step_index").between(1, F.col("n_steps")), F.lit(False))
    message = (
        F.when(F.col("created_seq").isNull() | (F.col("created_seq") > F.col("seq")), F.concat(F.lit("Task queue not found: "), F.coalesce("queue_id", F.lit("None"))))
        .when(~F.col("status").isin(STATUSES), F.lit(f"Invalid status. Use one of: {', '.join(STATUSES)}."))
        .when(~range_ok, F.concat(F.lit("Invalid step_index. Use a value from 1 to "), F.col("n_steps").cast("string"), F.lit(".")))
    )
    out = joined.withColumn("message", message).withColumn("ok", F.col("message").isNull())
    return out.select("seq", "queue_id", "step_index", "status", "note", "ok", "message")


def created_steps(log: DataFrame) -> DataFrame:
    rows = queues(log).select("queue_id", "title", "created_at", "created_seq", F.posexplode("steps").alias("at", "step"))
    return rows.select("queue_id", "title", "created_at", "created_seq", (F.col("at") + 1).alias("step_index"), "step.description")


def step_states(log: DataFrame) -> DataFrame:
    """A row for each step as it stands at the log's end: queue_id, title, created_at, created_seq, step_index, description, status, note."""
    last = Window.partitionBy("queue_id", "step_index").orderBy(F.desc("seq"))
    latest = checked_updates(log).filter("ok").withColumn("rank", F.row_number().over(last)).filter("rank = 1")
    joined = created_steps(log).join(latest.select("queue_id", "step_index", "status", "note"), ["queue_id", "step_index"], "left")
    return joined.select(
        "queue_id", "title", "created_at", "created_seq", "step_index", "description",
        F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("note", F.lit("")).alias("note"),
    )


def queue_states(log: DataFrame) -> DataFrame:
    """A row for each queue at the log's end, with its steps in order."""
    step = F.struct("step_index", "description", "status", "note")
    grouped = step_states(log).groupBy("queue_id", "title", "created_at", "created_seq").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return grouped.withColumn("steps", F.transform("steps", lambda s: F.struct(s["description"].alias("description"), s["status"].alias("status"), s["note"].alias("note"))))


def queue_texts(log: DataFrame) -> DataFrame:
    shown = rendered_queue(F.col("queue_id"), F.col("title"), F.col("created_at"), F.col("steps"))
    return queue_states(log).select("queue_id", "created_seq", shown.alias("output"))


def progress(steps: DataFrame, keys: list[str], status: str = "status", step: str = "step_index") -> DataFrame:
    """Completed and all steps of each key; rows without a step (from an outer join) count as none."""
    return steps.groupBy(*keys).agg(F.count_if(F.col(status) == "completed").alias("completed"), F.count(step).alias("total"))


def queue_progress(log: DataFrame) -> DataFrame:
    """queue_id, title, created_seq, completed, total and the line that lists the queue."""
    counted = progress(step_states(log), ["queue_id", "title", "created_seq"])
    line = F.concat(F.col("queue_id"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("completed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" completed)"))
    return counted.withColumn("output", line)


def listing(log: DataFrame) -> DataFrame:
    """One row: all queues in the order of their creation."""
    lines = queue_progress(log).agg(F.sort_array(F.collect_list(F.struct("created_seq", "output"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda r: r["output"]), "\n")
    return lines.select(or_default(text, NO_QUEUES).alias("output"))


def command_outputs(log: DataFrame) -> DataFrame:
    """What each command answers when it is its turn: seq, ok, output.

    For the commands on one queue, each of the queue's steps is looked up as of the command: commands and updates of
    a step stand in one window, and the last update before a command is carried on to it.
    """
    updates = checked_updates(log)
    made = creations(log)
    asks = (
        made.filter("ok").select("seq", "queue_id")
        .unionByName(updates.filter("ok").select("seq", "queue_id"))
        .unionByName(log.filter("op = 'get'").select("seq", "queue_id"))
    )
    points = asks.join(created_steps(log), "queue_id").filter("created_seq <= seq").withColumn("state", F.lit(None).cast("struct<status:string,note:string>"))
    changes = updates.filter("ok").select("seq", "queue_id", "step_index", F.struct("status", "note").alias("state"))
    upto = Window.partitionBy("queue_id", "step_index").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.unionByName(changes, allowMissingColumns=True).withColumn("now", F.last("state", ignorenulls=True).over(upto)).filter("description IS NOT NULL")
    step = F.struct("step_index", "description", F.coalesce("now.status", F.lit("pending")).alias("status"), F.coalesce("now.note", F.lit("")).alias("note"))
    shown = seen.groupBy("seq", "queue_id", "title", "created_at").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    shown = shown.select("seq", F.lit(True).alias("ok"), rendered_queue(F.col("queue_id"), F.col("title"), F.col("created_at"), F.col("steps")).alias("output"))

    failed = made.filter("NOT ok").select("seq", "ok", F.col("message").alias("output")).unionByName(updates.filter("NOT ok").select("seq", "ok", F.col("message").alias("output")))
    known = queues(log).select("queue_id", "created_seq")
    missing = log.filter("op = 'get'").join(known, "queue_id", "left").filter("created_seq IS NULL OR created_seq > seq")
    missing = missing.select("seq", F.lit(False).alias("ok"), F.concat(F.lit("Task queue not found: "), F.coalesce("queue_id", F.lit("None"))).alias("output"))
    return shown.unionByName(failed).unionByName(missing).unionByName(list_outputs(log))


def list_outputs(log: DataFrame) -> DataFrame:
    """Each list command with the queues as of then. Every one of them names every queue there was, which is the size
    of its text; how many steps were done by then is a running sum over each queue's own changes."""
    lists = log.filter("op = 'list'").select(F.col("seq").alias("asked"))
    flips = checked_updates(log).filter("ok").select("seq", "queue_id", "step_index", (F.col("status") == "completed").cast("int").alias("done"))
    step = Window.partitionBy("queue_id", "step_index").orderBy("seq")
    changes = flips.select("seq", "queue_id", (F.col("done") - F.coalesce(F.lag("done").over(step), F.lit(0))).alias("change"))
    known = queues(log).select("queue_id", "title", "created_seq", F.size("steps").alias("total"))
    asks = lists.join(known, F.col("created_seq") < F.col("asked")).select(F.col("asked").alias("seq"), "queue_id", F.lit(0).alias("change"), "title", "created_seq", "total")
    upto = Window.partitionBy("queue_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asks.unionByName(changes, allowMissingColumns=True).withColumn("done", F.sum("change").over(upto)).filter("total IS NOT NULL")
    line = F.concat(F.col("queue_id"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" completed)"))
    texts = counted.groupBy(F.col("seq").alias("asked")).agg(F.sort_array(F.collect_list(F.struct("created_seq", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return lists.join(texts, "asked", "left").select(F.col("asked").alias("seq"), F.lit(True).alias("ok"), F.coalesce(text, F.lit(NO_QUEUES)).alias("output"))
