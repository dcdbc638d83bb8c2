"""The task log as a stream: one keyed state for each queue, answers as commands arrive.

State is a queue's header and a map of its steps. It never expires unless a time to live is given, since a queue can
be updated at any time. Answers equal those of the batch replay for each queue's own commands; a listing of all queues
has no key and belongs to the batch side.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomkit.operators.tasks import NO_STEPS, STATUSES

OUTPUT = "seq long, queue_id string, ok boolean, output string"


class QueueProcessor(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.header = handle.getValueState("header", "title string, created string", self.ttl_ms)
        self.steps = handle.getMapState("steps", "step_index int", "description string, status string, note string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A queue's commands of one micro-batch come in no certain order.
        batch = pd.concat(list(rows)).sort_values("seq")
        out = [(r.seq, key[0], *self.answer(key[0], r)) for r in batch.itertuples(index=False)]
        yield pd.DataFrame(out, columns=["seq", "queue_id", "ok", "output"])

    def answer(self, queue_id: str, r) -> tuple[bool, str]:
        known = self.header.exists()
        if r.op == "create":
            wanted = [s.strip() for s in (r.steps if r.steps is not None else []) if s and s.strip()]
            if not wanted:
                return False, NO_STEPS
            if known:
                return False, f"Task queue exists: {queue_id}"
            self.header.update(((r.title or "").strip() or "Untitled task queue", r.created))
            for i, description in enumerate(wanted, start=1):
                self.steps.updateValue((i,), (description, "pending", ""))
            return True, self.shown(queue_id)
        if not known:
            return False, f"Task queue not found: {queue_id}"
        if r.op == "update":
            status = (r.status or "").strip().lower()
            if status not in STATUSES:
                return False, f"Invalid status. Use one of: {', '.join(STATUSES)}."
            index = 0 if pd.isna(r.step_index) else int(r.step_index)
            if not self.steps.containsKey((index,)):
                return False, f"Invalid step_index. Use a value from 1 to {sum(1 for _ in self.steps.keys())}."
            description = self.steps.getValue((index,))[0]
            self.steps.updateValue((index,), (description, status, (r.note or "").strip()))
        return True, self.shown(queue_id)

    def shown(self, queue_id: str) -> str:
        title, created = self.header.get()
        lines = [f"Queue {queue_id}: {title}", f"Created: {created}"]
        for (index,), (description, status, note) in sorted(self.steps.iterator()):
            lines.append(f"{index}. [{status}] {description}" + (f" | note: {note}" if note else ""))
        return "\n".join(lines)

    def close(self) -> None:
        pass


def queue_answers(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Answers (seq, queue_id, ok, output) to a stream of create, update and get commands that carry a queue_id."""
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("created")
    rows = log.filter("op IN ('create', 'update', 'get') AND queue_id IS NOT NULL").select("seq", "queue_id", "op", "title", "steps", "step_index", "status", "note", created)
    return rows.groupBy("queue_id").transformWithStateInPandas(QueueProcessor(ttl_ms), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "none")


def run_to_end(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what its source holds now and returns the rows it appended.

    Rows and state are written to the folder that spark.checkpoint.dir names; only where none is named, as in tests,
    to a temporary one, which a cluster's executors wouldn't share, so there it is refused. Keyed state needs the
    RocksDB store: the session's own setting is put back once the stream has started.
    """
    folder = working_folder(spark, "stream")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = started(stream, folder)
    finally:
        spark.conf.set(store, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def working_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder in the one that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError("Name a shared folder in spark.checkpoint.dir.")
    return f"{named or tempfile.mkdtemp(prefix='loomkit-')}/{kind}-{uuid.uuid4().hex}"


def started(stream: DataFrame, folder: str):
    return stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
