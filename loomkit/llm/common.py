"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word, as the operators count it: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return text.encode().split() if text else []


def count_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """A bounded cache from words to 64-bit hashes; a word's hash never depends on what was seen before."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a result depends on all bits of its input."""
    v = values.copy()
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def window_hashes(hashes: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `length` consecutive word hashes (polynomial in an odd base, then mixed)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out *= np.uint64(base)
        out += hashes[i : i + n]
    return mixed(out)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the session names in spark.checkpoint.dir. Where none is named, a local session (tests) gets
    a temporary one; on a cluster that would be a folder its executors don't share, so it is refused."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("Name a shared folder in spark.checkpoint.dir.")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomkit-checkpoint-"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes a frame now and cuts its lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


PART_BYTES = 1 << 20  # bytes of a packed frame that one task reads, unless cores would be left without any


def cut_packed(df: DataFrame) -> DataFrame:
    """cut(), read by no more tasks than its bytes need or there are cores. A small frame in very many partitions would
    leave as many nearly empty files in each later step, each of which takes a block of disk at least."""
    done = cut(df)
    rows = done._jdf.queryExecution().logical().rdd()
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rows.getCheckpointFile().get())
    written = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    few = max(pieces(written, PART_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    return done.coalesce(few) if few < rows.getNumPartitions() else done


SMALL_BYTES = 8 << 20  # a side of a join of so many bytes at most is sent to every task


def is_small(df: DataFrame, most_bytes: int | None = None) -> bool:
    """Whether a frame's rows take at most `most_bytes`, summed where the rows are."""
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return total <= (SMALL_BYTES if most_bytes is None else most_bytes)


def broadcast_if_small(df: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Marks a frame for broadcast only if its rows take at most `most_bytes` as they are; otherwise Spark shuffles for
    the join. A frame that is costly to compute should be cut before."""
    return F.broadcast(df) if is_small(df, most_bytes) else df


HEAVY, SALTS = 500, 32  # rows of a key that is joined apart from the others; parts such a key is cut into


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of `rows` with `counted`, which has one row for each key and says in column n how many rows share it.

    Keys of more than HEAVY rows are joined without bringing their rows together: they are sent to the rows if their
    size allows it, else both sides are cut into SALTS parts. All other keys go by a plain join. Both frames are read
    more than once, so they should be cut before.
    """
    heavy = counted.filter(F.col("n") > HEAVY).drop("n")
    light = counted.filter(F.col("n") <= HEAVY).drop("n")
    if heavy.isEmpty():
        return rows.join(light, on)
    if is_small(heavy):
        known = F.broadcast(heavy.select(*on))
        return rows.join(F.broadcast(heavy), on).unionByName(rows.join(known, on, "left_anti").join(light, on))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    parts = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = salted.join(parts.select(*on, "salt"), [*on, "salt"], "left_anti").drop("salt")
    return salted.join(parts, [*on, "salt"]).drop("salt").unionByName(others.join(light, on))


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a text column."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(amount: float, each: float) -> int:
    """How many pieces of about `each` an amount makes, one at least."""
    return max(1, math.ceil(amount / each))
