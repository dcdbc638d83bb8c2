"""A training corpus out of raw documents, in five stages. Each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm.common import ensure_checkpoint_dir, remove_folder
from loomkit.llm.decontaminate import drop_contaminated
from loomkit.llm.line_dedup import dedup_lines
from loomkit.llm.mixing import mix
from loomkit.llm.near_copies import marked_groups
from loomkit.llm.quality import keep_good
from loomkit.llm.simhash import keep_one_of_each


# All stages take and return whatever columns the documents have, under any names; rows that are equal are kept or
# dropped alike (near-dedup keeps one of them), and an empty table stays empty. Texts of any length are read whole.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go. Null, empty and blank texts fail the base rules;
    null languages and sources are groups of their own; ties at the cutoff stay."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, a run being two lines or one of 50 words or more, and documents of which every line
    went; n_chars follows the text, if there is such a column. Null and empty texts stay. A null doc_id comes after all
    others; texts that share an id are ordered by hash. Columns named n_lines and n_removed pass unchanged."""
    own = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    kept = docs.withColumnsRenamed({c: f"_kept_{c}" for c in own})
    out = dedup_lines(kept, run=2, long_words=50).filter("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    out = out.drop("n_lines", "n_removed").withColumnsRenamed({f"_kept_{c}": c for c in own})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays. They are linked by
    SimHash first, checked exactly, and completed by what no distance of fingerprints finds. It is that of the smallest doc_id; a null id comes last, and of texts that share an id the one of the smallest hash stays. Null,
    empty and blank texts are copies of each other."""
    return keep_one_of_each(docs, marked_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 of its five-word shingles or more) go. Null texts contain none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and how many words it takes (taken, repeats
    counted); columns of these names are replaced. Null sources are one source; null and empty texts have no words to take."""
    return mix(docs).filter("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# Minimum-covariance-determinant estimates and XXH64 fingerprints have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`. Stages are written to the shared folder of spark.checkpoint.dir; a
    stage's table goes once the next one is written."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{i}")
        if i:
            remove_folder(spark, f"{shared}/{i - 1}")
        docs = spark.read.parquet(f"{shared}/{i}")
    return docs
