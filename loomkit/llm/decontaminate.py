"""Benchmark decontamination by size-partitioned MinHash containment search.

A fixed MinHash signature of a long document almost never holds the minimum of a short item, so only the items are
sketched, and containment is asked of each of the document's shingles. Items are partitioned by their number of
shingles; in the class of up to u shingles a sketch holds the floor((1 - t) * u) + 1 smallest shingle hashes. A
document that contains a share t of an item's shingles lacks at most (1 - t) * u of them, so it meets the sketch at
least once: no match is missed. Candidates are verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import WordHashes, total_bytes, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
RESULT = "doc_id long, item_id long, n_shared long, n_item long, containment double"
BROADCAST_BYTES = 8 << 20  # text of all items; beyond it, sketches and documents are joined by a shuffle
LOW_BITS = 1 << 20


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], length: int) -> set[bytes]:
    return {b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)}


class Sketches:
    """The sketches of some items, and their shingles for the exact check."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        cache = WordHashes()
        self.items: list[tuple[int | None, int, set[bytes]]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            words = tokens(text)
            if not words:
                continue
            length = min(SHINGLE, len(words))
            values = np.unique(window_hashes(cache.array(words), length))
            upper = (1 << len(values).bit_length()) - 1  # of the class [2^i, 2^(i+1))
            sketch = values[: int((1 - THRESHOLD) * upper + 1e-9) + 1]
            found.setdefault(length, []).append((sketch, len(self.items)))
            self.items.append((item_id, length, shingles(words, length)))
        self.index = {}
        for length, sketches in found.items():
            values = np.concatenate([s for s, _ in sketches])
            owners = np.concatenate([np.full(len(s), i) for s, i in sketches])
            order = np.argsort(values, kind="stable")
            low = np.zeros(LOW_BITS, dtype=bool)
            low[values & np.uint64(LOW_BITS - 1)] = True
            self.index[length] = (values[order], owners[order], low)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items whose sketch the document meets."""
        out: set[int] = set()
        for length, (values, owners, low) in self.index.items():
            own = window_hashes(hashes, length)
            own = np.unique(own[low[own & np.uint64(LOW_BITS - 1)]])
            left, right = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            for a, b in zip(left[left < right].tolist(), right[left < right].tolist(), strict=True):
                out.update(owners[a:b].tolist())
        return out

    def matches(self, text: str | None, cache: WordHashes) -> list[tuple[int | None, int, int]]:
        words = tokens(text)
        hits = self.candidates(cache.array(words)) if words else ()
        sets: dict[int, set[bytes]] = {}
        out = []
        for i in sorted(hits):
            item_id, length, own = self.items[i]
            if length not in sets:
                sets[length] = shingles(words, length)
            shared = len(own & sets[length])
            if shared >= THRESHOLD * len(own):
                out.append((item_id, shared, len(own)))
        return out


def as_table(rows: list[tuple]) -> pa.RecordBatch:
    names = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64())]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def small_items(items: DataFrame) -> list | None:
    """The items, if their text is of a size to send to each executor."""
    if total_bytes(items, "text") > BROADCAST_BYTES or items.count() > BROADCAST_BYTES // 64:
        return None
    return [tuple(r) for r in items.select("item_id", "text").collect()]


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each item that a document contains at 0.8 or more of the item's distinct five-word shingles (A-Z lower-cased).

    Takes doc_id and text, item_id and text; other columns are left out. Returns doc_id, item_id, n_shared, n_item,
    containment: one row for each row of `docs` and row of `items` that match, so repeated rows give repeated rows.
    An item of fewer than five words is one shingle. Null, empty and blank texts match nothing on either side; null
    ids come out as null. Empty tables give an empty table. Items beyond BROADCAST_BYTES of text go by a shuffle.
    """
    few = small_items(items)
    if few is None:
        return find_many_items(docs, items)
    sketches = docs.sparkSession.sparkContext.broadcast(Sketches(few))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, index = WordHashes(), sketches.value
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield as_table([(doc_id, item, n, of, n / of) for doc_id, text in rows for item, n, of in index.matches(text, cache)])

    return docs.select("doc_id", "text").mapInArrow(search, RESULT)


def find_many_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As find_items, for any number of items: shingles meet sketches in an equality join, then pairs are verified."""

    @F.pandas_udf("array<long>")
    def sketch(texts):
        out = []
        for text in texts:
            index = Sketches([(0, text)]).index
            out.append([v for values, _, _ in index.values() for v in values.view(np.int64).tolist()])
        return texts.__class__(out)

    lengths = [r[0] for r in items.select(F.least(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " ")), " ")), F.lit(SHINGLE)).alias("n")).filter("n > 0").distinct().collect()]

    @F.pandas_udf("array<long>")
    def values(texts):
        cache, out = WordHashes(), []
        for text in texts:
            hashes = cache.array(tokens(text))
            out.append(np.unique(np.concatenate([np.empty(0, np.uint64), *(window_hashes(hashes, n) for n in lengths)])).view(np.int64))
        return texts.__class__(out)

    @F.pandas_udf("struct<n_shared:long,n_item:long>")
    def shared(texts, others):
        rows = []
        for text, other in zip(texts, others, strict=True):
            words, own = tokens(text), tokens(other)
            length = min(SHINGLE, len(own))
            rows.append((len(shingles(words, length) & (wanted := shingles(own, length))), len(wanted)))
        import pandas as pd

        return pd.DataFrame(rows, columns=["n_shared", "n_item"])

    left = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("d"))
    right = items.select("item_id", F.col("text").alias("item"), F.xxhash64("item_id", "text").alias("i"))
    keys = right.select("i", F.explode(sketch("item")).alias("v")).distinct()
    pairs = left.select("d", F.explode(values("text")).alias("v")).distinct().join(keys, "v").select("d", "i").distinct()
    found = pairs.join(left, "d").join(right, "i").withColumn("s", shared("text", "item")).filter(F.col("s.n_shared") >= THRESHOLD * F.col("s.n_item"))
    return found.select("doc_id", "item_id", "s.n_shared", "s.n_item", (F.col("s.n_shared") / F.col("s.n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that contain none of the items (see find_items). Null texts stay."""
    few = small_items(items)
    if few is None:
        found = find_many_items(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("text_key")).distinct()
        rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_key"))
        return rows.join(found, "text_key", "left_anti").select("row.*")
    sketches = docs.sparkSession.sparkContext.broadcast(Sketches(few))

    @F.pandas_udf("boolean")
    def clean(texts):
        cache, index = WordHashes(), sketches.value
        return texts.map(lambda text: not index.matches(text, cache))

    return docs.filter(clean("text"))
