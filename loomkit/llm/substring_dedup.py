"""Substring dedup by level-wise doubling.

A window of `length` words can only be repeated if every shorter window inside it is. So the shortest
level is judged first, on few windows: the winnowed ones, one leader (the smallest hash) for each window of the
next length, which equal windows share. Windows that are repeated at one length alone are
extended to twice that length, up to `length`; a text without survivors asks for nothing at the next level.

Texts are dealt into chunks by a hash of doc_id and text, so that no id is a chunk by itself, and hashes into buckets by their value. A chunk sends each
distinct hash once, packed, to its bucket, however often the chunk holds it, so a passage that many documents
share costs a bucket one entry for each chunk. The bucket answers with one bit for each entry. All levels
read the same exchange of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import WordHashes, pieces, total_bytes, window_hashes

SHORTEST = 8  # words of the first level at most
CHUNKS_A_BUCKET = 4  # a bucket holds as many hashes as so many chunks send, so that what a chunk packs for it is worth a row
SECOND_BASE = 0xD6E8FEB86659FD93
REQUEST = "level int, bucket long, chunk long, hashes binary, more binary, docs binary, alone binary"
REPLY = "level int, bucket long, chunk long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,stop:long>>"


def level_lengths(length: int) -> list[int]:
    """The lengths judged, ascending: each is at least half of the next one. 13 gives 7, 13."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Chunk:
    """The texts of a chunk as one array of word hashes; `ranks` orders documents as doc_id does, null last."""

    def __init__(self, table: pa.Table, cache: WordHashes):
        self.ids = table.column("doc_id").to_pylist()
        self.texts = table.column("text")
        self.words: list[bytes] = []
        ends = []
        for text in self.texts:
            self.words += (text.as_py() or "").encode().split()
            ends.append(len(self.words))
        self.ends = np.array(ends, dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = cache.array(self.words)
        largest = (1 << 63) - 1
        self.ranks = np.array([largest if x is None else x for x in self.ids], dtype=np.int64)
        self.row = np.repeat(np.arange(len(self.ids)), self.ends - self.starts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each position and whether the window lies inside one text."""
        values = window_hashes(self.hashes, length)
        inside = np.arange(len(values)) + length <= self.ends[self.row[: len(values)]]
        return values, inside


def leaders(values: np.ndarray, reach: int) -> np.ndarray:
    """For each run of `reach` neighbouring values, the position of its first smallest one."""
    n = len(values) - reach + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(values, reach)
    return np.concatenate([np.argmin(runs[i : i + 65536], axis=1) + np.arange(i, min(i + 65536, n)) for i in range(0, n, 65536)])


def asked(chunk: Chunk, lengths: list[int], level: int, replies: dict[int, dict[int, np.ndarray]], buckets: int):
    """Positions that `level` asks about, with their hashes grouped by bucket: the same for every call on a chunk."""
    length = lengths[level]
    values, inside = chunk.windows(length)
    if level == 0:
        at = np.flatnonzero(inside)
        if len(lengths) > 1:  # equal windows of the next length have equal leaders, so these decide for both
            _, longer = chunk.windows(lengths[1])
            at = np.unique(leaders(values, lengths[1] - length + 1)[longer])
    elif level == 1:
        shorter, _ = chunk.windows(lengths[0])
        before, ok, _, _, _ = judged(chunk, lengths, 0, replies, buckets)
        alive = np.zeros(len(chunk.words), dtype=bool)
        alive[before[ok]] = True
        at = np.flatnonzero(inside & alive[leaders(shorter, length - lengths[0] + 1)])
    else:
        before, ok, _, _, _ = judged(chunk, lengths, level - 1, replies, buckets)
        alive = np.zeros(len(chunk.words), dtype=bool)
        alive[before[ok]] = True
        at = np.flatnonzero(inside)
        at = at[alive[at] & alive[at + length - lengths[level - 1]]]
    ranks = chunk.ranks[chunk.row[at]]
    order = np.lexsort((ranks, values[at]))
    at, ranks, keys = at[order], ranks[order], values[at][order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    entry = np.cumsum(first) - 1
    lead = np.flatnonzero(first)
    last = np.append(lead[1:], len(at)) - 1
    return at, ranks, entry, lead, last, keys


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the keys, so a bucket is a slice of the sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def judged(chunk: Chunk, lengths: list[int], level: int, replies, buckets: int):
    """The positions asked about at a level and each one's answer; the smallest rank in the chunk comes along."""
    at, ranks, entry, lead, last, keys = asked(chunk, lengths, level, replies, buckets)
    home = bucket_of(keys[lead], buckets)
    bits = [np.empty(0, dtype=bool)]
    for b, n in zip(*np.unique(home, return_counts=True), strict=True):
        bits.append(np.unpackbits(replies[level][int(b)], count=n).astype(bool))
    return at, np.concatenate(bits)[entry], ranks, entry, lead


def requests(chunk_id: int, chunk: Chunk, lengths: list[int], level: int, replies, buckets: int) -> pa.Table:
    at, ranks, entry, lead, last, keys = asked(chunk, lengths, level, replies, buckets)
    home = bucket_of(keys[lead], buckets)
    final = level == len(lengths) - 1
    # Sparing bytes: only the last length decides what goes, so only there more hash bits and documents are sent.
    more = (window_hashes(chunk.hashes, lengths[level], SECOND_BASE)[at[lead]] >> np.uint64(32)).astype(np.uint32) if final else None
    rows: dict[str, list] = {k: [] for k in ("level", "bucket", "chunk", "hashes", "more", "docs", "alone")}
    edges = np.flatnonzero(np.diff(home, prepend=-1, append=-1)) if len(home) else np.zeros(1, dtype=int)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        part = lead[i:j]
        rows["level"].append(level)
        rows["bucket"].append(int(home[i]))
        rows["chunk"].append(chunk_id)
        rows["hashes"].append(keys[part].tobytes())
        rows["more"].append(more[i:j].tobytes() if final else b"")
        rows["docs"].append(ranks[part].tobytes() if final else b"")
        rows["alone"].append(b"" if final else np.packbits(ranks[part] == ranks[last[i:j]]).tobytes())
    return pa.table(rows, schema=pa.schema([("level", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("hashes", "more", "docs", "alone"))]))


def answered(table: pa.Table) -> pa.Table:
    """One bucket's answers. Before the last length: is the window in two documents? At the last: is it in a document before the chunk's first?"""
    rows = table.to_pylist()
    keys = np.concatenate([np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows])
    sizes = [len(r["hashes"]) // 8 for r in rows]
    if rows[0]["docs"]:
        more = np.concatenate([np.frombuffer(r["more"], dtype=np.uint32) for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], dtype=np.int64) for r in rows])
        order = np.lexsort((docs, more, keys))
        k, m, d = keys[order], more[order], docs[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        yes = smallest < d
    else:
        alone = np.concatenate([np.unpackbits(np.frombuffer(r["alone"], dtype=np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        yes = alone[order] == 0
        yes[1:] |= same
        yes[:-1] |= same
    out = np.empty(len(keys), dtype=bool)
    out[order] = yes
    ends = np.cumsum(sizes)
    return pa.table({"level": pa.array([r["level"] for r in rows], pa.int32()), "bucket": [r["bucket"] for r in rows], "chunk": [r["chunk"] for r in rows], "bits": [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]})


def collected(table: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in table.to_pylist():
        out.setdefault(r["level"], {})[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def kept(chunk: Chunk, lengths: list[int], replies, buckets: int) -> pa.Table:
    at, earlier, ranks, entry, lead = judged(chunk, lengths, len(lengths) - 1, replies, buckets)
    gone = at[earlier | (ranks > ranks[lead][entry])] if len(at) else at
    edge = np.zeros(len(chunk.words) + 1, dtype=np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + lengths[-1], -1)
    removed = np.cumsum(edge)[:-1] > 0
    rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "removed")}
    for i, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
        mask = removed[a:b]
        turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        spans = [{"start": int(x), "stop": int(y)} for x, y in turns.reshape(-1, 2)]
        own, at_word = [], a
        for s in spans:
            own += chunk.words[at_word : a + s["start"]]
            at_word = a + s["stop"]
        own += chunk.words[at_word:b]
        rows["doc_id"].append(chunk.ids[i])
        rows["n_words"].append(b - a)
        rows["n_removed"].append(int(mask.sum()))
        rows["kept_text"].append(b" ".join(own).decode())
        rows["removed"].append(spans)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", span)]))


def dedup_substrings(docs: DataFrame, length: int = 13, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Removes every word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    Takes doc_id (long) and text; other columns are left out, whatever they are called. Returns one row for each
    input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the removed word spans.

    Windows are judged on the input. Null, empty and blank texts have no words and lose none; so do texts shorter
    than a window. Rows that share a doc_id count as one document, so they never remove each other's words. A null
    doc_id ranks after all others (with the largest long); such rows don't remove from each other. An empty table
    gives an empty table. Very long texts are read whole. A chunk holds about `chunk_bytes` of text, or one text if
    that is longer (copies of a row, which share id and text, are one chunk's); memory per task follows that.
    """
    lengths = level_lengths(length)
    n = pieces(total_bytes(docs, "text"), chunk_bytes)
    buckets = pieces(n, CHUNKS_A_BUCKET)
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"))
    by_chunk = texts.groupBy("chunk")
    cache = WordHashes()
    replies = None

    def asking(level: int):
        if level == 0:
            return lambda key, table: requests(key[0].as_py(), Chunk(table, cache), lengths, 0, {}, buckets)
        return lambda key, table, heard: requests(key[0].as_py(), Chunk(table, cache), lengths, level, collected(heard), buckets)

    for level in range(len(lengths)):
        groups = by_chunk if level == 0 else by_chunk.cogroup(replies.groupBy("chunk"))
        answers = groups.applyInArrow(asking(level), REQUEST).groupBy("bucket").applyInArrow(answered, REPLY)
        replies = answers if level == 0 else replies.unionByName(answers)

    def last(key, table, heard):
        return kept(Chunk(table, cache), lengths, collected(heard), buckets)

    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(last, RESULT)
