"""Near-copies by SimHash and the exact Jaccard similarity of five-word shingles.

Operator 4 comes first: fingerprints, their links by halves with one wildcard bit, an exact check of the linked sets, and
components. No SimHash distance bounds a Jaccard similarity, so that can't find all pairs. What it left apart is
completed by prefix filtering, which only looks at sets of different components: under any one order of all shingles, two sets of similarity 4/5 or more share a shingle among the first fifth of
each. All documents' shingles are counted in counters, which several shingles may share, and shingles of larger counters
come later in the order, so that prefixes hold rare ones. The order decides how many candidates there are, never which
pairs are found. As many shingles share a counter in a large table as in a small one (up to MOST_COUNTERS): else chance
would hide which shingles are frequent, and ever more frequent ones would stand in prefixes. Candidates are verified
over the whole sets.

Sets that are equal count as one. Where CENTRES sets or fewer share a prefix shingle, each pair of them is a candidate,
and how many such shingles a pair shares bounds its similarity from above: what two sets share beyond their prefixes is
outside the prefix of one of them. Where more sets share a shingle, all are first held against a few as centres; what
these links connect needs no further pairs. All other pairs of such a shingle are then verified too, so no link is
missed. BITS parities of each set bound a pair's similarity there: two sets differ in at least as many shingles as
parities. That tells most pairs of up to about a thousand words apart; pairs of longer texts are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import WordHashes, broadcast_if_small, join_counted, total_bytes, window_hashes
from loomkit.llm.common import cut_packed as cut
from loomkit.llm.simhash import components, fingerprint, links_between

SHINGLE = 5
LEAST, OF = 4, 5  # similarity 4/5 or more is a near copy
COUNTERS, CHUNK = 1 << 18, 1 << 12  # counters of shingles, at least, and how many of them travel in one row
COUNTER_BYTES, MOST_COUNTERS = 256, 1 << 22  # bytes of text a counter, and how many counters there are at most
BITS = 1024  # parities of a set
CENTRES = 16  # sets that all other sets of a shingle are held against first, if it has more than so many


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of a text's five-word runs (A-Z lower-cased), sorted; of fewer words the whole is one run."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    found = np.sort(window_hashes(hashes.array(words), min(SHINGLE, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    hashes = WordHashes()
    return texts.map(lambda t: shingles(t, hashes).view(np.int64))


def counters(own: np.ndarray, of: int) -> np.ndarray:
    """Which of so many counters (a power of two) counts each shingle."""
    return (own & np.uint64(of - 1)).view(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """BITS bits as longs: whether the number of a set's shingles that fall to a bit is odd. Shingles are dealt by other
    bits of the hash than to counters."""
    place = ((own >> np.uint64(32)) & np.uint64(BITS - 1)).view(np.int64)
    return np.packbits(np.bincount(place, minlength=BITS) & 1).view(np.int64)


def chunk_rows(counts: np.ndarray) -> pa.RecordBatch:
    """The chunks of counters that aren't all zero, each in the narrowest type that holds its counts."""
    chunks = [(i, part.astype(np.min_scalar_type(part.max())).tobytes()) for i, part in enumerate(counts.reshape(-1, CHUNK)) if part.any()]
    return pa.record_batch([pa.array([i for i, _ in chunks], pa.int32()), pa.array([part for _, part in chunks], pa.binary())], names=["chunk", "counts"])


def chunk_counts(part: bytes) -> np.ndarray:
    return np.frombuffer(part, f"u{len(part) // CHUNK}")


def counters_for(docs: DataFrame) -> int:
    """How many counters a table gets: a power of two, in proportion to its texts, from COUNTERS to MOST_COUNTERS."""
    size = COUNTERS
    wanted = total_bytes(docs, "text") / COUNTER_BYTES
    while size < min(wanted, MOST_COUNTERS):
        size *= 2
    return size


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents the shingles of each counter stand, over all documents. What a task sends and what the
    driver gets are of a bounded size."""
    size = counters_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, counters(shingles(text.as_py(), hashes), size), 1)
        yield chunk_rows(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts[chunk * CHUNK : (chunk + 1) * CHUNK] += chunk_counts(part)
        yield chunk_rows(counts)

    schema = "chunk int, counts binary"
    total = np.zeros(size, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition(min(size, COUNTERS) // CHUNK, "chunk").mapInArrow(add, schema).collect():
        total[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += chunk_counts(row.counts)
    return total


def with_prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key (a hash of the set of shingles), n (its size), the set's prefix, rare shingles first, the
    set's parities, and fp, the text's fingerprint as operator 4 has it."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))

    @F.pandas_udf("struct<key:long,n:long,prefix:array<long>,bits:array<long>,fp:long>")
    def marked(texts: pd.Series) -> pd.DataFrame:
        hashes, rows = WordHashes(), []
        for text in texts:
            own = shingles(text, hashes)
            n, order = len(own), np.lexsort((own, counts.value[counters(own, len(counts.value))]))
            prefix = own[order[: n + 1 - -(-LEAST * n // OF)]]
            rows.append((xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), n, prefix.view(np.int64), parities(own), int(np.uint64(fingerprint(text)).astype(np.int64))))
        return pd.DataFrame(rows, columns=["key", "n", "prefix", "bits", "fp"])

    out = docs.select("doc_id", F.xxhash64("text").alias("text_key"), marked.asNondeterministic()("text").alias("p"))
    return out.select("doc_id", "text_key", "p.*")


def may_be_near(n1: str, place1: str, n2: str, place2: str) -> str:
    """Whether two sets can be near copies whose first common shingle stands at these places of their order."""
    return f"{LEAST + OF} * least({n1} - {place1}, {n2} - {place2}) >= {LEAST} * ({n1} + {n2})"


def parities_allow(x: str, y: str) -> str:
    """Whether two sets (n, bits) can be near copies, which differ in a ninth of the sum of their sizes at most."""
    apart = " + ".join(f"bit_count({x}.bits[{i}] ^ {y}.bits[{i}])" for i in range(BITS // 64))
    return f"{LEAST + OF} * ({apart}) <= {OF - LEAST} * ({x}.n + {y}.n)"


def verified(pairs: DataFrame, docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets have the similarity."""
    pairs = cut(pairs.distinct())
    keys = pairs.selectExpr("explode(array(a, b)) AS key").distinct()
    wanted = cut(marked.join(keys, "key").groupBy("key").agg(F.min("text_key").alias("text_key")))
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(broadcast_if_small(wanted), "text_key")
    sets = cut(texts.groupBy("key").agg(F.first("text").alias("text")).select("key", shingle_set("text").alias("own")))
    for c in "ab":
        pairs = pairs.join(broadcast_if_small(sets.select(F.col("key").alias(c), F.col("own").alias(f"set_{c}"))), c)
    near = f"{LEAST + OF} * size(array_intersect(set_a, set_b)) >= {LEAST} * (size(set_a) + size(set_b))"
    return pairs.filter(near).select("a", "b")


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that connect sets as operator 4 connects their texts' fingerprints."""
    own = cut(marked.select("fp", "key").distinct())
    low = cut(own.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")))
    same = join_counted(own, low.filter("n > 1"), ["fp"]).selectExpr("low AS a", "key AS b")
    linked = cut(links_between(low.select("fp")))
    ends = cut(low.join(linked.selectExpr("explode(array(a, b)) AS fp").distinct(), "fp").select("fp", "low"))
    for c in "ab":
        linked = linked.join(broadcast_if_small(ends.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}"))), c)
    return same.unionByName(linked.selectExpr("least(low_a, low_b) AS a", "greatest(low_a, low_b) AS b")).filter("a <> b")


def open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """The sets that a prefix shingle brings together (s, key, n, place, bits) with their roots by the links so far, without
    the shingles whose sets are all connected."""
    roots = components(links).withColumnRenamed("node", "key")
    left = members.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    unsettled = left.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("s")
    return cut(left.join(unsettled, "s"))


def few_pairs(members: DataFrame, crowd: DataFrame) -> DataFrame:
    """Candidates (a, b) of different roots, of the shingles that few sets share. A pair's number of them, with what shingles in `crowd`
    may add to it, has to leave the similarity possible."""
    held = members.join(broadcast_if_small(crowd.select("s").distinct()), "s", "left_anti").groupBy("s").agg(F.collect_list(F.struct("key", "n", "root")).alias("held"))
    sized = f"{OF} * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n)"
    pairs = f"explode(flatten(transform(held, x -> transform(filter(held, y -> x.key < y.key AND x.root <> y.root AND {sized}), y -> struct(x.key AS a, y.key AS b, x.n + y.n AS both, greatest(x.n, y.n) AS most))))) AS p"
    counted = cut(held.selectExpr(pairs).select("p.*").groupBy("a", "b", "both", "most").agg(F.count("*").alias("common")))
    crowded = cut(crowd.groupBy("key").agg(F.count("*").alias("k")))
    for c in "ab":
        counted = counted.join(broadcast_if_small(crowded.select(F.col("key").alias(c), F.col("k").alias(f"k{c}"))), c, "left")
    possible = f"common + least(coalesce(ka, 0), coalesce(kb, 0)) + ceil({LEAST} * most / {OF}) - 1"
    return counted.filter(f"{LEAST + OF} * ({possible}) >= {LEAST} * both").select("a", "b")


def links_of(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) that connect keys exactly as all pairs of near copies do."""
    hashed = cut(verified(simhash_pairs(marked), docs, marked))
    roots = broadcast_if_small(components(hashed).withColumnRenamed("node", "key"))
    rooted = marked.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    entries = rooted.selectExpr("key", "n", "root", "posexplode(prefix) AS (place, s)")
    shared = entries.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    members = cut(entries.join(shared, "s").select("s", "key", "n", "place", "root").distinct())
    crowds = cut(members.groupBy("s").count().filter(F.col("count") > CENTRES).select("s"))
    crowd = cut(members.join(broadcast_if_small(crowds), "s"))
    few = few_pairs(members, crowd)
    if crowds.isEmpty():
        return hashed.unionByName(verified(few, docs, marked))
    own = broadcast_if_small(crowd.select("key").distinct())
    crowd = cut(crowd.join(broadcast_if_small(cut(marked.join(own, "key").groupBy("key").agg(F.first("bits").alias("bits")))), "key"))
    centre = lambda i: F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("order"), "key", "n", "place", "bits", "root")).alias(f"c{i}")
    centres = crowd.groupBy("s").agg(*map(centre, range(CENTRES)))
    centres = centres.select("s", F.array_distinct(F.array(*[F.col(f"c{i}").dropFields("order") for i in range(CENTRES)])).alias("centres"))
    centres = broadcast_if_small(cut(centres.selectExpr("s", "inline(centres)")))
    # The bounds are conditions of the join, so only pairs that pass them become rows.
    star = crowd.alias("x").join(centres.alias("c"), "s").filter("x.root <> c.root").filter(may_be_near("x.n", "x.place", "c.n", "c.place")).filter(parities_allow("x", "c"))
    star = star.selectExpr("least(x.key, c.key) AS a", "greatest(x.key, c.key) AS b")
    links = cut(hashed.unionByName(verified(few.unionByName(star), docs, marked)))
    left = open_members(crowd, links)
    # Near copies differ in size by a quarter at most, so only sets of one band of sizes or the next one meet.
    banded = left.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.26))))
    others = banded.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    both = banded.alias("x").join(others.alias("y"), ["s", "band"]).filter("x.key < y.key AND x.root <> y.root")
    more = both.filter(may_be_near("x.n", "x.place", "y.n", "y.place")).filter(parities_allow("x", "y")).selectExpr("x.key AS a", "y.key AS b")
    return links.unionByName(verified(more, docs, marked))


def marked_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and root of each document: near copies, and what chains of them connect,
    have one root. Null, empty and blank texts have the empty set and are copies of each other."""
    marked = cut(with_prefixes(docs))
    roots = components(links_of(docs, marked))
    return marked.join(roots, marked.key == roots.node, "left").select("doc_id", "text_key", F.coalesce("root", "key").alias("root"))
