"""SimHash near-dedup by deletion-variant signatures.

Two fingerprints that differ in at most 3 of 64 bits have a half of 32 bits that differs in at most one bit. So
each half is indexed under the 32 variants in which one bit is a wildcard: an equality join of variants finds the
halves at distance one (a variant holds two values at most, since only the wildcard is free), and equality of the
half itself finds distance zero. The full fingerprints behind such halves are then verified.

Only distinct fingerprints take part, so a group of copies costs one row. Where very many fingerprints share a half, the
other half is indexed in the same way: at most 3 bits differ in it, so one of its quarters of 16 bits differs in at
most one, and fingerprints meet under the quarters' one-wildcard variants. What is still a crowd there is cut into
blocks, each pair of which is verified in its own unit. Units yield a spanning forest of their links, never all of
their pairs. Components come from alternating star contractions;
links that are few enough for one task are connected there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, is_small, join_counted, pieces
from loomkit.llm.common import cut_packed as cut

BITS, HALF, DISTANCE, SHINGLE = 64, 32, 3, 3
BLOCK = 2048  # fingerprints of a half in one block
SPREAD_ROWS = 20_000  # halves whose variants one task makes


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the hashes of all word shingles (A-Z lower-cased, repeats included); 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= SHINGLE:
        spans = [(0, len(line))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in spans], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, column: str = "text", name: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def signed(texts):
        return texts.map(lambda t: int(np.uint64(fingerprint(t)).astype(np.int64)))

    return docs.withColumn(name, signed(F.col(column)))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads units whose rows stand together; yields links that connect what each unit's verified pairs connect."""

    def links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(unit)) + 1
        found = [spanning(f[s == 0], f[s == 1]) for s, f in zip(np.split(side, edges), np.split(fp.view(np.uint64), edges), strict=True)]
        out = np.concatenate(found).view(np.int64)
        return pa.record_batch({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(name).to_numpy(zero_copy_only=False) for name in ("unit", "side", "fp")])
        if held[0][0][0] == held[-1][0][-1]:
            continue
        unit, side, fp = map(np.concatenate, zip(*held, strict=True))
        whole = int(np.flatnonzero(np.diff(unit))[-1]) + 1
        yield links(unit[:whole], side[:whole], fp[:whole])
        held = [[unit[whole:], side[whole:], fp[whole:]]]
    if held:
        yield links(*map(np.concatenate, zip(*held, strict=True)))


def spanning(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs within DISTANCE bits: inside `left` if `right` is empty, else across the two."""
    points = np.concatenate([left, right])
    label, links = np.arange(len(points)), []
    for i in range(len(left)):
        start = len(left) if len(right) else i + 1
        near = np.flatnonzero(np.bitwise_count(points[start:] ^ points[i]) <= DISTANCE) + start
        foreign, first = np.unique(label[near], return_index=True)
        merged = foreign != label[i]
        if merged.any():
            links += [(points[i], points[j]) for j in near[first[merged]]]
            label[np.isin(label, foreign[merged])] = label[i]
    return np.array(links, dtype=np.uint64).reshape(-1, 2)


def links_between(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) exactly as all pairs within DISTANCE bits do."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE
    halves = fingerprints.selectExpr("fp", "stack(2, 0, shiftrightunsigned(fp, 32), 1, fp & 4294967295L) AS (half, value)")
    sizes = halves.groupBy("half", "value").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    sizes = sizes.withColumn("m", F.ceil(F.col("n") / block).cast("int"))

    # 32 variants come of each row, so these rows are dealt out by number before, which no later step merges again.
    spread = sizes.select("half", "value").repartition(pieces(2 * fingerprints.count(), SPREAD_ROWS))
    variants = spread.selectExpr("half", "value", "explode(transform(sequence(0, 31), i -> (value & ~shiftleft(1L, i)) * 64 + i * 2 + half)) AS key")
    one_off = variants.groupBy("key").agg(F.min("value").alias("v0"), F.max("value").alias("v1")).filter("v0 <> v1")
    one_off = one_off.selectExpr("cast(key & 1 AS int) AS half", "v0", "v1")
    for k in "01":
        one_off = one_off.join(sizes.selectExpr("half", f"value AS v{k}", f"n AS n{k}", f"lo AS lo{k}", f"hi AS hi{k}", f"m AS m{k}"), ["half", f"v{k}"])
    single = "n0 = 1 AND n1 = 1"
    plain = one_off.filter(single).filter(near("lo0", "lo1")).selectExpr("lo0 AS a", "lo1 AS b")
    plain = plain.unionByName(sizes.filter("n = 2").filter(near("lo", "hi")).selectExpr("lo AS a", "hi AS b"))

    same = sizes.filter("n > 2").selectExpr("half", "value AS v0", "value AS v1", "m AS m0", "m AS m1")
    units = same.unionByName(one_off.filter(f"NOT ({single})").select("half", "v0", "v1", "m0", "m1"))
    units = units.selectExpr("half", "xxhash64(half, v0, v1) AS unit", "v0 = v1 AS own", "m0 > 1 OR m1 > 1 AS heavy", "stack(2, 0, v0, m0, 1, v1, m1) AS (side, value, m)")
    units = units.filter("NOT own OR side = 0").selectExpr("*", "explode(sequence(0, m - 1)) AS part").drop("m")
    # Parts of a value spread its fingerprints over tasks.
    shared = halves.join(sizes.select("half", "value", "m"), ["half", "value"]).selectExpr("half", "value", "cast(pmod(xxhash64(fp), m) AS int) AS part", "fp")
    members = units.join(shared, ["half", "value", "part"])
    light = members.filter("NOT heavy").select("unit", "side", "fp")
    crowded = blocked(by_quarters(members.filter("heavy").select("half", "unit", "own", "side", "fp")), block)
    near_ones = light.unionByName(crowded).repartition("unit").sortWithinPartitions("unit").mapInArrow(forest, "a long, b long")
    return plain.unionByName(near_ones)


def by_quarters(members: DataFrame) -> DataFrame:
    """Deals the fingerprints of a crowded half (half, unit, own, side, fp) out by the one-wildcard variants of the
    other half's two quarters: (unit, own, side, fp), one row for each of 32 variants."""
    other = members.withColumn("other", F.expr("if(half = 0, fp & 4294967295L, shiftrightunsigned(fp, 32))"))
    variant = "explode(flatten(transform(array(0, 1), q -> transform(sequence(0, 15), i -> ((shiftrightunsigned(other, 16 * q) & 65535L) & ~shiftleft(1L, i)) * 32 + i * 2 + q)))) AS variant"
    return other.selectExpr("*", variant).selectExpr("xxhash64(unit, variant) AS unit", "own", "side", "fp")


def blocked(members: DataFrame, block: int) -> DataFrame:
    """Units of at most about two blocks (unit, side, fp) that bring together whatever the given units do."""
    counts = members.groupBy("unit", "own").agg(F.count_if(F.expr("side = 0")).alias("n0"), F.count_if(F.expr("side = 1")).alias("n1"))
    counts = counts.filter("own AND n0 > 1 OR n0 > 0 AND n1 > 0").selectExpr("unit", f"cast(ceil(n0 / {block}) AS int) AS m0", f"cast(ceil(if(own, n0, n1) / {block}) AS int) AS m1")
    rows = members.join(counts, "unit").withColumn("part", F.expr("cast(pmod(xxhash64(fp), if(side = 0, m0, m1)) AS int)"))
    places = """CASE WHEN own THEN concat(transform(sequence(part, m0 - 1), j -> struct(part AS i, j AS j, 0 AS side)), transform(filter(sequence(0, part), i -> i < part), i -> struct(i AS i, part AS j, 1 AS side)))
        WHEN side = 0 THEN transform(sequence(0, m1 - 1), j -> struct(part AS i, j AS j, 0 AS side)) ELSE transform(sequence(0, m0 - 1), i -> struct(i AS i, part AS j, 1 AS side)) END"""
    return rows.select("unit", "fp", F.explode(F.expr(places)).alias("at")).selectExpr("xxhash64(unit, at.i, at.j) AS unit", "at.side AS side", "fp")


def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node that reaches a smaller one over links (a, b) that one task holds."""
    ends = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"]) for batch in batches]
    nodes, place = np.unique(np.concatenate([np.empty((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    (a, b), root = place.reshape(2, -1), np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    away = root != np.arange(len(nodes))
    yield pa.record_batch({"node": pa.array(nodes[away]), "root": pa.array(nodes[root[away]])})


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that reaches a smaller one; root is the smallest. By alternating large and small stars,
    unless the links are so few that one task holds them."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if is_small(edges):
        return cut(edges.coalesce(1).mapInArrow(connected, "node long, root long"))
    told = summary(edges)
    for _ in range(most_rounds):
        both = edges.selectExpr("stack(2, a, b, b, a) AS (u, v)")
        hubs = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.filter("v > u").join(hubs, "u").selectExpr("v AS x", "least(u, low) AS y").distinct()
        lows = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(lows, "x").selectExpr("if(y = low, x, y) AS a", "low AS b")
        edges, before = cut(small.distinct()), told
        told = summary(edges)
        if told == before:
            return edges.selectExpr("a AS node", "b AS root")
    raise RuntimeError("components did not settle")


def summary(edges: DataFrame) -> tuple:
    """Tells edge sets apart: their size and the sum of their rows' hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def marked_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), simhash and component_id of each document."""
    marked = cut(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("text_key"), "simhash"))
    distinct = cut(marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links_between(distinct))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    component = labelled.join(ids, "root").select(F.col("fp").alias("simhash"), "root", "component_id", "n")
    return join_counted(marked, cut(component), ["simhash"])


def group_near_copies(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, simhash (signed long) and component_id, the smallest doc_id reachable over
    links between fingerprints that differ in at most 3 bits.

    Takes doc_id (long) and text; other columns are left out, whatever they are called. Null, empty and blank texts
    have fingerprint zero and are linked like any other; texts of fewer than three words hash their whole sequence.
    Equal texts and repeated rows share a fingerprint, and repeated rows all come out. A null doc_id comes out as null
    and is never the smallest, so component_id is null only where a component has no other id. Very long texts are
    read whole, in time in proportion to their length; a text has to fit in a task. An empty table gives an empty table.
    """
    return marked_groups(docs).select("doc_id", "simhash", "component_id")


def keep_one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = marked_groups) -> DataFrame:
    """The rows of `docs`, all columns, without those that near-copy another: of each component one row stays, that of
    the smallest doc_id (null ids last); of rows that share this id, the one with the smallest hash of its text, once.
    `grouped` gives the components, as doc_id, text_key and root.
    """
    ranked = grouped(docs).selectExpr("root", "struct(doc_id IS NULL AS last, doc_id, text_key) AS rank")
    each = cut(ranked.groupBy("root", "rank").agg(F.count("*").alias("copies")))
    shared = cut(each.groupBy("root").agg(F.min("rank").alias("best"), F.sum("copies").alias("n")).filter("n > 1"))
    # Only rows of groups of several have to meet a decision. Texts stay where they are if those are few.
    others = cut(join_counted(each, shared, ["root"]).filter("rank <> best OR copies > 1").selectExpr("rank.*", "rank = best AS first"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_key")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.text_key") == F.col("o.text_key"))
    kept = rows.join(broadcast_if_small(others.select("doc_id", "text_key")).alias("o"), same, "left_anti").select("row")
    repeated = others.filter("first").select("doc_id", "text_key")
    if not repeated.isEmpty():
        once = rows.join(broadcast_if_small(repeated).alias("o"), same, "left_semi").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")
