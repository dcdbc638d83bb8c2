"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import documents, frame

from loomkit.llm import near_copies
from loomkit.llm.simhash import group_near_copies


def brute_groups(texts):
    """The smallest place that chains of pairs of five-word Jaccard similarity of 0.8 or more reach, for each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("centres", [3, 16])
def test_stage_drops_all_near_copies(spark, monkeypatch, centres):
    monkeypatch.setattr(near_copies, "CENTRES", centres)
    monkeypatch.setattr(near_copies, "COUNTERS", 1 << 13)  # many shingles share a counter
    r = random.Random(3)
    rows = [x for x in documents(99) if x[0] is not None]
    common = [f"c{j}" for j in range(60)]
    for base in range(12):
        words = [f"b{base}w{j}" for j in range(r.randrange(50, 300))] + common
        for copy in range(10):
            own = list(words)
            for _ in range(r.randrange(0, 2 + len(own) // 30)):
                own[r.randrange(len(own))] = f"new{r.randrange(10**9)}"
            rows.append((1000 + base * 10 + copy, " ".join(own)))
    rows = list({i: (i, t) for i, t in rows}.values())
    label = brute_groups([t for _, t in rows])
    smallest = {}
    for (i, _), x in zip(rows, label, strict=True):
        smallest[x] = min(i, smallest.get(x, i))
    assert 20 < len(smallest) < len(rows) - 30
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(smallest.values())


def test_counts_cover_all_documents(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COUNTERS", 1 << 13)
    rows = [(i, None if i % 7 == 0 else f"same five words stand here w{i} and {'x y ' * (i % 5)}") for i in range(300)]
    hashes, wanted = near_copies.WordHashes(), [0] * (1 << 13)
    for _, text in rows:
        for c in near_copies.counters(near_copies.shingles(text, hashes), 1 << 13).tolist():
            wanted[c] += 1
    assert near_copies.shingle_counts(frame(spark, rows).repartition(3)).tolist() == wanted
    assert not near_copies.shingle_counts(frame(spark, [])).any()


def test_sets_differ_in_at_least_as_many_shingles_as_parities():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 300, 5000):
        for changed in (0, 1, n // 20, n // 2):
            a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 1 << 64, changed, np.uint64)]))
            apart = int(np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum())
            differ = len(np.setxor1d(a, b))
            assert apart <= differ and (apart - differ) % 2 == 0
            assert apart >= 0.7 * differ or differ > near_copies.BITS // 4


def test_prefixes_keep_to_rare_shingles_in_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COUNTERS", 1 << 12)
    monkeypatch.setattr(near_copies, "COUNTER_BYTES", 16)
    r = random.Random(8)
    own = lambda n: [f"{r.randrange(1 << 30):x}" for _ in range(n)]
    passages = [own(12) for _ in range(400)]
    rows = [(i, " ".join(own(100) + passages[i // 5] + own(88))) for i in range(2000)]  # a passage stands in five texts
    entries = near_copies.with_prefixes(frame(spark, rows)).selectExpr("explode(prefix) AS s")
    shared = entries.groupBy("s").count().filter("count > 3").selectExpr("coalesce(sum(count), 0) AS n").first().n
    assert shared < 100


def test_counts_travel_in_types_that_hold_them():
    counts = np.zeros(4 * near_copies.CHUNK, np.int64)
    for chunk, most in enumerate((255, 256, 1 << 16, 1 << 32)):
        counts[chunk * near_copies.CHUNK + 7] = most
    rows = near_copies.chunk_rows(counts)
    assert (np.concatenate([near_copies.chunk_counts(p) for p in rows.column("counts").to_pylist()]) == counts).all()


def test_simhash_links_come_first(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {i: t for i, t in documents(60) if i is not None}
    texts |= {5000 + i: " ".join([*words[: 390 - i], *[f"x{i}"] * (i > 0), *words[390 - i :]]) for i in range(6)}
    docs = frame(spark, list(texts.items()))
    component = {r.doc_id: r.component_id for r in group_near_copies(docs).collect()}
    marked = near_copies.cut(near_copies.with_prefixes(docs))
    root = {r.node: r.root for r in near_copies.components(near_copies.simhash_pairs(marked)).collect()}
    got = {r.doc_id: root.get(r.key, r.key) for r in marked.collect()}
    assert len(set(component.values())) == len({(component[i], got[i]) for i in texts}) == len(set(got.values()))
    assert len(set(component.values())) < len({r.key for r in marked.collect()})


def test_small_tables_leave_few_shuffle_files(spark):
    """Each file takes a block of disk at least, however little is in it."""

    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {x for x in names if x.startswith("shuffle_")}

    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:90] + [f"x{i}"] * (i % 3)) for i in range(40)] + [" ".join(f"{i}y{j}" for j in range(30)) for i in range(40)]
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, were = files(), {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = corpus_pipeline.near_dedup(spark, frame(spark, list(enumerate(texts))).repartition(60), "")
        assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_groups(texts)))
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert len(files() - before) < 3000
