"""Mixing, chat formatting and the pipeline, with nulls, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random

import pytest

import corpus_pipeline
from loomkit.llm import chat, mixing

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * sizes[s] for s in capped}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("bucket", [2000, 3])
def test_mixing(spark, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    r = random.Random(2)
    sources = [*(f"s{i}" for i in range(7)), "big", None, "é", ""]
    rows = [(i, " ".join("w" * r.randrange(0, 60)), r.choice([*sources, *["big"] * 6])) for i in range(300)]
    rows += [(400, None, "s1"), (401, "", "s2"), (None, "a b c", "s3"), rows[5], rows[5], (402, " \t", "only blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS bucket", "3 AS of", "4 AS start")
    got = mixing.mix(df).collect()
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    assert len(got) == len(rows) and sorted(c for c in got[0].asDict() if c in ("bucket", "of", "start")) == ["bucket", "of", "start"]
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert all(x.source_size == sizes[s] and abs(x.target - target[s]) < 1e-6 and x.size == size(x.text) and 0 <= x.taken <= 3 * x.size for x in own)
        assert abs(sum(x.taken for x in own) - target[s]) <= 1
    key = lambda x: repr((x.doc_id, x.source, x.taken))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    assert [x.taken for x in mixing.mix(df.filter("doc_id >= 401")).collect()] == [0, 0]


def conversations(seed):
    r = random.Random(seed)
    texts = ["", None, "hello", "\\", "#", "###", "### user: x", "</turn>", "\\### Assistant: </turn> ok", "<", "<\\/turn>", "a\nb", "É🙂", "##", "\\#"]
    rows = []
    for conv in range(40):
        for turn in range(r.randrange(1, 7)):
            rows.append((conv, turn, r.choice(["user", "assistant", "a:b", "", None, "x\\"]) if turn else "user", r.choice(texts[: 4 if turn < 2 else None])))
    return rows + [(100, 0, "user", "tie"), (100, 0, "user", "other"), (None, 1, "assistant", "no id"), (101, None, "user", "first"), (101, 1, "user", "x"), (0, 0, rows[0][2], rows[0][3]), *((200 + i, t, "user", f"same {t}") for i in range(30) for t in range(3))]


@pytest.mark.parametrize(("tokenizer", "tokens", "shard"), [(None, 1 << 16, 256), (TOKENIZER, 1 << 16, 256), (None, 40, 2)])
def test_chat(spark, tokenizer, tokens, shard, monkeypatch):
    monkeypatch.setattr(chat, "SHARD_PATHS", shard)
    rows = conversations(6)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS tree")
    packs, members = chat.format_conversations(df, tokenizer, tokens)
    read = {r.path_id: r for r in chat.read_back(packs).collect()}
    path_of = {r.conv_id: r.path_id for r in members.collect()}
    order = lambda x: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in (x[1], x[2] or "", x[3] or ""))
    for conv, turns in itertools.groupby(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, order(x))), key=lambda x: x[0]):
        want = [(x[2] or "", x[3] or "") for x in turns]
        got = read[path_of[conv]]
        assert [tuple(t) for t in got.turns] == want
        assert got.loss_text == "".join(t for role, t in want if role == "assistant")
        assert got.formatted_chars == sum(len(chat.piece(role, t)[0]) for role, t in want)
    parts = {}
    for r in packs.collect():
        parts.setdefault(r.pack_id, []).append(r)
    for pack in parts.values():
        pack.sort(key=lambda r: r.start)
        ids = [i for r in pack for i in r.token_ids]
        at = 0
        for r in pack:
            assert r.start == at and r.position == sum(s.stop - s.start for s in r.attends)
            assert all(s.stop <= r.start for s in r.attends)
            at += len(r.token_ids)
            if tokenizer is None:
                prefix = [i for s in r.attends for i in ids[s.start : s.stop]]
                text = "".join(map(chr, prefix + r.token_ids))
                assert [(chat.unescaped(m[1]), chat.unescaped(m[2])) for m in chat.TURN.finditer(text)] == [tuple(t) for t in read[r.path_id].turns]
    if tokens > 1000:
        # Shared turns stand in the text once: as many turns as there are distinct prefixes.
        prefixes = {tuple(map(tuple, r.turns[: i + 1])) for r in read.values() for i in range(len(r.turns))}
        assert sum(len(chat.TURN.findall(r.text)) for p in parts.values() for r in p) == len(prefixes)
    empty, none = chat.format_conversations(df.limit(0))
    assert empty.count() == none.count() == chat.read_back(empty).count() == 0


def test_tokenizer_files_agree():
    by_merges, by_ranks = chat.encoder(TOKENIZER), chat.encoder(TOKENIZER.replace(".json", ".tiktoken"))
    for text in ("", "### user: Où est-il? 123  \n\n x</turn>\n", "🙂 don't", "<|endoftext|>"):
        assert by_merges(text) == by_ranks(text)


def test_escapes():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice(["\\", "#", "<", "/", "</turn>", "turn>", ":", " ", "\n", "a"]) for _ in range(r.randrange(0, 9)))
        written, a, b = chat.piece(text, text)
        assert [(chat.unescaped(m[1]), chat.unescaped(m[2])) for m in chat.TURN.finditer(written + chat.piece("user", "z")[0])] == [(text, text), ("user", "z")]
        assert chat.unescaped(written[a:b]) == text and "</turn>" not in written[a:b] and "##" not in written[a:b]


def brute_pipeline(rows, items):
    """The five stages over lists, by the brute-force versions of the operators' tests."""
    from test_filters import brute_matches, brute_verdicts
    from test_near_copies import brute_groups

    good = brute_verdicts([(r["text"], r["lang"], r["source"]) for r in rows])
    rows = sorted((r for k, r in enumerate(rows) if good[k]), key=lambda r: r["doc_id"])
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    first = {}
    for r in rows:
        lines = list(filter(None, map(strip, r["text"].split("\n"))))
        for p in range(len(lines) - 1):
            first.setdefault((lines[p], lines[p + 1]), (r["doc_id"], p))
        for p, line in enumerate(lines):
            if len(line.encode().split()) >= 50:
                first.setdefault(line, (r["doc_id"], p))
    left = []
    for r in rows:
        lines = list(filter(None, map(strip, r["text"].split("\n"))))
        gone = {q for p in range(len(lines) - 1) if first[lines[p], lines[p + 1]] < (r["doc_id"], p) for q in (p, p + 1)}
        gone |= {p for p, line in enumerate(lines) if first.get(line, (r["doc_id"], p)) < (r["doc_id"], p)}
        if gone and len(gone) == len(lines):
            continue
        out, n = [], -1
        for line in r["text"].split("\n"):
            n += bool(strip(line))
            if not strip(line) or n not in gone:
                out.append(line)
        left.append(r | {"text": "\n".join(out)})
    label = brute_groups([r["text"] for r in left])
    seen, kept = set(), []
    for r, x in zip(left, label, strict=True):
        if x not in seen:
            seen.add(x)
            kept.append(r)
    kept = [r for r in kept if not brute_matches([(r["doc_id"], r["text"])], items)]
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in kept}
    sizes = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    target, out = brute_targets(sizes), {}
    for s, words in sizes.items():
        epochs, rest = divmod(int(target[s] + 1e-9), words) if words else (0, 0)
        for r in sorted((r for r in kept if r["source"] == s), key=lambda r: hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()):
            part = min(size[r["doc_id"]], max(rest, 0))
            rest -= size[r["doc_id"]]
            if taken := epochs * size[r["doc_id"]] + part:
                out[r["doc_id"]] = (r["text"], r["source"], taken)
    return out


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: (r.text, r.source, r.taken) for r in corpus_pipeline.run(spark, sf).collect()}
    expected = brute_pipeline(rows, items)
    assert set(got) == set(expected)
    for k, (text, source, taken) in got.items():
        assert (text, source) == expected[k][:2] and abs(taken - expected[k][2]) <= 1


def test_stages_on_hard_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, " ".join(f"w{i}" for i in range(80)), None, "s", 1), (2, " ".join(f"w{i}" for i in range(80)), None, "s", 1), (3, "x " * 100_000, "en", None, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).selectExpr("*", "1 AS row", "2 AS q", "3 AS size", "4 AS n_lines", "5 AS `a.b`")
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
            out.collect()
            # Each stage by itself also takes what an earlier one would have dropped.
