"""Repeated single long lines, in the pipeline's line stage and against brute force."""

import random

import corpus_pipeline
import pytest
from test_dedup import frame

from loomkit.llm import common, line_dedup


@pytest.mark.parametrize("run", [2, 3])
def test_long_lines(spark, run):
    r = random.Random(run)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 49, 50, 80])))
    shared = [line() for _ in range(20)]
    rows = [(i, "\n".join(r.choice(shared) if r.random() < 0.5 else line() for _ in range(r.randrange(1, 7)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, rows[5][1].split("\n")[0])]
    seen, expected = set(), []
    for i, t in rows:
        lines, gone = [x for x in (t or "").split("\n") if x], set()
        for size in (1, run):
            for p in range(len(lines) - size + 1):
                window = tuple(lines[p : p + size])
                if size == run or len(window[0].split()) >= 50:
                    if window in seen:
                        gone.update(range(p, p + size))
                    seen.add(window)
        expected.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    got = line_dedup.dedup_lines(frame(spark, rows), run, long_words=50).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_stage_deletes_single_long_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(52)), " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"first\n{long}\nlast"), (2, f"other\n{long}\nend"), (3, long), (4, f"a\n{short}\nb"), (5, f"c\n{short}\nd")]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("other\nend", 9), 4: (rows[3][1], len(rows[3][1])), 5: (rows[4][1], len(rows[4][1]))}


def test_odd_ends_and_long_lines(spark):
    """Only ASCII white space is trimmed; a line of a million spaces and one of a million words take seconds."""
    rows = [(1, "abc  \u2028\nx"), (2, "abc \u2028\nx"), (3, "abc\x85\ny"), (4, "abc\ny"), (5, "a" + " " * 1_000_000 + "b\nend" + " " * 1_000_000), (6, "w " * 1_000_000 + "\nsame\nsame too"), (7, "same\n \nsame too\t"), (8, "same\x0b\n\f\n same too\nz")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows), 2, long_words=50).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(rows[i][1], 2, 0) for i in range(5)]
    assert got[6] == (rows[5][1], 3, 0) and got[7] == (" ", 2, 2) and got[8] == ("\f\nz", 3, 2)


@pytest.mark.parametrize("small", [8 << 20, -1])
def test_common_lines(spark, small, monkeypatch):
    """A line and a run that nearly all documents share, joined apart from the others in both ways."""
    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(common, "SMALL_BYTES", small)
    rows = [(i, f"own {i}\ncommon\nrun of\ntwo lines\nown end {i % 50}\ncommon") for i in range(200)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, (_, text) in enumerate(rows):
        gone = 0 if i == 0 else 3 if i < 50 else 5
        lines = text.split("\n")
        assert got[i] == ("\n".join([lines[0], *lines[6 - (5 - gone) :]]) if gone else text, gone)
