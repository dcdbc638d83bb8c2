"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Four statistics of each text are transformed and put on a fine lattice. A group (language and source) is then a count
for each occupied cell, however many documents it has, and cell counts are whole numbers, so estimates don't depend on
the order in which partitions are merged. For each group the covariance of ALPHA of its points with the smallest
determinant is sought: from several deterministic starts, concentration steps (the ALPHA points nearest to the present
centre under the present covariance, their mean and covariance, again) go on until the determinant no longer falls;
the start that ends at the smallest one decides. A floor on each standard deviation keeps groups whose texts hardly
differ from rejecting everything else.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, cut

# Characters that count as symbols, white space that ends words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

# Of the transformed statistics: log of the mean word length, roots of symbols a symbol or word, of repeated lines a line, of repeated words a word.
FLOORS = (0.10, 0.10, 0.20, 0.20)
CELL = 0.01  # edge of a lattice cell in each of them; the last three are below 1, the first below log of the longest text
P = len(FLOORS)
ALPHA, CONFIDENCE = 0.75, 0.9999
MOST_STEPS = 200
FEWEST_WORDS, MOST_REPEATED = 50, 50

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def chi_square(x: float, df: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_point(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, df) < p else (low, middle)
    return high


CUTOFF = chi_square_point(CONFIDENCE, P)


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pairs = own[:-1] * len(ids) + own[1:]
    if len(ids) > 2_000_000:  # three numbers no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + own[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : i + n - 2] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def statistics_of(text: Column) -> Column:
    @F.pandas_udf(", ".join(STATS.split(", ")))
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[s.split()[0] for s in STATS.split(", ")])

    return stats.asNondeterministic()(text)


def with_vectors(df: DataFrame) -> DataFrame:
    """From column q (statistics): base_failed, the lattice cell x of the transformed statistics, and the group of lang and source."""
    q = lambda name: F.col(f"q.{name}").cast("double")
    failed = (F.col("q.n_words") < FEWEST_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * F.col("q.n_words"))
    shares = [
        F.log(q("word_chars") / q("n_words")),
        F.sqrt(q("n_symbols") / (q("n_symbols") + q("n_words"))),
        F.sqrt(q("n_dup_lines") / q("n_lines")),
        F.sqrt(q("n_repeat_words") / q("n_words")),
    ]
    x = F.array(*[F.floor(v / CELL + 0.5).cast("int") for v in shares])
    group = F.xxhash64(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source")
    return df.withColumn("base_failed", failed).withColumn("x", F.when(~failed, x)).withColumn("grp", group)


def squared_distance() -> Column:
    d = [F.col("x")[i] * F.lit(CELL) - F.col("centre")[i] for i in range(P)]
    return sum(d[i] * d[j] * F.col("precision")[i * P + j] for i in range(P) for j in range(P))


def moments(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = weights @ points / weights.sum()
    d = points - centre
    return centre, (d * weights[:, None]).T @ d / weights.sum()


def distances(points: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)


def held(order: np.ndarray, weights: np.ndarray, size: float) -> np.ndarray:
    """The weights of the first `size` points in that order; of the last cell just the part that fits."""
    before = np.cumsum(weights[order]) - weights[order]
    out = np.zeros(len(weights))
    out[order] = np.clip(size - before, 0, weights[order])
    return out


def median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)]


def starts(points: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Deterministic first estimates: medians with absolute deviations; the nearer half around the medians; the
    covariance of directions from the medians; mean and covariance of all."""
    floors = np.diag(np.square(FLOORS))
    middle = np.array([median(points[:, i], weights) for i in range(P)])
    spread = np.array([1.4826 * median(np.abs(points[:, i] - middle[i]), weights) for i in range(P)])
    scaled = (points - middle) / np.maximum(spread, FLOORS)
    far = np.sqrt(np.square(scaled).sum(axis=1))
    near = held(np.argsort(far, kind="stable"), weights, math.ceil(weights.sum() / 2))
    directions = scaled / np.where(far > 0, far, 1)[:, None] * np.maximum(spread, FLOORS)
    out = [(middle, np.diag(np.maximum(spread, FLOORS) ** 2)), (middle, moments(directions, weights)[1] + floors)]
    for w in (near, weights):
        centre, cov = moments(points, w)
        out.append((centre, cov + floors))
    return out


def smallest_determinant(points: np.ndarray, weights: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance (made consistent for normal data, floors added) and its determinant for the share alpha of
    the weighted points that concentration steps find from the best start."""
    size = math.ceil(alpha * weights.sum())
    consistency = alpha / chi_square(chi_square_point(alpha, P), P + 2) if alpha < 1 else 1.0
    floors, best = np.diag(np.square(FLOORS)), None
    for centre, cov in starts(points, weights):
        last = math.inf
        for _ in range(MOST_STEPS):
            inner = held(np.argsort(distances(points, centre, cov), kind="stable"), weights, size)
            centre, spread = moments(points, inner)
            cov = consistency * spread + floors
            now = float(np.linalg.det(cov))
            if now >= last * (1 - 1e-12):
                break
            last = now
        if best is None or now < best[2] * (1 - 1e-12):
            best = centre, cov, now
    return best


def fit(vectors: DataFrame) -> DataFrame:
    """(grp, centre, precision, determinant) of each group from the rows (grp, x) with an x. Documents are counted by
    cell before they meet, so a task holds a group's occupied cells, not its documents."""
    cells = vectors.filter("x IS NOT NULL").groupBy("grp", "x").agg(F.count("*").alias("n"))

    def estimate(key, frame):
        points = np.array(frame["x"].tolist(), dtype=np.int64)
        order = np.lexsort(points.T)
        centre, cov, determinant = smallest_determinant(points[order] * CELL, frame["n"].to_numpy(dtype=float)[order])
        return pd.DataFrame([(key[0], centre.tolist(), np.linalg.inv(cov).ravel().tolist(), determinant)], columns=["grp", "centre", "precision", "determinant"])

    return cells.groupBy("grp").applyInPandas(estimate, "grp long, centre array<double>, precision array<double>, determinant double")


def judged(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds kept: false where the base rules fail, else whether the squared distance is within the cutoff."""
    joined = vectors.join(broadcast_if_small(estimate.select("grp", "centre", "precision")), "grp", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(squared_distance() <= CUTOFF, F.lit(True))).drop("centre", "precision")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Takes doc_id, text, lang and source; other columns are left out. Null, empty and blank texts have no words and
    fail the base rules. Very long texts are read whole, in time in proportion (n log n for the repeated windows);
    a task holds one text's words at a time. Null languages and sources form groups of their own. Equal and repeated
    rows get equal verdicts; a group of one document, or of equal ones, rejects none. Reruns and other partitionings
    give the same verdicts. An empty table gives an empty table.
    """
    stats = docs.select("doc_id", "lang", "source", statistics_of(F.col("text")).alias("q"))
    vectors = cut(with_vectors(stats).select("doc_id", "q", "base_failed", "x", "grp"))
    return judged(vectors, cut(fit(vectors))).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that quality_verdicts keeps. Rows are written once beside their figures, which
    spares both a shuffle of the texts and a second reading of them."""
    rows = docs.select(F.struct("*").alias("row"), "lang", "source", statistics_of(F.col("text")).alias("q"))
    vectors = cut(with_vectors(rows).select("row", "base_failed", "x", "grp").filter("NOT base_failed"))
    return judged(vectors, cut(fit(vectors))).filter("kept").select("row.*")
