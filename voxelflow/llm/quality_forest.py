"""Quality rules by an isolation forest over rule statistics.

Statistics are counted over every whole text in one pass. The forest is fitted on a bounded sample of labelled
documents (about `trees` x `sample` rows, those at the low end of a hash of their id): its random splits isolate the few odd ones early. The threshold comes from every labelled document: a histogram of scores by label (aggregated
on the executors) gives the cut that separates best while at most `max_good_lost` of the good ones are lost. Without
labels of both kinds there is no cut, and only the base rule decides.

Null text has no words and fails the base rule; a null id has no label; several labels of an id each count; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import BLANK
from .shared import arrow_rows, id_and_text, materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]
SYMBOLS = "#*$%&|<>"
SCORE_BINS = 1000


def rule_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, upper, digits


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1] if len(number) > 1 << 20 else ids[:-2] * len(number) + ids[1:-1]
    _, at, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : len(words) - window + 1 + k] |= again
    return int(covered.sum())


def features(c: np.ndarray) -> np.ndarray:
    """Rule statistics from COUNTS (a row each): word length, shares of symbols and capitals (their roots, as most texts have few) and of repeated words. Length and repeated lines also vary widely among good documents and would hide the rest."""
    n_words, chars, symbols, _, repeat, _, upper, _ = c.astype(float).T
    words, chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    return np.column_stack([chars / words, np.sqrt(symbols / chars), repeat / words, np.sqrt(upper / chars)])


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits as flat arrays; a point's score is 2 ** -(mean path length / expected one), higher: more anomalous."""

    def __init__(self, points: np.ndarray, trees: int, sample: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = min(sample, len(points))
        self.norm = float(average_path(size)) or 1.0
        self.trees = [self._tree(points[rng.choice(len(points), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]

    @staticmethod
    def _tree(points: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        stack = [(0, points, 0)]
        while stack:
            node, x, d = stack.pop()
            lo, hi = x.min(axis=0), x.max(axis=0)
            wide = np.flatnonzero(hi > lo)
            if d >= depth or not wide.size:
                path[node] = d + float(average_path(len(x)))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[node], cut[node], left[node] = f, c, len(feature)
            for part in (x[x[:, f] <= c], x[x[:, f] > c]):
                stack.append((len(feature), part, d + 1))
                for column, empty in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
                    column.append(empty)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = rows[inner]
                f = feature[node[at]]
                node[at] = left[node[at]] + (x[at, f] > cut[node[at]])
            total += path[node]
        return 2 ** -(total / len(self.trees) / self.norm)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every row of docs."""

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(i, *rule_counts(t)) for i, t in arrow_rows([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * (1 + len(COUNTS)))], ["doc_id", *COUNTS])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_score(counts: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """counts with score, the forest's (0 without one)."""
    sent = counts.sparkSession.sparkContext.broadcast(forest)
    kept = counts.columns

    def judge(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            score = sent.value.score(features(x)) if sent.value and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*kept, "score"])

    return counts.mapInArrow(judge, ", ".join(f"`{c}` {t}" for c, t in counts.dtypes) + ", score double")


def calibrate(good: np.ndarray, bad: np.ndarray, max_good_lost: float) -> float:
    """The score from which documents are rejected, from histograms of scores over SCORE_BINS bins of [0, 1]."""
    if not good.sum() or not bad.sum():
        return float("inf")
    lost, caught = (1 - np.concatenate([[0], np.cumsum(h)]) / h.sum() for h in (good, bad))
    fits = lost <= max_good_lost
    return float(np.argmax(np.where(fits, caught - lost, -1)) / SCORE_BINS)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, max_good_lost: float = 0.02,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept for every row of docs. labels: 1 is good, 0 is bad."""
    counts = materialize(rule_statistics(docs, id_col, text_col), "rule-statistics")
    known = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good")).dropna()
    labelled = materialize(counts.join(known, "doc_id"), "labelled-statistics")
    share = trees * sample / max(1, labelled.count())  # of a hash's range: no task or driver sorts the labelled rows
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    seen = picked.select(*COUNTS).toPandas().sort_values(COUNTS).to_numpy()
    forest = IsolationForest(features(seen), trees, sample) if len(seen) > 1 else None
    bins = F.least(F.lit(SCORE_BINS - 1), F.floor(F.col("score") * SCORE_BINS)).cast("int")
    histogram = np.zeros((2, SCORE_BINS))
    for good, at, n in with_score(labelled.where(~base_failed()), forest).groupBy((F.col("good") > 0).cast("int"), bins).count().collect():
        histogram[good, at] = n
    cut = calibrate(histogram[1], histogram[0], max_good_lost)
    judged = with_score(counts, forest).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(cut)))
