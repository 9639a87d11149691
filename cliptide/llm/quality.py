"""Text quality by a sparse rule ensemble over statistics of the text.

Shallow trees grown over the statistics give candidate rules: every path from a root is a conjunction of comparisons.
A logistic model with a lasso penalty weighs the rules, most weights become zero, and the rest is compiled into one
Spark column expression. Statistics are one pass over whole texts; training and scoring read them, not the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stage
from .text import lower_ascii, narrow, rows_out, slices, span_hash, utf8, word_spans

#: Labelled rows that training reads at most, about; more are thinned by a hash of the id.
TRAIN_ROWS = 200_000
TREES, DEPTH, LASSO = 12, 3, 0.0005
STATS = (
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "upper", "lower", "beyond_ascii", "digits", "marks",
    "stops", "bare_words", "marked_words", "shouted_words", "repeats_last", "distinct_words", "lines", "distinct_lines",
)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double for each of STATS) of every row; null and empty texts have zeros."""
    schema = pa.schema([("doc_id", pa.int64()), *[(s, pa.float64()) for s in STATS]])
    kind = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 beyond ASCII, 4 digit, 5 sentence mark, 6 other mark
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 1, 2, 3, 4
    kind[[c for c in range(33, 127) if not kind[c]]] = 6
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 5

    def measure(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        n = len(starts) - 1
        size = np.diff(starts)
        row = np.repeat(np.arange(n), size)
        cls = kind[data]
        by = np.bincount(row * 7 + cls, minlength=7 * n).reshape(n, 7)
        shown = np.maximum(by[:, 1:].sum(axis=1), 1)
        begin, end, of = word_spans(data, starts)
        words = np.bincount(of, minlength=n)
        each = np.maximum(words, 1)
        per = lambda flag: np.bincount(of, weights=flag, minlength=n) / each
        longest = np.zeros(n)
        np.maximum.at(longest, of, end - begin)
        sums = lambda k: np.concatenate(([0], np.cumsum(cls == k)))
        inside = lambda s: s[end] - s[begin]
        upper, lower, beyond, marks = inside(sums(1)), inside(sums(2)), inside(sums(3)), inside(sums(6))
        h = span_hash(lower_ascii(data), begin, end)
        again = np.zeros(len(h))
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])

        def distinct(owner, hashes):
            order = np.lexsort((hashes, owner))
            o, x = owner[order], hashes[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
            return np.bincount(o[new], minlength=n)

        # Lines: cut at newlines and at the ends of texts; blank ones do not count.
        cut = np.unique(np.concatenate((starts, np.flatnonzero(data == 10) + 1)))
        a, b = cut[:-1], cut[1:]
        trimmed = b - (data[np.maximum(b - 1, 0)] == 10) if len(data) else b
        full = trimmed > a
        a, b = a[full], trimmed[full]
        line_of = np.searchsorted(starts, a, side="right") - 1
        lines = np.bincount(line_of, minlength=n)
        return [
            np.log1p(size), np.log1p(words), size / each, longest, by[:, 1] / shown, by[:, 2] / shown, by[:, 3] / shown,
            by[:, 4] / shown, by[:, 6] / shown, by[:, 5] / shown, per((marks + upper + lower + beyond) == 0),
            per((marks > 0) & (upper + lower + beyond > 0)), per((upper > 1) & (lower == 0)), per(again),
            distinct(of, h) / each, np.log1p(lines), distinct(line_of, span_hash(data, a, b)) / np.maximum(lines, 1),
        ]

    def run(batches):
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for lo, hi in slices(np.diff(starts), 2_000_000):
                part = data[starts[lo] : starts[hi]]
                columns = measure(part, starts[lo : hi + 1] - starts[lo])
                yield rows_out(schema, doc_id=batch.column(0).slice(lo, hi - lo), **dict(zip(STATS, columns)))

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of comparisons (statistic, is it at most, threshold), with its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.tests:
            out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if m else '>'} {t:.6g}" for n, m, t in self.tests) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(described: str) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path of a tree from its root, inner ones included, read from the model's printed form."""
    out, path = [], {}
    for line in described.splitlines():
        m = _LINE.match(line)
        if m:
            depth = len(m[1])
            path = {d: t for d, t in path.items() if d < depth}
            path[depth] = (STATS[int(m[3])], m[4] == "<=", float(m[5]))
            out.append(tuple(path[d] for d in sorted(path)))
    return out


def fit(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, lasso: float = LASSO) -> RuleEnsemble:
    """Rules and weights from rows (doc_id, STATS) and (doc_id, label 0 or 1).

    Rows with a null id or label are left out. With one class, or no labelled row, the ensemble has no rule and scores
    the share of label 1, or one half.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    share, n = known.agg(F.avg("label"), F.count("*")).first()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    if share is None or share in (0.0, 1.0):
        p = 0.5 if share is None else min(max(share, 0.01), 0.99)
        return RuleEnsemble((), float(np.log(p / (1 - p))))
    rows = stage(
        measured.dropDuplicates(["doc_id"]).join(known, "doc_id").select(array_to_vector(F.array(*STATS)).alias("features"), "label", *STATS),
        "labelled",
    )
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=7).fit(rows)
    paths = sorted({p for t in forest.trees for p in tree_rules(t.toDebugString)})
    if not paths:
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    held = rows.select(array_to_vector(F.array(*[Rule(p).column().cast("double") for p in paths])).alias("features"), "label")
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(held)
    rules = tuple(Rule(p, float(w)) for p, w in zip(paths, lasso_fit.coefficients.toArray()) if w)
    return RuleEnsemble(rules, float(lasso_fit.intercept))


def score(measured: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """(doc_id, score) of rows (doc_id, STATS), by the compiled rules."""
    return measured.select("doc_id", ensemble.score().alias("score"))
