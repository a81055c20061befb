"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark column expressions. On a bounded sample of labelled rows small trees
are grown; every path from a root to a node is a rule, a conjunction of comparisons. A
lasso-penalised logistic regression over the rules' truth values keeps few of them, and
the kept rules with their weights become one Spark column expression again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.llm import common

# Bounds of the fit: labelled rows used, about (chosen by a hash of the id); trees and their depth.
SAMPLE_ROWS = 10_000
TREES, DEPTH, TREE_ROWS, BINS = 40, 3, 1_000, 64
PENALTY = 0.002
ROUNDS = 400
STATISTICS = ("log_words", "word_length", "distinct_share", "capital_share", "mark_share", "symbol_share", "digit_share",
              "line_words")
Rule = tuple[tuple[int, bool, float], ...]      # (statistic, is at most, bound), in order


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every whole text; shares of an empty or null text are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count_of = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", ""))
    rows = common.keyed(docs).select("doc_id", text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("n", F.greatest(F.size("words"), F.lit(1)))
    rows = rows.select(
        "doc_id", "n", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("distinct"),
        F.length("text").alias("chars"), count_of("A-Z").alias("capitals"), count_of(r"!-/:-@\[-`{-~").alias("marks"),
        count_of("#*$%&|<>").alias("symbols"), count_of("0-9").alias("digits"), (count_of(r"\n") + 1).alias("lines"))
    share = lambda c: F.col(c) / F.greatest("chars", F.lit(1))
    return rows.select(
        "doc_id", F.log1p("n_words").alias("log_words"),
        (F.greatest(F.col("chars") - F.col("n_words"), F.lit(0)) / F.col("n")).alias("word_length"),
        (F.col("distinct") / F.col("n")).alias("distinct_share"), share("capitals").alias("capital_share"),
        share("marks").alias("mark_share"), share("symbols").alias("symbol_share"), share("digits").alias("digit_share"),
        (F.col("n_words") / F.col("lines")).alias("line_words"))


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 9) -> list[Rule]:
    """Paths of trees grown on random rows, each split chosen among random statistics by the drop of the Gini index."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    found: dict[Rule, None] = {}

    def grow(rows, path, depth):
        if path:
            found[tuple(sorted(path))] = None
        labels = y[rows]
        if depth == DEPTH or labels.min(initial=1) == labels.max(initial=0):
            return
        best = None
        for f in rng.permutation(x.shape[1])[:4]:
            left = x[rows, f][:, None] <= cuts[f]
            n_left, good_left = left.sum(0), (left & labels[:, None]).sum(0)
            n_right, good_right = len(rows) - n_left, labels.sum() - good_left
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = good_left * (n_left - good_left) / n_left + good_right * (n_right - good_right) / n_right
            impurity[(n_left < 5) | (n_right < 5)] = np.inf
            if len(impurity) and np.isfinite(impurity.min()) and (best is None or impurity.min() < best[0]):
                k = int(impurity.argmin())
                best = (impurity[k], int(f), float(cuts[f][k]))
        if best:
            _, f, bound = best
            goes = x[rows, f] <= bound
            grow(rows[goes], path + [(f, True, bound)], depth + 1)
            grow(rows[~goes], path + [(f, False, bound)], depth + 1)

    for _ in range(TREES):
        grow(rng.choice(len(x), min(TREE_ROWS, len(x)), replace=False), [], 0)
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= bound) == at_most for f, at_most, bound in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + penalty * sum |weight|, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(z)), z])
    step = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = ahead = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        slope = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / len(a)
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / later * (new - w)
        w, momentum = new, later
    return float(w[0]), w[1:]


def fit(labelled: DataFrame) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules. Without rows the score is 0.5; with one class it is that class's smoothed share."""
    rows = labelled.toPandas()
    x, y = rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy() == 1
    if not len(y):
        return 0.0, []
    prior = (y.sum() + 1) / (len(y) + 2)
    rules = grow_rules(x, y)
    if not rules or y.all() or not y.any():
        return float(np.log(prior / (1 - prior))), []
    truth = np.column_stack([holds(r, x) for r in rules]).astype(float)
    _, distinct = np.unique(truth, axis=1, return_index=True)
    rules = [rules[k] for k in sorted(distinct)]
    bias, weights = lasso(truth[:, sorted(distinct)], y.astype(float))
    return bias, [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-4]


def compiled(bias: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble as one expression over the statistics' columns."""
    def condition(rule: Rule) -> Column:
        return reduce(lambda a, b: a & b, [F.col(STATISTICS[f]) <= bound if at_most else F.col(STATISTICS[f]) > bound
                                           for f, at_most, bound in rule])
    total = reduce(lambda a, b: a + b, [F.when(condition(r), w).otherwise(0.0) for w, r in rules], F.lit(bias))
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, training: Column, held_out: Column, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and empty texts score like any text without words. Labels of a repeated id count
    once, null labels not at all; an empty table gives no rows.
    """
    stats = statistics(docs)
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & training)
             .dropDuplicates(["doc_id"]))
    share = min(1.0, SAMPLE_ROWS / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    texts = common.keyed(docs).join(marks, "doc_id")
    bias, rules = fit(statistics(texts).join(marks, "doc_id").dropDuplicates(["doc_id"]))
    score = compiled(bias, rules)
    return stats.select("doc_id", held_out.alias("held_out"), score.alias("score")).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
