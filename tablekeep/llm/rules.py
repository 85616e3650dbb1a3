"""Quality rules: isolation forests on rule statistics.

1. Rule statistics of every whole text (counts of words, symbols, repeated
   lines, repeated word windows, repeated neighbours, capitals); base rules
   reject the plain cases.
2. Isolation forests (Liu, Ting, Zhou 2008) over ratios of the rows that pass
   the base rules, one for each group of statistics and one for all together:
   trees of random splits on subsamples; anomalous rows are isolated after few
   splits. Trees are fitted in parallel, one group of about ``tree_rows`` rows
   each, so a fitted forest has a bounded size whatever the table holds.
3. The score above which a forest rejects a row is calibrated on all labelled
   rows: forest by forest, the cut that gains most labelled rows (bad ones
   caught less good ones lost) among those not yet rejected; a forest without
   gain rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_neighbours"]
FEATURES = ["symbol_ratio", "neighbour_ratio", "word_length", "upper_ratio", "repeat_ratio", "dup_line_ratio"]
#: Forests in the order in which they are calibrated.
FORESTS = {"symbols": ["symbol_ratio"], "neighbours": ["neighbour_ratio"], "words": ["word_length"],
           "capitals": ["upper_ratio"], "repeats": ["repeat_ratio", "dup_line_ratio"], "all": FEATURES}
MIN_GAIN = 2  # labelled rows that a cut must gain
WINDOW = 5
SCORE_STEPS = 1000  # resolution of the calibration histogram
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_WORD = re.compile(rf"[^{SPACES}]")


def repeated_window_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    found = Counter(grams)
    total, covered_to = 0, 0
    for i, g in enumerate(grams):
        if found[g] > 1:
            total += i + window - max(i, covered_to)
            covered_to = i + window
    return total


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; a null text is empty."""
    text = text or ""
    data = common.utf8(text)
    words = data.split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup,
            repeated_window_words(words), lines, len(data) - len(data.translate(None, _CAPITALS)),
            sum(map(bytes.__eq__, words, words[1:])))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, *COUNTS, base_failed)`` for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([rule_counts(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(COUNTS))]],
                                          names=["doc_id", *COUNTS])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = common.map_arrow(narrow, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return stats.withColumn("base_failed", (F.col("n_words") < 10)
                            | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def with_features(stats: DataFrame) -> DataFrame:
    """Ratios, damped so that a short text is not extreme by one word."""
    words, lines, chars = (F.col(c).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    return stats.withColumns({
        "symbol_ratio": F.col("n_symbols") / (words + 10), "neighbour_ratio": F.col("n_neighbours") / (words + 10),
        "word_length": (chars + 500) / (words + 100), "upper_ratio": F.col("n_upper") / (chars + 200),
        "repeat_ratio": F.col("n_repeat_words") / (words + 20), "dup_line_ratio": F.col("n_dup_lines") / (lines + 5)})


def _average_path(n: float) -> float:
    """Average path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(points: np.ndarray, seed: int, max_depth: int) -> np.ndarray:
    """Nodes ``(feature, split, left, right, path)``; a leaf has feature -1
    and its path length (depth plus the average for what it still holds)."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    todo = [(np.arange(len(points)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        part = points[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_features = np.flatnonzero(high > low)
        if depth >= max_depth or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(rows))])
            continue
        f = int(rng.choice(open_features))
        split = float(rng.uniform(low[f], high[f]))
        nodes.append([f, split, -1, -1, 0.0])
        left = part[:, f] <= split
        todo.append((rows[left], depth + 1, me, 0))
        todo.append((rows[~left], depth + 1, me, 1))
    return np.array(nodes, dtype=np.float64)


def fit_forest(rows: DataFrame, features: list[str], trees: int = 64, tree_rows: int = 256, seed: int = 7) -> list[np.ndarray]:
    """A forest over ``rows``. A row falls into a tree's subsample by a hash of
    its values, with the chance that gives ``tree_rows`` rows a tree, so the
    sampled rows are at most about ``trees * tree_rows``."""
    n = rows.count()
    if n == 0:
        return []
    copies = min(float(trees), trees * tree_rows / n)
    max_depth = 2 * math.ceil(math.log2(tree_rows))
    h = F.xxhash64(F.lit(seed), "doc_id", *features)
    more = (F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < copies - math.floor(copies)).cast("int")
    sample = (rows.select(*features, F.shiftrightunsigned(h, 8).alias("h"), (more + math.floor(copies)).alias("copies"))
              .filter("copies > 0")
              .select(*features, "h", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
              .select(*features, ((F.col("h") + F.col("copy")) % trees).cast("int").alias("tree")))

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values(features)[features].to_numpy(np.float64)
        return pd.DataFrame({"tree": [key[0]], "nodes": [grow_tree(points, seed + int(key[0]), max_depth).tobytes()]})
    common.ship_package(rows.sparkSession)
    fitted = sample.groupBy("tree").applyInPandas(fit, "tree int, nodes binary").collect()
    return [np.frombuffer(r.nodes, np.float64).reshape(-1, 5) for r in sorted(fitted)]


def forest_scores(forest: list[np.ndarray], points: np.ndarray, tree_rows: int = 256) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 ** (-mean path length / expected length)."""
    if not forest:
        return np.zeros(len(points))
    total = np.zeros(len(points))
    every = np.arange(len(points))
    for nodes in forest:
        at = np.zeros(len(points), dtype=np.int64)
        feature = nodes[:, 0].astype(np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = points[every, np.maximum(f, 0)] <= nodes[at, 1]
            at = np.where(inner, np.where(go_left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
        total += nodes[at, 4]
    return np.power(2.0, -total / len(forest) / _average_path(tree_rows))


def calibrated_cuts(marked: DataFrame, names: list[str]) -> dict[str, float]:
    """The score from which each forest rejects, on all rows of ``marked``
    (scores and ``bad``). Without labels of both classes nothing is
    rejected. Only score histograms come to the driver."""
    cuts = dict.fromkeys(names, math.inf)
    left = marked
    for name in names:
        bins = (left.groupBy(F.floor(F.col(name) * SCORE_STEPS).alias("bin"))
                .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect())
        good = sum(r.n - r.bad for r in bins)
        best, gain = MIN_GAIN - 1, 0
        for r in bins:  # at most SCORE_STEPS + 1 bins, highest scores first
            gain += 2 * r.bad - r.n
            if gain > best and good:
                best, cuts[name] = gain, r.bin / SCORE_STEPS
        left = left.filter(F.col(name) < F.lit(cuts[name]))
    return cuts


def apply_rules(docs: DataFrame, labels: DataFrame, trees: int = 64, tree_rows: int = 256) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score_<forest>..., n_lines, n_upper, n_neighbours)``,
    one row per row of ``docs``.

    ``kept`` is false for rows that fail the base rules or that a forest
    rejects. Null texts count as empty (and fail the base rules); null and
    repeated ids keep their rows; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    stats = common.stage(with_features(rule_statistics(docs)), "rule-statistics")
    fitted = stats.filter(~F.col("base_failed"))
    forests = {f: fit_forest(fitted, features, trees, tree_rows) for f, features in FORESTS.items()}
    names = [f.name for f in stats.schema.fields]
    scores = [f"score_{f}" for f in FORESTS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {f: batch.column(names.index(f)).to_numpy(zero_copy_only=False) for f in FEATURES}
        got = [forest_scores(forests[f], np.column_stack([column[x] for x in features]), tree_rows) for f, features in FORESTS.items()]
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, got)], names=[*names, *scores])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    scored = common.map_arrow(stats, run, f"{fields}, " + ", ".join(f"{s} double" for s in scores))
    scored = common.stage(scored, "rule-scores")
    marks = (labels.filter("quality is not null and doc_id is not null")
             .groupBy("doc_id").agg((F.max("quality") == 0).alias("bad")))
    marked = scored.filter(~F.col("base_failed")).join(marks, "doc_id").select("bad", *scores)
    cuts = calibrated_cuts(common.stage(marked, "rule-labels"), scores)
    kept = ~F.col("base_failed")
    for name in scores:
        kept = kept & (F.col(name) < F.lit(cuts[name]))
    return scored.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), *scores, *COUNTS[5:])
