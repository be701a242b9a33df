"""Quality classifier (operator 9).

Method: a sparse rule ensemble. Small trees are grown on statistics of labelled texts; each
path from a root becomes a conjunctive rule; logistic regression with a lasso penalty keeps
few of the rules; those are compiled into one Spark column expression that scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.shared import WORD, stored, words_of

#: Labelled rows that training may gather to the driver: those with the least hash of doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, CUTS = 40, 3, 10, 24
PENALTY, STEPS = 0.002, 400

STATISTICS = ("n_words", "word_length", "distinct_share", "upper_share", "digit_share", "symbols_a_word", "marks_a_word", "bars_a_word", "odd_share", "words_a_line", "dup_line_share", "longest_word", "stop_gap")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (double) of each whole text; null and empty texts give zeros."""
    body = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("_w"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("_l"),
        F.char_length(body).alias("chars"),
        *(F.regexp_count(body, F.lit(p)).alias(n) for n, p in (("upper", r"\p{Lu}"), ("letters", r"\p{L}"), ("digits", r"[0-9]"), ("symbols", r"[#*$%&<>@^~]"), ("marks", r"[!?]"), ("bars", r"\|"), ("stops", r"[.,;:]"))),
    )
    n = F.greatest(F.size("_w"), F.lit(1))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    odd = F.col("chars") - F.col("letters") - F.col("digits")
    return cut.select(
        "doc_id",
        F.size("_w").cast("double").alias("n_words"),
        (F.char_length(F.array_join("_w", "")) / n).alias("word_length"),
        (F.size(F.array_distinct("_w")) / n).alias("distinct_share"),
        share("upper", "letters").alias("upper_share"),
        share("digits", "chars").alias("digit_share"),
        (F.col("symbols") / n).alias("symbols_a_word"),
        (F.col("marks") / n).alias("marks_a_word"),
        (F.col("bars") / n).alias("bars_a_word"),
        (odd / F.greatest("chars", F.lit(1))).alias("odd_share"),
        (F.size("_w") / F.greatest(F.size("_l"), F.lit(1))).alias("words_a_line"),
        ((F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1))).alias("dup_line_share"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.char_length(w))), F.lit(0)).cast("double").alias("longest_word"),
        (F.size("_w") / (F.col("stops") + 1)).alias("stop_gap"),
    )


#: A rule: (statistic, greater, cut) terms that must all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """Logistic model over rules: the prior log odds and each rule's weight."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, greater, cut in rule:
                holds = holds & ((F.col(name) > cut) if greater else (F.col(name) <= cut))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` (a column for each statistic) the rule covers."""
    out = np.ones(len(x), bool)
    for name, greater, cut in rule:
        column = x[:, STATISTICS.index(name)]
        out &= (column > cut) if greater else (column <= cut)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Distinct paths of small Gini trees, each on a bootstrap sample and half of the statistics."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for j in range(x.shape[1])]
    found: dict[Rule, None] = {}

    def split(rows: np.ndarray, columns: np.ndarray, path: Rule) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
            return
        best = (0.0, None)
        target, n = y[rows], len(rows)
        whole = target.mean() * (1 - target.mean())
        for j in columns:
            above = x[rows, j][:, None] > cuts[j][None, :]
            n_above = above.sum(axis=0)
            fits = (n_above >= LEAST_LEAF) & (n - n_above >= LEAST_LEAF)
            if not fits.any():
                continue
            ones = (above * target[:, None]).sum(axis=0)
            p = ones / np.maximum(n_above, 1)
            q = (target.sum() - ones) / np.maximum(n - n_above, 1)
            gain = np.where(fits, whole - (n_above * p * (1 - p) + (n - n_above) * q * (1 - q)) / n, 0.0)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), (j, float(cuts[j][k])))
        if best[1] is None:
            return
        j, cut = best[1]
        up = x[rows, j] > cut
        split(rows[up], columns, (*path, (STATISTICS[j], True, cut)))
        split(rows[~up], columns, (*path, (STATISTICS[j], False, cut)))

    for _ in range(TREES):
        rows = random.integers(0, len(x), min(len(x), 4000))
        split(rows, np.sort(random.choice(x.shape[1], -(-x.shape[1] // 2), replace=False)), ())
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps; the intercept is not penalised."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n) if k else 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new_w = v - step * (z.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = c - step * error.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """The rule ensemble of labelled rows; of one class or none, its smoothed share alone."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    kept: dict[bytes, Rule] = {}
    for rule in sorted(grow_rules(x, y), key=lambda r: (len(r), r)):
        cover = holds(rule, x)
        if 0 < cover.sum() < len(x):  # of rules that cover the same rows the simplest stays
            kept.setdefault(np.packbits(cover).tobytes(), rule)
    rules = list(kept.values())
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(x), 0))
    intercept, weights = lasso_logistic(z, y.astype(np.float64))
    return RuleModel(float(intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(statistics: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> RuleModel:
    """Fit to labelled rows that are not held out, at most ``most`` of them by a hash of doc_id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_d")).agg(F.min("quality").alias("_y"))
    present = statistics.select(F.col("doc_id").alias("_at"))
    pool = known.filter(~held_out(F.col("_d"))).join(present, F.col("_d") == F.col("_at"), "left_semi").orderBy(F.xxhash64("_d"), "_d").limit(most)
    rows = statistics.join(pool, F.col("doc_id") == F.col("_d")).select("_d", "_y", *STATISTICS).dropDuplicates(["_d"]).orderBy("_d").collect()  # at most ``most``
    x = np.array([[r[s] for s in STATISTICS] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r._y for r in rows], dtype=np.int64))


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have statistics of zero and are scored like any other. Null doc_ids
    are never held out. Contradicting labels of a document count as 0; labels without a
    document are ignored; without labels every score is 0.5. Repeated rows repeat.
    """
    statistics = stored(text_statistics(docs.select("doc_id", "text")), "text-statistics")
    model = train(statistics, labels, most)
    scored = statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
