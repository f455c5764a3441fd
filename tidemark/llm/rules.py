"""Quality rules: counts of each text, and decision lists that are learned from labels and run as Spark conditions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batched, hashed_share, table, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Labelled rows that a list is learned from, about.
FIT_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct", "longest_run")
_CONTINUED, _UPPER = bytes(range(0x80, 0xC0)), bytes(range(65, 91))


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8.

    n_upper counts A-Z, n_marks exclamation and question marks, n_distinct different words, and longest_run the longest run
    of one word.
    """
    words = text.split()
    n = len(words)
    continued = len(text) - len(text.translate(None, _CONTINUED))
    spaces = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    repeated = 0
    if n > REPEAT_WINDOW and len(number) < n:
        with np.errstate(over="ignore"):
            mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            window = np.zeros(n - REPEAT_WINDOW + 1, np.uint64)
            for k in range(REPEAT_WINDOW):
                window = window * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : len(window) + k]
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        twice = np.flatnonzero(count[back] > 1)
        edge[twice] += 1
        edge[twice + REPEAT_WINDOW] -= 1
        repeated = int((np.cumsum(edge) > 0).sum())
    change = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if n else np.zeros(1, int)
    return (n, len(text) - continued - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len({*lines}), repeated, len(lines), len(text) - len(text.translate(None, _UPPER)), text.count(b"!") + text.count(b"?"), len(number), int(np.diff(change).max(initial=0)))


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and COUNTS for each row. Null texts count as empty. Nothing is shuffled."""
    docs = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    schema = docs.drop("_text").withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(x.as_py()) for x in batch.column(len(keep))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in counts.T)], names=[*keep, *COUNTS])

    return batched(docs).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions are about: shares of the counts, null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return {
        "symbols": share("n_symbols", "word_chars"), "word_length": share("word_chars", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"), "marks": share("n_marks", "n_words"),
        "distinct": share("n_distinct", "n_words"), "run": share("longest_run", "n_words"), "words": F.col("n_words").cast("double"), "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return F.coalesce(c > self.threshold if self.above else c <= self.threshold, F.lit(False))


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the condition of the highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    here = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[here]).any():
        p, n = bad[here].sum(), here.sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            own = values[here]
            for t in np.unique(np.nanquantile(own, np.linspace(0, 1, cuts), method="lower")) if np.isfinite(own).any() else ():
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    held = here & c.holds(x)
                    if p1 := bad[held].sum():
                        g = p1 * (np.log2(p1 / held.sum()) - np.log2(p / n))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, cuts: int = 48) -> list[Rule]:
    """Rules that reject, in order: each is grown on two thirds of what is left, cut back on the other third, and kept while
    it is right there in ``precision`` of what it covers, and covers at least two bad rows of the third."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most_rules and bad[left].sum() >= 6:
        third = left % 3 == len(rules) % 3
        grow, prune = left[~third], left[third]
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions, cuts)
        xp, bp = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(r: Rule) -> float:
            held = _covers(r, xp, len(bp))
            p, n = bp[held].sum(), (~bp[held]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        held = _covers(rule, xp, len(bp))
        if bp[held].sum() < 2 or bp[held].mean() < precision:
            break
        rules.append(rule)
        left = left[~_covers(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def fit(counts: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from ``rows`` labelled ids or so, taken by a hash of doc_id; without labels of both classes there are no rules.

    Rows that fail the base rules are left out: they are rejected anyway. Of rows of one id and the same counts one counts.
    Only what is taken goes to the driver.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = hashed_share(labels, "doc_id", rows, labels.count())
    x = counts.where(~base_failed()).join(labels, "doc_id").select("doc_id", F.xxhash64("doc_id").alias("h"), "quality", *(c.alias(n) for n, c in features().items()))
    got = x.distinct().toPandas().sort_values(["h", *features()]).reset_index(drop=True)
    bad = got["quality"].to_numpy(int) == 0
    if not bad.any() or bad.all():
        return []
    return learn({n: got[n].to_numpy(float) for n in features()}, bad)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects, else the row is kept."""
    out: Column | None = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, False) if out is None else out.when(held, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learned(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from ``rows`` labelled documents or so; only their texts are counted."""
    some = labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct()
    some = hashed_share(some, "doc_id", rows, some.count())
    return fit(counted(docs.join(F.broadcast(some), "doc_id", "left_semi"), "doc_id"), labels, rows)  # about ``rows`` ids


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for each row of ``docs``. The texts are read once; what follows uses the counts."""
    counts = written(counted(docs, "doc_id"), "counts")
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(fit(counts, labels)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and fail. Texts of any length are counted whole. A null doc_id stays null, and such a row is judged by rules that it
    taught nothing to; repeated rows are judged each, and equal ones alike. Without labels no rule is learned, and what passes
    the base stays. An empty table gives no rows; other columns are ignored, whatever their names."""
    done = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
