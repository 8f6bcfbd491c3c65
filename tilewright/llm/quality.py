r"""Quality rules: text statistics, fixed base rules and a learned decision list, with DataFrame functions only.

The list is fitted by sequential covering: a rule is a conjunction of thresholds on statistics, grown literal by literal
for the largest information gain on one part of the labelled rows, pruned on the other, kept while it is precise there,
after which the rows it covers are set aside. What comes out is an ordered conditional expression, so a corpus of any
size is judged in one pass without a join or a shuffle.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of their id; statistics and verdicts cover every row.

Defined cases: null text has no words, so the base rules reject it; rows without a label take no part in the fit; without
labels of both kinds the list is empty and the base rules alone decide; repeated rows get equal verdicts; a statistic of a
text without words divides by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.rows import whole_row
from tilewright.functions.text import SPACE_RUN, WORD, filled

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8  # a power of two: window hashes come from doubling
SYMBOLS = r"[#*$%&|<>]"
SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio")


def _count(text: Column, pattern: str) -> Column:
    """Characters that the class ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics (long) and the ratios the list may test (double).

    A window of eight words stands as the 64-bit hash of its words' hashes. Only a text whose window hashes are not all
    different sorts them, to find which positions repeat, and merges those positions into covered words.
    """
    text = filled(F.col(text_col))
    rows = docs.select(whole_row(docs).alias("row"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACE_RUN, -1), ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.greatest(F.size("w"), F.lit(0)))
    pair = lambda name, apart: F.zip_with(
        F.col(name), F.slice(name, apart + 1, F.col("n")), lambda a, b: F.xxhash64(a, b)
    )
    for name, of, apart in (("two", "wh", 1), ("four", "two", 2), ("eight", "four", 4)):
        rows = rows.withColumn(name, pair(of, apart))  # hashes of 2, 4 and 8 words from those of half as many
    rows = rows.withColumn("win", F.when(F.col("n") >= WINDOW, F.slice("eight", 1, F.col("n") - (WINDOW - 1))))
    rows = rows.drop("two", "four", "eight")
    placed = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("win")) < F.size("win"), placed))

    def twice(one: Column, i: Column) -> Column:
        before, after = F.get("placed", i - 1)["h"], F.get("placed", i + 1)["h"]
        return F.coalesce(before == one["h"], F.lit(False)) | F.coalesce(after == one["h"], F.lit(False))

    positions = F.sort_array(F.transform(F.filter("placed", twice), lambda one: one["i"]))
    rows = rows.withColumn("positions", positions)

    def cover(state: Column, at: Column) -> Column:
        end = at + WINDOW
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(at, state["end"])).alias("n"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    repeated = F.coalesce(F.aggregate("positions", start, cover, lambda s: s["n"]), F.lit(0))
    rows = rows.select(
        "row",
        "t",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        _count(F.col("t"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("t"), r"[^\p{L}\p{M}\x20\x09-\x0D]").alias("n_marks"),
    )
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return rows.select(
        "row",
        *BASE,
        per("word_chars", "n_words").alias("mean_word"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_upper", "word_chars").alias("upper_ratio"),
        per("n_marks", "word_chars").alias("mark_ratio"),
    )


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    """``feature >= threshold`` or, where not ``above``, ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        value = data[self.feature]
        return value >= self.threshold if self.above else value < self.threshold


@dataclass
class DecisionList:
    """Rules in order; a row is rejected by the first that holds and kept if none does."""

    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        """The list as one conditional expression over the statistics."""
        verdict = None
        for rule in self.rules:
            holds = rule[0].column()
            for literal in rule[1:]:
                holds = holds & literal.column()
            verdict = F.when(holds, F.lit(False)) if verdict is None else verdict.when(holds, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def said(self) -> str:
        """The list in words."""
        sign = lambda x: f"{x.feature} {'>=' if x.above else '<'} {x.threshold:.6g}"
        return "\n".join("reject if " + " and ".join(map(sign, rule)) for rule in self.rules) + "\nelse keep"


def _covered(rule: tuple[Literal, ...], data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for literal in rule:
        out &= literal.holds(data)
    return out


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray, most: int, cuts: int) -> tuple[Literal, ...]:
    rule: tuple[Literal, ...] = ()
    inside = left.copy()
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        now = math.log2(p / (p + n))
        best: tuple[float, Literal | None] = (0.0, None)
        for name, values in data.items():
            edges = np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, cuts)))
            for edge in edges.tolist():
                for above in (True, False):
                    literal = Literal(name, above, edge)
                    hit = inside & literal.holds(data)
                    p2, n2 = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p2:
                        gain = p2 * (math.log2(p2 / (p2 + n2)) - now)
                        if gain > best[0] + 1e-9:
                            best = (gain, literal)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(data)
    return rule


def fit_list(
    data: dict[str, np.ndarray],
    bad: np.ndarray,
    fold: np.ndarray,
    precision: float = 0.97,
    most_rules: int = 12,
    most_literals: int = 4,
    cuts: int = 33,
) -> DecisionList:
    """Sequential covering on rows in memory; ``fold`` is True for rows that prune rather than grow.

    A pruned rule stays if at least ``precision`` of what it covers is bad, on either part and on both together.
    """
    out = DecisionList()
    left = np.ones(len(bad), bool)
    while len(out.rules) < most_rules and (left & bad & ~fold).sum() >= 5:
        rule = _grow(data, bad, left & ~fold, most_literals, cuts)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covered(rule[:k], data, len(bad)) & left & fold
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        hit = _covered(rule, data, len(bad)) & left
        parts = [hit & fold, hit & ~fold, hit]
        if any(not part.any() or bad[part].mean() < precision for part in parts):
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def learn_list(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Fit on at most ``sample`` labelled rows; the ids of that bounded choice alone meet the texts."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(order, "doc_id")
        .limit(sample)
        .select(F.col("doc_id").alias("label_id"), "quality")
    )
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")
    rows = (
        with_statistics(met)
        .select(*BASE, *RATIOS, F.col("row.quality").alias("quality"), F.md5(F.col("row.doc_id").cast("string")).alias("key"))
        .collect()
    )
    # Filtered here: Spark would push a filter below the statistics and spell each of them out in it again.
    rows = [r for r in rows if r.n_words >= LEAST_WORDS and 100 * r.n_repeat_words <= MOST_REPEATED * r.n_words]
    rows.sort(key=lambda r: (r.key, *[r[c] for c in BASE]))
    if not rows:
        return DecisionList()
    # Ratios that do not move with a text's length, so that long clean documents are judged like short ones.
    data = {name: np.array([row[name] for row in rows], float) for name in RATIOS}
    bad = np.array([row["quality"] == 0 for row in rows])
    fold = np.array([int(row["key"][-4:], 16) % 3 == 0 for row in rows])
    return fit_list(data, bad, fold)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row`` (the document), the base statistics, ``base_failed`` and ``kept``."""
    rules = learn_list(docs, labels, sample)
    failed = base_failed()
    return with_statistics(docs).select(
        "row", *BASE, failed.alias("base_failed"), (~failed & rules.kept()).alias("kept")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns.

    The row number in the condition keeps the filter above the statistics: pushed below, it would compute them anew.
    """
    verdicts = judged(docs, labels, sample).withColumn("nth", F.monotonically_increasing_id())
    return verdicts.where(F.col("kept") & (F.col("nth") >= 0)).select("row.*")
