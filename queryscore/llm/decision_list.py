"""Quality rules: text statistics and a decision list learned from labels by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore.llm.native import GAP_CHARS, let, one_label, removed, total, words
from queryscore.llm.scratch import kept

MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3

MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.95
MIN_COVERED = 4
CUTS = 32
NEAR = 0.95

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "marks_per_word",
)


def _repeated(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in ``w``.

    Sorting (window, position) brings equal windows together in n log n; their positions, sorted
    again, each cover the words up to the next one.
    """
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda q, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), q - F.get(at, k - 1)))))

    def positions(p: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))
        twice = F.filter(p, lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, positions), covered))

    return F.when(F.size(w) < WINDOW, 0).otherwise(let(windows, count)).cast("bigint")


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` plus the statistics of every whole text; a null text has zeros.

    A column of ``carry`` with the name of a statistic gives way.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    left = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("bigint")
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(docs["text"]), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), _repeated(w).alias("n_repeat_words"),
    ))
    of_lines = let(with_word, lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ))
    rows = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("_doc"), of_words.alias("_w"), of_lines.alias("_l"),
        F.length(removed(text, GAP_CHARS)).cast("bigint").alias("word_chars"),
        left(r"#*$%&|<>").alias("n_symbols"), left(r"\p{Lu}").alias("n_upper"),
        (F.length(text) - F.length(removed(text, "!?"))).cast("bigint").alias("n_marks"),
    )
    return rows.select(
        *[F.col("_doc")[c].alias(c) for c in carry if c not in STATISTICS],
        *[F.col(x)[s].alias(s) for x, s in (
            ("_w", "n_words"), ("_l", "n_dup_lines"), ("_w", "n_repeat_words"), ("_l", "n_lines"),
        )], "word_chars", "n_symbols", "n_upper", "n_marks",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "log_words": F.log2(F.col("n_words") + 1.0),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
    }[name]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    cut: int

    def on_values(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def on_bins(self) -> Column:
        bin_ = F.get("bins", F.lit(FEATURES.index(self.feature)))
        return bin_ > self.cut if self.above else bin_ <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions, of) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & of(c)
    return out


def _below(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < value))


def _counts(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(feature, bin) → (bad, good) rows: a table of fixed size, whatever the number of rows."""
    each = rows.select("bad", F.posexplode("bins").alias("f", "b"))
    counted = each.groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    return {(r.f, r.b): (r.bad, r.good) for r in counted.collect()}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained about the bad rows that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition with the highest gain; of thresholds nearly as good on its feature, the middle one."""
    counts = _counts(rows)
    found = []
    for f, name in enumerate(FEATURES):
        bad = [counts.get((f, b), (0, 0))[0] for b in range(len(cuts[name]) + 1)]
        good = [counts.get((f, b), (0, 0))[1] for b in range(len(cuts[name]) + 1)]
        p0, n0 = sum(bad), sum(good)
        if not p0 or not n0:
            return None
        for cut, threshold in enumerate(cuts[name]):
            p, n = sum(bad[: cut + 1]), sum(good[: cut + 1])
            for above, p_, n_ in ((False, p, n), (True, p0 - p, n0 - n)):
                if p_ >= MIN_COVERED and (g := _gain(p_, n_, p0, n0)) > 0:
                    found.append((g, n_, Condition(name, above, threshold, cut)))
    if not found:
        return None
    gain, good, best = max(found, key=lambda x: x[0])
    near = [
        c for g, n, c in found
        if g >= NEAR * gain and n <= good and (c.feature, c.above) == (best.feature, best.above)
    ]
    return near[len(near) // 2]


def _pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The shortest prefix of the rule that is worth most on rows it was not grown on, with its counts."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], Condition.on_bins).cast("int")
        sums += [F.sum(hit * F.col("bad")), F.sum(hit * (1 - F.col("bad")))]
    flat = [x or 0 for x in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    pairs = list(zip(flat[::2], flat[1::2]))
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pairs]
    k = worth.index(max(worth))
    return rule[: k + 1], *pairs[k]


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[Rule]:
    """An ordered list of rules for bad documents (label 0), from all labelled rows.

    A rule grows by the threshold with the highest information gain on two thirds of the rows and
    is cut back on the last third; the rows it covers then leave. Learning ends when a rule is not
    precise on the last third. Each step is one aggregation with a result of fixed size. Without
    labels of both kinds there are no rules.
    """
    rows = stats.where(~base_failed()).join(one_label(labels, label), "doc_id")
    values = F.array(*[feature(f) for f in FEATURES])
    rows = kept(rows.select("doc_id", (1 - F.col("label")).alias("bad"), values.alias("values")), "labelled")
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    value = [F.get("values", F.lit(i)) for i in range(len(FEATURES))]
    quantiles = lambda v, bad: F.percentile_approx(F.when(F.col("bad") == bad, v), at)
    found = rows.agg(*[quantiles(v, bad).alias(f"q{i}_{bad}") for i, v in enumerate(value) for bad in (0, 1)]).first()
    if any(x is None for x in found):
        return []
    cuts = {}
    for i, f in enumerate(FEATURES):
        ends = sorted({*found[f"q{i}_0"], *found[f"q{i}_1"]})
        cuts[f] = sorted({*ends, *[(a + b) / 2 for a, b in zip(ends, ends[1:])]})
    bins = F.array(*[_below(cuts[f], v) for f, v in zip(FEATURES, value)])
    rows = kept(rows.select("bad", bins.alias("bins"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prunes")), "labelled")
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        growing = left.where(~F.col("prunes"))
        while len(rule) < MAX_CONDITIONS:
            condition = _best(growing.where(_all(rule, Condition.on_bins)), cuts)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        rule, bad, good = _pruned(rule, left.where(F.col("prunes")))
        if bad < MIN_COVERED or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left.where(~_all(rule, Condition.on_bins))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a document, null when none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule, Condition.on_values), k).otherwise(out)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, carry: list[str], label: str = "quality") -> DataFrame:
    """``carry``, the statistics, base_failed, rule (the rejecting one) and kept of every document.

    A null text counts as empty and fails the base rule. Rows with equal ids are judged one by one.
    """
    stats = kept(statistics(docs, carry), "statistics")
    rules = learn(stats, labels, label)
    rule = F.when(~base_failed(), verdict(rules))
    return stats.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
