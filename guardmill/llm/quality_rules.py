"""Quality rules as weak supervision: votes, estimated accuracies, posterior probability."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from .columns import BLANKS, document_text, need_columns, word_list

WINDOW = 5
KEEP, REJECT, ABSTAIN = 1, 0, -1
#: Marks that prose does not set twice in a row.
DOUBLED = "!#*$%&"
#: Marks that prose does not hang on the end of a word.
TAILS = "#*$%&"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of `window` words found more than once in the text.

    Windows are hashed to 64 bits where they stand. Texts without a repeat, nearly all, end
    there; otherwise the hashes are sorted with their places, equal neighbours mark places,
    and every marked place covers the words up to the next one, at most a whole window.
    Time n log n, memory proportional to the text.
    """
    def gram(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *[F.get(words, i + j) for j in range(1, window)])

    def marked(sorted_grams: Column) -> Column:
        def place(gram_at: Column, i: Column) -> Column:
            near = (F.get(sorted_grams, i - 1)["h"] == gram_at["h"]) | (
                F.get(sorted_grams, i + 1)["h"] == gram_at["h"])
            return F.when(F.coalesce(near, F.lit(False)), gram_at["i"])
        places = F.transform(sorted_grams, place)
        return F.array_sort(F.filter(places, lambda p: p.isNotNull()))

    def covered(places: Column) -> Column:
        def step(p: Column, i: Column) -> Column:
            return F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(window)),
                           F.lit(window))
        return F.aggregate(F.transform(places, step), F.lit(0).cast("long"),
                           lambda total, x: total + x)

    starts = F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))
    grams = F.transform(starts, gram)

    def with_places(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))

    return _let(grams, lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        _let(with_places(hashes), lambda s: _let(marked(s), covered))))


def _occurrences(text: Column, parts: Sequence[str]) -> Column:
    total = F.lit(0)
    for part in parts:
        left = F.replace(text, F.lit(part), F.lit(""))
        total = total + (F.octet_length(text) - F.octet_length(left)) / len(part)
    return total


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def rule_inputs(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """identity and the counts the rules look at, one row per document, no shuffle."""
    need_columns(docs, identity, text)
    body = document_text(text)
    listed = docs.select(F.col(identity).alias("id"), body.alias("body"),
                         word_list(body).alias("words"))
    lines = F.filter(F.split("body", "\n"),
                     lambda line: F.translate(line, BLANKS, "") != "")
    symbols = F.translate("body", "#*$%&|<>", "")
    n_lines = F.size("lines").cast("long")
    flat = F.concat(F.translate("body", BLANKS[1:], " " * (len(BLANKS) - 1)), F.lit(" "))
    n_doubled = _occurrences(F.col("body"), [mark * 2 for mark in DOUBLED])
    n_tails = _occurrences(flat, [f"{mark} " for mark in TAILS])
    upper = F.length("body") - F.length(
        F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return listed.withColumn("lines", lines).select(
        F.col("id").alias(identity), F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(symbols)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        n_lines.alias("n_lines"), upper.cast("long").alias("n_upper"),
        (F.length("body") - F.length(F.translate("body", "!?", ""))).cast("long")
        .alias("n_marks"),
        n_doubled.cast("long").alias("n_doubled"), n_tails.cast("long").alias("n_tails"),
        _occurrences(F.col("body"), ["|"]).cast("long").alias("n_bars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def default_rules() -> dict[str, Column]:
    """Each rule votes keep or reject, or abstains between its two thresholds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.greatest(F.col("n_lines"), F.lit(1))

    def low_is_good(share: Column, good: float, bad: float) -> Column:
        return (F.when(share >= bad, REJECT).when(share <= good, KEEP)
                .otherwise(ABSTAIN))

    mean = F.col("word_chars") / n
    return {
        "length": F.when(F.col("n_words") < 20, REJECT)
        .when(F.col("n_words") >= 40, KEEP).otherwise(ABSTAIN),
        "word_chars": F.when((mean < 2.5) | (mean > 12), REJECT)
        .when((mean >= 3) & (mean <= 9), KEEP).otherwise(ABSTAIN),
        "symbols": low_is_good(F.col("n_symbols") / n, 0.05, 0.2),
        "dup_lines": low_is_good(F.col("n_dup_lines") / n_lines, 0.1, 0.3),
        "repeats": low_is_good(F.col("n_repeat_words") / n, 0.05, 0.2),
        "shouting": low_is_good(
            F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), 0.1, 0.3),
        "marks": low_is_good(F.col("n_marks") / n, 0.1, 0.3),
        "doubled": low_is_good(F.col("n_doubled") / n, 0.05, 0.2),
        "tails": low_is_good(F.col("n_tails") / n, 0.05, 0.2),
        "bars": low_is_good(F.col("n_bars") / n, 0.05, 0.2),
        "variety": F.when(F.col("n_distinct") / n < 0.15, REJECT)
        .when(F.col("n_distinct") / n > 0.3, KEEP).otherwise(ABSTAIN),
    }


@dataclass(frozen=True)
class LabelModel:
    """Probability of a good document, and of each rule's votes given good or bad."""

    prior: float
    votes: tuple[dict[int, tuple[float, float]], ...]

    def log_odds(self, names: Sequence[str]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, chances in zip(names, self.votes, strict=True):
            weight = F.lit(0.0)
            for vote in (KEEP, REJECT):
                good, bad = chances[vote]
                weight = F.when(F.col(name) == vote, math.log(good / bad)).otherwise(weight)
            total = total + weight
        return total

    def accuracy(self, rule: int) -> float:
        """Chance that the rule is right, where it votes."""
        good, bad = self.votes[rule][KEEP]
        no_good, no_bad = self.votes[rule][REJECT]
        right = self.prior * good + (1 - self.prior) * no_bad
        return right / (right + self.prior * no_good + (1 - self.prior) * bad)


#: Start of the estimation: a good document's chance of a reject vote, and a bad one's.
FALSE_ALARM, HIT = 0.02, 0.25


def start_model(rules: int, prior: float = 0.85) -> LabelModel:
    votes = {KEEP: (1 - FALSE_ALARM, 1 - HIT), REJECT: (FALSE_ALARM, HIT)}
    return LabelModel(prior, tuple(dict(votes) for _ in range(rules)))


def fit_label_model(patterns: Mapping[tuple[int, ...], int], rules: int,
                    rounds: int = 50, smoothing: float = 2.0) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns.

    `patterns` has at most 3^rules entries however many documents there are. At the start
    one rejecting rule does not outweigh the others, two do. An abstention carries no
    weight. The chances are kept within 1:999 and on the side of the vote: a rule may turn
    out useless but not inverted, so the two classes can't change places. Without
    documents the start stays.
    """
    model = start = start_model(rules)
    total = sum(patterns.values())
    if not total:
        return start
    ordered = sorted(patterns.items())
    for _ in range(rounds):
        good_rows = 0.0
        counts = [{v: [smoothing * side for side in start.votes[j][v]]
                   for v in (KEEP, REJECT)} for j in range(rules)]
        for votes, n in ordered:
            odds = math.log(model.prior / (1 - model.prior))
            for chances, vote in zip(model.votes, votes, strict=True):
                if vote != ABSTAIN:
                    odds += math.log(chances[vote][0] / chances[vote][1])
            good = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_rows += n * good
            for count, vote in zip(counts, votes, strict=True):
                if vote != ABSTAIN:
                    count[vote][0] += n * good
                    count[vote][1] += n * (1 - good)
        model = LabelModel(
            min(0.99, max(0.5, good_rows / total)),
            tuple(_chances(count) for count in counts))
    return model


def _chances(count: dict[int, list[float]]) -> dict[int, tuple[float, float]]:
    def share(side: int) -> float:
        kept = count[KEEP][side] / (count[KEEP][side] + count[REJECT][side])
        return min(0.999, max(0.001, kept))

    good = share(0)
    bad = min(share(1), good)
    return {KEEP: (good, bad), REJECT: (1 - good, 1 - bad)}


def judge_documents(docs: DataFrame, identity: str = "doc_id", text: str = "text",
                    threshold: float = 0.5,
                    rules: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per document: counts, base_failed, posterior, kept.

    `base_failed`: fewer than 10 words, or over 20 % of the words in repeated windows. `kept`
    is false then, else whether the posterior probability of a good document reaches
    `threshold`. Null text counts as empty; repeated rows are judged alike; other columns
    are not read; no rows give no rows.

    The texts are read once. Vote patterns are counted in one aggregation with at most
    3^rules groups; expectation-maximisation runs over these counts.
    """
    rules = dict(rules or default_rules())
    names = [f"vote_{name}" for name in rules]
    counted = settled(rule_inputs(docs, identity, text))
    voted = counted.select("*", *[v.alias(n) for v, n in zip(rules.values(), names,
                                                             strict=True)])
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    model = fit_label_model({tuple(r[n] for n in names): r["n"] for r in patterns},
                            len(names))
    posterior = 1 / (1 + F.exp(-model.log_odds(names)))
    failed = (F.col("n_words") < 10) | (
        100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select(
        identity, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), posterior.alias("posterior"),
        (~failed & (posterior >= threshold)).alias("kept"))
