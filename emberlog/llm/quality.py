"""Quality rules by weak supervision.

Rules over text statistics vote good, bad or abstain. Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules rows) estimates how often each rule votes good on good texts and bad on
bad ones; the posterior probability of being good replaces all-must-pass filtering. All work on documents is
column expressions; the estimate itself sees one row per vote pattern.
"""

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.once import once
from emberlog.llm.frames import SPACE, WORD, let, words_of
from emberlog.session import stage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "letters", "sentences")
STEPS = 20
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_ends"
)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the array, the first included."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = F.filter(
                p,
                lambda x, k: (F.get(p, k - 1)["g"].eqNullSafe(x["g"]) & (k > 0))
                | F.get(p, k + 1)["g"].eqNullSafe(x["g"]),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(d: Column) -> Column:
            return F.aggregate(
                F.transform(d, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(d, k + 1) - x, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return let(pairs, lambda p: let(twice(p), total))

    def grams(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        )

    def count(h: Column) -> Column:
        repeats = let(
            grams(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))
        )
        return F.when(F.size(h) < width, F.lit(0).cast("long")).otherwise(repeats)

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns STATISTICS (null text: empty); columns of these names are replaced."""
    docs = docs.drop(*STATISTICS)
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    )
    by_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct")),
    )
    solid = F.regexp_replace(text, SPACE, "")

    def removed(pattern: str) -> Column:
        return (F.length("_solid") - F.length(F.regexp_replace("_solid", pattern, ""))).cast("long")

    counted = once(docs.withColumns({"_words": by_words, "_lines": by_lines, "_solid": solid}), "_words", "_lines", "_solid")
    return once(
        counted.withColumns(
            {
                "n_words": F.col("_words.n_words"),
                "word_chars": F.length("_solid").cast("long"),
                "n_symbols": removed(SYMBOLS),
                "n_dup_lines": F.col("_lines.n_lines") - F.col("_lines.n_distinct"),
                "n_repeat_words": F.col("_words.n_repeat_words"),
                "n_lines": F.col("_lines.n_lines"),
                "n_letters": F.length(F.regexp_replace("_solid", r"[^\p{L}\p{M}]+", "")).cast("long"),
                "n_ends": removed(r"[.!?…。۔]+"),
            }
        ).drop("_words", "_lines", "_solid"),
        *STATISTICS,
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rule_votes() -> dict[str, Column]:
    """One vote per rule: 1 good, -1 bad, 0 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": _vote(words >= 50, words < MIN_WORDS),
        "word_length": _vote((chars >= 3 * words) & (chars <= 10 * words), (chars * 2 < 5 * words) | (chars > 14 * words)),
        "symbols": _vote(50 * F.col("n_symbols") <= words, 10 * F.col("n_symbols") > words),
        "dup_lines": _vote(10 * F.col("n_dup_lines") <= F.col("n_lines"), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _vote(10 * F.col("n_repeat_words") <= words, 100 * F.col("n_repeat_words") > MAX_REPEAT * words),
        "letters": _vote(10 * F.col("n_letters") >= 9 * chars, 10 * F.col("n_letters") < 7 * chars),
        "sentences": _vote(60 * F.col("n_ends") >= words, (words >= 60) & (200 * F.col("n_ends") < words)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


class Accuracies:
    """Share of good texts, and per rule how often it votes good on good texts and bad on bad ones."""

    def __init__(self, rules=RULES):
        self.prior = 0.8
        self.good = dict.fromkeys(rules, 0.9)
        self.bad = dict.fromkeys(rules, 0.5)

    def weights(self) -> tuple[float, dict[str, dict[int, float]]]:
        """The prior log-odds, and what each vote adds to it."""
        votes = {
            rule: {0: 0.0, 1: log(self.good[rule] / (1 - self.bad[rule])), -1: log((1 - self.good[rule]) / self.bad[rule])}
            for rule in self.good
        }
        return log(self.prior / (1 - self.prior)), votes

    def log_odds(self, votes: Column) -> Column:
        odds, weights = self.weights()
        total = F.lit(odds)
        for rule, of in weights.items():
            total = total + F.when(votes[rule] == 1, of[1]).when(votes[rule] == -1, of[-1]).otherwise(0.0)
        return total


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> Accuracies:
    """Expectation-maximisation over the counts of all vote patterns of the corpus.

    ``patterns`` has one entry per pattern, 3 ** rules at most, whatever the size of the corpus.
    """
    found = Accuracies()
    for _ in range(steps):
        odds, weights = found.weights()
        shares = [
            1 / (1 + exp(-odds - sum(weights[rule][v] for rule, v in zip(RULES, votes, strict=True)))) for votes, _ in patterns
        ]
        good = sum(q * n for q, (_, n) in zip(shares, patterns, strict=True))
        total = sum(n for _, n in patterns)
        found.prior = min(0.98, max(0.02, (good + 1) / (total + 2)))
        for k, rule in enumerate(RULES):
            sums = {1: [9.0, 5.0], -1: [1.0, 5.0]}
            for q, (votes, n) in zip(shares, patterns, strict=True):
                if votes[k]:
                    sums[votes[k]][0] += q * n
                    sums[votes[k]][1] += (1 - q) * n
            found.good[rule] = min(0.999, max(0.5, sums[1][0] / (sums[1][0] + sums[-1][0])))
            found.bad[rule] = min(0.999, max(0.02, sums[-1][1] / (sums[1][1] + sums[-1][1])))
    return found


def judged(docs: DataFrame, text: bool = True) -> DataFrame:
    """``docs`` (without its text if ``text`` is false) with STATISTICS, the votes in ``_votes``, ``base_failed``, ``posterior`` and ``kept``.

    Null text has no words and fails. Equal texts get equal verdicts; repeated rows stay; an empty table
    gives an empty result. Columns of ``docs`` with the names added are replaced. The documents are
    written once with their statistics, because the estimate needs all of them before any verdict.
    """
    docs = docs.drop("base_failed", "posterior", "kept", "_votes")
    votes = F.struct(*[v.cast("tinyint").alias(n) for n, v in rule_votes().items()])
    counted = text_statistics(docs).withColumn("_votes", votes)
    counted = stage(counted if text else counted.drop("text"), "quality")
    patterns = counted.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).orderBy("_votes").collect()
    odds = estimate([(tuple(r._votes), r.n) for r in patterns]).log_odds(F.col("_votes"))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return counted.withColumns({"base_failed": base_failed(), "posterior": posterior}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, posterior and kept of every document."""
    return judged(docs.select("doc_id", "text"), text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns unchanged."""
    rows = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text")
    return judged(rows, text=False).filter("kept").select("_row.*")
