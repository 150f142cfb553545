"""Quality rules combined by weak supervision, in built-in expressions only.

Each rule looks at a document's surface statistics and votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the
vote patterns of the whole corpus estimates each rule's accuracy on good and on bad documents and the share of good ones,
with no labels; a document's verdict is its posterior probability of being good.  So a bad vote of an inaccurate rule is outvoted by good ones,
where a filter that every rule must pass would reject the document.  The patterns
are counted by one aggregation and at most ``3 ** len(RULES)`` counts reach the driver, however large the corpus.

Defined results: null and empty texts have no words, all statistics are zero and ``base_failed`` holds; a word is a run of
characters other than space and the control characters 9 to 13; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WORD_SEPARATORS, count_of, let, text_or_empty

#: Symbols that count as markup debris (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is kept at this posterior probability of being good.
THRESHOLD = 0.5
ROUNDS = 100


def words_of(text: Column) -> Column:
    """The words of a text, unchanged."""
    return F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, the first occurrence included.

    Windows are compared by hash; only texts that hold a repeated window at all go on to mark positions.
    """

    def hashes(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(own) - WINDOW), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        """Sort windows by hash; those equal to a neighbour repeat.  Then walk their places in order."""
        tagged = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(tagged, lambda t: let(places(t), spread))

    def places(t: Column) -> Column:
        last = F.size(t) - 1
        repeats = F.filter(
            F.transform(t, lambda x, k: F.when((x["h"] == F.get(t, k - 1)["h"]) | ((k < last) & (x["h"] == F.get(t, k + 1)["h"])), x["i"])),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(repeats)

    def spread(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    repeated = let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, repeated).otherwise(0).cast("bigint")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of surface statistics per document; ``keep`` names columns to carry along."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), *keep)
    split = own.withColumn("_words", words_of(F.col("_text")))
    return split.select(
        "doc_id",
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", WORD_SEPARATORS, "")).cast("bigint").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        count_of(F.col("_text"), "!").alias("n_shouts"),
        count_of(F.col("_text"), ".,;:?!").alias("n_marks"),
        count_of(F.col("_text"), "\\n").alias("n_breaks"),
        count_of(F.col("_text"), "A-Z").alias("n_capitals"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct"),
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("bigint")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, and abstains otherwise."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


#: SQL over the columns of :func:`statistics`.  Every rule can vote both ways; each kind of junk is seen by two rules or more.
RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars BETWEEN 4 * n_words AND 7 * n_words", "word_chars > 9 * n_words OR word_chars < 3 * n_words"),
    Rule("symbols", "n_symbols = 0 AND n_words >= 20", "10 * n_symbols > n_words"),
    Rule("symbol_share", "100 * n_symbols < word_chars AND n_words >= 20", "25 * n_symbols > word_chars"),
    Rule("lines", "n_dup_lines = 0 AND n_breaks >= 3", "50 * n_dup_lines > n_words"),
    Rule("repetition", "n_repeat_words = 0 AND n_words >= 50", "10 * n_repeat_words > n_words"),
    Rule("variety", "10 * n_distinct >= 6 * n_words AND n_words >= 50", "10 * n_distinct < 4 * n_words AND n_words >= 50"),
    Rule("capitals", "100 * n_capitals <= 4 * word_chars AND n_capitals > 0", "10 * n_capitals > word_chars"),
    Rule("shouts", "n_shouts = 0 AND n_words >= 10", "10 * n_shouts > n_words"),
    Rule("punctuation", "100 * n_marks BETWEEN 8 * n_words AND 25 * n_words", "100 * n_marks < 4 * n_words OR 100 * n_marks > 60 * n_words"),
)
#: Where expectation-maximisation starts: the chance that a rule which votes is right, on good and on bad documents, and the share of good ones.
#: Rules seldom accuse a good document; most see one kind of junk and find the others fine.
START_GOOD, START_BAD = 0.99, 0.2
START_SHARE = 0.85
#: The start stays in the estimates with the weight of so many documents, whatever the size of the corpus.
STRENGTH = 20


@dataclass(frozen=True)
class Model:
    """The share of good documents and, per rule, the chance that its vote is right on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def lent(self) -> list[tuple[float, float]]:
        """Per rule, the log odds of being good that a good vote and a bad vote lend."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(pair[v < 0] for v, pair in zip(votes, self.lent(), strict=True) if v)

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, (good, bad) in zip(votes, self.lent(), strict=True):
            odds = odds + F.when(vote == 1, F.lit(good)).when(vote == -1, F.lit(bad)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over counted vote patterns.

    Given a document's class, the rules that vote are right independently of each other, each with unknown chances on good and on bad documents; an
    abstention is no evidence.  A rule that accuses good documents often loses weight, and others outvote it; one that never does decides
    alone.  The start, better than chance, settles which class is the good one.
    """
    rules = range(len(RULES))
    now = Model(START_SHARE, (START_GOOD,) * len(RULES), (START_BAD,) * len(RULES))

    def right(shares: list[tuple[tuple[int, ...], float]], k: int, vote: int, start: float) -> float:
        voted = sum(w for votes, w in shares if votes[k])
        return (sum(w for votes, w in shares if votes[k] == vote) + STRENGTH * start) / (voted + STRENGTH)

    for _ in range(rounds):
        posterior = [(votes, n, 1 / (1 + math.exp(-max(-50.0, min(50.0, now.odds(votes)))))) for votes, n in patterns]
        good, bad = [(votes, n * p) for votes, n, p in posterior], [(votes, n * (1 - p)) for votes, n, p in posterior]
        share = (sum(w for _, w in good) + STRENGTH * START_SHARE) / (sum(n for _, n in patterns) + STRENGTH)
        now = Model(share, tuple(right(good, k, 1, START_GOOD) for k in rules), tuple(right(bad, k, -1, START_BAD) for k in rules))
    return now


def fitted(stats: DataFrame) -> Model:
    """The model of all rows of ``stats``: their vote patterns are counted, at most ``3 ** len(RULES)`` of them."""
    counted = stats.groupBy(*[r.vote().alias(r.name) for r in RULES]).count().collect()
    return fit(sorted((tuple(row)[:-1], row["count"]) for row in counted))


def judged(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base_failed, quality, kept``."""
    quality = F.when(F.col("n_words") > 0, model.posterior([r.vote() for r in RULES])).otherwise(0.0)
    return stats.select("*", base_failed().alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, the posterior ``quality`` and ``kept`` for every document."""
    stats = written(statistics(docs, id_col, text_col), "statistics")
    return judged(stats, fitted(stats))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.

    Each row is written with its statistics, so there is no join.  The written table also keeps the optimizer from moving the
    filter below the statistics, where it would compute them anew for every rule.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    stats = written(statistics(packed, "_id", "_body", keep=("_row",)), "statistics")
    return judged(stats, fitted(stats)).filter("kept").select("_row.*")
