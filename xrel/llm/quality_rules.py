"""Quality rules (operator 7): decision lists learned by sequential covering, all in DataFrame operations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import stored, words

# Fixed values of the base rule: fewer words, or more than this percentage of words in repeated windows, fail.
LEAST_WORDS = 50
MOST_REPEATED = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Every feature is cut into levels by a fixed rule, so the learner sees counts per level and never a row.
# name: (value from the statistics, levels per unit, exponent, largest level)
FEATURES = {
    "words": ("log2(1 + n_words)", 8, 1.0, 255),
    "word_length": ("word_chars / n_words", 8, 1.0, 255),
    "symbols": ("n_symbols / n_words", 64, 0.5, 255),
    "dup_lines": ("n_dup_lines / n_lines", 64, 0.5, 64),
    "repeats": ("n_repeat_words / n_words", 64, 0.5, 64),
    "capitals": ("n_capitals / word_chars", 64, 0.5, 64),
    "marks": ("n_marks / n_words", 64, 0.5, 255),
    "distinct": ("n_distinct_words / n_words", 64, 1.0, 64),
}
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_COVER = 5


def with_statistics(rows: DataFrame) -> DataFrame:
    """Add the statistics of column _text to rows: those of STATISTICS, and n_lines, n_capitals, n_marks, n_distinct_words.

    A run of three words is known by its hash, shortened by as many bits as its place needs; both travel in one
    number, so that sorting numbers brings equal runs together.
    """
    words_ = rows.withColumn("_words", words("_text")).withColumn(
        "_lines", F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = words_.withColumn("n_words", F.size("_words")).withColumn(
        "_step", F.expr("shiftleft(1L, length(bin(n_words)))")
    )
    run = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    place = lambda i: run(i).bitwiseAND(-F.col("_step")).bitwiseOR(i.cast("bigint"))
    runs = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), place))
    placed = counted.withColumn("_runs", F.sort_array(F.coalesce(runs, F.array().cast("array<bigint>"))))
    head = lambda x: x.bitwiseAND(-F.col("_step"))
    equal = lambda x, i: F.coalesce(head(x) == head(F.get("_runs", i)), F.lit(False))
    twice = F.filter("_runs", lambda x, i: equal(x, i - 1) | equal(x, i + 1))
    at = placed.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("_step") - 1))))
    fresh = F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - x, F.lit(3))))
    count = lambda pattern: F.coalesce(F.regexp_count("_text", F.lit(pattern)), F.lit(0)).cast("bigint")
    return at.select(
        *rows.columns,
        F.col("n_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(fresh, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"[!?|]").alias("n_marks"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct_words"),
        # A filter that also asks for this column is not pushed down, where it would repeat all of the above.
        F.monotonically_increasing_id().alias("_number"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def level(name: str) -> Column:
    """The level of a feature; texts without words are at level 0."""
    value, per_unit, exponent, top = FEATURES[name]
    number = F.expr(value.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
    return F.coalesce(F.least(F.floor(F.pow(number, F.lit(exponent)) * per_unit), F.lit(top)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    level: int

    def column(self) -> Column:
        own = F.col(f"_{self.feature}")
        return own >= self.level if self.at_least else own < self.level

    def __str__(self) -> str:
        value, per_unit, exponent, _ = FEATURES[self.feature]
        return f"{value} {'>=' if self.at_least else '<'} {(self.level / per_unit) ** (1 / exponent):.4g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects. What no rule covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejected(self) -> Column:
        """An ordered conditional expression over the level columns."""
        chain = F
        for rule in self.rules:
            chain = chain.when(_all(rule), F.lit(True))
        return chain.otherwise(F.lit(False)) if self.rules else F.lit(False)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _all(rule: tuple[Condition, ...] | list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _best(rows: DataFrame, rule: list[Condition]) -> Condition | None:
    """The condition with the largest gain of information on the rows that the rule covers so far."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{n}").alias("level")) for n in FEATURES]))
    # At most as many rows as features have levels.
    counts = (
        rows.where(_all(rule)).select(cells.alias("c"), "_bad").groupBy("c.feature", "c.level")
        .agg(F.sum("_bad").alias("bad"), F.count("*").alias("n")).orderBy("feature", "level").collect()
    )
    if not counts:
        return None
    of = {n: [r for r in counts if r.feature == n] for n in FEATURES}
    one = next(iter(of.values()))
    bad, n = sum(r.bad for r in one), sum(r.n for r in one)
    if bad in (0, n):
        return None
    best, most = None, 1e-9
    for name, levels in of.items():
        below_bad = below = 0
        for r in levels:
            for at_least, p, k in ((True, bad - below_bad, n - below), (False, below_bad, below)):
                if p and k < n:
                    gain = p * (math.log2(p / k) - math.log2(bad / n))
                    if gain > most + 1e-9:
                        best, most = Condition(name, at_least, r.level), gain
            below_bad, below = below_bad + r.bad, below + r.n
    return best


def _pruned(rows: DataFrame, rule: list[Condition]) -> tuple[tuple[Condition, ...], int, int]:
    """The beginning of the rule that does best on rows kept aside, with the bad and all rows it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        held = _all(rule[:k]).cast("bigint")
        sums += [F.coalesce(F.sum(held * F.col("_bad")), F.lit(0)), F.coalesce(F.sum(held), F.lit(0))]
    got = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    scores = [(got[2 * k], got[2 * k + 1]) for k in range(len(rule))]
    worth = [(2 * p - n) / n if n else -1.0 for p, n in scores]
    k = max(range(len(rule)), key=lambda i: (worth[i], scores[i][0], -i))
    return tuple(rule[: k + 1]), *scores[k]


def learn_rules(statistics: DataFrame, labels: DataFrame) -> DecisionList:
    """Learn what rejects rows of quality 0, from statistics (with doc_id) and labels (doc_id, quality).

    Rules grow on two thirds of the labelled rows and are pruned on the rest, split by a hash of the id. A rule must
    cover at least LEAST_COVER rows kept aside with a precision of LEAST_PRECISION; the rows it covers then go, and
    the next is learned from the others. Rows that fail the base rule anyway are left out. Null labels are ignored,
    repeated ones count as often as they appear. Every step is one small sum over all labelled rows.
    """
    known = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("_id"), (F.col("quality") == 0).cast("int").alias("_bad")
    )
    levels = [level(n).alias(f"_{n}") for n in FEATURES]
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    joined = statistics.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    rows = stored(joined.select(aside.alias("_aside"), "_bad", *levels), "labelled")
    learned = DecisionList()
    while len(learned.rules) < MAX_RULES:
        open_ = rows.where(~learned.rejected())
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS and (step := _best(open_.where(~F.col("_aside")), rule)):
            rule.append(step)
        if not rule:
            break
        short, bad, n = _pruned(open_.where("_aside"), rule)
        if n < LEAST_COVER or bad < LEAST_PRECISION * n:
            break
        learned.rules.append(short)
    return learned


def judged(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """statistics with base_failed and kept."""
    with_levels = statistics.withColumns({f"_{n}": level(n) for n in FEATURES})
    failed = base_failed()
    return with_levels.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rules.rejected()).drop(
        *[f"_{n}" for n in FEATURES]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; null and empty texts have no words. Other columns are ignored."""
    return with_statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))).drop("_text", "_number")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Per row of docs: doc_id, statistics, base_failed, kept; and the rules. Repeated rows are judged one by one."""
    statistics = stored(document_statistics(docs), "statistics")
    rules = learn_rules(statistics, labels)
    return judged(statistics, rules), rules


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, that the base rule and the learned rules keep.

    Rules are learned from the statistics of labelled rows alone; all rows are then judged in one pass.
    """
    known = labels.where("quality is not null").select(F.col("doc_id").cast("bigint").alias("_id"))
    labelled = docs.join(known, F.col("doc_id").cast("bigint") == F.col("_id"), "left_semi")
    rules = learn_rules(stored(document_statistics(labelled), "statistics"), labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = judged(with_statistics(docs.select(whole, F.col("text").alias("_text"))), rules).where("kept and _number >= 0")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
