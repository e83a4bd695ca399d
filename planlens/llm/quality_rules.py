"""Quality rules as a learned decision list, in Spark expressions only.

Every text gets statistics in one scan. From labelled documents, sequential
covering learns rules that reject: a rule is a conjunction of thresholds on
statistics, grown condition by condition by the information gained on two
thirds of the labelled rows, then pruned from the end by its worth on the other
third; rows it covers are set aside and the next rule is grown. Each step is
one grouped count in Spark over (statistic, range) pairs, so what reaches the
driver is a table of fixed size. The list becomes an ordered conditional
expression over the statistics of all documents.

Words are runs of characters other than blank and \\t \\n \\v \\f \\r. A null or empty
text has no words and fails the base rules. Rows without a label, with null
labels or null ids aren't learned from; conflicting labels each count.
Repeated rows get a row each, other columns are ignored, an empty table gives
no rows; without labels of both kinds the list is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.columns import named
from planlens.workspace import Scratch

SPACE = r"[\x20\x09-\x0D]"
#: The base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

STATISTICS = ("words", "mean_length", "symbols", "dup_lines", "repeated", "distinct", "bangs", "capitals", "bars", "digits")
RANGES, MOST_RULES, MOST_CONDITIONS = 24, 8, 3
LEAST_COVER, LEAST_PRECISION = 10, 0.8


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class ``text`` has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]++", ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by 64-bit hashes. Sorted with their places, equal ones
    are neighbours; sorted places then tell how many words they cover together.
    """

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def doubled(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        return F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(found: Column) -> Column:
        paired = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(paired, lambda pairs: let(F.sort_array(doubled(pairs)), covered))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(repeated)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= 3, let(hashes, lambda h: let(windows(h), count))).otherwise(F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, and the statistics that rules may use."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    chosen = docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"))
    text = F.col("text")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))

    counted = chosen.select(
        "doc_id",
        let(words_of(text), of_words).alias("w"),
        count_of(text, r"#*$%&|<>").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.struct(count_of(text, "!").alias("bangs"), count_of(text, r"\p{Lu}").alias("capitals"), count_of(text, "|").alias("bars"), count_of(text, "0-9").alias("digits"), count_of(text, r"\n").alias("lines")).alias("c"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    longs = [F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")]
    return counted.select(
        "doc_id", *longs,
        F.col("w.n_words").cast("double").alias("words"),
        rate("w.word_chars", "w.n_words").alias("mean_length"),
        rate("n_symbols", "w.word_chars").alias("symbols"),
        F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("c.lines") + 1.0), F.lit(0.0)).alias("dup_lines"),
        rate("w.n_repeat_words", "w.n_words").alias("repeated"),
        rate("w.n_distinct", "w.n_words").alias("distinct"),
        rate("c.bangs", "w.n_words").alias("bangs"),
        rate("c.capitals", "w.word_chars").alias("capitals"),
        rate("c.bars", "w.n_words").alias("bars"),
        rate("c.digits", "w.word_chars").alias("digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    limit: float

    def holds(self) -> Column:
        return F.col(self.statistic) > self.limit if self.above else F.col(self.statistic) <= self.limit

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds()
    return out


def _information(bad: float, good: float) -> float:
    return -math.log2((bad + 1) / (bad + good + 2))


def _best_condition(counts: list, limits: dict[str, list[float]], bad: float, good: float) -> tuple[float, Condition | None]:
    """The condition with the greatest gain (FOIL) from counts of each statistic's ranges."""
    best, chosen = 0.0, None
    for name in sorted(limits):
        per = {r["range"]: (r["bad"], r["good"]) for r in counts if r["name"] == name}
        low_bad = low_good = 0
        for k, limit in enumerate(limits[name]):
            low_bad, low_good = low_bad + per.get(k, (0, 0))[0], low_good + per.get(k, (0, 0))[1]
            for above, (b, g) in ((False, (low_bad, low_good)), (True, (bad - low_bad, good - low_good))):
                gain = b * (_information(bad, good) - _information(b, g))
                if b >= LEAST_COVER and gain > best + 1e-9:
                    best, chosen = gain, Condition(name, above, limit)
    return best, chosen


def _ranges(limits: dict[str, list[float]]) -> Column:
    """(name, range) of each statistic: the number of limits below its value."""
    of = lambda name, at: F.size(F.filter(F.lit(at), lambda t: F.col(name) > t))
    return F.array(*(F.struct(F.lit(name).alias("name"), of(name, at).alias("range")) for name, at in sorted(limits.items())))


def _tally() -> tuple[Column, Column]:
    return F.coalesce(F.sum((F.col("quality") == 0).cast("long")), F.lit(0)).alias("bad"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good")


def learn(labelled: DataFrame, scratch: Scratch) -> list[Rule]:
    """Rules that reject, from rows of statistics with ``quality`` (0 or 1)."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    found = labelled.agg(*(F.percentile_approx(c, cuts, 5_000).alias(c) for c in STATISTICS)).first()
    limits = {c: sorted({float(v) for v in found[c]}) for c in STATISTICS if found[c]}
    if not limits:
        return []
    rows = labelled.select("quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grows"), *STATISTICS, F.explode(_ranges(limits)).alias("r"))
    rows = scratch.save(rows.select("quality", "grows", *STATISTICS, "r.name", "r.range"), "ranges")
    single = rows.filter(F.col("name") == min(limits))
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = ~fires(rules[-1]) if rules else F.lit(True)
        for earlier in rules[:-1]:
            left = left & ~fires(earlier)
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            counts = rows.filter(left & F.col("grows") & fires(rule)).groupBy("name", "range").agg(*_tally()).collect()  # statistics times ranges
            bad, good = (sum(r[c] for r in counts if r["name"] == min(limits)) for c in ("bad", "good"))
            if bad < LEAST_COVER or rule and good == 0:
                break
            _, condition = _best_condition(counts, limits, bad, good)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        rule = prune(single.filter(left & ~F.col("grows")), rule)
        if not rule:
            break
        rules.append(rule)
    return rules


def prune(held: DataFrame, rule: Rule) -> Rule:
    """The beginning of ``rule`` that is worth most on rows it wasn't grown on; none if it isn't precise there."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = fires(rule[:k])
        sums += [F.sum((hit & (F.col("quality") == q)).cast("long")).alias(f"{name}{k}") for q, name in ((0, "bad"), (1, "good"))]
    r = held.agg(*sums).first()
    best, kept = 0.0, ()
    for k in range(1, len(rule) + 1):
        bad, good = r[f"bad{k}"] or 0, r[f"good{k}"] or 0
        worth = (bad - good) / (bad + good) if bad + good else -1.0
        if worth > best and bad / (bad + good) >= LEAST_PRECISION:
            best, kept = worth, rule[:k]
    return kept


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects, as an ordered conditional expression."""
    if not rules:
        return F.lit(True)
    out = F.when(fires(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(fires(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, base counts, base_failed, kept of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.save(statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    labelled = scratch.save(stats.join(known, "doc_id"), "labelled")
    rules = learn(labelled, scratch)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
