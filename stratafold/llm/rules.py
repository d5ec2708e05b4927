"""Learned decision lists of quality rules, native to Spark.

Statistics of each whole text are built-in column expressions.  A bounded sample
of labelled documents is measured with the same expressions; sequential covering
grows threshold conjunctions by information gain, prunes them on held-back rows
and emits the accepted ones, in order, as one conditional expression.

Rules are learned from labelled documents that the base rules keep.

Defined results: a null text has no words; documents under ``min_words`` words or
with over half their words in repeated three-word windows fail the base rules; with
no labelled rows of both kinds there are no learned rules and the base decides
alone; a labelled id with several rows is learned from its least text; repeated rows
are judged alike; a very long text is measured whole, in arrays of its words;
documents are carried in one struct, so extra columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: At most so many labelled documents are collected to learn from.
MAX_LABELLED = 6000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["symbol_share", "upper_share", "bang_share", "pipe_share", "digit_share", "repeat_share", "distinct_share", "dup_line_share", "mean_word", "top_gap"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: str, characters: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def positions(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (x["h"] == F.get(ordered, j - 1)["h"]) | (x["h"] == F.get(ordered, j + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(ordered, positions), covered))

    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(grams, windows)).cast("long")


def row_of(docs: DataFrame) -> Column:
    """All columns of a document as one struct, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def measure(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) as row, the base statistics, long, and the learned rules'
    measures, double."""
    cut = rows.select("row", F.coalesce(F.col("text"), F.lit("")).alias("_text")).select(
        "row",
        F.array_remove(F.split("_text", "[ \t\n\x0b\x0c\r]+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_lines"),
        # All characters that are counted below; the rest of the text is read once.
        F.regexp_replace("_text", "[^A-Z0-9!#*$%&|<>]+", "").alias("_marks"),
    )
    base = cut.select(
        "row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count("_marks", SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_lines"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        _count("_marks", "A-Z").alias("_upper"),
        _count("_marks", "!").alias("_bang"),
        _count("_marks", "|").alias("_pipe"),
        _count("_marks", "0-9").alias("_digit"),
    )

    def share(part: str | Column, whole: str) -> Column:
        part = F.col(part) if isinstance(part, str) else part
        return F.when(F.col(whole) > 0, part * 100.0 / F.col(whole)).otherwise(0.0)

    return base.select(
        "row",
        *BASE,
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_bang", "n_words").alias("bang_share"),
        share("_pipe", "n_words").alias("pipe_share"),
        share("_digit", "word_chars").alias("digit_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_distinct", "n_words").alias("distinct_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"),
        (share("word_chars", "n_words") / 100.0).alias("mean_word"),
        (share(F.col("n_words") - F.col("_distinct"), "n_words") - share("n_repeat_words", "n_words")).alias("top_gap"),
    )


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.measure] > self.threshold if self.above else row[self.measure] <= self.threshold

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list) -> list:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _best_condition(rows: list, measures: list[str], barred: set[tuple[str, bool]] = frozenset()) -> tuple[float, Condition | None]:
    """The threshold with the most information gain for the rejected class."""
    p0 = sum(bad for _, bad in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return 0.0, None
    before, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for name in measures:
        ordered = sorted((r[name], bad) for r, bad in rows)
        p = n = 0
        for (a, bad), (b, _) in zip(ordered, ordered[1:]):
            p, n = p + bad, n + (not bad)
            if a == b:
                continue
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp and (name, above) not in barred and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best:
                    best, found = gain, Condition(name, above, (a + b) / 2)
    return best, found


def learn(rows: list[tuple[int, dict[str, float], int]], measures: list[str] = MEASURES, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.9, min_support: int = 3) -> list[Rule]:
    """Ordered rejection rules from rows (key, measures, quality).

    Two thirds of the rows, by key, grow a rule; the others prune it.  A rule stays if
    it is precise where it grew and, with one more good row assumed, over both parts;
    then all it covers is set aside and the next rule is grown from the rest.  After
    a rule that does not stay, the next one may not begin with the same measure and side.
    """
    grow = [(m, int(not quality)) for key, m, quality in rows if zlib.crc32(str(key).encode()) % 3]
    prune = [(m, int(not quality)) for key, m, quality in rows if not zlib.crc32(str(key).encode()) % 3]
    rules: list[Rule] = []
    barred: set[tuple[str, bool]] = set()
    while len(rules) < max_rules:
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions:
            _, condition = _best_condition(inside, measures, barred if not rule else frozenset())
            if condition is None:
                break
            rule += (condition,)
            inside = _covered((condition,), inside)
        if not rule:
            break

        def worth(candidate: Rule) -> float:
            """Smoothed share of bad rows among those of the prune set that it covers."""
            hit = _covered(candidate, prune)
            return (sum(bad for _, bad in hit) + 1) / (len(hit) + 2)

        def stays(candidate: Rule) -> bool:
            caught = _covered(candidate, grow)
            bad, both = sum(b for _, b in caught), caught + _covered(candidate, prune)
            return bad >= min_support and bad >= min_precision * len(caught) and sum(b for _, b in both) >= min_precision * (len(both) + 1) - 1

        found = [r for r in (rule[:k] for k in range(len(rule), 0, -1)) if stays(r)]
        if not found:
            barred.add((rule[0].measure, rule[0].above))
            continue
        rule = max(found, key=lambda r: (worth(r), -len(r)))
        rules.append(_tightest(rule))
        grow = [r for r in grow if not all(c.holds(r[0]) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r[0]) for c in rule)]
    return rules


def _tightest(rule: Rule) -> Rule:
    """The rule without conditions that another one on the same measure implies."""
    best: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        held = best.get((c.measure, c.above))
        if held is None or (c.threshold > held.threshold) == c.above:
            best[c.measure, c.above] = c
    return tuple(best.values())


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps the document."""
    if not rules:
        return F.lit(True)
    chain = F
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True))


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled documents, the first by hashed id."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = joined.groupBy("_id").agg(F.min("_quality").alias("_quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = measure(one.select(F.struct("_id", "_quality").alias("row"), "text")).select("row.*", *MEASURES, base_failed().alias("_failed")).collect()
    return learn(sorted(((r["_id"], {m: r[m] for m in MEASURES}, r["_quality"]) for r in rows if not r["_failed"]), key=lambda r: r[0]))


def judge(docs: DataFrame, rules: list[Rule], min_words: int = MIN_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Rows (row, statistics, measures, base_failed, kept): ``row`` is the document, or
    only the columns to carry."""
    measured = measure(docs.select((F.struct(*carry) if carry else row_of(docs)).alias("row"), "text"))
    return measured.withColumn("base_failed", base_failed(min_words)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules, carry=["doc_id"]).select("row.doc_id", *BASE, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    judged = judge(docs, fit(docs, labels))
    # A column that is not deterministic keeps the filter above the projection; pushed
    # below it, the statistics would be computed once for every condition.
    return judged.select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_stays")).where("_stays").select("row.*")
