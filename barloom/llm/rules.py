"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule reads statistics of a text and says whether the text fails. A sample gives
each statistic's cost (seconds of a job over it) and each rule's selectivity; the
next rule is the one that rejects most of what the rules before it leave, per
second. A statistic is evaluated only for texts that no earlier rule rejected.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, checkpoint, read

#: White space, symbols, words of a repeat window.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows (in expectation) that costs and selectivities are estimated on.
SAMPLE_ROWS = 500
#: Least seconds that a cost counts as: below it a timing is noise.
LEAST_S = 0.01


def _has_word(line: Column) -> Column:
    return F.translate(line, BLANKS, "") != ""


def _windows(words: Column) -> Column:
    """A hash of each window's words; no window in fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    each = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def _sorted(windows: Column) -> Column:
    """(hash, position) in order, where some hash comes twice."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def _repeated(pairs: Column) -> Column:
    """Positions of windows that share their hash with a neighbour in order."""

    def twice(x: Column, i: Column) -> Column:
        return F.when((x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]), x["at"])

    return F.sort_array(F.array_compact(F.transform(pairs, twice)))


def _covered(at: Column) -> Column:
    """Words under the windows at these ascending positions."""
    lengths = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.get(at, i + 1) - p))
    return F.coalesce(F.aggregate(lengths, F.lit(0), lambda a, b: a + b), F.lit(0))


#: The steps of each statistic: (column, expression from what is there); `text` is there.
Step = tuple[str, Callable[[dict[str, Column]], Column]]
STATS: dict[str, tuple[Step, ...]] = {
    "n_words": (("n_words", lambda c: F.regexp_count(c["text"], F.lit(WORD))),),
    "word_chars": (("word_chars", lambda c: F.length(F.translate(c["text"], BLANKS, ""))),),
    "n_symbols": (("n_symbols", lambda c: F.length(c["text"]) - F.length(F.translate(c["text"], SYMBOLS, ""))),),
    "n_lines": (
        ("lines", lambda c: F.filter(F.split(c["text"], "\n", -1), _has_word)),
        ("n_lines", lambda c: F.size(c["lines"])),
    ),
    "n_dup_lines": (
        ("lines", lambda c: F.filter(F.split(c["text"], "\n", -1), _has_word)),
        ("n_dup_lines", lambda c: F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))),
    ),
    "n_repeat_words": (
        ("hashes", lambda c: F.transform(F.array_remove(F.split(c["text"], BLANK_RUN, -1), ""), lambda w: F.xxhash64(w))),
        ("windows", lambda c: _windows(c["hashes"])),
        ("pairs", lambda c: _sorted(c["windows"])),
        ("repeated", lambda c: _repeated(c["pairs"])),
        ("n_repeat_words", lambda c: _covered(c["repeated"])),
    ),
}
COUNTS = tuple(STATS)


@dataclass(frozen=True)
class Rule:
    """A text fails if `fails` holds for its statistics, those in `needs`."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


#: Whole-number comparisons, so that every engine decides alike.
RULES = (
    Rule("few_words", ("n_words",), lambda s: s["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda s: 100 * s["n_repeat_words"] > 30 * s["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 12 * s["n_words"])),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda s: 100 * s["n_dup_lines"] > 35 * s["n_lines"]),
)
BASE = ("few_words", "repeats")


def _evaluate(frame: DataFrame, stat: str, wanted: Column) -> DataFrame:
    """frame with the columns of a statistic where they are wanted and missing."""
    for name, step in STATS[stat]:
        if name not in frame.columns:
            value = step({c: F.col(c) for c in frame.columns})
            frame = frame.withColumn(name, F.when(wanted, value))
    return frame


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))


def costs_and_patterns(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[tuple[frozenset, int]]]:
    """Of a sample: seconds of each statistic, and how many texts fail which set of
    rules (at most one entry for each set)."""
    there = docs.count()
    if not there:
        return {}, []
    sample = checkpoint(_texts(docs).select("text").sample(min(1.0, rows / there), 7))

    def seconds(frame: DataFrame, column: Column) -> float:
        began = time.perf_counter()
        frame.agg(F.sum(column)).collect()
        return time.perf_counter() - began

    seconds(sample, F.length("text"))
    idle = min(seconds(sample, F.length("text")) for _ in range(2))
    costs, everything = {}, sample
    for stat in dict.fromkeys(n for r in rules for n in r.needs):
        alone = _evaluate(sample, stat, F.lit(True))
        costs[stat] = max(LEAST_S, min(seconds(alone, F.col(stat)) for _ in range(2)) - idle)
        everything = _evaluate(everything, stat, F.lit(True))
    flags = [F.coalesce(r.fails({c: F.col(c) for c in everything.columns}), F.lit(False)).alias(r.name) for r in rules]
    found = everything.select(*flags).groupBy(*[r.name for r in rules]).count().collect()
    return costs, [(frozenset(r.name for r in rules if row[r.name]), row["count"]) for row in found]


def order_rules(costs: dict[str, float], patterns: list[tuple[frozenset, int]], rules=RULES) -> list[Rule]:
    """Rules by rejection per cost: each time the one that rejects most of what is
    left, divided by the cost of its statistics not evaluated yet; ties as given."""
    left, out, known = list(rules), [], set()
    while left:

        def gain(rule: Rule) -> float:
            rejected = sum(n for names, n in patterns if rule.name in names)
            return rejected / max(LEAST_S, sum(costs.get(s, LEAST_S) for s in rule.needs if s not in known))

        best = max(left, key=gain)
        out.append(best)
        left.remove(best)
        known |= set(best.needs)
        patterns = [(names, n) for names, n in patterns if best.name not in names]
    return out


def judge(docs: DataFrame, rules=RULES, order: list[Rule] | None = None) -> DataFrame:
    """(row, text, the statistics, failed): row is the document as a struct; failed
    is the first rule in order that it fails, null if it passes all.

    Statistics that the cascade did not reach are null. The order, and with it which
    rule is named first, depends on timings of the sample; whether failed is null
    does not. Null text counts as empty; an empty table gives no rows; repeated rows
    and null ids are rows of their own. Columns of any name may stand in docs.
    Windows are equal if their 64-bit hashes are, within one text.
    """
    order = order_rules(*costs_and_patterns(docs, rules), rules) if order is None else order
    frame = _texts(docs).withColumn("failed", F.lit(None).cast("string"))
    for rule in order:
        for stat in rule.needs:
            frame = _evaluate(frame, stat, F.col("failed").isNull())
        fails = rule.fails({c: F.col(c) for c in frame.columns})
        frame = frame.withColumn("failed", F.when(F.col("failed").isNull() & fails, F.lit(rule.name)).otherwise(F.col("failed")))
    return frame


def keep_passing(docs: DataFrame, rules=RULES, order: list[Rule] | None = None) -> DataFrame:
    """The documents that fail no rule, with their columns. They are exploded from
    arrays of one or none: a filter would be pushed below the cascade, and each
    statistic's expression written out again and again on the way."""
    passed = F.when(F.col("failed").isNull(), F.array("row"))
    return judge(docs, rules, order).select(F.explode(passed).alias("row")).select("row.*")


def op12(spark, sf_dir: str) -> DataFrame:
    """The cascade's verdicts. The result also asks for every count of every text:
    those that the cascade did not reach are evaluated after it, for the rest only."""
    frame = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    for stat in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        rest = frame.select("row", "text", "failed", *[F.col(c).alias(f"had_{c}") for c in COUNTS if c in frame.columns])
        rest = _evaluate(rest, stat, F.col(f"had_{stat}").isNull())
        rest = rest.withColumn(stat, F.coalesce(f"had_{stat}", stat))
        frame = rest.select("row", "text", "failed", stat, *[F.col(f"had_{c}").alias(c) for c in COUNTS if c in frame.columns and c != stat])
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base = [r.fails({c: F.col(c) for c in COUNTS if c in frame.columns}) for r in RULES if r.name in BASE]
    return frame.select("row.doc_id", *counts, (base[0] | base[1]).alias("base_failed"), F.col("failed").isNull().alias("kept"))


OP12_SQL = rf"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (select r, i, w[i:i + {WINDOW - 1}] as win from docs, unnest(range(1, len(w) - {WINDOW - 2})) as u(i)),
twice as (select r, i from windows qualify count(*) over (partition by r, win) > 1),
covered as (select r, count(distinct p) as n from twice, unnest(range(i, i + {WINDOW})) as u(p) group by r),
counted as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from docs left join covered using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or 100 * n_dup_lines > 35 * n_lines) as kept
from judged"""
