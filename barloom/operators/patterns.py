"""Candle patterns as rule tables, and combinations of patterns as data.

A rule is an expression over the bar (o, h, l, c) and the three rows before it
(o1..o3 and so on), or over earlier rules; a missing value makes it false. The
lags share one window, so all rules of a library cost one pass over the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .windows import by_code, full, padded

# The definitions of the patterns.
SHARED = {
    "gap_up": "o > c1 * 1.002",
    "gap_down": "o < c1 * 0.998",
    "top": "h > h1 and h > h2",
    "bottom": "l < l1 and l < l2",
    "bull_engulf": "c > o and c1 < o1 and c >= o1 and o <= c1",
    "bear_engulf": "c < o and c1 > o1 and c <= o1 and o >= c1",
    "piercing": "c1 < o1 and o < c1 and c > (o1 + c1) / 2 and c < o1",
    "downpour": "c1 > o1 and o > c1 and c < o1",
    "dark_cloud": "c1 > o1 and o > c1 and c < (o1 + c1) / 2 and c > o1",
    "morning_star": "c2 < o2 and l1 < least(c2, o2) and h1 < greatest(c2, o2) * 1.02 and c > o and c > (o2 + c2) / 2",
    "evening_star": "c2 > o2 and h1 > greatest(c2, o2) and l1 > least(c2, o2) * 0.98 and c < o and c < (o2 + c2) / 2",
    "harami_bull": "c1 < o1 and c > o and c < o1 and o > c1",
    "harami_bear": "c1 > o1 and c < o and c > o1 and o < c1",
    "red_three": "c > o and c1 > o1 and c2 > o2 and c > c1 and c1 > c2 and o > o1 and o < c1",
    "held_open": "c2 > o2 and c1 < o1 and c < o and l1 >= o2 * 0.995 and l >= o2 * 0.995",
    "swallow_three": "c > o and c1 < o1 and c2 < o2 and c > greatest(o1, o2, coalesce(o3, o1)) and o < least(c1, c2, coalesce(c3, c1))",
    "cannon": "c > o and c1 < o1 and c2 > o2 and l1 >= l2 * 0.99 and c > h2",
    "long_top": "c > o and h - greatest(o, c) > 1.5 * abs(c - o) and h >= high20 * 0.97",
}
MAIN = SHARED | {
    "shooting": "h - greatest(o, c) > 2 * abs(c - o) and abs(c - o) < 0.35 * nullif(h - l, 0)",
    "top_star": "top or shooting",
    "flat_top": "abs(h - h1) / greatest(h1, 0.01) < 0.004 and h >= h1 * 0.998",
    "south_three": "c2 < o2 and abs(c1 - o1) < 0.4 * abs(c2 - o2) and c > o and c > (o2 + c2) / 2",
}
EXTENDED = MAIN | {
    "shooting": "h - greatest(o, c) > 2 * abs(c - o) and abs(c - o) < 0.35 * nullif(h - l, 0) and c <= o + abs(c - o) * 0.2",
    "harami_bear": "(c1 > o1 and c < o and c > o1 and o < c1) or (c1 > o1 and abs(c - o) < 0.3 * abs(o1 - c1) and c < o)",
    "harami_bull": "(c1 < o1 and c > o and c < o1 and o > c1) or (c1 < o1 and abs(c - o) < 0.3 * abs(c1 - o1) and c > o)",
    "counter_cannon": "c < o and c1 > o1 and c2 < o2 and h1 <= h2 * 1.01 and c < l2",
    "double_cannon": "c > o and c1 < o1 and c2 > o2 and abs(c2 - o2) > 0.5 * abs(c - o) and c > c1",
    "hammer": "least(o, c) - l > 2 * abs(c - o) and abs(c - o) < 0.35 * nullif(h - l, 0)",
}
BASIC = SHARED | {
    "shooting": "h - greatest(o, c) > 2 * abs(c - o) and abs(c - o) < 0.3 * nullif(h - l, 0)",
    "hammer": "least(o, c) - l > 2 * abs(c - o) and abs(c - o) < 0.3 * nullif(h - l, 0)",
    "flat_top": "abs(h - h1) / h1 < 0.003 and h >= h1 * 0.999",
    "south_three": "c2 < o2 and abs(c1 - o1) < 0.35 * abs(c2 - o2) and c > o and c > (o2 + c2) / 2",
    "swallow_three": "c > o and c1 < o1 and c2 < o2 and o3 is not null and c3 is not null and c > greatest(o1, o2, o3) and o < least(c1, c2, c3)",
}
DIP = {
    "ma_up": "ma20 > ma20_3",
    "above_ma": "c >= ma20",
    "big_red": "c < o and (o - c) / c1 > 0.03",
    "big_green": "c > o and (c - o) / c1 > 0.03",
    "gap_up_big": "o / c1 - 1 > 0.01",
    "gap_down_big": "o / c1 - 1 < -0.01",
    "trend_dip": "ma_up and above_ma and big_red and ret1 > -0.095",
    "chase": "ret10 > 0.15 and big_green and gap_up_big",
}

# Combinations as (pattern, rows before) in order, with the weights
# of the weighted variant where it has one.
GOOD = [
    ((("south_three", 1), ("bull_engulf", 0)), 3.89), ((("downpour", 1), ("harami_bear", 0)), 3.79), ((("piercing", 1), ("bear_engulf", 0)), 3.73), ((("harami_bull", 1), ("downpour", 0)), 3.68),
    ((("bottom", 1), ("south_three", 0)), 3.56), ((("held_open", 1), ("swallow_three", 0)), 3.54), ((("held_open", 1), ("south_three", 0)), 3.49), ((("evening_star", 1), ("swallow_three", 0)), 3.35),
    ((("south_three", 1), ("downpour", 0)), 22.56), ((("top_star", 1), ("cannon", 0)), 16.16), ((("long_top", 1), ("gap_up", 0)), 9.36), ((("long_top", 1), ("downpour", 0)), 12.83),
    ((("bull_engulf", 1), ("gap_up", 0)), 9.39), ((("red_three", 1), ("top_star", 0)), 12.21),
    ((("downpour", 2), ("harami_bear", 1), ("gap_down", 0)), 9.59), ((("bull_engulf", 2), ("gap_up", 1), ("shooting", 0)), 9.39), ((("bottom", 2), ("downpour", 1), ("harami_bear", 0)), 8.55),
    ((("harami_bull", 2), ("gap_up", 1), ("top", 0)), 7.35), ((("gap_down", 2), ("top", 1), ("harami_bear", 0)), 7.19), ((("downpour", 2), ("gap_down", 1), ("harami_bear", 0)), 7.18),
    ((("gap_down", 2), ("cannon", 1), ("flat_top", 0)), 7.14), ((("bottom", 2), ("red_three", 1), ("flat_top", 0)), 6.77), ((("gap_down", 2), ("piercing", 1), ("harami_bear", 0)), 6.71),
    ((("gap_up", 2), ("harami_bull", 1), ("morning_star", 0)), 6.32), ((("piercing", 2), ("evening_star", 1), ("bottom", 0)), None), ((("morning_star", 2), ("piercing", 1), ("evening_star", 0)), None),
]
BAD = [(("gap_up", 1), ("gap_down", 0)), (("bear_engulf", 1), ("flat_top", 0)), (("bottom", 1), ("gap_down", 0)), (("gap_down", 1), ("bottom", 0)), (("gap_up", 2), ("gap_down", 0))]
BAD_WEIGHTED = [*BAD, (("gap_up", 2), ("top", 0))]
GOOD_BASIC = [(("piercing", 1), ("bear_engulf", 0)), (("south_three", 1), ("bull_engulf", 0)), (("bottom", 1), ("south_three", 0)), (("held_open", 1), ("swallow_three", 0)), (("downpour", 1), ("harami_bear", 0)), (("held_open", 1), ("bull_engulf", 0))]
BAD_BASIC = [(("morning_star", 2), ("bottom", 1), ("gap_down", 0)), (("gap_down", 1), ("evening_star", 0)), (("gap_down", 1), ("dark_cloud", 0)), (("gap_up", 2), ("gap_up", 1), ("gap_down", 0)), (("gap_up", 2), ("gap_up", 1), ("top", 0))]


def name_of(steps) -> str:
    return ">".join(f"{p}@{k}" for p, k in steps)


def with_lags(panel: DataFrame) -> DataFrame:
    """Short names for the bar and its three rows before, and the 20-row high."""
    out = panel
    for short, column in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")):
        out = out.withColumn(short, F.col(column))
        for k in (1, 2, 3):
            out = out.withColumn(f"{short}{k}", F.lag(column, k).over(by_code()))
    return out.withColumn("high20", full(F.col("high"), F.max, 20))


def flags(lagged: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One boolean column per rule, false where anything is missing; rules may name earlier ones."""
    out = lagged
    for name, rule in rules.items():
        out = out.withColumn(name, F.coalesce(F.expr(rule), F.lit(False)))
    return out


def combo(steps):
    """All patterns of the steps at their rows; rows before the first are false."""
    every = None
    for pattern, back in steps:
        one = F.col(pattern) if not back else F.coalesce(F.lag(pattern, back).over(by_code()), F.lit(False))
        every = one if every is None else every & one
    return every


def combo_hits(flagged: DataFrame, combos: list, name: str = "hits") -> DataFrame:
    """An array of the names of the combinations that hit in a row: rows are
    exploded by what hits only, never by all rules."""
    told = F.array(*[F.when(combo(steps), F.lit(name_of(steps))) for steps in combos])
    return flagged.withColumn(name, F.filter(told, lambda x: x.isNotNull()))


def event_study(hits: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """(combo, hits, mean_k...) over rows(hits, fwd_k...): hits count rows without a return too."""
    rows = hits.select(F.explode("hits").alias("combo"), *[f"fwd{k}" for k in horizons])
    return rows.groupBy("combo").agg(F.count("*").alias("hits"), *[F.avg(f"fwd{k}").alias(f"mean_{k}d") for k in horizons])


def keep_combos(study: DataFrame, least: int, relaxed: int, mean: str = "mean_5d") -> DataFrame:
    """Combinations with a positive mean and `least` hits, or `relaxed` hits if none has."""
    good = study.where(F.col(mean) > 0)
    any_strict = F.max(F.col("hits") >= least).over(Window.partitionBy())
    return good.withColumn("_strict", any_strict).where(F.col("hits") >= F.when(F.col("_strict"), least).otherwise(relaxed)).drop("_strict")


def padded_forward(panel: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """fwd_k: padded k-row return from this row on; the last k rows have none."""
    filled = padded("close")
    out = panel.withColumn("_filled", filled)
    for k in horizons:
        out = out.withColumn(f"fwd{k}", F.lead("_filled", k).over(by_code()) / F.col("_filled") - 1)
    return out.drop("_filled")
