"""Daily review rules over tables with one row per date (or per code and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import half_up
from .windows import by_code

#: Order of what an order by streak or amount leaves open: several instruments may share a code.
TIES = ("code", "name", "industry")


def steps(value: Column, table, otherwise) -> Column:
    """The first entry (least value, result) that the value reaches, else otherwise."""
    out = None
    for least, result in table:
        out = F.when(value >= least, result) if out is None else out.when(value >= least, result)
    return out.otherwise(otherwise)


def ladder(panel: DataFrame) -> DataFrame:
    """(date_idx, date, first, second, third, top_boards, top_code, highs): streaks of 1, 2,
    3 counted, the highest of 4 and more, and the eight highest codes."""
    high = F.when(F.col("streak") >= 4, F.struct((-F.col("streak")).alias("s"), "code"))
    out = panel.groupBy("date_idx", "date").agg(
        *[F.count_if(F.col("streak") == k).alias(n) for k, n in ((1, "first"), (2, "second"), (3, "third"))], F.min(high).alias("best"), F.slice(F.array_sort(F.collect_list(high)), 1, 8).alias("highs")
    )
    return out.select("date_idx", "date", "first", "second", "third", F.coalesce(-F.col("best.s"), F.lit(0)).alias("top_boards"), F.coalesce("best.code", F.lit("")).alias("top_code"), F.array_join(F.col("highs.code"), ",").alias("highs"))


def promotion(panel: DataFrame, least: int = 2) -> DataFrame:
    """(date_idx, date, num, den, rate): codes with a streak of `least` on the row before
    that close at the limit again; a lag in the panel's window, no self-join."""
    before = F.lag("streak").over(by_code())
    rows = panel.withColumn("_b", before)
    den, num = F.count_if(F.col("_b") >= least), F.count_if((F.col("_b") >= least) & F.col("is_limit"))
    return rows.groupBy("date_idx", "date").agg(num.alias("num"), den.alias("den"), F.round(F.when(den > 0, num * 100.0 / den).otherwise(0.0), 1).alias("rate"))


def premium(panel: DataFrame, face: float = -5.0, worst: int = 5) -> DataFrame:
    """(date_idx, date, avg, median, big_face, sample, worst): today's percent changes of
    the codes that closed at the limit on the row before."""
    rows = panel.withColumn("_b", F.lag("is_limit").over(by_code())).withColumn("_p", F.when(F.col("_b"), F.col("ret1") * 100))
    bad = F.when(F.col("_p") < face, F.struct("_p", "code"))
    out = rows.groupBy("date_idx", "date").agg(F.round(F.avg("_p"), 2).alias("avg"), F.round(F.median("_p"), 2).alias("median"), F.count_if(F.col("_p") < face).alias("big_face"), F.count("_p").alias("sample"), F.slice(F.array_sort(F.collect_list(bad)), 1, worst).alias("w"))
    return out.select("date_idx", "date", "avg", "median", "big_face", "sample", F.array_join(F.col("w.code"), ",").alias("worst"))


def sector_counts(panel: DataFrame, sectors: DataFrame, top: int = 12) -> DataFrame:
    """(date_idx, date, sector, n, rank): limit-ups per sector and date, the `top` largest."""
    rows = panel.where("is_limit").join(sectors.select("code", "sector"), "code").groupBy("date_idx", "date", "sector").agg(F.count("*").alias("n"))
    w = Window.partitionBy("date_idx").orderBy(F.desc("n"), "sector")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def emotion_score(days: DataFrame) -> DataFrame:
    """days with s1..s5, total and base added, from columns zt, dt, zb_rate, rate, avg,
    big_face, red_pct, amount_yi, amount_delta, second, third, top_boards,
    top_sector, n_sectors. Missing values leave their part out, as the rules say."""
    c = F.col
    s1 = steps(c("zt"), ((80, 12), (50, 8), (30, 5)), 2) + F.when(c("dt") <= 3, 8).when(c("dt") <= 10, 4).otherwise(0)
    s1 = s1 + F.when((c("top_boards") >= 5) & (c("third") >= 2) & (c("second") >= 5), 5).when((c("top_boards") >= 3) & (c("second") >= 3), 3).otherwise(0)
    s2 = steps(F.coalesce("rate", F.lit(0.0)), ((50, 12), (35, 9), (20, 5)), 2)
    s2 = s2 + F.coalesce(steps(c("avg"), ((3, 8), (1, 5), (-1, 2)), 0), F.lit(0)) + F.when(F.coalesce("big_face", F.lit(0)) == 0, 5).when(c("big_face") <= 3, 2).otherwise(0)
    s2 = F.when(c("zb_rate") >= 35, F.greatest(s2 - 6, F.lit(0))).otherwise(s2)
    s3 = F.when(c("red_pct").isNull(), 0).otherwise(steps(c("red_pct"), ((60, 12), (50, 8), (40, 4)), 1))
    worst = F.greatest("dt", F.lit(1))
    s3 = s3 + F.when(c("zt") > worst * 8, 8).when(c("zt") > worst * 3, 5).otherwise(0)
    s4 = F.when(c("amount_yi").isNull(), 0).otherwise(steps(c("amount_yi"), ((18000, 10), (12000, 7), (8000, 4)), 2))
    s4 = s4 + F.when(c("amount_delta").isNull(), 4).when(c("amount_delta") > 500, 8).when(c("amount_delta") > 0, 5).when(c("amount_delta") > -800, 3).otherwise(0)
    s5 = steps(F.coalesce("top_sector", F.lit(0)), ((8, 6), (5, 4), (3, 2)), 0) + steps(F.coalesce("n_sectors", F.lit(0)), ((4, 4), (2, 2)), 0)
    out = days
    for name, value, most in (("s1", s1, 25), ("s2", s2, 25), ("s3", s3, 20), ("s4", s4, 20), ("s5", s5, 10)):
        out = out.withColumn(name, F.least(value, F.lit(most)).cast("int"))
    out = out.withColumn("total", F.expr("s1 + s2 + s3 + s4 + s5"))
    return out.withColumn("base", F.greatest(F.lit(40), F.least(F.lit(75), c("total") - 10)))


def market_regime(total: Column, strong: Column) -> Column:
    return F.when((total >= 75) & strong, "attack").when(total >= 65, "mixed, strong").when(total >= 50, "mixed").when(total >= 35, "ebb").otherwise("defence")


def position_anchor(total: Column, strong: Column) -> Column:
    return F.when((total >= 75) & strong, 7.0).when(total >= 70, 5.0).when(total >= 60, F.when(strong, 4.0).otherwise(3.0)).when(total >= 45, 2.0).otherwise(1.0)


def macro_coefficient(position: Column) -> Column:
    """0.6 + 0.4 * clamp(position / 0.9), 4 digits; null or not finite: 1."""
    usable = position.isNotNull() & ~F.isnan(position) & (F.abs(position) != float("inf"))
    return F.when(usable, F.round(0.6 + 0.4 * F.greatest(F.lit(0.0), F.least(position / 0.9, F.lit(1.0))), 4)).otherwise(1.0)


def blend_anchor(anchor: Column, position: Column, as_of: Column, day: Column, longest: int = 5) -> Column:
    """struct(final, coeff, reason): the anchor scaled by the macro coefficient, in
    [1, 7]; unscaled where the macro state is missing, newer than the day or too old."""
    lag = F.datediff(day, as_of)
    reason = F.when(position.isNull(), "missing").when(lag < 0, "newer").when(lag > longest, "stale")
    coeff = F.when(reason.isNotNull(), 1.0).otherwise(macro_coefficient(position))
    final = F.greatest(F.lit(1.0), F.least(F.round(anchor * coeff, 1), F.lit(7.0)))
    return F.struct(final.alias("final"), coeff.alias("coeff"), F.coalesce(reason, F.when(coeff >= 1, "full"), F.lit("")).alias("reason"))


def pick_amount(amount: Column, complete: Column, fallback: Column) -> Column:
    """struct(amount, scope): the whole market's only if it is complete for sure."""
    whole = amount.isNotNull() & F.coalesce(complete, F.lit(False))
    return F.struct(F.when(whole, amount).otherwise(fallback).alias("amount"), F.when(whole, "market").when(fallback.isNotNull(), "index").otherwise("none").alias("scope"))


def leader_risk(seal: Column, turnover: Column, top: Column) -> Column:
    seal, turnover = F.coalesce(seal, F.lit(0.0)), F.coalesce(turnover, F.lit(0.0))
    return F.when(top, "high").when(turnover <= 0, "unknown").when(seal / turnover < 0.3, "high").otherwise("mid")


def classify_sector(name: Column, industry: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule (sector, keywords) one of whose keywords the name holds, else
    eight characters of the industry, else 'other'."""
    out = None
    for sector, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        out = F.when(hit, sector) if out is None else out.when(hit, sector)
    rest = F.when(F.coalesce(F.length(industry), F.lit(0)) > 0, F.substring(industry, 1, 8)).otherwise("other")
    return out.otherwise(rest) if out is not None else rest


def theme_level(n: Column) -> Column:
    return steps(n, ((8, "A-"), (5, "B+"), (3, "B")), "watch")


#: The grades, from the best on.
GRADES = ((90, "S"), (80, "A+"), (70, "A"), (60, "A-"), (50, "B+"), (40, "B"), (30, "B-"), (20, "C"))


def grade(score: Column) -> Column:
    return steps(score, GRADES, "D")


def top_sectors(ups: DataFrame) -> DataFrame:
    """(date_idx, top_sector, top_n): the sector with most limit-ups of a date, ties by name."""
    counts = ups.groupBy("date_idx", "industry").agg(F.count("*").alias("n"))
    best = counts.groupBy("date_idx").agg(F.min_by(F.struct("industry", "n"), F.struct((-F.col("n")).alias("m"), F.isnull("industry").alias("none"), "industry")).alias("t"))
    return best.select("date_idx", F.col("t.industry").alias("top_sector"), F.col("t.n").alias("top_n"))


def _by_rank(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("date_idx").orderBy(*order)))


def leaders(rows: DataFrame) -> DataFrame:
    """The rows of a date's leaders with their rank r: of the six highest streaks (then
    amount) the first five by distinct name."""
    highest = _by_rank(rows.where("is_limit"), F.desc("streak"), F.desc_nulls_last("amount"), *TIES).where("r <= 6")
    named = highest.withColumn("again", F.row_number().over(Window.partitionBy("date_idx", "name").orderBy("r"))).where("again = 1").drop("again")
    return _by_rank(named, F.col("r")).where("r <= 5")


def core_roles(rows: DataFrame, watched: Column) -> DataFrame:
    """(date_idx, date, code, name, role, r) from rows(date_idx, date, code, name, industry,
    streak, is_limit, amount, close, ma20) with everything that traded; a row for each
    instrument of a code.

    leader: see leaders. mid: the four largest limit-ups by amount in the date's top
    sector, filled up to five with watched names of that sector at or above their MA20.
    elastic: the five largest limit-ups of 20 % boards. Ties go by code, then name."""
    ups = rows.where("is_limit")
    tops = top_sectors(ups)
    by_amount = (F.desc_nulls_last("amount"), *TIES)
    strong = _by_rank(ups.join(tops, "date_idx").where("industry = top_sector"), *by_amount).where("r <= 4").withColumn("kind", F.lit(0))
    same = F.contains("top_sector", F.left("industry", F.lit(2))) | F.contains("industry", F.left("top_sector", F.lit(2)))
    filling = rows.where(watched & (F.col("close") >= F.col("ma20"))).join(tops, "date_idx").where(same)
    filling = filling.join(strong.select("date_idx", "name"), ["date_idx", "name"], "left_anti")
    both = strong.select("date_idx", "date", "code", "name", "kind", "r").unionByName(_by_rank(filling, *TIES).withColumn("kind", F.lit(1)).select("date_idx", "date", "code", "name", "kind", "r"))
    mid = _by_rank(both, "kind", "r", "code").where("r <= 5")
    elastic = _by_rank(ups.where(F.substring("code", 1, 2).isin("30", "68")), *by_amount).where("r <= 5")
    out = None
    for role, df in (("leader", leaders(rows)), ("mid", mid), ("elastic", elastic)):
        part = df.select("date_idx", "date", "code", "name", F.lit(role).alias("role"), F.col("r").cast("long").alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


def four_dim_scores(rows: DataFrame, emotion: DataFrame, watched: Column, most: int = 16) -> DataFrame:
    """(date_idx, date, name, k, theme, pos, flow, hold, raw, grade, elastic, act): per date
    the highest board, four leaders (each by its own name, whatever shares its code) and
    the watched names, each name once (the first kept), `most` at most (the report's
    length). emotion(date_idx, total) sets the penalty. Ties go by code, then name."""
    c = F.col
    tops = top_sectors(rows.where("is_limit"))
    counts = rows.where("is_limit").groupBy("date_idx", "industry").agg(F.count("*").alias("n_sector"))
    lead = leaders(rows).withColumn("r", c("r").cast("long")).join(tops, "date_idx")
    board = lead.where((c("r") == 1) & (c("streak") >= 4))
    board = board.select("date_idx", "date", "name", F.lit(0).alias("kind"), c("r").alias("k"), *[F.lit(v).cast("double").alias(n) for n, v in (("theme", 70), ("pos", 85), ("flow", 40), ("hold", 55))])
    theme = F.when(c("industry") == c("top_sector"), 60).otherwise(45) + F.when(c("top_n") >= 8, 10).otherwise(0)
    high = lead.where("r <= 4").select("date_idx", "date", "name", F.lit(1).alias("kind"), c("r").alias("k"), F.least(theme, F.lit(90)).cast("double").alias("theme"), F.least(F.lit(90), 35 + c("streak") * 12).cast("double").alias("pos"), F.lit(45.0).alias("flow"), F.lit(50.0).alias("hold"))
    seen = rows.where(watched & c("close").isNotNull()).join(counts, ["date_idx", "industry"], "left")
    up = F.coalesce(c("is_limit"), F.lit(False))
    theme = F.when(c("n_sector").isNotNull(), F.least(F.lit(90), 40 + c("n_sector") * 5)).otherwise(50)
    theme = F.when(up, F.least(F.lit(95), theme + 20)).otherwise(theme)
    above, below = F.coalesce(c("close") >= c("ma20"), F.lit(False)), F.coalesce(c("close") < c("ma20"), F.lit(False))
    flow = 50 + F.when(above, 15).when(below, -10).otherwise(0) + F.when(c("ret5") > 0.03, 10).otherwise(0)
    hold = 50 + F.when(above, 15).otherwise(0) + F.when(c("ret5") < -0.05, -10).otherwise(0)
    own = seen.select("date_idx", "date", "name", F.lit(2).alias("kind"), F.row_number().over(Window.partitionBy("date_idx").orderBy(*TIES)).cast("long").alias("k"), theme.cast("double").alias("theme"), F.when(up, 55.0).otherwise(40.0).alias("pos"), flow.cast("double").alias("flow"), hold.cast("double").alias("hold"))
    every = board.unionByName(high).unionByName(own)
    once = every.withColumn("again", F.row_number().over(Window.partitionBy("date_idx", "name").orderBy("kind", "k"))).where("again = 1")
    kept = once.withColumn("rank", F.row_number().over(Window.partitionBy("date_idx").orderBy("kind", "k")).cast("long")).where(c("rank") <= most)
    penalty = F.when(c("total") < 50, 8).when(c("total") < 65, 4).otherwise(0)
    kept = kept.join(emotion.select("date_idx", "total"), "date_idx", "left").withColumn("penalty", F.when(c("total").isNull(), 4).otherwise(penalty))
    g = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (35 * c("theme") + 30 * c("pos") + 20 * c("flow") + 15 * c("hold")) / 100 - c("penalty")))
    kept = kept.withColumn("g", g)
    act = F.when(c("g") >= 75, "follow").when(c("g") >= 60, "watch").when(c("g") >= 45, "hold").otherwise("avoid")
    return kept.select("date_idx", "date", "name", "rank", *[grade(c(n)).alias(n) for n in ("theme", "pos", "flow", "hold")], half_up(c("g"), 1).alias("raw"), grade(c("g")).alias("grade"), grade((c("theme") + c("pos")) / 2).alias("elastic"), act.alias("act"))
