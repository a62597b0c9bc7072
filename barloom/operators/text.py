"""Text jobs: news tags and clean-up, evidence sentences, traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import title_key

# Words of traps in disclosures.
TRAPS = {"framework": ("框架协议", "战略合作协议", "意向性协议"), "intent": ("意向采购", "意向订单", "意向性订单", "意向协议"), "firm": ("正式订单", "中标通知", "正式合同", "采购合同"), "not binding": ("不具有法律效力", "没有强制约束力", "不具约束力", "无强制约束力")}


def tags(text: Column, words: dict[str, list[str]], default: Column) -> Column:
    """Names of the word lists that the text hits, or the default alone."""
    found = F.filter(F.array(*[F.when(text.rlike("|".join(w)), F.lit(t)) for t, w in words.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def in_window(time: Column, day: str, hours: int = 48) -> Column:
    """Whether a time as text lies within `hours` of the start of the day: year-month-day
    or month-day (of the day's year) with hours and minutes, - or / between. A time
    that can't be read counts if it contains the day, a missing one always."""
    plain = F.replace(time, F.lit("/"), F.lit("-"))
    at = F.coalesce(F.try_to_timestamp(plain, F.lit("y-M-d H:m[:s]")), F.try_to_timestamp(F.concat(F.lit(f"{day[:4]}-"), plain), F.lit("y-M-d H:m")))
    near = F.abs(F.unix_timestamp(at) - F.unix_timestamp(F.lit(day).cast("timestamp"))) <= hours * 3600
    return F.when(F.coalesce(time, F.lit("")) == "", True).when(at.isNotNull(), near).otherwise(F.contains(time, F.lit(day)))


def news_window(items: DataFrame, day: str, hours: int = 48) -> DataFrame:
    """Items whose time (text) is in the window, or all if none is."""
    rows = items.withColumn("_near", in_window(F.col("time"), day, hours))
    some = rows.agg(F.coalesce(F.max("_near"), F.lit(False)).alias("m")).select("m").scalar()
    return rows.where(F.col("_near") | ~some).drop("_near")


def first_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key: a map-side combined minimum of (order, row), so a
    frequent key never gathers in one task."""
    names = rows.columns
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def news_clean(items: DataFrame, day: str, late: bool = False) -> DataFrame:
    """(category, time, title, summary) cleaned: summaries equal to the title go, items
    after the day go (or are marked), the earliest per category and title key stays."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    rows = items.where(F.length(bare(F.col("title"))) > 0)
    rows = rows.withColumn("summary", F.when((bare(F.col("summary")) == "") | (bare(F.col("summary")) == bare(F.col("title"))), "").otherwise(F.col("summary")))
    after = F.to_date("time") > F.lit(day).cast("date")
    rows = rows.withColumn("summary", F.when(after, F.trim(F.concat(F.lit("[after] "), "summary"))).otherwise(F.col("summary"))) if late else rows.where(~F.coalesce(after, F.lit(False)))
    rows = rows.withColumn("key", title_key(F.col("title")))
    keyed = first_per_key(rows.where("key != ''"), ["category", "key"], "time", "title", "summary")
    return keyed.unionByName(rows.where("key = ''")).drop("key")


def sentence(text: Column, word: str, width: int = 45) -> Column:
    """`width` characters to either side of the word's first place; '' without it."""
    at = F.instr(text, word)
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + width)).otherwise("")


def traps(text: Column) -> Column:
    """Map of trap class to its number of exact places."""
    plain = F.coalesce(text, F.lit(""))
    count = lambda w: ((F.length(plain) - F.length(F.replace(plain, F.lit(w)))) / len(w)).cast("int")
    return F.create_map(*[x for name, words in TRAPS.items() for x in (F.lit(name), sum((count(w) for w in words), F.lit(0)))])


def answers(rows: DataFrame) -> DataFrame:
    """Non-empty answers of rows(conv_id, turn, role, text): the question side never counts."""
    return rows.where((F.col("role") == "assistant") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))


def news_rank(rows: DataFrame, limits: dict[str, int], default: int = 10) -> DataFrame:
    """The first rows per tag by time and title, up to the tag's limit (a top-k report)."""
    most = F.lit(default)
    for tag, n in limits.items():
        most = F.when(F.col("tag") == tag, n).otherwise(most)
    w = Window.partitionBy("tag").orderBy(F.desc("time"), "title", "doc_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
