"""Rotation and heat of labels (concepts, industries) over dates."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .breadth import clamp, count_if

ABSENT = 999


def concept_daily_mean(rows: DataFrame) -> DataFrame:
    """Mean change per (date, label), nulls and NaN left out."""
    p = F.col("change_pct")
    return rows.filter(p.isNotNull() & ~F.isnan(p)).groupBy("date", "label").agg(F.avg(p).alias("avg_pct"))


def last_dates(dates: DataFrame, days: int) -> DataFrame:
    """The last ``days`` dates (7 to 30) of ``dates``."""
    return dates.select("date").distinct().orderBy(F.col("date").desc()).limit(max(7, min(30, days)))


def rotation_ranks(means: DataFrame, days: int, dates: DataFrame | None = None) -> DataFrame:
    """Ranks of labels on each of the last dates; ``dates`` is where those come from, by default ``means``, which is then evaluated twice."""
    last = last_dates(means if dates is None else dates, days)
    w = Window.partitionBy("date").orderBy(F.col("avg_pct").desc(), "label")
    return means.join(F.broadcast(last), "date", "left_semi").withColumn("rank", F.row_number().over(w))  # at most 30 rows


def rotation_matrix(means: DataFrame, days: int, dates: DataFrame | None = None) -> DataFrame:
    """Per date the labels in falling order of their means."""
    ranked = rotation_ranks(means, days, dates)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    return ranked.groupBy("date").agg(listed.alias("labels"))


# What makes a rotation class (ranks, places and deviations), and how many labels each lists.
CLASSES = ("persistent_leaders", "rising", "fading", "institutional", "hot_money")
RECENT, LEADING, BEHIND, CAUGHT_UP, MOVED, STEADY, STEADY_MEAN, RESTLESS, LISTED = 3, 10, 30, 20, 20, 5, 20, 20, 8


def rank_vectors(means: DataFrame, days: int, dates: DataFrame | None = None) -> DataFrame:
    """Per label its ranks and means in order of the dates, filled up at the end with rank ``ABSENT`` and mean 0 for dates it lacks.

    ``ranks, pcts, avg_rank, rank_std`` (both to one digit), ``recent``, the mean of the last
    three ranks, ``first`` and ``latest``. A vector has at most 30 entries.
    """
    span = last_dates(means if dates is None else dates, days).agg(F.count(F.lit(1)).cast("int").alias("days"))
    ranked = rotation_ranks(means, days, dates)
    seen = ranked.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("date", "rank", F.col("avg_pct").alias("pct")))).alias("seen"))
    seen = seen.join(F.broadcast(span))  # one row
    absent = F.col("days") - F.size("seen")
    ranks = F.concat(F.transform("seen", lambda x: x["rank"]), F.array_repeat(F.lit(ABSENT), absent))
    pcts = F.concat(F.transform("seen", lambda x: F.bround(x["pct"], 4)), F.array_repeat(F.lit(0.0), absent))
    out = seen.select("label", "days", ranks.alias("ranks"), pcts.alias("pcts"))
    total = lambda c, f=lambda x: x: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    mean = total("ranks") / F.col("days")
    out = out.withColumn("_mean", mean)
    spread = F.sqrt(total("ranks", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))) / F.col("days"))
    near = F.least(F.lit(RECENT), F.col("days"))
    return out.select(
        "label",
        "days",
        "ranks",
        "pcts",
        F.bround("_mean", 1).alias("avg_rank"),
        F.bround(spread, 1).alias("rank_std"),
        (total(F.slice("ranks", -near, near)) / near).alias("recent"),
        F.element_at("ranks", 1).alias("first"),
        F.element_at("ranks", -1).alias("latest")
    )


def rotation_signals(means: DataFrame, days: int, dates: DataFrame | None = None, most: int = LISTED) -> DataFrame:
    """``class, place, label`` and its rank vector: the first ``most`` labels of each of ``CLASSES``; a label may be in several.

    Leaders are among the first lately; risers came from behind to the front, and faders
    the other way; the steady are near the front with little deviation; the restless have
    much. Leaders are in order of their mean rank, risers and faders of the move, the steady and
    the restless of their deviation.
    """
    v = rank_vectors(means, days, dates)
    gain = F.col("first") - F.col("latest")
    rules = {
        "persistent_leaders": ((F.col("recent") <= LEADING) & (F.col("latest") <= LEADING), F.col("avg_rank"), F.lit(0.0)),
        "rising": ((F.col("first") > BEHIND) & (F.col("latest") <= CAUGHT_UP) & (gain >= MOVED), -gain, F.lit(0.0)),
        "fading": ((F.col("first") <= LEADING) & (F.col("latest") > BEHIND) & (gain <= -MOVED), gain, F.lit(0.0)),
        "institutional": ((F.col("rank_std") <= STEADY) & (F.col("avg_rank") <= STEADY_MEAN), F.col("rank_std"), F.col("avg_rank")),
        "hot_money": (F.col("rank_std") >= RESTLESS, -F.col("rank_std"), F.lit(0.0)),
    }
    fits = F.array(*[F.when(rule, F.struct(F.lit(name).alias("class"), a.cast("double").alias("a"), b.cast("double").alias("b"))) for name, (rule, a, b) in rules.items()])
    rows = v.select("*", F.explode(F.filter(fits, lambda x: x.isNotNull())).alias("fit")).select(*v.columns, "fit.*")
    place = F.row_number().over(Window.partitionBy("class").orderBy("a", "b", "label"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("class", "place", "label", "ranks", "pcts", "avg_rank", "rank_std")


# Bounds and weights of a leader's score, of heat and of risk.
LEADER = {"momentum": 0.35, "turnover": 0.22, "amount": 0.18, "cap": 0.15, "volume": 0.07, "boards": 0.03}
HEAT = {"mean": 0.38, "up": 0.2, "strong": 0.16, "amount": 0.12, "leader": 0.14}
RISK = {"mean": 0.55, "weak": 0.45}
STRONG, STRONG_SHARE = 0.05, 0.18
MOST_TURNOVER, MOST_AMOUNT, MOST_CAP, MOST_LABEL_AMOUNT = 30, 20e9, 300e9, 80e9


def _part(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def _log_part(c: Column, most: float) -> Column:
    return _part(F.log1p(F.greatest(c, F.lit(0.0))) / math.log1p(most))


def leader_score(cap: str = "market_cap") -> Column:
    """0 to 100, from six parts of a row; what is null counts as 0, a volume ratio as 1."""
    known = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other))
    parts = {
        "momentum": _part((known("change_pct") + 0.02) / 0.12),
        "turnover": _log_part(known("turnover_rate"), MOST_TURNOVER),
        "amount": _log_part(known("amount"), MOST_AMOUNT),
        "cap": _log_part(known(cap), MOST_CAP),
        "volume": _part((known("vol_ratio_5d", 1.0) - 1) / 4),
        "boards": _part(known("consecutive_limit_ups") / 5),
    }
    return reduce(lambda a, b: a + b, [parts[k] * w for k, w in LEADER.items()]) * 100


def concept_heat(rows: DataFrame) -> DataFrame:
    """Per label on one day: counts of risers and fallers and of strong and weak rows (5 %), mean, median, leader, heat and risk.

    ``rows``: symbol, label, change_pct, amount, turnover_rate, market_cap, vol_ratio_5d,
    consecutive_limit_ups; a symbol has one row a label. Rows without a change count as
    members, and as flat.
    """
    p, n = F.col("change_pct"), F.count(F.lit(1))
    out = rows.withColumn("leader_score", leader_score()).groupBy("label").agg(
        n.alias("n"),
        F.avg(p).alias("avg_pct"),
        F.median(p).alias("median_pct"),
        count_if(p > 0).alias("up"),
        count_if(p < 0).alias("down"),
        F.count(p).alias("_known"),
        count_if(p >= STRONG).alias("strong"),
        count_if(p <= -STRONG).alias("weak"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"),
        F.avg("turnover_rate").alias("avg_turnover"),
        F.avg("vol_ratio_5d").alias("avg_vol_ratio"),
        F.max_by("symbol", F.struct("leader_score", "symbol")).alias("leader"),
        F.max("leader_score").alias("leader_score"),
    )
    mean, many = F.coalesce("avg_pct", F.lit(0.0)), F.greatest(F.lit(1.0), F.col("n") * STRONG_SHARE)
    up_rate = F.coalesce(F.try_divide(F.col("up").cast("double"), F.col("_known").cast("double")), F.lit(0.0))
    heat = {
        "mean": _part((mean + 0.02) / 0.09),
        "up": _part((up_rate - 0.35) / 0.55),
        "strong": _part(F.col("strong") / many),
        "amount": _log_part(F.col("amount"), MOST_LABEL_AMOUNT),
        "leader": _part(F.col("leader_score") / 100),
    }
    risk = {"mean": _part((0.01 - mean) / 0.08), "weak": _part(F.col("weak") / many)}
    weighed = lambda parts, weights: reduce(lambda a, b: a + b, [parts[k] * w for k, w in weights.items()]) * 100
    return out.withColumns(
        {"flat": F.greatest(F.col("n") - F.col("up") - F.col("down"), F.lit(0)), "up_rate": up_rate, "heat": weighed(heat, HEAT), "risk": weighed(risk, RISK)}
    ).drop("_known")
