"""Admission of condensed sessions, guards over event logs, and the comparison of runs and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.windows import with_carried


def delivered(messages: DataFrame) -> DataFrame:
    """The last answer of each session and how many it has: messages of the assistant that hold more than white space."""
    return messages.filter((F.col("role") == "assistant") & F.col("text").rlike(r"\S")).groupBy("session").agg(F.max("seq").alias("last_answer"), F.count("*").alias("answers"))


def admission(surface: DataFrame, least: int = 64, reply: int = 512, limit: int = 2000, share: float = 0.25, most: int = 1024) -> DataFrame:
    """Whether keeping a session's checkpoints only saves enough, whether its request fits the limit, and what its anchors may cost."""
    per = surface.groupBy("session").agg(F.sum("tokens").alias("before"), F.coalesce(F.sum(F.when(F.col("is_checkpoint"), F.col("tokens"))), F.lit(0)).cast("long").alias("after"))
    return per.select(
        "session", "before", "after", (F.col("before") - F.col("after") >= least).alias("saves"), (F.col("before") + reply <= limit).alias("fits"),
        F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.col("before") * share))).cast("long").alias("anchor_budget"),
    )


def low_savings(events: DataFrame, least: float) -> DataFrame:
    """Low events that follow at least two others of their key without a better one between.

    The two events before are looked up within a key's hour; only the first and last two of each hour of a key meet in one task.
    """
    low = F.coalesce(F.col("value") < least, F.lit(False))
    hours = events.select("event_id", "user_id", "ts", low.alias("low"), F.date_trunc("hour", "ts").alias("hour"))
    hour, key = Window.partitionBy("user_id", "hour"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    third = lambda w: F.col("low") & F.lag("low", 1, False).over(w) & F.lag("low", 2, False).over(w)
    up = hour.orderBy("ts", "event_id")
    rows = hours.withColumn("at", F.row_number().over(up)).withColumn("left", F.count("*").over(hour) - F.col("at")).withColumn("suppressed", third(up))
    edges = rows.filter("at <= 2 or left < 2").withColumn("suppressed", third(key)).filter("at <= 2")
    return rows.filter("at > 2").unionByName(edges).select("event_id", "user_id", "suppressed")


#: Rows of a key that one task looks at together, by their ids.
SPAN = 1 << 16


def on_time(events: DataFrame, seconds: int) -> DataFrame:
    """Events at most so many seconds behind the latest one of their key that arrived before them."""
    rows = with_carried(events.withColumn("part", F.floor(F.col("event_id") / SPAN)), "user_id", "part", F.max("ts"), lambda s, w: F.max(s).over(w))
    order = Window.partitionBy("user_id", "part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("now", F.greatest(F.max("ts").over(order), "carried")).filter(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL '{seconds}' SECOND")).select("event_id", "user_id")


def inventory(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that only one of two inventories (path, sha256) holds, or both with different contents."""
    a, b = left.select("path", F.col("sha256").alias("a")), right.select("path", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("differs")
    return a.join(b, "path", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", state.alias("state"))
