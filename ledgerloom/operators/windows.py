"""Budget, pressure and range operators over priced surfaces, as windows and aggregations by session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _session() -> WindowSpec:
    return Window.partitionBy("session")


def _upward() -> WindowSpec:
    return _session().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _downward() -> WindowSpec:
    return _session().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_carried(rows: DataFrame, key: str, block: str, state: Column, over: Callable[[Column, WindowSpec], Column]) -> DataFrame:
    """rows with `carried`: what the blocks of their key before their own come to, by over(a block's state, the window of earlier blocks).

    So a running state of a key with very many rows is made block by block: one row for each block of a key meets in a task, its rows don't.
    """
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(F.col(key).alias("k"), F.col(block).alias("b")).agg(state.alias("s"))
    return rows.join(per.select("k", "b", over(F.col("s"), earlier).alias("carried")), rows[key].eqNullSafe(F.col("k")) & rows[block].eqNullSafe(F.col("b"))).drop("k", "b")


def running_pressure(surface: DataFrame) -> DataFrame:
    return surface.select("session", "pos", "tokens", F.sum("tokens").over(_upward()).alias("pressure"))


def tail_tokens(surface: DataFrame) -> DataFrame:
    return surface.select("session", "pos", F.sum("tokens").over(_downward()).alias("tail"))


def threshold_crossing(surface: DataFrame, threshold: int) -> DataFrame:
    """The first place of each session whose pressure reaches the threshold."""
    over = running_pressure(surface).filter(F.col("pressure") >= threshold)
    return over.groupBy("session").agg(F.min("pos").alias("pos"), F.min("pressure").alias("pressure"))


def select_range(surface: DataFrame, retain: int, absorb_floor: float, minimum: int) -> DataFrame:
    """The head span to replace: start, end and tokens.

    The tail that stays holds at least `retain` tokens; checkpoints at its head are taken into the span while the
    tail keeps absorb_floor of that; the cut moves back to a place where no tool call is open; spans below `minimum` are none.
    """
    w = surface.select("session", "pos", "tokens", "is_checkpoint", "balanced", F.when(F.col("has_system"), 1).otherwise(0).alias("first"), F.sum("tokens").over(_downward()).alias("tail"), F.count("*").over(_session()).alias("n"))
    w = w.withColumn("keep", F.coalesce(F.max(F.when(F.col("tail") >= retain, F.col("pos"))).over(_session()), F.lit(0))).filter("keep > first")
    stays = ~(F.col("is_checkpoint") & (F.col("tail") - F.col("tokens") >= retain * absorb_floor))
    w = w.withColumn("cut", F.coalesce(F.min(F.when((F.col("pos") >= F.col("keep")) & stays, F.col("pos"))).over(_session()), F.col("n"))).filter("cut < n")
    w = w.withColumn("cut", F.max(F.when(F.col("balanced") & (F.col("pos") <= F.col("cut")) & (F.col("pos") > F.col("first")), F.col("pos"))).over(_session()))
    span = w.filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("cut"))).groupBy("session").agg(F.min("first").cast("long").alias("start"), (F.min("cut") - 1).alias("end"), F.sum("tokens").alias("tokens"))
    return span.filter(F.col("tokens") >= minimum)


def pairing_balance(surface: DataFrame) -> DataFrame:
    """Tool calls still open before each place: questions stand for calls and answers for results."""
    before = _session().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return surface.select("session", "pos", F.coalesce(F.sum(step).over(before), F.lit(0)).alias("open_calls")).withColumn("balanced", F.col("open_calls") == 0)


def last_turns(surface: DataFrame) -> DataFrame:
    """The last place and role of each session, and whether a turn is open (its last role is the user's)."""
    return surface.groupBy("session").agg(F.max("pos").alias("turn"), F.max_by("role", "pos").alias("role")).withColumn("open_turn", F.col("role") == "user")


def role_profile(surface: DataFrame) -> DataFrame:
    return surface.groupBy("role").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


def price_check(surface: DataFrame) -> DataFrame:
    """Each session's total, and whether its suffix sums may be reused: all prices and the total whole, not below zero, and exact as doubles."""
    safe = (F.col("tokens") >= 0) & (F.col("tokens") <= 2**53 - 1)
    per = surface.groupBy("session").agg(F.sum("tokens").alias("total"), F.bool_and(safe).alias("all_safe"))
    return per.select("session", "total", (F.col("all_safe") & (F.col("total") <= 2**53 - 1)).alias("reusable"))


def replaced(surface: DataFrame, spans: DataFrame, cost: int) -> DataFrame:
    """The surface once each span gave way to one checkpoint of so many tokens, dense again, and its generation."""
    rows = surface.select("session", "pos", "tokens").join(spans.select("session", "start", "end"), "session", "left")
    inside = F.coalesce(F.col("pos").between(F.col("start"), F.col("end")), F.lit(False))
    left = rows.filter(~inside | (F.col("pos") == F.col("start"))).withColumn("is_new", inside)
    dense = F.row_number().over(_session().orderBy("pos")) - 1
    return left.select("session", dense.cast("long").alias("pos"), F.when(F.col("is_new"), F.lit(cost).cast("long")).otherwise(F.col("tokens")).alias("tokens"), "is_new", F.when(F.col("start").isNull(), 0).otherwise(1).cast("long").alias("generation"))


def stale(surface: DataFrame, measured: DataFrame) -> DataFrame:
    """Sessions whose measurement (session, pos, seq) isn't of the surface as it stands."""
    a, b = surface.select("session", "pos", F.col("seq").alias("a")), measured.select("session", "pos", F.col("seq").alias("b"))
    return a.join(b, ["session", "pos"], "full").groupBy("session").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("stale"))


def span_keys(surface: DataFrame, spans: DataFrame, policy: str) -> DataFrame:
    """What identifies a session's span for repeated attempts: a digest of its places, prices and policy. A span's places meet in one row."""
    rows = surface.join(spans.select("session", "start", "end"), "session").filter(F.col("pos").between(F.col("start"), F.col("end")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: F.concat_ws(":", x["pos"], x["tokens"])), ",")
    return rows.groupBy("session").agg(F.sha2(F.concat(F.lit(policy + "|"), listed), 256).alias("key"))
