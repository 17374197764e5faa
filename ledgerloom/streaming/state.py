"""Hysteresis, replay control, the pressure machine and signed events over append-only streams, each with its batch twin."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.policy import DECISION, STATE, Limits, State, decisions, stored
from ledgerloom.operators.store import TEMP_AGE, sweep_temps
from ledgerloom.operators.windows import with_carried


def hysteresis(events: DataFrame, start: float, release: float) -> DataFrame:
    """Whether each event finds its key's pressure on: it turns on at `start`, and off below `release`. The last event outside the band decides. For batches; `pressure_stream` is the machine over streams.

    A task holds one key's hour; of its other hours, the last mark.
    """
    mark = F.when(F.col("value") >= start, True).when(F.col("value") < release, False)
    rows = events.select("event_id", "user_id", "ts", mark.alias("mark"), F.date_trunc("hour", "ts").alias("hour"))
    last = F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("ts", "event_id")))
    rows = with_carried(rows, "user_id", "hour", last, lambda s, w: F.last(s, ignorenulls=True).over(w))
    order = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("event_id", "user_id", F.coalesce(F.last("mark", ignorenulls=True).over(order), "carried", F.lit(False)).alias("active"))


def pressure_stream(measured: DataFrame, limits: Limits) -> DataFrame:
    """The pressure machine's decisions over a stream of measurements, a state for each session. `ledgerloom.operators.policy.pressure_log` decides the same over a batch; a session's rows must arrive in order of their events, over micro-batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        none = lambda v: None if v is None or v != v else v
        state = State(*map(none, held.get)) if held.exists else State()
        rows = pd.concat(list(frames), ignore_index=True)
        out = decisions(state, rows, limits)
        held.update(stored(state))
        yield out

    return measured.groupBy("session").applyInPandasWithState(run, DECISION, STATE, "append", "NoTimeout")


def replay_guard(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first delivery of each (user, event); on a stream the state is dropped behind the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])
    return events.dropDuplicates(["user_id", "event_id"])


def admitted(deliveries: DataFrame, window: int) -> DataFrame:
    """Whether each delivery (key, n: order of arrival, id, stamp, now) is admitted: its id must not have been admitted at a stamp that is at most `window` seconds before now.

    A delivery that is refused doesn't renew the id, so an id's deliveries are decided one after another: a task reads them in order, batch by batch, and holds one stamp.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            ok = []
            for key, i, stamp, now in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "stamp", "now")), strict=True):
                if held != (key, i):
                    held, at = (key, i), None
                ok.append(at is None or (now is not None and now - at > window))
                at = stamp if ok[-1] else at
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "n")), pa.array(ok, pa.bool_())], ["key", "id", "n", "admitted"])

    rows = deliveries.select("key", "id", F.col("n").cast("long").alias("n"), F.col("stamp").cast("double").alias("stamp"), F.col("now").cast("double").alias("now"))
    kinds = dict(rows.dtypes)
    return rows.repartition("key", "id").sortWithinPartitions("key", "id", "n").mapInArrow(run, f"key {kinds['key']}, id {kinds['id']}, n long, admitted boolean")


def mac(text: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text's bytes in hex, as two digests over the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def signed_text() -> Column:
    """What an event's signature covers: its id and time stamp, each led by its length, and its body."""
    return F.concat(F.length("event_id"), F.lit(":"), "event_id", F.lit("."), F.length("stamp"), F.lit(":"), "stamp", F.lit("."), "body")


def verified(events: DataFrame, secret: str, now: int, skew: int = 300) -> DataFrame:
    """event_id and why a signed event (event_id, stamp, signature, body: strings) is refused: stale_timestamp (late or ahead), malformed_signature, bad_signature; null if it is good. Batches and streams alike.

    An empty secret, and a null in what is signed, refuse every signature.
    """
    number = F.when(F.trim("stamp") == "", F.lit(0.0)).otherwise(F.col("stamp").try_cast("double"))
    well = F.coalesce(F.col("signature").rlike(r"\Av1=[0-9A-Fa-f]{64}\z"), F.lit(False))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    good = F.coalesce(F.lower(F.substring("signature", 4, 64)) == mac(signed_text(), secret), F.lit(False))
    reason = F.when(F.lit(secret == ""), "bad_signature").when(~finite, "malformed_signature").when(F.abs(F.lit(now) - number) > skew, "stale_timestamp").when(~well, "malformed_signature").when(~good, "bad_signature")
    return events.select("event_id", reason.alias("reason"))


def pressure_windows(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their summed value for each user and time window; late events are dropped behind the watermark on a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "user_id", "n", "total")


def current(responses: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Responses (session, generation, ...) to the surface as it is still; those that it has moved on from go."""
    now = surfaces.select("session", F.col("generation").alias("now"))
    return responses.join(now, "session").filter(F.col("generation") == F.col("now")).drop("now")


def sweep_on_timer(spark: SparkSession, root: str, every: str = "61 minutes", least: int = TEMP_AGE, seen: list | None = None) -> StreamingQuery:
    """A query that sweeps a store's stale temporary files at each turn of a processing-time timer, until it is stopped; `seen` gets each turn's files and bytes."""

    def run(ticks: DataFrame, _: int) -> None:
        done = sweep_temps(ticks.sparkSession, root, int(time.time() * 1000), least)
        if seen is not None:
            seen.append(done)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).foreachBatch(run).start()
