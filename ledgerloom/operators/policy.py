"""Budgets, cooldowns and passes of the pressure policy, as columns, and its state machine, as a fold over a session's measurements.

The machine is one function from a state and a measurement to a state and a decision; `pressure_log` runs it over a session's rows in batch, and
`ledgerloom.streaming.state.pressure_stream` over a stream, so both decide alike.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Policy:
    """Settings of the policy; the defaults are the base profile's. Every setting is checked when the policy is made."""

    threshold_ratio: float = 0.8
    retain_ratio: float = 0.16
    retain_tokens: int | None = None
    max_tokens: int = 8192
    release_ratio: float = 0.6
    cooldown_events: int = 24
    cooldown_turns: int = 1
    max_passes: int = 2
    min_compact_tokens: int = 4096
    absorb_floor: float = 0.75
    output_reserve: float | None = None
    max_input_tokens: int = 0
    anchor_tokens: int = 1024
    anchor_share: float = 0.25
    kinds: tuple[str, ...] = ("errors", "tests", "files", "artifacts", "commands", "user_pins", "deliverables")
    local_providers: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name in ("threshold_ratio", "retain_ratio", "release_ratio", "anchor_share"):
            _check(0 < getattr(self, name) < 1, f"{name} must lie between 0 and 1")
        _check(0 < self.absorb_floor <= 1, "absorb_floor must lie above 0 and be at most 1")
        for name in ("max_tokens", "max_passes", "min_compact_tokens", "anchor_tokens"):
            _check(isinstance(getattr(self, name), int) and getattr(self, name) > 0, f"{name} must be a positive whole number")
        for name in ("cooldown_events", "cooldown_turns", "max_input_tokens"):
            _check(isinstance(getattr(self, name), int) and getattr(self, name) >= 0, f"{name} must be a whole number, 0 or more")
        _check(self.release_ratio < self.threshold_ratio, "release_ratio must lie below threshold_ratio")
        _check(self.output_reserve is None or self.output_reserve > 0, "output_reserve must be a share or a positive number")
        _check(set(self.kinds) <= set(Policy.__dataclass_fields__["kinds"].default), "kinds holds an unknown kind")
        _check(all(isinstance(p, str) and p for p in self.local_providers), "local_providers must be names that are not empty")


#: Named profiles over the base.
PROFILES = {
    "base": Policy(),
    "cloud-l": Policy(threshold_ratio=0.72, retain_ratio=0.14, release_ratio=0.55, cooldown_events=32, min_compact_tokens=8192, anchor_tokens=2048),
    "local-4090": Policy(threshold_ratio=0.78, retain_ratio=0.22, max_tokens=4096, release_ratio=0.62, output_reserve=12288, anchor_tokens=768),
}


@dataclass(frozen=True)
class StoreSettings:
    """Settings of the artifact store, checked when made."""

    max_artifact_bytes: int = 64 << 20
    max_total_bytes: int = 8 << 30
    retention_days: int = 30
    chunk_lines: int = 120
    chunk_overlap: int = 20
    default_label: str = "internal"
    max_read_bytes: int = 32 << 10
    tenant: str = "default"

    def __post_init__(self) -> None:
        for name in ("max_artifact_bytes", "max_total_bytes", "chunk_lines", "max_read_bytes"):
            _check(getattr(self, name) > 0, f"{name} must be positive")
        _check(self.retention_days >= 0 and 0 <= self.chunk_overlap < self.chunk_lines, "retention_days must be 0 or more, chunk_overlap below chunk_lines")
        _check(self.max_total_bytes >= self.max_artifact_bytes, "max_total_bytes must hold one artifact")
        _check(self.default_label in ("public", "internal", "confidential", "secret"), "default_label is unknown")


def resolved(grid: DataFrame) -> DataFrame:
    """The budgets of each setting: window, ratio, retain_ratio, release_ratio, max_tokens, reserve (null, a share or a number), default_max (nullable), requested, max_input.

    status says why a setting is refused; the budgets stand beside it.
    """
    whole = lambda c: F.floor(c).cast("long")
    c = F.col
    derived = F.greatest(c("window") * F.lit(0.05), c("max_tokens") * F.lit(2.0))
    derived = whole(F.when(c("default_max").isNull(), derived).otherwise(F.least(c("default_max").cast("double"), derived)))
    scaled = F.when(c("reserve") < 1, whole(c("window") * c("reserve"))).otherwise(c("reserve").cast("long"))
    out = grid.withColumn("output_reserve", F.greatest(F.coalesce(scaled, derived), c("requested"))).withColumn("wanted", whole(c("window") * c("ratio"))).withColumn("retain", whole(c("window") * c("retain_ratio")))
    out = out.withColumn("usable", F.least(c("window") - c("output_reserve"), F.when(c("max_input") > 0, c("max_input")).otherwise(F.lit(2**62)))).withColumn("threshold", F.least("wanted", "usable"))
    release = F.when(c("threshold") == c("wanted"), whole(c("window") * c("release_ratio"))).otherwise(whole(c("threshold") * c("release_ratio") / c("ratio")))
    status = F.when(c("retain") >= c("threshold"), "retain above threshold").when(c("output_reserve") >= c("window"), "reserve above window").otherwise("ok")
    return out.select("window", "ratio", "requested", "max_input", "reserve", "output_reserve", "usable", "threshold", release.alias("release"), "retain", status.alias("status"))


def infeasible(surface: DataFrame, usable: int) -> DataFrame:
    """Sessions whose system messages alone fill the usable input."""
    fixed = surface.groupBy("session").agg(F.coalesce(F.sum(F.when(F.col("role") == "system", F.col("tokens"))), F.lit(0)).cast("long").alias("fixed"))
    return fixed.withColumn("infeasible", F.col("fixed") >= usable)


@dataclass
class State:
    """What the machine keeps for a session: the mark of the last condensation, the passes of the current step, and the last key that saved too little."""

    mark_event: int | None = None
    mark_turn: int | None = None
    turn: int | None = None
    step: int | None = None
    passes: int = 0
    key: str | None = None
    failures: int = 0


@dataclass(frozen=True)
class Limits:
    threshold: float
    release: float
    cooldown_events: int = 24
    cooldown_turns: int = 1
    max_passes: int = 2


STATE = "mark_event long, mark_turn long, turn long, step long, passes long, key string, failures long"
DECISION = "session long, event long, action string, passes long, left double"


def decide(state: State, event: int, turn: int, step: int, total: float, saving: float, failed: str | None, key: str | None, limits: Limits) -> tuple[str, float]:
    """Steps the machine over one measurement and says what happens and what pressure is left; `state` becomes the next state.

    total: tokens now; saving: tokens that one pass takes off; failed: null, or why passes fail ('low-savings', 'busy', any other); key: what identifies the span.
    """
    if total < limits.threshold:
        return "below", total
    if state.mark_event is not None and not (event - state.mark_event >= limits.cooldown_events and turn - state.mark_turn >= limits.cooldown_turns):
        return "cooldown", total
    if (state.turn, state.step) != (turn, step):
        state.turn, state.step, state.passes = turn, step, 0
    done = 0
    while state.passes < limits.max_passes:
        if key is not None and state.key == key and state.failures >= 2:
            return ("suppressed" if not done else "condensed"), total
        state.passes += 1
        if failed is not None:
            if key is not None and failed == "low-savings":
                state.failures = min(2, (state.failures if state.key == key else 0) + 1)
                state.key = key
            elif failed != "busy":
                state.key, state.failures = None, 0
            state.mark_event, state.mark_turn = event, turn
            return "failed", total
        state.key, state.failures, done = None, 0, done + 1
        total -= saving
        if total < limits.release:
            state.mark_event, state.mark_turn = event, turn
            return "released", total
    if done:
        state.mark_event, state.mark_turn = event, turn
    return "exhausted", total


def decisions(state: State, rows: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """The machine over a session's rows (session, event, turn, step, total, saving, failed, key), in order of their events."""
    out = []
    for r in rows.sort_values("event").itertuples():
        text = lambda v: v if isinstance(v, str) else None
        action, left = decide(state, int(r.event), int(r.turn), int(r.step), float(r.total), float(r.saving), text(r.failed), text(r.key), limits)
        out.append((int(r.session), int(r.event), action, state.passes, left))
    return pd.DataFrame(out, columns=[x.split(" ")[0] for x in DECISION.split(", ")])


def stored(state: State) -> tuple:
    return tuple(asdict(state).values())


def pressure_log(measured: DataFrame, limits: Limits) -> DataFrame:
    """The machine's decision at each measurement. A session's measurements meet in one task."""
    return measured.groupBy("session").applyInPandas(lambda rows: decisions(State(), rows, limits), DECISION)


def pass_budget(steps: DataFrame, most: int) -> DataFrame:
    """Passes that are left in a step (session, turn, step) before each of its passes."""
    before = Window.partitionBy("session", "turn", "step").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("session", "event", F.greatest(F.lit(0).cast("long"), F.lit(most) - F.count("*").over(before)).alias("left"))


def cooled(steps: DataFrame, events: int, turns: int) -> DataFrame:
    """Whether each step is far enough, in events and in turns, from the one before it in its session; the first always is."""
    order = Window.partitionBy("session").orderBy("event")
    far = (F.col("event") - F.lag("event").over(order) >= events) & (F.col("turn") - F.lag("turn").over(order) >= turns)
    return steps.select("session", "event", "turn", F.coalesce(far, F.lit(True)).alias("passed"))
