"""Messages of typed blocks: text of a message, provenance, wire form, look-ups in the log, and redaction over runs of blocks.

A block has ix, type, block_call and text; a message has session, pos, seq, role, source, call_id, is_error and its blocks in order. The text of
a tool-result block is that of its inner blocks; of a tool-call block, its arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import token_estimate
from ledgerloom.operators.redaction import redact, replace_each
from ledgerloom.sources.log import HEADING

CHECKPOINT = "compact-checkpoint"
KEYS = ("session", "pos", "seq", "role", "source", "call_id", "is_error")
VISIBLE = ("text", "reasoning")


def messages(blocks: DataFrame) -> DataFrame:
    """One row a message, its blocks as an array; a message's few blocks meet in one row."""
    return blocks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ix", "type", "block_call", "text"))).alias("content"))


def _runs(content: Column, same) -> Column:
    """The blocks in runs: a block joins the run before it if same(last block of it, block)."""
    start = F.filter(F.sequence(F.lit(0), F.size(content) - 1), lambda i: (i == 0) | ~same(F.get(content, i - 1), F.get(content, i)))
    return F.transform(start, lambda i, k: F.slice(content, i + 1, F.coalesce(F.get(start, k + 1), F.size(content)) - i))


def _visible(b: Column) -> Column:
    return b["type"].isin(*VISIBLE)


def _joined(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda b: b["text"]), "")


def text_of(content: Column) -> Column:
    """Adjacent text and reasoning without separator; a tool result, and what stands on either side of another block, in lines of their own."""
    runs = _runs(content, lambda a, b: _visible(a) & _visible(b))
    shown = F.filter(runs, lambda r: _visible(r[0]) | (r[0]["type"] == "tool-result"))
    return F.array_join(F.transform(shown, _joined), "\n")


def is_tool_output() -> Column:
    """Whether the message carries tool output in one of its two forms; the native one names the call in its source and in its one block."""
    one = F.get("content", F.lit(0))
    native = (F.col("role") == "user") & (F.col("source") == "tool") & (F.col("call_id") != "") & (F.size("content") == 1) & (one["type"] == "tool-result") & (one["block_call"] == F.col("call_id"))
    return (F.col("role") == "tool") | F.coalesce(native, F.lit(False))


def is_human() -> Column:
    return F.coalesce((F.col("role") == "user") & (F.col("source") == "user"), F.lit(False))


def is_checkpoint() -> Column:
    return F.coalesce((F.col("role") == "user") & (F.col("source") == CHECKPOINT), F.lit(False))


def is_delivered() -> Column:
    """An answer: of the assistant, with text that is seen, and without a call."""
    return (F.col("role") == "assistant") & F.exists("content", lambda b: (b["type"] == "text") & b["text"].rlike(r"\S")) & ~F.exists("content", lambda b: b["type"] == "tool-call")


def profile(found: DataFrame) -> DataFrame:
    """The text of each message and what it is."""
    return found.select("session", "pos", text_of(F.col("content")).alias("text"), is_tool_output().alias("tool_output"), is_human().alias("human"), is_checkpoint().alias("checkpoint"), is_delivered().alias("delivered"))


def _wire(b: Column) -> Column:
    error = F.when(F.col("is_error"), " (error)").otherwise("")
    called = F.concat(F.lit("[tool call "), b["block_call"], F.lit(": run] "), b["text"])
    result = F.concat(F.lit("[tool result "), b["block_call"], error, F.lit("] "), b["text"])
    return F.when(_visible(b), F.when(b["text"] != "", b["text"])).when(b["type"] == "tool-call", called).when(b["type"] == "tool-result", result)


def surface_nodes(found: DataFrame) -> DataFrame:
    """Messages as they go over the wire: tool output under the role tool, blocks as texts, empty texts and images left out, and the first result's call."""
    role = F.when((F.col("role") == "user") & F.col("source").eqNullSafe("tool"), "tool").otherwise(F.col("role"))
    first = F.get(F.transform(F.filter("content", lambda b: b["type"] == "tool-result"), lambda b: b["block_call"]), F.lit(0))
    wire = F.array_compact(F.transform("content", _wire))
    return found.select("session", "seq", role.alias("role"), F.array_join(wire, "\u0001").alias("content"), F.size(wire).cast("long").alias("n_blocks"), first.alias("tool_call_id"))


def priced(found: DataFrame) -> DataFrame:
    """A session's messages as a priced surface: session, pos (dense from 0), tokens, is_checkpoint, has_system, open_calls and balanced (no call before the place lacks its result).

    A call ends with the first later tool output of its id; without one it stays open. An id that a message calls twice is one call.
    """
    calls = found.select("session", "pos", F.explode(F.array_distinct(F.transform(F.filter("content", lambda b: b["type"] == "tool-call"), lambda b: b["block_call"]))).alias("call"))
    answers = found.filter(is_tool_output()).select("session", F.col("call_id").alias("call"), F.col("pos").alias("at"))
    pairs = calls.join(answers, ["session", "call"], "left").groupBy("session", "call", "pos").agg(F.min(F.when(F.col("at") > F.col("pos"), F.col("at"))).alias("at"))
    steps = pairs.select("session", F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("at").alias("pos"), F.lit(-1).alias("d")))).alias("s")).select("session", "s.pos", "s.d").filter("pos is not null")
    rows = found.select("session", "pos", token_estimate(text_of(F.col("content"))).alias("tokens"), is_checkpoint().alias("is_checkpoint"), (F.col("role") == "system").alias("system"))
    rows = rows.join(steps.groupBy("session", "pos").agg(F.sum("d").alias("d")), ["session", "pos"], "left")
    order = Window.partitionBy("session").orderBy("pos")
    open_calls = F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.select("session", (F.row_number().over(order) - 1).cast("long").alias("pos"), "tokens", "is_checkpoint", F.first("system").over(order).alias("has_system"), open_calls.alias("open_calls"))
    return rows.withColumn("balanced", F.col("open_calls") == 0)


def aligned(surface: DataFrame, found: DataFrame) -> DataFrame:
    """A surface (session, pos, seq) with its messages; seqs that the log doesn't know go."""
    return surface.select("session", "pos", "seq").join(found.drop("pos"), ["session", "seq"])


def shadowed(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Messages within the span (session, start, end) that their session replaces; those of a session without a span all, under the seq -1."""
    rows = found.join(spans.select("session", "start", "end"), "session", "left")
    return rows.filter(F.col("start").isNull() | F.col("pos").between(F.col("start"), F.col("end"))).withColumn("seq", F.when(F.col("start").isNull(), F.lit(-1).cast("long")).otherwise(F.col("seq"))).drop("start", "end")


def neutral(text: Column) -> Column:
    """A text in which no line opens with the trusted heading."""
    return F.regexp_replace(text, rf"(?m)^\Q{HEADING}\E", "the Anchors section")


def neutralized(found: DataFrame) -> DataFrame:
    """Messages whose runs of text hold no trusted heading, also where one is cut over blocks; a run that changes becomes one block."""
    runs = _runs(F.col("content"), lambda a, b: _visible(a) & _visible(b))
    done = F.transform(runs, lambda r: F.when(_visible(r[0]) & (neutral(_joined(r)) != _joined(r)), F.array(neutral(_joined(r)))).otherwise(F.transform(r, lambda b: F.coalesce(b["text"], F.lit("")))))
    flat = F.flatten(done)
    return found.select("session", "pos", F.array_join(flat, "").alias("text"), F.size(flat).cast("long").alias("n_blocks"))


def _hits(before: Column, after: Column) -> Column:
    return after != before


def redacted_runs(found: DataFrame, alike: tuple[tuple[str, ...], ...] = (("text",), ("reasoning",))) -> DataFrame:
    """Messages with credentials taken out of runs of blocks, so that one cut over two blocks is caught; a run that changes collapses into its first block.

    alike: the types that make up one run each; other blocks, and a call's arguments, are redacted by themselves, images not at all.
    """
    group = lambda b: sum((F.when(b["type"].isin(*g), i + 1).otherwise(0) for i, g in enumerate(alike)), F.lit(0))
    runs = _runs(F.col("content"), lambda a, b: (group(a) > 0) & (group(a) == group(b)))
    pairs = F.transform(runs, lambda r: F.struct(_joined(r).alias("before"), r.alias("run")))
    done = F.transform(pairs, lambda p: F.struct(p["before"].alias("before"), F.when(p["run"][0]["type"] == "image", p["before"]).otherwise(redact(p["before"])).alias("after"), p["run"].alias("run")))
    kept = lambda p: F.when(_hits(p["before"], p["after"]), F.array(F.struct(p["run"][0]["type"].alias("type"), p["after"].alias("text")))).otherwise(F.transform(p["run"], lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))))
    out = found.select("session", "pos", done.alias("d"))
    return out.select("session", "pos", F.flatten(F.transform("d", kept)).alias("blocks"), F.exists("d", lambda p: _hits(p["before"], p["after"])).alias("changed"))


def from_wire(wire: DataFrame, visible: DataFrame) -> DataFrame:
    """Wire blocks (doc_id, ix, type, text, sha256) as texts: text and code as they are, references as addresses; addresses without a claim in `visible` give way."""
    from ledgerloom.operators.artifacts import UNRESOLVABLE

    body = F.when(F.col("type").isin("text", "code"), F.coalesce("text", F.lit(""))).when(F.col("type").isin("artifact_ref", "image_ref"), F.concat(F.lit("artifact://sha256/"), F.coalesce("sha256", F.lit(""))))
    rows = wire.select("doc_id", "ix", body.alias("text")).filter("text is not null")
    cited = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("artifact://sha256/([0-9a-f]{64})"), 1))).alias("sha256"), "doc_id", "ix")
    known = cited.join(visible.select("sha256").distinct(), "sha256", "left_semi").groupBy("doc_id", "ix").agg(F.collect_set("sha256").alias("known"))
    keep = lambda m: F.when(F.array_contains(F.coalesce("known", F.array().cast("array<string>")), F.substring(m, 19, 64)), m).otherwise(UNRESOLVABLE)
    return rows.join(known, ["doc_id", "ix"], "left").select("doc_id", "ix", replace_each(F.col("text"), "artifact://sha256/[0-9a-f]{64}", keep).alias("text"))


def at(events: DataFrame, seq: int) -> DataFrame:
    """Each session's event of one seq."""
    return events.filter(F.col("seq") == seq)


def clocks(events: DataFrame) -> DataFrame:
    """Each session's current turn and step (0 before the first), whether a turn is open, and the provider and model of the current request, null if either is empty."""
    of = lambda kind, value: F.max_by(F.when(F.col("type") == kind, F.col(value)), F.when(F.col("type") == kind, F.col("seq")))
    edge = F.col("type").isin("turn/start", "turn/end")
    per = events.groupBy("session").agg(
        F.coalesce(of("turn/start", "turn"), F.lit(0)).alias("turn"), F.coalesce(of("step/start", "step"), F.lit(0)).alias("step"), F.coalesce(F.max_by(F.when(edge, F.col("type")), F.when(edge, F.col("seq"))) == "turn/start", F.lit(False)).alias("open_turn"),
        of("request/header", "provider").alias("p"), of("request/header", "model").alias("m"),
    )
    full = (F.col("p") != "") & (F.col("m") != "")
    return per.select("session", "turn", "step", "open_turn", F.when(full, F.col("p")).alias("provider"), F.when(full, F.col("m")).alias("model"))
