"""Condensed sessions: exact anchors, checkpoints, and summary documents, one session or document a call of `ledgerloom.functions.condense`.

A session's messages meet in one task, as its log does; documents are handled row by row in Arrow batches.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import condense as C
from ledgerloom.operators import messages as M

ANCHORS = "session long, disposition string, kind string, text string, seq long, source_order long, pointer string, is_stub boolean, pending boolean"
CHECKPOINT = "session long, body string, overflow string, invented long, last_answer long, kept long, left long"


def _span(found: DataFrame) -> DataFrame:
    return found.select("session", "pos", "seq", M.text_of(F.col("content")).alias("text"), M.is_human().alias("human"), M.is_checkpoint().alias("checkpoint"), M.is_delivered().alias("delivered"))


def _messages(rows: pa.Table) -> list[C.Message]:
    return [C.Message(r["seq"], r["text"] or "", r["human"], r["checkpoint"], r["delivered"]) for r in rows.sort_by("pos").to_pylist()]


def _by_session(span: DataFrame, schema: str, of: Callable[[int, list[C.Message]], list[tuple]]) -> DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        out = of(rows.column("session")[0].as_py(), _messages(rows))
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return span.groupBy("session").applyInArrow(run, schema)


def extracted(found: DataFrame, budget: int, quota: int = 24, longest: int = 320, known: set[str] | None = None) -> DataFrame:
    """The anchors of each session's messages, kept or in the overflow."""

    def of(session: int, span: list[C.Message]) -> list[tuple]:
        x = C.extract(span, budget, quota, longest, known)
        return [(session, d, a.kind, a.text, a.seq, a.order, a.pointer, a.stub, C.is_pending(a, x.last_answer)) for d, group in (("kept", x.kept), ("overflow", x.overflow)) for a in group]

    return _by_session(_span(found), ANCHORS, of)


def carried_forward(found: DataFrame) -> DataFrame:
    """The anchors that checkpoints hand on."""

    def of(session: int, span: list[C.Message]) -> list[tuple]:
        return [(session, "carried", a.kind, a.text, a.seq, i, a.pointer, a.stub, a.pending) for m in span if m.checkpoint for i, a in enumerate(C.carried(m.text, m.seq) or [])]

    return _by_session(_span(found), ANCHORS, of)


def items(found: DataFrame) -> DataFrame:
    """The work items of human messages, with their further lines."""

    def of(session: int, span: list[C.Message]) -> list[tuple]:
        return [(session, m.seq, x) for m in span if m.human for x in C.deliverables(m.text)]

    return _by_session(_span(found), "session long, seq long, text string", of)


def checkpoints(found: DataFrame, budget: int, quota: int = 24, longest: int = 320, share: float = 0.25) -> DataFrame:
    """The body that stands for each session without a document: its anchors within a share of its tokens and the budget, and the rest as an overflow."""
    empty = C.parse('{"schema_version": 1, "task_state": {}}')

    def of(session: int, span: list[C.Message]) -> list[tuple]:
        tokens = sum(-(-len(m.text) // 4) for m in span)
        x = C.extract(span, max(0, min(budget, int(tokens * share))), quota, longest)
        return [(session, C.render_summary(empty, x, compact=True), C.render_overflow(x), x.invented, x.last_answer, len(x.kept), len(x.overflow))]

    return _by_session(_span(found), CHECKPOINT, of)


def _rows(docs: DataFrame, schema: str, of: Callable[[str], tuple]) -> DataFrame:
    """doc_id and of(text) for each row."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(x or "") for x in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(columns, schema.split(", "), strict=True)]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def parsed(docs: DataFrame, flat: bool = False, version: int = 1) -> DataFrame:
    """Documents read from texts: JSON in canonical form and whether they say anything, or why they are refused."""

    def of(text: str) -> tuple:
        try:
            doc = (C.parse_flat if flat else C.parse)(text, version)
        except C.Refused as e:
            return None, None, str(e)
        return C.canonical(doc), C.has_content(doc), None

    return _rows(docs, "document string, has_content boolean, refused string", of)


def repaired(docs: DataFrame, version: int = 1) -> DataFrame:
    def of(text: str) -> tuple:
        out, done = C.repair(text, version)
        return out, ",".join(done)

    return _rows(docs, "repaired string, repairs string", of)


def grounded(docs: DataFrame, outputs: list[str], version: int = 1) -> DataFrame:
    """How many files of each readable document quote tool output, and how many do so word for word."""

    def of(text: str) -> tuple:
        try:
            doc = C.parse(text, version)
        except C.Refused:
            return None, None
        quoted = lambda d: sum(x["artifact"] is not None for x in d["files"])
        return quoted(doc), quoted(C.ground(doc, outputs))

    return _rows(docs, "quoted long, grounded long", of)


def summaries(docs: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """Each session's checkpoint from its document (doc_id = session, text), or from its words where that can't be read."""
    texts = docs.select(F.col("doc_id").alias("session"), F.col("text").alias("summary"))
    joined = _span(found).join(texts, "session", "left")

    def run(rows: pa.Table) -> pa.Table:
        x = C.extract(_messages(rows.drop_columns(["summary"])), budget)
        text = rows.column("summary")[0].as_py() or ""
        try:
            body, read = C.render_summary(C.parse(text), x), True
        except C.Refused:
            body, read = C.prose(text, x), False
        return pa.table([pa.array([rows.column("session")[0].as_py()], pa.int64()), pa.array([f"{C.PREAMBLE}\n\n<summary>\n{body}\n</summary>"]), pa.array([read])], ["session", "checkpoint", "read"])

    return joined.groupBy("session").applyInArrow(run, "session long, checkpoint string, read boolean")


def canonical(docs: DataFrame) -> DataFrame:
    """JSON texts in canonical form, with their SHA-256."""
    shown = _rows(docs, "canonical string", lambda text: (C.canonical(json.loads(text)),))
    return shown.withColumn("sha256", F.sha2("canonical", 256))


def usage(parts: DataFrame) -> DataFrame:
    """Summed counters of each session's requests; one that no request has stays absent."""
    return parts.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "reasoning")])


def redacted_blocks(found: DataFrame) -> DataFrame:
    """Messages as many blocks as before, without credentials: session, pos, ix, type, text. Runs of one type are redacted together, calls' arguments and tool output by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for session, pos, content in zip(*(batch.column(c).to_pylist() for c in ("session", "pos", "content")), strict=True):
                alike = lambda b: b["type"] if b["type"] in M.VISIBLE else b["ix"]
                for kind, group in itertools.groupby(content, alike):
                    group = list(group)
                    texts = [b["text"] or "" for b in group]
                    done = C.redacted_run(texts) if kind in M.VISIBLE else [t if b["type"] == "image" else C.redacted_text(t)[0] for b, t in zip(group, texts, strict=True)]
                    rows += [(session, pos, b["ix"], b["type"], t) for b, t in zip(group, done, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)], ["session", "pos", "ix", "type", "text"])

    return found.select("session", "pos", "content").mapInArrow(run, "session long, pos long, ix long, type string, text string")


def redacted_json(docs: DataFrame) -> DataFrame:
    """JSON texts with every string leaf redacted, in canonical form, and whether that changed one."""

    def of(text: str) -> tuple:
        value = json.loads(text)
        done = C.redacted_leaves(value)
        return C.canonical(done), done != value

    return _rows(docs, "json string, changed boolean", of)


def holding(docs: DataFrame, mark: str) -> DataFrame:
    """Whether a JSON text holds a mark in a string or over adjacent blocks."""
    return _rows(docs, "collision boolean", lambda text: (C.holds(json.loads(text), mark),))
