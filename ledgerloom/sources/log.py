"""The session log as relations: events, and messages of typed blocks, made from `conversations` by SQL that both engines read.

The tables hold plain turns only. What a log has besides (tool results in both forms, checkpoints, images, reasoning, calls, messages without a
source, malformed call ids) is made of each row's ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import table

# Fixed value: the heading of the block of machine-extracted lines.
HEADING = "## Anchors (verbatim, machine-extracted — do not paraphrase)"
_NL = "chr(10)"
_CHECKPOINT = f"""concat('{HEADING}', {_NL}, '- file: src/a', CAST(conv_id % 3 AS STRING), '.py', {_NL}, '- deliverable: Q1: first', chr(92), 'nsecond', {_NL}, '- deliverable_ref_pending: Q2 (full text: artifact://sha256/', repeat('ab', 32), ')',
 {_NL}, '- test: 3 passed', {_NL}, '- unknown: x', {_NL}, '## Next', {_NL}, '- file: not/this.py')"""
_HUMAN = f"""concat('  must: keep ', CAST(turn AS STRING), {_NL}, 'Q', CAST(turn + 1 AS STRING), ': item', {_NL}, 'and its second line', {_NL}, '必須 keep the order', {_NL}, 'never drop rows?', {_NL}, 'see src/m', CAST(conv_id % 7 AS STRING), '.py:', CAST(turn + 1 AS STRING),
 ' of artifact://sha256/', repeat(CASE conv_id % 2 WHEN 0 THEN 'cd' ELSE 'ab' END, 32))"""
_TAIL = f"""concat(CASE conv_id % 2 WHEN 0 THEN '' ELSE concat(repeat('b2', 6), {_NL}) END, '  $ run ', CAST(turn % 2 AS STRING), {_NL}, 'ValueError: failed ', CAST(turn AS STRING), {_NL}, '2 passed', {_NL}, 'sk-', repeat('a1', 5))"""
_PAYLOAD = f"""concat('payload ', CAST(conv_id % 3 AS STRING), {_NL}, repeat(concat('the same line of output', {_NL}), CAST(3 + turn % 4 AS INT)), repeat('x', CAST(100 + conv_id % 5 * 200 AS INT)))"""

BLOCKS = f"""SELECT * FROM (
 SELECT conv_id AS session, turn AS pos, turn * 10 + 3 AS seq, CAST(k.ix AS BIGINT) AS ix, CASE WHEN role = 'user' AND f = 1 THEN 'tool' ELSE role END AS role,
  CASE WHEN role <> 'user' THEN role WHEN f < 2 THEN 'tool' WHEN f = 2 THEN 'compact-checkpoint' WHEN f = 3 THEN CAST(NULL AS STRING) ELSE 'user' END AS source,
  CASE WHEN role = 'user' AND f < 2 THEN concat('c', CAST(turn AS STRING)) END AS call_id, CASE WHEN role = 'user' AND f < 2 THEN conv_id % 4 = 0 END AS is_error,
  CASE WHEN role = 'system' THEN CASE WHEN ix = 0 THEN 'text' END WHEN role = 'assistant' THEN CASE (f + 1) % 3 WHEN 0 THEN CASE ix WHEN 0 THEN 'reasoning' WHEN 1 THEN 'text' END WHEN 1 THEN CASE ix WHEN 0 THEN 'text' WHEN 1 THEN 'tool-call' END ELSE CASE WHEN ix = 0 THEN 'reasoning' END END
   WHEN f = 0 THEN CASE WHEN ix = 0 THEN 'tool-result' END WHEN f = 1 THEN CASE WHEN ix < 2 THEN 'text' END WHEN f = 2 THEN CASE WHEN ix = 0 THEN 'text' END WHEN ix = 1 AND conv_id % 2 = 0 THEN 'image' ELSE 'text' END AS type,
  CASE WHEN role = 'assistant' AND ix = 1 AND (f + 1) % 3 = 1 THEN concat('c', CAST(turn + 1 AS STRING)) WHEN role = 'user' AND f = 0 THEN CASE WHEN conv_id % 5 = 0 THEN 'other' ELSE concat('c', CAST(turn AS STRING)) END END AS block_call,
  CASE WHEN role = 'system' THEN 'system rules' WHEN role = 'assistant' THEN CASE WHEN (f + 1) % 3 = 1 AND ix = 1 THEN concat('{{"n":', CAST(turn AS STRING), '}}') WHEN (f + 1) % 3 = 0 AND ix = 1 AND conv_id % 4 = 0 THEN '  ' ELSE concat('answer of Q', CAST(turn AS STRING), CASE WHEN ix = 0 THEN ' thought' ELSE ' said' END) END
   WHEN f = 0 THEN {_PAYLOAD} WHEN f = 1 THEN CASE WHEN ix = 0 THEN {_PAYLOAD} ELSE 'more' END WHEN f = 2 THEN {_CHECKPOINT} WHEN ix = 0 THEN {_HUMAN} WHEN ix = 1 THEN CASE WHEN conv_id % 2 = 0 THEN '' ELSE concat({_NL}, 'sk-', repeat('a1', 6)) END ELSE {_TAIL} END AS text
 FROM (SELECT conv_id, turn, role, (conv_id + turn) % 7 AS f FROM {{conversations}}) c CROSS JOIN (VALUES (0), (1), (2)) AS k(ix)) b WHERE type IS NOT NULL"""

EVENTS = """SELECT * FROM (
 SELECT conv_id AS session, turn * 10 + CAST(k.ix AS BIGINT) AS seq, CASE k.ix WHEN 0 THEN CASE WHEN role = 'user' THEN 'turn/start' END WHEN 1 THEN 'request/header' WHEN 2 THEN CASE WHEN role = 'assistant' THEN 'step/start' END WHEN 3 THEN concat(role, '/message') ELSE CASE WHEN role = 'assistant' AND conv_id % 3 > 0 THEN 'turn/end' END END AS type,
  turn AS turn, turn % 3 AS step, CASE WHEN conv_id % 11 = 0 THEN '' ELSE concat('p', CAST(conv_id % 2 AS STRING)) END AS provider, concat('m', CAST(turn % 3 AS STRING)) AS model
 FROM {conversations} c CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(ix)) e WHERE type IS NOT NULL"""


TABLES = ("documents", "conversations", "events", "orders")


def relation(sql: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A reader of what an SQL text over {tables} gives, and the text for another engine."""
    other = sql.replace("{", "{{").replace("}", "}}")  # braces that name no table
    for t in TABLES:
        other = other.replace(f"{{{{{t}}}}}", f"{{{t}}}")

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(other, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})

    plain = sql
    for t in TABLES:
        plain = plain.replace(f"{{{t}}}", t)
    return read, plain


blocks, BLOCKS_SQL = relation(BLOCKS)
log_events, EVENTS_SQL = relation(EVENTS)
