"""Readers of the log, document and reference relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import token_estimate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as priced surfaces: session, pos (dense from 0), tokens, is_checkpoint, balanced, has_system."""
    c = table(spark, sf_dir, "conversations")
    # A checkpoint at every seventh place and an open tool call before every fifth stand for events the table has none of.
    key = F.col("conv_id") * 7 + F.col("turn") * 3
    return c.select(
        F.col("conv_id").alias("session"), F.col("turn").cast("long").alias("pos"), token_estimate(F.col("text")).alias("tokens"),
        (key % 7 == 0).alias("is_checkpoint"), (key % 5 != 0).alias("balanced"), (F.col("conv_id") % 3 == 0).alias("has_system"), "role", "text",
    )


SURFACE_SQL = """SELECT conv_id AS session, CAST(turn AS BIGINT) AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, (conv_id * 7 + turn * 3) % 7 = 0 AS is_checkpoint,
 (conv_id * 7 + turn * 3) % 5 <> 0 AS balanced, conv_id % 3 = 0 AS has_system, role, text FROM conversations"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on documents: ref_id, sha256, tenant, session, label, retain_until."""
    d = table(spark, sf_dir, "documents")
    labels = F.array(*map(F.lit, LABELS))
    return d.select(
        F.col("doc_id").alias("ref_id"), F.sha2("text", 256).alias("sha256"), F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("tenant"), (F.col("doc_id") % 50).alias("session"),
        F.element_at(labels, (F.col("doc_id") % 4 + 1).cast("int")).alias("label"), (F.col("doc_id") * 37 % 1000).alias("retain_until"),
    )


# Security labels from the lowest.
LABELS = ["public", "internal", "confidential", "secret"]
REFS_SQL = """SELECT doc_id AS ref_id, sha256(text) AS sha256, 't' || CAST(doc_id % 4 AS VARCHAR) AS tenant, doc_id % 50 AS session,
 ['public', 'internal', 'confidential', 'secret'][CAST(doc_id % 4 + 1 AS INT)] AS label, doc_id * 37 % 1000 AS retain_until FROM documents"""

# Text for each message and document that the tables lack, in SQL that both engines read; {h} is the hex SHA-256 of the row's id.
DRAFT = """concat(coalesce(text, ''), chr(10), 'Q', CAST(turn + 1 AS STRING), ': item ', CAST(conv_id % 7 AS STRING), chr(10),
 CASE turn % 5 WHEN 0 THEN 'MUST keep the order' WHEN 1 THEN 'never drop rows?' WHEN 2 THEN 'avoid copies' ELSE 'as before' END, chr(10),
 'see src/m', CAST(conv_id % 7 AS STRING), '.py:', CAST(turn + 1 AS STRING), ' and (docs/a.md)', chr(10),
 CASE conv_id % 3 WHEN 0 THEN concat('ValueError: failed ', CAST(turn AS STRING)) WHEN 1 THEN 'FAILED test_a' ELSE '3 passed, 1 failed' END, chr(10), '  $ run ', CAST(turn % 2 AS STRING))"""
SECRET = """concat(coalesce(text, ''), ' tok ', substr({h}, 1, 16), 'GHJKMNPQRSTVWXYZ', ' ', CASE doc_id % 6 WHEN 0 THEN concat('AKIA', upper(substr({h}, 1, 16))) WHEN 1 THEN concat('ghp_', substr({h}, 1, 40))
 WHEN 2 THEN concat('SK-', substr({h}, 1, 30)) WHEN 3 THEN concat('Authorization:  Bearer ', substr({h}, 1, 24), '" mail a@', CASE doc_id % 18 WHEN 3 THEN 'b.org' WHEN 9 THEN 'example.org' ELSE 'example.organ.de' END, ' 10.0.0.1') WHEN 4 THEN concat('artifact://sha256/', {h}) ELSE concat('eyJ', substr({h}, 1, 12), '.', substr({h}, 13, 12), '.', substr({h}, 25, 12)) END, ' ',
 CASE doc_id % 4 WHEN 0 THEN concat('sk-', substr({h}, 1, 24), '-- end') WHEN 1 THEN concat('/', substr({h}, 1, 20), 'GHJKMNPQRSTVWXYZ== end') WHEN 2 THEN '[REDACTED:aws_key:0000]' ELSE concat(substr({h}, 1, 20), 'GHJKMNPQRSTVWXYZ==x/') END)"""
CITED = """concat(coalesce(text, ''), ' see artifact://sha256/', {h}, ' or artifact://sha256/', {t})"""
RUNS = """CASE doc_id % 11 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN concat('x', chr(10), '[adaptive-repeat:v1 additional=3]', chr(10)) WHEN 2 THEN ''
 ELSE concat(coalesce(text, ''), chr(10), repeat(concat('the same line over and over', chr(10)), CAST(doc_id % 9 AS INT)), CASE doc_id % 2 WHEN 0 THEN 'end' ELSE '' END) END"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (session, seq, role, text, subject) with work items, pins, paths, errors and commands."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS session", "turn AS seq", "role", f"{DRAFT} AS text", "concat('Q', CAST(turn + 1 AS STRING), '-Q', CAST(turn + 1 + conv_id % 3 AS STRING), ' done') AS subject")


DRAFTS_SQL = f"SELECT conv_id AS session, turn AS seq, role, {DRAFT} AS text, concat('Q', CAST(turn + 1 AS STRING), '-Q', CAST(turn + 1 + conv_id % 3 AS STRING), ' done') AS subject FROM conversations"


def _with(text: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").selectExpr("doc_id", text.format(h="sha2(CAST(doc_id AS STRING), 256)", t="sha2(text, 256)") + " AS text")

    return read, "SELECT doc_id, " + text.format(h="sha256(CAST(doc_id AS STRING))", t="sha256(text)") + " AS text FROM documents"


secrets, SECRETS_SQL = _with(SECRET)
cited, CITED_SQL = _with(CITED)
runs, RUNS_SQL = _with(RUNS)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool payloads (session, pos, payload) that sessions repeat."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS session", "turn AS pos", "concat('payload ', CAST(turn % 2 AS STRING), repeat('x', CAST(60 + conv_id % 5 * 30 AS INT))) AS payload")


PAYLOADS_SQL = "SELECT conv_id AS session, turn AS pos, concat('payload ', CAST(turn % 2 AS STRING), repeat('x', CAST(60 + conv_id % 5 * 30 AS INT))) AS payload FROM conversations"
