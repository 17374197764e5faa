"""Lossless encodings of tool output within a session: folded lines, and repeated payloads that refer to one definition. Either is applied whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import messages as M
from ledgerloom.operators.artifacts import FOLD, folded_all

# What opens a payload's mark, the length of the rule that explains marks to a reader, and the least that a group and, beyond the rule, the whole must save.
MARK = "[adaptive-tool:v1 "
RULE_CHARS = 483
LEAST = 128


def collisions(found: DataFrame, mark: str) -> DataFrame:
    """Whether a session holds the mark already, in a block or over adjacent ones."""
    return found.select("session", F.contains(F.array_join(F.transform("content", lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit(mark)).alias("hit")).groupBy("session").agg(F.bool_or("hit").alias("collision"))


def _outputs(found: DataFrame) -> DataFrame:
    """Tool outputs that are plain text: session, pos, is_error, their text and the number of its blocks."""
    plain = F.forall("content", lambda b: b["type"].isin("text", "tool-result"))
    return found.filter(M.is_tool_output() & plain).select("session", "pos", "is_error", F.array_join(F.transform("content", lambda b: b["text"]), "").alias("text"), F.to_json(F.transform("content", lambda b: b["text"])).alias("content"))


def folded_outputs(found: DataFrame) -> DataFrame:
    """Tool outputs with runs of lines folded, unless their session holds the mark: session, pos, text, before, after (characters)."""
    key = F.concat_ws(":", "session", "pos")
    rows = _outputs(found).join(collisions(found, FOLD).filter("not collision").select("session"), "session", "left_semi").withColumn("doc_id", key)
    done = folded_all(rows.select("doc_id", "text")).select("doc_id", F.col("text").alias("folded"))
    return rows.join(done, "doc_id").select("session", "pos", F.col("folded").alias("text"), F.length("text").cast("long").alias("before"), F.length("folded").cast("long").alias("after"))


def encoded_payloads(found: DataFrame) -> DataFrame:
    """Tool outputs (session, pos, text) with each payload that repeats given once, at its last place, and by reference before.

    Equal payloads have equal blocks and error states. A group is encoded if that saves LEAST, a session if all its groups save more than the rule and LEAST; ids go by a
    payload's first place. A session that holds the mark already is left as it is.
    """
    rows = _outputs(found).join(collisions(found, MARK).filter("not collision").select("session"), "session", "left_semi").withColumn("error", F.coalesce(F.col("is_error").cast("string"), F.lit("-")))
    key = ["session", "error", "content"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first(F.length("text")).alias("chars")).filter("n > 1")
    # An id's digits count for the saving; groups that are passed over don't take an id, so ids are given in order of the groups that could.
    order = Window.partitionBy("session").orderBy("first")
    size = lambda i: F.length(i.cast("string"))
    saves = lambda i: F.col("chars") * (F.col("n") - 1) - (F.lit(len(MARK) + len("define=]\n")) + size(i)) - (F.lit(len(MARK) + len("ref=]")) + size(i)) * (F.col("n") - 1)
    worth = groups.filter(saves(F.lit(1)) >= LEAST).withColumn("id", F.row_number().over(order)).withColumn("saved", saves(F.col("id"))).filter(F.col("saved") >= LEAST)
    sessions = worth.groupBy("session").agg(F.sum("saved").alias("all")).filter(F.col("all") > RULE_CHARS + LEAST).select("session")
    kept = worth.join(sessions, "session", "left_semi").select(*key, "id", "last")
    out = rows.join(kept, key, "left")
    define, refer = F.concat(F.lit(f"{MARK}define="), F.col("id").cast("string"), F.lit("]\n"), F.col("text")), F.concat(F.lit(f"{MARK}ref="), F.col("id").cast("string"), F.lit("]"))
    return out.select("session", "pos", F.when(F.col("id").isNull(), F.col("text")).when(F.col("pos") == F.col("last"), define).otherwise(refer).alias("text"))


def decoded_payloads(encoded: DataFrame) -> DataFrame:
    """The inverse. A reference without definition, or a payload defined twice, is an error."""
    opened = r"\A\[adaptive-tool:v1 define=(\d+)\]\n"
    marked = encoded.withColumn("d", F.regexp_extract("text", opened, 1)).withColumn("r", F.regexp_extract("text", r"\A\[adaptive-tool:v1 ref=(\d+)\]\z", 1))
    given = marked.filter("d <> ''").groupBy("session", F.col("d").alias("id")).agg(F.count("*").alias("n"), F.first(F.regexp_replace("text", opened, "")).alias("body"))
    rows = marked.withColumn("id", F.when(F.col("d") != "", F.col("d")).when(F.col("r") != "", F.col("r"))).join(given, ["session", "id"], "left")
    fail = lambda why: F.raise_error(F.lit(why)).cast("string")
    text = F.when(F.col("id").isNull(), F.col("text")).when(F.col("n").isNull(), fail("missing payload definition")).when(F.col("n") > 1, fail("payload defined twice")).otherwise(F.col("body"))
    return rows.select("session", "pos", text.alias("text"))
