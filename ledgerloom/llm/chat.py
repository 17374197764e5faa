"""Chat formatting with cumulative-snapshot collapse. DataFrame operations only.

A log that stores a conversation anew after every turn holds each state as a prefix of the next. Every turn gets a hash of its place,
role and text; the exclusive-or of the hashes up to it, twice 64 bits, identifies the prefix that ends there, as a
running window. Of equal conversations the one with the least conv_id stays, and an anti-join drops those that
equal a proper prefix of a longer one. Only then is text gathered and rendered. Prefixes are made distinct before the
join, so a first turn that a third of all conversations share is one row.

A turn marker inside a role or text is broken by a backslash (one more, where some stand there), and line ends and backslashes of roles are
escaped, so no text forges a turn and the rendered form can be read back.

Defined cases: null roles and texts are the empty string where rendered, and differ from it where compared; turns that
tie are ordered by role, then text; a null conv_id is a conversation of its own; an empty table gives an empty table. A conversation
is one row of output, so its turns meet in one task, however long; repeated rows are turns of their own; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("n", F.row_number().over(order))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are neither a proper prefix of another nor equal to one of a smaller conv_id."""
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = lambda c: F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("value"))
    turns = _turns(conversations).select("conv_id", "n", F.xxhash64("n", known("role"), known("text")).alias("x"), F.xxhash64(known("text"), known("role"), "n", F.lit("second")).alias("y"))
    states = turns.select("conv_id", "n", F.count("*").over(whole).alias("n_turns"), F.bit_xor("x").over(so_far).alias("x"), F.bit_xor("y").over(so_far).alias("y"))
    states = Cut(states, "states").df
    full = states.filter("n = n_turns").groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id"))
    prefixes = states.filter("n < n_turns").select("n", "x", "y").distinct()
    return full.join(prefixes, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def _broken(x: Column) -> Column:
    """x with one more backslash in each turn marker."""
    return F.regexp_replace(x, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "kept_id")
    turns = _turns(conversations)
    rows = turns.join(kept, turns.conv_id.eqNullSafe(F.col("kept_id")))
    role = F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    line = F.concat(F.lit("<|im_start|>"), _broken(role), F.lit("\n"), _broken(F.coalesce("text", F.lit(""))), F.lit("<|im_end|>\n"))
    said = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return rows.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(said, lambda s: s["line"]), "").alias("rendered"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
                  count(*) OVER (PARTITION BY conv_id) AS n_turns, coalesce(replace(replace(role, '\', '\\'), chr(10), '\n'), '') AS r, coalesce(text, '') AS x,
                  coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS said FROM conversations),
     l AS (SELECT *, '<|im_start|>' || regexp_replace(r, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') || chr(10)
                     || regexp_replace(x, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') || '<|im_end|>' || chr(10) AS line FROM t),
     p AS (SELECT conv_id, n, n_turns, string_agg(said, '') OVER w AS said, string_agg(line, '') OVER w AS rendered FROM l
           WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     f AS (SELECT said, n_turns, min(conv_id) AS conv_id, min(rendered) AS rendered FROM p WHERE n = n_turns GROUP BY said, n_turns)
SELECT f.conv_id, f.n_turns, f.rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.n_turns AND p.n = f.n_turns AND p.said = f.said)
"""
