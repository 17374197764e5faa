"""The library's registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import artifacts as A
from ledgerloom.operators import windows as W
from ledgerloom.plans.log import CATALOGUE as LOG
from ledgerloom.plans.log import range_sql
from ledgerloom.plans.sessions import CATALOGUE as SESSIONS
from ledgerloom.sources.tables import REFS_SQL, SURFACE_SQL, references, surface, table
from ledgerloom.streaming import state as S

FLAGSHIP = "rng1_select_range"
RETAIN, FLOOR, MINIMUM, THRESHOLD = 300, 0.5, 50, 600

S_ = f"WITH s AS ({SURFACE_SQL})"
R_ = f"WITH r AS ({REFS_SQL})"
L_ = """WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents),
 x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM l)"""


def _docs(f: Callable[..., DataFrame], *a) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(table(spark, d, "documents"), *a)


def _surface(f: Callable[..., DataFrame], *a) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(surface(spark, d), *a)


def _refs(f: Callable[..., DataFrame], *a) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(references(spark, d), *a)


def _tokens(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{32,}"), F.lit(0))).alias("token"))
    return found.select("doc_id", "token", F.round(T.entropy(F.col("token")), 6).alias("bits"), (T.entropy(F.col("token")) >= 4.0).alias("redacted"))


_CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rng1_select_range": (
        _surface(W.select_range, RETAIN, FLOOR, MINIMUM),
range_sql(f"WITH n AS ({SURFACE_SQL})", RETAIN, FLOOR, MINIMUM),
    ),
    "rng2_tail_tokens": (_surface(W.tail_tokens), f"{S_} SELECT session, pos, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS BIGINT) AS tail FROM s"),
    "rng3_pairing_balance": (
        _surface(W.pairing_balance),
        f"""{S_}, b AS (SELECT session, pos, CAST(coalesce(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_calls FROM s)
SELECT *, open_calls = 0 AS balanced FROM b""",
    ),
    "txt10_token_estimate": (lambda spark, d: surface(spark, d).select("session", "pos", "tokens"), f"{S_} SELECT session, pos, tokens FROM s"),
    "pol_running_pressure": (_surface(W.running_pressure), f"{S_} SELECT session, pos, tokens, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY pos) AS BIGINT) AS pressure FROM s"),
    "pol1_threshold_crossing": (
        _surface(W.threshold_crossing, THRESHOLD),
        f"{S_}, p AS (SELECT session, pos, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY pos) AS BIGINT) AS pressure FROM s) SELECT session, min(pos) AS pos, min(pressure) AS pressure FROM p WHERE pressure >= {THRESHOLD} GROUP BY session",
    ),
    "src2_last_turns": (_surface(W.last_turns), f"{S_} SELECT session, max(pos) AS turn, arg_max(role, pos) AS role, arg_max(role, pos) = 'user' AS open_turn FROM s GROUP BY session"),
    "src_role_profile": (_surface(W.role_profile), f"{S_} SELECT role, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS largest FROM s GROUP BY role"),
    "txt5_split_lines": (_docs(A.split_lines), f"{L_} SELECT doc_id, line_no, line FROM x"),
    "txt2_line_offsets": (_docs(A.line_offsets), f"{L_} SELECT doc_id, line_no, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM x"),
    "art4_chunk_lines": (
        _docs(A.chunk_lines, 8, 2),
        f"""{L_}, c AS (SELECT doc_id, l, unnest(list_filter(range(0, len(l), 6), lambda s: s = 0 OR s + 2 < len(l))) AS s FROM l)
SELECT doc_id, s + 1 AS line_start, CAST(least(s + 8, len(l)) AS BIGINT) AS line_end, sha256(array_to_string(l[s + 1:s + 8], chr(10))) AS sha256 FROM c""",
    ),
    "art2_read_lines": (_docs(A.read_lines, 2, 4), f"{L_} SELECT doc_id, array_to_string(l[2:4], chr(10)) AS slice, CAST(len(l[2:4]) AS BIGINT) AS n_lines FROM l"),
    "art3_grep_context": (
        _docs(A.grep, "token", 1),
        f"""{L_}, h AS (SELECT x.doc_id, x.line_no, l.l, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.line_no) AS k FROM x JOIN l ON x.doc_id = l.doc_id WHERE contains(x.line, 'token'))
SELECT doc_id, line_no, greatest(line_no - 1, 1) AS line_start, least(line_no + 1, CAST(len(l) AS BIGINT)) AS line_end, array_to_string(l[greatest(line_no - 1, 1):line_no + 1], chr(10)) AS context FROM h WHERE k <= 50""",
    ),
    "enc8_content_address": (
        _docs(A.content_address),
        "WITH d AS (SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents) SELECT sha256, bytes, count(*) AS copies, min(doc_id) AS first_doc, (count(*) - 1) * bytes AS saved FROM d GROUP BY sha256, bytes",
    ),
    "enc1_fold_runs": (
        _docs(A.fold_runs),
        f"""{L_}, y AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS g FROM x)
SELECT doc_id, min(line_no) AS line_no, count(*) AS length, CAST(any_value(length(line)) AS BIGINT) AS line_chars FROM y GROUP BY doc_id, line, g HAVING count(*) >= 2""",
    ),
    "red3_entropy_tokens": (
        _docs(_tokens),
        """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{32,}')) AS token FROM documents),
 e AS (SELECT doc_id, token, list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)))) AS bits FROM t)
SELECT doc_id, token, round(bits, 6) AS bits, bits >= 4.0 AS redacted FROM e""",
    ),
    "txt8_mime": (lambda spark, d: table(spark, d, "pages").select("page_id", T.mime(F.col("html")).alias("mime")), "SELECT page_id, CASE WHEN regexp_matches(regexp_replace(html[:512], '^\\s+', ''), '^[\\{\\[]') THEN 'application/json' ELSE 'text/plain' END AS mime FROM pages"),
    "txt13_single_line": (_docs(lambda d: d.select("doc_id", F.sha2(T.single_line(F.col("text")), 256).alias("sha256"))), "SELECT doc_id, sha256(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS sha256 FROM documents"),
    "txt14_escape_newlines": (_docs(lambda d: d.select("doc_id", F.sha2(T.escape_newlines(F.col("text")), 256).alias("sha256"))), "SELECT doc_id, sha256(replace(replace(text, '\\', '\\\\'), chr(10), '\\n')) AS sha256 FROM documents"),
    "acl2_visible_refs": (_refs(A.visible, "t1", "confidential", 200), f"{R_} SELECT * FROM r WHERE tenant = 't1' AND retain_until > 200 AND list_position(['public', 'internal', 'confidential', 'secret'], label) <= 3"),
    "acl3_effective_label": (
        _refs(A.effective_label, "t1", "confidential", 200),
        f"{R_} SELECT sha256, ['public', 'internal', 'confidential', 'secret'][max(list_position(['public', 'internal', 'confidential', 'secret'], label))] AS label, count(*) AS claims FROM r WHERE tenant = 't1' AND retain_until > 200 AND list_position(['public', 'internal', 'confidential', 'secret'], label) <= 3 GROUP BY sha256",
    ),
    "str1_hysteresis": (
        lambda spark, d: S.hysteresis(table(spark, d, "events"), 60.0, 20.0),
        """WITH m AS (SELECT event_id, user_id, ts, CASE WHEN value >= 60 THEN true WHEN value < 20 THEN false END AS mark FROM events)
SELECT event_id, user_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active FROM m""",
    ),
    "str6_replay_guard": (lambda spark, d: S.replay_guard(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("n")), "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in (_CATALOGUE | SESSIONS | LOG).items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (_CATALOGUE | SESSIONS | LOG).items() if s}
