"""Registered queries over the message log, the store, policies, condensed sessions and evidence, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import anchors as N
from ledgerloom.operators import artifacts as A
from ledgerloom.operators import condensed as C
from ledgerloom.operators import encodings as E
from ledgerloom.operators import evidence as V
from ledgerloom.operators import messages as M
from ledgerloom.operators import policy as P
from ledgerloom.operators import redaction as R
from ledgerloom.operators import store as S
from ledgerloom.operators import windows as W
from ledgerloom.plans.sessions import D_
from ledgerloom.sources import log as L
from ledgerloom.sources import tables as B
from ledgerloom.streaming import state as Z

_NL = "chr(10)"
_LABELS = "['public', 'internal', 'confidential', 'secret']"
_REFS = f"r AS ({B.REFS_SQL})"
_VISIBLE = f"v AS (SELECT * FROM r WHERE tenant = 't1' AND retain_until > 200 AND list_position({_LABELS}, label) <= 3)"
_B = f"b AS ({L.BLOCKS_SQL})"
_RUNS = f"""{_B}, g AS (SELECT *, type IN ('text', 'reasoning') AS vis FROM b), h AS (SELECT *, CASE WHEN vis AND coalesce(lag(vis) OVER (PARTITION BY session, pos ORDER BY ix), false) THEN 0 ELSE 1 END AS new FROM g),
 i AS (SELECT *, sum(new) OVER (PARTITION BY session, pos ORDER BY ix) AS run FROM h), runs AS (SELECT session, pos, run, any_value(vis) AS vis, min(type) AS type, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY ix) AS t FROM i GROUP BY session, pos, run)"""
_MESSAGES = f"""{_RUNS}, texts AS (SELECT session, pos, string_agg(t, chr(10) ORDER BY run) AS text FROM runs WHERE vis OR type = 'tool-result' GROUP BY session, pos),
 m AS (SELECT session, pos, seq, role, source, call_id, is_error, count(*) AS n, min(type) AS type, min(block_call) AS block_call, bool_or(type = 'tool-call') AS calls, bool_or(type = 'text' AND regexp_matches(text, '\\S')) AS says FROM b GROUP BY ALL),
 p AS (SELECT m.session, m.pos, m.seq, m.role, m.is_error, coalesce(texts.text, '') AS text, coalesce(m.role = 'tool' OR (m.role = 'user' AND source = 'tool' AND call_id <> '' AND n = 1 AND type = 'tool-result' AND block_call = call_id), false) AS tool_output,
  coalesce(m.role = 'user' AND source = 'user', false) AS human, coalesce(m.role = 'user' AND source = 'compact-checkpoint', false) AS checkpoint, m.role = 'assistant' AND says AND NOT calls AS delivered FROM m LEFT JOIN texts ON m.session = texts.session AND m.pos = texts.pos)"""


_steps, _STEPS = L.relation("SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS event, event_id, value FROM {events}")
STEPS = f"SELECT *, CAST(floor(event / 7) AS BIGINT) AS turn, CAST(floor(event / 3) AS BIGINT) AS step FROM ({_STEPS})"


def steps(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).withColumn("turn", F.floor(F.col("event") / 7)).withColumn("step", F.floor(F.col("event") / 3))


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of sessions: their events' values as pressure, and now and then a pass that fails."""
    kind = F.when(F.col("event") % 13 == 0, "busy").when(F.col("event") % 5 == 0, "low-savings").when(F.col("event") % 17 == 0, "other")
    return steps(spark, d).select("session", "event", "turn", "step", F.col("value").alias("total"), (F.col("event") % 4 * 9.0).alias("saving"), kind.alias("failed"), F.concat(F.lit("k"), (F.col("event") % 2).cast("string")).alias("key"))


LIMITS = P.Limits(threshold=60.0, release=40.0, cooldown_events=3, cooldown_turns=0, max_passes=2)

_grid, GRID = L.relation(
    """SELECT CAST(w AS BIGINT) AS window, CAST(r AS DOUBLE) AS ratio, CAST(0.16 AS DOUBLE) AS retain_ratio, CAST(0.6 AS DOUBLE) AS release_ratio, CAST(x AS BIGINT) AS max_tokens, CAST(v AS DOUBLE) AS reserve, CAST(f AS BIGINT) AS default_max, CAST(q AS BIGINT) AS requested, CAST(i AS BIGINT) AS max_input
 FROM (VALUES (8000), (32000), (131072)) a(w) CROSS JOIN (VALUES (0.15), (0.72), (0.8)) b(r) CROSS JOIN (VALUES (1024), (8192)) c(x) CROSS JOIN (VALUES (0.1), (12288), (CAST(NULL AS INT))) e(v) CROSS JOIN (VALUES (4096), (CAST(NULL AS INT))) g(f) CROSS JOIN (VALUES (0), (20000)) h(q) CROSS JOIN (VALUES (0), (20000)) j(i)"""
)
_spans, SPANS = L.relation("SELECT conv_id AS session, CAST(1 AS BIGINT) AS start, CAST(2 + conv_id % 2 AS BIGINT) AS `end` FROM {conversations} WHERE conv_id % 3 > 0 AND turn = 3")
SPANS = SPANS.replace("`", '"')
_items, ITEMS = L.relation("SELECT conv_id AS session, turn * 10 + 3 AS seq, concat('q', CAST(turn % 3 AS STRING)) AS label, turn % 2 = 0 AS marked, CASE turn % 4 WHEN 0 THEN turn * 10 WHEN 1 THEN CAST(NULL AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS after FROM {conversations} WHERE role = 'user'")
_tracked, TRACKED = L.relation("SELECT conv_id AS session, concat('q', CAST(turn % 2 AS STRING)) AS label FROM {conversations} WHERE role = 'assistant'")
_entries, ENTRIES = L.relation("SELECT conv_id AS session, turn AS seq, concat('Q', CAST(turn AS STRING), ': done. Task ', CAST(conv_id % 3 AS STRING), ' next', chr(10), '- 1) question 2 and Q7', CASE conv_id % 2 WHEN 0 THEN '! Q8' ELSE ' Q9x' END) AS text FROM {conversations}")
_answers = lambda spark, d: M.messages(L.blocks(spark, d)).select("session", "pos", "seq", M.is_delivered().alias("delivered"))


def _last(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).filter("delivered").groupBy("session").agg(F.max("seq").alias("last_answer"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return N.pending(_items(spark, d), _last(spark, d))


_PENDING = f"""{_MESSAGES}, la AS (SELECT session, max(seq) AS last_answer FROM p WHERE delivered GROUP BY session), it AS ({ITEMS}),
 pe AS (SELECT it.session, it.seq, it.label, CASE WHEN marked THEN after IS NULL OR after < 0 OR last_answer IS NULL OR last_answer <= after ELSE coalesce(it.seq <> -1 AND it.seq >= last_answer, false) END AS pending FROM it LEFT JOIN la ON it.session = la.session)"""
_OPEN = f"""{_PENDING}, tr AS (SELECT DISTINCT session, label FROM ({TRACKED})), pr AS (SELECT session, label, count(*) AS n, min(seq) AS seq, arg_min(pending, seq) AS pending FROM pe GROUP BY session, label),
 op AS (SELECT pr.session, pr.label, pr.seq FROM pr LEFT JOIN tr ON pr.session = tr.session AND pr.label = tr.label WHERE tr.label IS NULL OR n > 1 OR pr.pending)"""


def _open(spark: SparkSession, d: str) -> DataFrame:
    return N.open_items(_pending(spark, d), _tracked(spark, d))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Contents (doc_id, sha256, body, encoding, bytes), some no text, some damaged."""
    docs = B.table(spark, d, "documents")
    odd = F.unhex(F.lit("FF00"))
    body = F.when(F.col("doc_id") % 10 == 3, odd).when(F.col("doc_id") % 17 == 0, F.encode(F.concat("text", F.lit("!")), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.sha2(odd, 256)).otherwise(F.sha2("text", 256)).alias("sha256"), body.alias("body"), F.when(F.col("doc_id") % 10 == 3, "binary").otherwise("utf-8").alias("encoding"))


_BLOBS = "bl AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN sha256('\\xFF\\x00'::BLOB) ELSE sha256(text) END AS sha256, text, doc_id % 10 = 3 AS odd, doc_id % 10 <> 3 AND doc_id % 17 = 0 AS damaged FROM documents)"
_REFS_USED = lambda spark, d: A.visible(B.references(spark, d), "t1", "confidential", 200)


def range_sql(given: str, retain: int, floor: float, minimum: int) -> str:
    """The span to replace, over the surface n that the text `given` names."""
    return f"""{given},
 w AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suf, count(*) OVER (PARTITION BY session) AS n, CASE WHEN has_system THEN 1 ELSE 0 END AS first FROM n),
 k AS (SELECT session, any_value(n) AS n, any_value(first) AS first, coalesce(max(CASE WHEN suf >= {retain} THEN pos END), 0) AS keep0 FROM w GROUP BY session),
 a AS (SELECT w.session, any_value(k.first) AS first, any_value(k.n) AS n, coalesce(min(CASE WHEN w.pos >= keep0 AND NOT (w.is_checkpoint AND w.suf - w.tokens >= {retain * floor}) THEN w.pos END), any_value(k.n)) AS keep1
       FROM w JOIN k ON w.session = k.session GROUP BY w.session HAVING any_value(keep0) > any_value(k.first)),
 b AS (SELECT w.session, any_value(a.first) AS first, max(CASE WHEN w.balanced AND w.pos <= a.keep1 AND w.pos > a.first THEN w.pos END) AS keep2 FROM w JOIN a ON w.session = a.session WHERE a.keep1 < a.n GROUP BY w.session)
SELECT w.session, CAST(any_value(b.first) AS BIGINT) AS start, any_value(b.keep2) - 1 AS "end", CAST(sum(tokens) AS BIGINT) AS tokens
FROM w JOIN b ON w.session = b.session WHERE b.keep2 IS NOT NULL AND w.pos >= b.first AND w.pos < b.keep2 GROUP BY w.session HAVING sum(tokens) >= {minimum}"""


def _messages(f: Callable[..., DataFrame], *a) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(M.messages(L.blocks(spark, d)), *a)


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(B.table(spark, d, "documents").select("doc_id", "text", "lang"))


def _value(c: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return _docs(lambda x: x.select("doc_id", c().alias("value")))


def _hashed(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("sha256", F.sha2(column, 256)).drop(column)


def _sweep_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored contents, of which some have no claim at all."""
    docs = B.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes")).distinct()
    return docs.unionByName(B.table(spark, d, "pages").select(F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes")).distinct())


_SWEEP = f"{_REFS}, bl AS (SELECT DISTINCT sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents UNION ALL SELECT DISTINCT sha256(html), CAST(octet_length(encode(html)) AS BIGINT) FROM pages), lv AS (SELECT DISTINCT sha256 FROM r WHERE retain_until > 500)"
_contexts = lambda spark, d: B.cited(spark, d).withColumn("checkpoint", F.col("doc_id") % 3 == 0).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(S.SECRET_MARK))).otherwise(F.col("text")))
_TAINT = f"{_REFS}, ct AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || '{S.SECRET_MARK}' ELSE text END AS text FROM ({B.CITED_SQL})), se AS (SELECT sha256 FROM r WHERE tenant = 't3' AND retain_until > 200 GROUP BY sha256 HAVING max(list_position({_LABELS}, label)) = 4), ci AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'artifact://sha256/([0-9a-f]{{64}})', 1)) AS sha256 FROM ct) JOIN se USING (sha256)), ta AS (SELECT ct.doc_id, (ct.doc_id % 9 = 0 AND ct.doc_id % 3 = 0) OR ci.doc_id IS NOT NULL AS tainted FROM ct LEFT JOIN ci ON ct.doc_id = ci.doc_id)"
_tainted = lambda spark, d: S.tainted(_contexts(spark, d), B.references(spark, d), "t3", 200)
_targets = lambda spark, d: B.table(spark, d, "documents").filter("doc_id % 5 > 0").selectExpr("doc_id", "concat('p', CAST(doc_id % 3 AS STRING)) AS provider")
_attempts, ATTEMPTS = L.relation("SELECT o_orderkey AS k, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS id, concat('j', CAST(o_custkey % 20 AS STRING)) AS job, o_custkey % 50 AS index, o_orderpriority AS purpose, o_orderstatus AS wire FROM {orders} WHERE o_orderkey % 50 = 0")
ATTEMPTS = ATTEMPTS.replace("AS index", 'AS "index"')
_records, RECORDS = L.relation("SELECT o_orderkey - o_orderkey % 7 AS id, o_orderstatus AS arm, CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS exit_code, CAST(o_custkey % 3 AS STRING) AS sha256 FROM {orders} WHERE o_orderkey % 40 = 0")
_plan, PLAN = L.relation("SELECT o_orderkey AS id, 'F' AS arm, CAST(o_custkey % 3 AS STRING) AS sha256 FROM {orders} WHERE o_orderkey % 280 < 250")
_streams, STREAMS = L.relation(
    """SELECT user_id AS request, event_type AS purpose, CAST(event_id AS BIGINT) AS ms, CASE event_id % 4 WHEN 0 THEN concat('data: {"usage":{"prompt_tokens":', CAST(event_id AS STRING), ',"completion_tokens":2,"total_tokens":9}}') WHEN 1 THEN 'data: {"choices":[{"finish_reason":"length"},{"finish_reason":"stop"}]}' WHEN 2 THEN ': keep-alive' ELSE 'data: [DONE]' END AS line FROM {events}"""
)
_replies, REPLIES = L.relation("""SELECT doc_id AS job, concat(CASE doc_id % 3 WHEN 0 THEN concat(' ```json', chr(10)) ELSE '' END, CASE doc_id % 5 WHEN 0 THEN 'none' ELSE concat('{"owner":"', lang, '","region":"r', CAST(doc_id % 2 AS STRING), '"}') END, CASE doc_id % 3 WHEN 0 THEN concat(chr(10), '``` ') ELSE '' END) AS text FROM {documents}""")
_requests, REQUESTS = L.relation("SELECT concat('j', CAST(user_id % 7 AS STRING)) AS job, CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE event_id END AS tokens, event_id * 2 AS counted, CAST(64 AS BIGINT) AS cap FROM {events}")
_timings, TIMINGS = L.relation("SELECT event_type AS name, value AS baseline, CAST(event_id % 17 + 1 AS DOUBLE) AS candidate FROM {events} WHERE value > 0 AND event_id % 10 = 0")
_counters, COUNTERS = L.relation("SELECT user_id AS session, event_id AS input_tokens, event_id % 5 AS output_tokens, CASE WHEN user_id % 2 = 0 THEN event_id % 3 END AS cache_read, CASE WHEN event_id % 2 = 0 AND user_id % 3 = 0 THEN CAST(4 AS BIGINT) END AS reasoning FROM {events}")
_json, JSON = L.relation("""SELECT doc_id, concat('{"b": ', CAST(doc_id AS STRING), ', "a": [1, {"z": "', lang, '", "y": null}], "é": true}') AS text FROM {documents}""")
_secret_json, _SECRET_JSON = L.relation("""SELECT doc_id, concat('{"name":"t', CAST(doc_id % 3 AS STRING), '","args":[{"key":"sk-', repeat('a1', CAST(8 + doc_id % 5 AS INT)), '"},', CAST(doc_id AS STRING), ',null]}') AS text FROM {documents}""")
_documents, _DOCUMENTS = L.relation(
    """SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN concat('here: ```json', chr(10)) ELSE 'so ' END, '{"schema_version":', CASE doc_id % 7 WHEN 0 THEN '2' ELSE '1' END, ',"task_state":{"goal":"', CASE doc_id % 3 WHEN 0 THEN '' ELSE 'goal' END, '","open":["Q1: later",', CASE doc_id % 5 WHEN 0 THEN '3' ELSE '"Q2 { x"' END,
 ']},"files":[{"path":"a.py","artifact":"payload ', CAST(doc_id % 4 AS STRING), '"}],"tests":', CASE doc_id % 11 WHEN 0 THEN '"no list"' ELSE '[{"command":"t","failing":["f"]}]' END, CASE doc_id % 6 WHEN 0 THEN '' ELSE '}' END, CASE doc_id % 4 WHEN 0 THEN concat(chr(10), '```') ELSE ' end' END) AS text FROM {documents}"""
)
_broken, _BROKEN = L.relation("""SELECT doc_id, concat('{"schema_version":1,"task_state":{"goal":"g","open":"one","decisions":[', CASE doc_id % 3 WHEN 0 THEN '{}' ELSE '' END, ']}', CASE doc_id % 2 WHEN 0 THEN '}' ELSE '' END) AS text FROM {documents}""")
_flats, _FLATS = L.relation("""SELECT doc_id, concat('{"schema_version":1,"goal":"g","completed":["a"],"open":[],"state":["s"],"constraints":[],"next_step":', CASE doc_id % 3 WHEN 0 THEN '3' ELSE '"n"' END, CASE doc_id % 5 WHEN 0 THEN ',"x":1' ELSE '' END, '}') AS text FROM {documents}""")
_SECRET = "a shared secret"


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of events: good ones, forged ones, late ones and malformed ones."""
    rows = B.table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 5 == 2, "1600000000").otherwise("1700000000").alias("stamp"), F.coalesce("props", F.lit("")).alias("body"), (F.col("event_id") % 5).alias("k"))
    good = Z.mac(Z.signed_text(), _SECRET)
    return rows.withColumn("signature", F.concat(F.lit("v1="), F.when(F.col("k") == 1, F.sha2("body", 256)).when(F.col("k") == 3, F.substring(good, 1, 63)).when(F.col("k") == 4, F.upper(good)).otherwise(good))).drop("k")


_PADS = ["".join(f"{b ^ pad:02x}" for b in _SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_MACS = f"""x AS (SELECT CAST(event_id AS STRING) AS id, event_id % 5 AS k, CASE WHEN event_id % 5 = 2 THEN '1600000000' ELSE '1700000000' END AS stamp, coalesce(props, '') AS body FROM events),
 h AS (SELECT id, k, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(length(id) || ':' || id || '.' || length(stamp) || ':' || stamp || '.' || body)))) AS mac FROM x)"""
_deliveries, _DELIVERIES = L.relation("SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n, event_id % 5 AS id, ts FROM {events}")
_FILE_RE = "[A-Za-z]+tion[ ,.]"
_LINES = """l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)"""
_CUTS = "c AS (SELECT doc_id, text, octet_length(encode(text)) AS n, [octet_length(encode(substr(text, 1, k))) for k in range(0, 81)] AS ends FROM documents)"
_NOTE = lambda text: f"concat(label, '{text.replace(chr(39), chr(39) * 2)}')"

_COUNTERS = ", ".join(f"o_orderkey % {i + 3} AS {c}" for i, c in enumerate(c for c in V.SUMS + V.STATS if not c.endswith("seconds") and c != "total_tokens"))
_arms, ARMS = L.relation(
    f"""SELECT o_orderkey AS job, concat('case ', CAST(o_custkey AS STRING)) AS `case`, CASE o_orderstatus WHEN 'O' THEN 'baseline' WHEN 'F' THEN 'compact' ELSE 'other' END AS arm, o_orderkey % 7 AS fact_passed, CAST(6 AS BIGINT) AS fact_total, o_orderkey % 1000 + 1 AS total_tokens, {_COUNTERS},
 CAST(o_orderkey % 97 AS DOUBLE) / 8 AS process_wall_seconds, CAST(o_orderkey % 89 AS DOUBLE) / 4 AS summary_wall_seconds, CAST(o_orderkey % 83 AS DOUBLE) / 2 AS network_seconds, CAST(o_orderkey % 79 AS DOUBLE) AS context_reduction_pct FROM {{orders}}"""
)
_uppers, UPPERS = L.relation("SELECT CASE o_orderstatus WHEN 'O' THEN 'baseline' ELSE 'compact' END AS arm, o_custkey % 100 AS upper FROM {orders} WHERE o_orderkey % 3 = 0")
_jobs, JOBS = L.relation("SELECT o_orderkey AS job, concat('h', CAST(o_orderkey % 2 AS STRING)) AS history, 'e' AS expected, o_orderstatus = 'F' AS auto, concat('s', CAST(o_orderkey % 3 AS STRING)) AS settings FROM {orders}")
ARMS = ARMS.replace("`", '"')
_paths, PATHS = L.relation("SELECT concat(CASE doc_id % 5 WHEN 0 THEN 'private/' WHEN 1 THEN 'src/.env.d/' WHEN 2 THEN 'tests/fixtures/' ELSE 'src/' END, CAST(doc_id % 40 AS STRING), CASE doc_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.tgz' ELSE '.py' END) AS path FROM {documents}")
_PRICED = f"""{_MESSAGES}, ca AS (SELECT DISTINCT session, pos, block_call AS id FROM b WHERE type = 'tool-call'), an AS (SELECT DISTINCT p.session, p.pos, b.call_id AS id FROM p JOIN b ON p.session = b.session AND p.pos = b.pos WHERE tool_output),
 pr AS (SELECT ca.session, ca.pos, ca.id, min(an.pos) AS r FROM ca LEFT JOIN an ON ca.session = an.session AND ca.id = an.id AND an.pos > ca.pos GROUP BY ALL),
 n AS (SELECT p.session, pos, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, checkpoint AS is_checkpoint, first_value(role = 'system') OVER (PARTITION BY session ORDER BY pos) AS has_system, NOT EXISTS (SELECT 1 FROM pr WHERE pr.session = p.session AND pr.pos < p.pos AND (r IS NULL OR r >= p.pos)) AS balanced FROM p)"""

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "txt11_message_profile": (_messages(lambda m: _hashed(M.profile(m))), f"WITH {_MESSAGES} SELECT session, pos, tool_output, human, checkpoint, delivered, sha256(text) AS sha256 FROM p"),
    "txt16_surface_nodes": (
        _messages(M.surface_nodes),
        f"""WITH {_B}, w AS (SELECT *, CASE WHEN type IN ('text', 'reasoning') THEN nullif(text, '') WHEN type = 'tool-call' THEN '[tool call ' || block_call || ': run] ' || text WHEN type = 'tool-result' THEN '[tool result ' || block_call || CASE WHEN is_error THEN ' (error)' ELSE '' END || '] ' || text END AS t FROM b)
SELECT session, seq, CASE WHEN role = 'user' AND source IS NOT DISTINCT FROM 'tool' THEN 'tool' ELSE role END AS role, coalesce(string_agg(t, chr(1) ORDER BY ix), '') AS content, count(t) AS n_blocks, arg_min(CASE WHEN type = 'tool-result' THEN block_call END, CASE WHEN type = 'tool-result' THEN ix END) AS tool_call_id FROM w GROUP BY session, seq, role, source""",
    ),
    "txt17_from_wire": (
        lambda spark, d: M.from_wire(B.cited(spark, d).select("doc_id", F.lit(0).alias("ix"), F.when(F.col("doc_id") % 2 == 0, "code").otherwise("artifact_ref").alias("type"), "text", F.regexp_extract("text", "sha256/([0-9a-f]{64})", 1).alias("sha256")), _REFS_USED(spark, d)).transform(_hashed),
        f"""WITH ct AS ({B.CITED_SQL}), {_REFS}, {_VISIBLE}, kn AS (SELECT list(DISTINCT sha256) AS known FROM v), t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'artifact://sha256/' || regexp_extract(text, 'sha256/([0-9a-f]{{64}})', 1) END AS text FROM ct),
 z AS (SELECT doc_id, string_split_regex(text, 'artifact://sha256/[0-9a-f]{{64}}') AS a, list_append(list_transform(regexp_extract_all(text, 'artifact://sha256/[0-9a-f]{{64}}'), lambda m: CASE WHEN list_contains(known, substr(m, 19, 64)) THEN m ELSE '{A.UNRESOLVABLE}' END), '') AS b FROM t, kn)
SELECT doc_id, 0 AS ix, sha256(array_to_string(list_transform(list_zip(a, b), lambda x: concat(x[1], x[2])), '')) AS sha256 FROM z""",
    ),
    "anc17_neutralized": (
        _messages(lambda m: _hashed(M.neutralized(m))),
        f"""WITH {_RUNS}, x AS (SELECT *, CASE WHEN vis THEN regexp_replace(t, '(?m)^## Anchors \\(verbatim, machine-extracted — do not paraphrase\\)', 'the Anchors section', 'g') ELSE t END AS u FROM runs)
SELECT session, pos, sha256(string_agg(u, '' ORDER BY run)) AS sha256, CAST(sum(CASE WHEN u <> t THEN 1 ELSE n END) AS BIGINT) AS n_blocks FROM x GROUP BY session, pos""",
    ),
    "red6_run_redaction": (
        _messages(lambda m: M.redacted_runs(m).select("session", "pos", F.sha2(F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), ""), 256).alias("sha256"), F.size("blocks").cast("long").alias("n_blocks"), "changed")),
        f"""WITH {_B}, h AS (SELECT *, CASE WHEN type IN ('text', 'reasoning') AND type IS NOT DISTINCT FROM lag(type) OVER (PARTITION BY session, pos ORDER BY ix) THEN 0 ELSE 1 END AS new FROM b), i AS (SELECT *, sum(new) OVER (PARTITION BY session, pos ORDER BY ix) AS run FROM h),
 q AS (SELECT session, pos, run, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY ix) AS t FROM i GROUP BY session, pos, run), x AS (SELECT *, regexp_extract(t, '(?i)\\bsk-[A-Za-z0-9_-]{{20,}}\\b') AS k FROM q), y AS (SELECT *, CASE WHEN k = '' THEN t ELSE replace(t, k, '[REDACTED:api_key:' || substr(sha256(k), 1, 4) || ']') END AS u FROM x)
SELECT session, pos, sha256(string_agg(u, '' ORDER BY run)) AS sha256, CAST(sum(CASE WHEN u <> t THEN 1 ELSE n END) AS BIGINT) AS n_blocks, bool_or(u <> t) AS changed FROM y GROUP BY session, pos""",
    ),
    "src1_event_at": (lambda spark, d: M.at(L.log_events(spark, d), 13).select("session", "seq", "type", "turn"), f"SELECT session, seq, type, turn FROM ({L.EVENTS_SQL}) WHERE seq = 13"),
    "src2_clocks": (
        lambda spark, d: M.clocks(L.log_events(spark, d)),
        f"""WITH e AS ({L.EVENTS_SQL}), g AS (SELECT session, coalesce(max(CASE WHEN type = 'turn/start' THEN turn END), 0) AS turn, coalesce(arg_max(step, seq) FILTER (type = 'step/start'), 0) AS step, coalesce(arg_max(type, seq) FILTER (type IN ('turn/start', 'turn/end')) = 'turn/start', false) AS open_turn,
 arg_max(provider, seq) FILTER (type = 'request/header') AS p, arg_max(model, seq) FILTER (type = 'request/header') AS m FROM e GROUP BY session) SELECT session, turn, step, open_turn, CASE WHEN p <> '' AND m <> '' THEN p END AS provider, CASE WHEN p <> '' AND m <> '' THEN m END AS model FROM g""",
    ),
    "src5_aligned": (
        lambda spark, d: M.aligned(B.table(spark, d, "conversations").selectExpr("conv_id AS session", "turn AS pos", "turn * 10 + CASE WHEN turn % 4 = 0 THEN 4 ELSE 3 END AS seq"), M.messages(L.blocks(spark, d))).select("session", "pos", "seq", "role", "source"),
        f"WITH {_B} SELECT DISTINCT c.conv_id AS session, c.turn AS pos, b.seq, b.role, b.source FROM conversations c JOIN b ON b.session = c.conv_id AND b.seq = c.turn * 10 + CASE WHEN c.turn % 4 = 0 THEN 4 ELSE 3 END",
    ),
    "src7_shadowed": (
        lambda spark, d: M.shadowed(M.messages(L.blocks(spark, d)), _spans(spark, d)).select("session", "pos", "seq", "role"),
        f"WITH {_B}, s AS ({SPANS}) SELECT DISTINCT b.session, b.pos, CASE WHEN s.session IS NULL THEN -1 ELSE b.seq END AS seq, b.role FROM b LEFT JOIN s ON b.session = s.session WHERE s.session IS NULL OR b.pos BETWEEN s.start AND s.\"end\"",
    ),
    "enc3_folded_outputs": (_messages(lambda m: E.folded_outputs(m).select("session", "pos", "before", F.sha2("text", 256).alias("sha256"))), None),
    "enc4_collisions": (_messages(lambda m: E.collisions(m, "payload 1\nthe same")), f"WITH {_B}, t AS (SELECT session, pos, string_agg(coalesce(text, ''), '' ORDER BY ix) AS t FROM b GROUP BY session, pos) SELECT session, bool_or(contains(t, 'payload 1' || chr(10) || 'the same')) AS collision FROM t GROUP BY session"),
    "enc5_encoded_payloads": (
        lambda spark, d: _payloads(spark, d, E.encoded_payloads).transform(_hashed),
        """WITH o AS ({O}), g AS (SELECT session, text, count(*) AS n, min(pos) AS a, max(pos) AS z FROM o GROUP BY session, text HAVING count(*) > 1), s AS (SELECT *, length(text) * (n - 1) - 27 - 24 * (n - 1) AS saved FROM g), w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY a) AS id FROM s WHERE saved >= 128),
 k AS (SELECT session FROM w GROUP BY session HAVING sum(saved) > 611), y AS (SELECT w.* FROM w JOIN k ON w.session = k.session)
SELECT o.session, o.pos, sha256(CASE WHEN y.id IS NULL THEN o.text WHEN o.pos = y.z THEN '[adaptive-tool:v1 define=' || y.id || ']' || chr(10) || o.text ELSE '[adaptive-tool:v1 ref=' || y.id || ']' END) AS sha256 FROM o LEFT JOIN y ON o.session = y.session AND o.text = y.text""".replace("{O}", "SELECT conv_id AS session, turn AS pos, 'payload ' || (turn % 2) || repeat('x', CAST(150 + conv_id % 5 * 150 AS INT)) AS text FROM conversations"),
    ),
    "enc6_payload_round_trip": (lambda spark, d: _payloads(spark, d, lambda m: E.decoded_payloads(E.encoded_payloads(m))).transform(_hashed), "SELECT conv_id AS session, turn AS pos, sha256('payload ' || (turn % 2) || repeat('x', CAST(150 + conv_id % 5 * 150 AS INT))) AS sha256 FROM conversations"),
    "enc9_canonical_json": (lambda spark, d: C.canonical(_json(spark, d)), """WITH c AS (SELECT doc_id, '{"a":[1,{"y":null,"z":"' || lang || '"}],"b":' || doc_id || ',"é":true}' AS canonical FROM documents) SELECT doc_id, canonical, sha256(canonical) AS sha256 FROM c"""),
    "pol2_pass_budget": (lambda spark, d: P.pass_budget(steps(spark, d), 2), f"WITH s AS ({STEPS}) SELECT session, event, greatest(0, 2 - count(*) OVER (PARTITION BY session, turn, step ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS \"left\" FROM s"),
    "pol3_cooldown": (lambda spark, d: P.cooled(steps(spark, d).filter("event % 5 < 2"), 3, 1), f"WITH s AS (SELECT * FROM ({STEPS}) WHERE event % 5 < 2) SELECT session, event, turn, coalesce(event - lag(event) OVER w >= 3 AND turn - lag(turn) OVER w >= 1, true) AS passed FROM s WINDOW w AS (PARTITION BY session ORDER BY event)"),
    "pol5_resolved": (
        lambda spark, d: P.resolved(_grid(spark, d)),
        f"""WITH g AS ({GRID.replace(' AS window', ' AS "window"')}), a AS (SELECT *, greatest(coalesce(CASE WHEN reserve < 1 THEN CAST(floor("window" * reserve) AS BIGINT) ELSE CAST(reserve AS BIGINT) END, CAST(floor(CASE WHEN default_max IS NULL THEN greatest("window" * 0.05::DOUBLE, max_tokens * 2.0::DOUBLE) ELSE least(CAST(default_max AS DOUBLE), greatest("window" * 0.05::DOUBLE, max_tokens * 2.0::DOUBLE)) END) AS BIGINT)), requested) AS output_reserve,
 CAST(floor("window" * ratio) AS BIGINT) AS wanted, CAST(floor("window" * retain_ratio) AS BIGINT) AS retain FROM g), b AS (SELECT *, least("window" - output_reserve, CASE WHEN max_input > 0 THEN max_input ELSE 4611686018427387904 END) AS usable FROM a), c AS (SELECT *, least(wanted, usable) AS threshold FROM b)
SELECT "window", ratio, requested, max_input, reserve, output_reserve, usable, threshold, CASE WHEN threshold = wanted THEN CAST(floor("window" * release_ratio) AS BIGINT) ELSE CAST(floor(threshold * release_ratio / ratio) AS BIGINT) END AS release, retain, CASE WHEN retain >= threshold THEN 'retain above threshold' WHEN output_reserve >= "window" THEN 'reserve above window' ELSE 'ok' END AS status FROM c""",
    ),
    "pol10_infeasible": (lambda spark, d: P.infeasible(B.surface(spark, d), 40), f"SELECT session, CAST(coalesce(sum(CASE WHEN role = 'system' THEN tokens END), 0) AS BIGINT) AS fixed, coalesce(sum(CASE WHEN role = 'system' THEN tokens END), 0) >= 40 AS infeasible FROM ({B.SURFACE_SQL}) GROUP BY session"),
    "rng2_price_check": (lambda spark, d: W.price_check(B.surface(spark, d)), f"SELECT session, CAST(sum(tokens) AS BIGINT) AS total, bool_and(tokens BETWEEN 0 AND 9007199254740991) AND sum(tokens) <= 9007199254740991 AS reusable FROM ({B.SURFACE_SQL}) GROUP BY session"),
    "rng1_stale": (
        lambda spark, d: W.stale(B.surface(spark, d).withColumn("seq", F.col("pos")), B.surface(spark, d).filter("session % 4 > 0 or pos < 2").withColumn("seq", F.when((F.col("session") % 7 == 0) & (F.col("pos") == 1), 99).otherwise(F.col("pos")))),
        f"WITH s AS ({B.SURFACE_SQL}) SELECT session, bool_or(NOT (session % 4 > 0 OR pos < 2) OR (session % 7 = 0 AND pos = 1)) AS stale FROM s GROUP BY session",
    ),
    "rng4_replaced": (
        lambda spark, d: W.replaced(B.surface(spark, d), _spans(spark, d), 20),
        f"""WITH s AS ({B.SURFACE_SQL}), p AS ({SPANS}), j AS (SELECT s.session, pos, tokens, p.start, coalesce(pos BETWEEN p.start AND p."end", false) AS is_new FROM s LEFT JOIN p ON s.session = p.session)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS pos, CASE WHEN is_new THEN 20 ELSE tokens END AS tokens, is_new, CAST(CASE WHEN start IS NULL THEN 0 ELSE 1 END AS BIGINT) AS generation FROM j WHERE NOT is_new OR pos = start""",
    ),
    "rng5_retained_chronology": (
        lambda spark, d: N.retained_chronology(_answers(spark, d), _spans(spark, d)),
        f"WITH {_MESSAGES}, s AS ({SPANS}), ch AS (SELECT p.session, max(CASE WHEN p.pos BETWEEN s.start AND s.\"end\" THEN p.seq END) AS inside, max(CASE WHEN p.pos > s.\"end\" THEN p.seq END) AS beyond FROM p JOIN s ON p.session = s.session WHERE delivered GROUP BY p.session) SELECT session, inside, greatest(inside, beyond) AS last_answer FROM ch",
    ),
    "rng6_span_keys": (
        lambda spark, d: W.span_keys(B.surface(spark, d), _spans(spark, d), "base"),
        f"WITH s AS ({B.SURFACE_SQL}), p AS ({SPANS}) SELECT s.session, sha256('base|' || string_agg(pos || ':' || tokens, ',' ORDER BY pos)) AS key FROM s JOIN p ON s.session = p.session WHERE pos BETWEEN p.start AND p.\"end\" GROUP BY s.session",
    ),
    "anc1_extracted": (_messages(C.extracted, 60), None),
    "anc9_items": (_messages(C.items), None),
    "anc13_carried_forward": (_messages(C.carried_forward), None),
    "anc18_checkpoints": (_messages(C.checkpoints, 200), None),
    "anc7_cited": (
        lambda spark, d: N.cited(M.profile(M.messages(L.blocks(spark, d))).withColumn("seq", F.col("pos")), spark.sql("SELECT repeat('ab', 32) AS sha256")),
        f"WITH {_MESSAGES}, u AS (SELECT session, pos AS seq, unnest(regexp_extract_all(text, 'artifact://sha256/[0-9a-f]{{64}}')) AS text FROM p) SELECT session, seq, text, text = 'artifact://sha256/' || repeat('ab', 32) AS resolved FROM u",
    ),
    "anc11_verbatim": (
        lambda spark, d: N.verbatim(N.anchors(B.drafts(spark, d)), B.drafts(spark, d).withColumn("text", F.regexp_replace("text", "src/", "lib/"))).distinct(),
        f"{D_} SELECT DISTINCT a.session, a.seq, a.kind, a.text FROM a JOIN d ON a.session = d.session AND a.seq = d.seq WHERE contains(replace(d.text, 'src/', 'lib/'), a.text)",
    ),
    "anc16_by_kind": (lambda spark, d: N.by_kind(N.distinct_anchors(N.anchors(B.drafts(spark, d)))), f"{D_} SELECT session, kind, count(*) AS n, min(seq) AS first_seq FROM u GROUP BY session, kind"),
    "dlv2_leading_labels": (
        lambda spark, d: N.leading_labels(_entries(spark, d)),
        f"WITH e AS ({ENTRIES}) SELECT DISTINCT session, seq, regexp_replace(regexp_replace(lower(unnest(regexp_extract_all(text, '(?i)(?:\\A|[.!?:\\n]+)[\\s*.)\\d-]*(Q\\d+|Question\\s?\\d+|Task\\s?\\d+)\\b', 1))), '\\s+', '', 'g'), '^question', 'q') AS label FROM e",
    ),
    "dlv6_pending": (_pending, f"WITH {_PENDING} SELECT session, seq, label, pending FROM pe"),
    "dlv5_open_items": (_open, f"WITH {_OPEN} SELECT session, label, seq FROM op"),
    "dlv7_reconciled": (
        lambda spark, d: N.reconciled(_open(spark, d), _tracked(spark, d).filter("session % 2 = 0")),
        f"WITH {_OPEN} SELECT session, seq, {_NOTE(N.UNRECONCILED)} AS note FROM op WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.session = op.session AND tr.label = op.label AND op.session % 2 = 0)",
    ),
    "dlv8_unmentioned": (
        lambda spark, d: N.notes(N.open_items(_pending(spark, d), N.leading_labels(_entries(spark, d))), N.UNMENTIONED, F.when(F.col("session") % 2 == 0, F.lit("artifact://x"))),
        None,
    ),
    "sum2_parsed": (lambda spark, d: C.parsed(_documents(spark, d)), None),
    "sum3_flat_parsed": (lambda spark, d: C.parsed(_flats(spark, d), True), None),
    "sum4_repaired": (lambda spark, d: C.repaired(_broken(spark, d)), None),
    "sum6_grounded": (lambda spark, d: C.grounded(_documents(spark, d), ["a payload 1 of it", "payload 2"]), None),
    "sum7_summaries": (lambda spark, d: C.summaries(_documents(spark, d), M.messages(L.blocks(spark, d)), 100), None),
    "sum12_usage": (lambda spark, d: C.usage(_counters(spark, d)), f"SELECT session, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(reasoning) AS BIGINT) AS reasoning FROM ({COUNTERS}) GROUP BY session"),
    "txt14_unescaped": (_value(lambda: F.sha2(T.unescape_newlines(T.escape_newlines(F.concat("text", F.lit("\\n\\\\\n")))), 256)), "SELECT doc_id, sha256(text || '\\n\\\\' || chr(10)) AS value FROM documents"),
    "txt15_quoted": (_value(lambda: T.quoted(F.concat(F.lit("a.b*(c)[d]\\ ^$"), F.col("lang")))), "SELECT doc_id, 'a\\.b\\*\\(c\\)\\[d\\]\\\\ \\^\\$' || lang AS value FROM documents"),
    "txt19_bullets": (_value(lambda: F.sha2(T.bullets(F.filter(F.slice(T.lines(F.col("text")), 1, 3), lambda x: F.length(x) > 100)), 256)), f"WITH {_LINES}, b AS (SELECT doc_id, list_filter(l[1:3], lambda x: length(x) > 100) AS l FROM l) SELECT doc_id, sha256(CASE WHEN len(l) = 0 THEN '- (none)' ELSE '- ' || array_to_string(l, chr(10) || '- ') END) AS value FROM b"),
    "uri1_addresses": (
        _docs(lambda x: x.select("doc_id", F.concat(T.address_of(F.sha2("text", 256)), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("")).alias("u")).select("doc_id", T.is_address(F.col("u")).alias("is_address"), T.digest_of(F.col("u")).alias("digest"))),
        "SELECT doc_id, doc_id % 3 <> 0 AS is_address, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS digest FROM documents",
    ),
    "art1_raw_range": (_docs(lambda x: S.raw_range(x, 10, 30)), "SELECT doc_id, substr(hex(encode(text)), 21, 40) AS bytes FROM documents"),
    "art2_read_bytes": (
        _docs(lambda x: S.read_range(x, "byte", 11, 40, 20).drop("byte_length")),
        f"""WITH {_CUTS}, a AS (SELECT *, coalesce(list_max(list_filter(ends, lambda x: x <= least(11, n))), 0) AS a, list_min(list_filter(ends, lambda x: x >= least(40, n))) AS b FROM c), z AS (SELECT *, b - a > 20 AS truncated, CASE WHEN b - a > 20 THEN list_min(list_filter(ends, lambda x: x >= a + 20)) ELSE b END AS z FROM a),
 t AS (SELECT *, substr(text, 1, list_position(ends, a) - 1) AS head, substr(text, 1, list_position(ends, z) - 1) AS upto, substr(text, 1, list_position(ends, z) - 2) AS before FROM z)
SELECT doc_id, substr(upto, length(head) + 1) AS text, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS line_start, CAST(1 + length(CASE WHEN z > a THEN before ELSE head END) - length(replace(CASE WHEN z > a THEN before ELSE head END, chr(10), '')) AS BIGINT) AS line_end, truncated FROM t""",
    ),
    "art2_read_lines_exact": (
        _docs(lambda x: S.read_range(x, "line", 2, 4).select("doc_id", F.sha2("text", 256).alias("sha256"), "line_start", "line_end")),
        "WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents), m AS (SELECT *, greatest(len(l), 1) AS n FROM l) SELECT doc_id, sha256(array_to_string(l[least(2, n):greatest(least(2, n), least(4, n))], '')) AS sha256, CAST(least(2, n) AS BIGINT) AS line_start, CAST(greatest(least(2, n), least(4, n)) AS BIGINT) AS line_end FROM m",
    ),
    "art5_read_report": (_docs(lambda x: S.read_report(x, "line", 1, 2, 64).select("doc_id", "report", "truncated")), None),
    "art3_grep_regex": (
        _docs(lambda x: A.grep(x, _FILE_RE, 1, True, 3)),
        f"""WITH {_LINES}, x AS (SELECT doc_id, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM x WHERE regexp_matches(line, '[A-Za-z]+tion[ ,.]'))
SELECT doc_id, line_no, greatest(line_no - 1, 1) AS line_start, least(line_no + 1, CAST(len(l) AS BIGINT)) AS line_end, array_to_string(l[greatest(line_no - 1, 1):line_no + 1], chr(10)) AS context FROM h WHERE k <= 3""",
    ),
    "art6_grep_report": (
        _docs(lambda x: A.grep_report(x, "token", 0, False, 2)),
        f"""WITH {_LINES}, x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM x WHERE contains(line, 'token')), g AS (SELECT doc_id, count(*) AS n, string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no) AS t FROM h WHERE k <= 2 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS hits, CASE WHEN n IS NULL THEN 'no matches' ELSE n || ' match(es)' || chr(10) || t || CASE WHEN n >= 2 THEN chr(10) || '(hit limit reached; narrow the pattern)' ELSE '' END END AS report FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    ),
    "acl4_opened": (
        lambda spark, d: S.opened(blobs(spark, d), B.references(spark, d), "t1", "confidential", 200),
        f"WITH {_REFS}, {_VISIBLE}, {_BLOBS} SELECT doc_id, CASE WHEN bl.sha256 NOT IN (SELECT sha256 FROM v) THEN 'MISSING' WHEN damaged THEN 'CORRUPT' WHEN odd THEN 'NOT_TEXT' ELSE 'OK' END AS status FROM bl",
    ),
    "acl5_audit": (lambda spark, d: S.audit(blobs(spark, d)), f"WITH {_BLOBS} SELECT doc_id, sha256 FROM bl WHERE damaged"),
    "acl6_stats": (
        lambda spark, d: S.stats(blobs(spark, d)).drop("mime"),
        f"""WITH {_BLOBS}, t AS (SELECT *, CASE WHEN damaged THEN text || '!' ELSE text END AS x FROM bl) SELECT doc_id, sha256, CAST(CASE WHEN odd THEN 2 ELSE octet_length(encode(x)) END AS BIGINT) AS byte_length, CASE WHEN NOT odd THEN CAST(CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + CASE WHEN x LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) END AS line_count, CASE WHEN odd THEN 'binary' ELSE 'utf-8' END AS encoding FROM t""",
    ),
    "acl7_tainted": (_tainted, f"WITH {_TAINT} SELECT doc_id, tainted FROM ta"),
    "acl8_downgrade": (lambda spark, d: S.downgrade(_tainted(spark, d), _targets(spark, d), ["p1"]), f"WITH {_TAINT} SELECT doc_id, tainted AND NOT (doc_id % 5 > 0 AND doc_id % 3 = 1) AS refused FROM ta"),
    "acl9_provenance": (lambda spark, d: _tainted(spark, d).select("doc_id", S.with_provenance(F.lit("summary"), F.col("tainted")).alias("summary")), f"WITH {_TAINT} SELECT doc_id, 'summary' || CASE WHEN tainted THEN chr(10) || '{S.SECRET_MARK}' ELSE '' END AS summary FROM ta"),
    "lif3_sweep": (lambda spark, d: A.sweep(_sweep_blobs(spark, d), B.references(spark, d), 500), f"WITH {_SWEEP} SELECT sha256, bytes FROM bl WHERE sha256 NOT IN (SELECT sha256 FROM lv)"),
    "lif3_sweep_report": (
        lambda spark, d: A.sweep_report(_sweep_blobs(spark, d), B.references(spark, d), 500, 100_000),
        f"WITH {_SWEEP}, x AS (SELECT bl.*, lv.sha256 IS NOT NULL AS live FROM bl LEFT JOIN lv ON bl.sha256 = lv.sha256) SELECT count_if(NOT live)::BIGINT AS blobs_removed, coalesce(sum(CASE WHEN NOT live THEN bytes END), 0)::BIGINT AS bytes_freed, coalesce(sum(CASE WHEN live THEN bytes END), 0)::BIGINT AS bytes_left, (SELECT count(*) FROM r WHERE retain_until <= 500) AS refs_removed, coalesce(sum(CASE WHEN live THEN bytes END), 0) > 100000 AS over FROM x",
    ),
    "snk4_put": (lambda spark, d: S.put(B.secrets(spark, d), B.references(spark, d), "t1", "confidential", 200, 400).drop("text"), None),
    "snk5_spilled": (_messages(lambda m: S.spilled(C.checkpoints(m, 40).filter("overflow <> ''").select("session", F.col("overflow").alias("text")), 200, False)), None),
    "red4_bytes": (lambda spark, d: R.redacted_bytes(blobs(spark, d)).select("doc_id", F.sha2("body", 256).alias("sha256"), "redacted"), None),
    "red10_hits": (lambda spark, d: R.hits_by_rule(B.secrets(spark, d)), None),
    "red7_blocks": (_messages(C.redacted_blocks), None),
    "red8_json_leaves": (lambda spark, d: C.redacted_json(_secret_json(spark, d)), None),
    "enc7_collisions": (lambda spark, d: C.holding(_json(spark, d), '"z'), "SELECT doc_id, false AS collision FROM documents"),
    "red9_wire_runs": (_messages(lambda m: M.redacted_runs(m, (("text", "reasoning"),)).select("session", "pos", F.size("blocks").cast("long").alias("n_blocks"), "changed")), None),
    "rep1_per_arm": (
        lambda spark, d: V.per_arm(_arms(spark, d), _uppers(spark, d)),
        f"""WITH r AS ({ARMS}), u AS (SELECT arm, CAST(sum(upper) AS BIGINT) AS upper FROM ({UPPERS}) GROUP BY arm)
SELECT r.arm, count(*) AS runs, CAST(count_if(fact_passed = fact_total) AS BIGINT) AS all_facts_correct_tasks, CAST(sum(fact_passed) AS BIGINT) AS fact_passed, CAST(sum(fact_total) AS BIGINT) AS fact_total,
 {", ".join(f"round(median({c}), 3) AS median_{c}" if k else f"median({c}) AS median_{c}" for c, k in V.MEDIANS.items())}, {", ".join(f"round(sum({c}), 3) AS {c}" if c.endswith("seconds") else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in V.SUMS + V.STATS)},
 CAST(coalesce(any_value(u.upper), 0) AS BIGINT) AS unknown_usage_upper_tokens FROM r LEFT JOIN u ON r.arm = u.arm GROUP BY r.arm""",
    ),
    "rep2_paired": (
        lambda spark, d: V.paired(_arms(spark, d), _jobs(spark, d)),
        f"""WITH x AS (SELECT r.*, history, expected, auto, settings FROM ({ARMS}) r JOIN ({JOBS}) j ON r.job = j.job), f AS (SELECT *, row_number() OVER (PARTITION BY "case", arm ORDER BY job) AS k FROM x WHERE arm IN ('baseline', 'compact'))
SELECT a."case", a.history = b.history AND a.expected = b.expected AS inputs_equal, a.settings = b.settings AND NOT a.auto AND b.auto AS settings_paired, a.fact_passed AS baseline_facts, b.fact_passed AS compact_facts, a.process_wall_seconds AS baseline_seconds, b.process_wall_seconds AS compact_seconds,
 a.total_tokens AS baseline_tokens, b.total_tokens AS compact_tokens, b.summary_wall_seconds AS summary_seconds, b.context_reduction_pct, round(100 * (b.total_tokens / a.total_tokens - 1), 2) AS token_change_pct FROM f a JOIN f b ON a."case" = b."case" WHERE a.k = 1 AND b.k = 1 AND a.arm = 'baseline' AND b.arm = 'compact'""",
    ),
    "red11_paths": (
        lambda spark, d: R.unpublishable(_paths(spark, d), ["private"], ["src/1.json", "src/7.tgz"]),
        f"SELECT path FROM ({PATHS}) WHERE path LIKE 'private/%' OR path LIKE 'tests/fixtures/%' OR path LIKE '%/.env%' OR path LIKE '%.csv' OR ((path LIKE '%.json' OR path LIKE '%.tgz') AND path NOT IN ('src/1.json', 'src/7.tgz'))",
    ),
    "rng3_open_calls": (_messages(lambda m: M.priced(m).select("session", "pos", "is_checkpoint", "has_system", "balanced")), f"WITH {_PRICED} SELECT session, pos, is_checkpoint, has_system, balanced FROM n"),
    "rng1_paired_range": (_messages(lambda m: W.select_range(M.priced(m), 60, 0.5, 10)), range_sql(f"WITH n AS (WITH {_PRICED} SELECT * FROM n)", 60, 0.5, 10)),
    "rep3_ledger": (
        lambda spark, d: V.ledger_faults(_attempts(spark, d).drop("k"), _attempts(spark, d).filter("k % 150 > 0").unionByName(_attempts(spark, d).filter("k % 400 = 0").withColumn("wire", F.lit("W"))), 5),
        f"""WITH a AS ({ATTEMPTS}), s AS (SELECT job, "index", purpose, wire FROM a), l AS (SELECT job, "index", purpose, wire FROM a WHERE k % 150 > 0 UNION ALL SELECT job, "index", purpose, 'W' FROM a WHERE k % 400 = 0),
 x AS (SELECT 'not listed' AS fault, * FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM l) UNION ALL SELECT 'not sent', * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM s) UNION ALL SELECT 'sent twice', * FROM (SELECT job, "index", purpose, wire FROM s GROUP BY ALL HAVING count(*) > 1))
SELECT fault, count(*) AS n FROM x GROUP BY fault UNION ALL SELECT 'limit', count(*) FROM a HAVING count(*) > 5""",
    ),
    "rep4_records": (
        lambda spark, d: V.record_faults(_records(spark, d), _plan(spark, d)),
        f"WITH c AS ({RECORDS}), p AS ({PLAN}), n AS (SELECT id, count(*) AS n FROM c GROUP BY id), x AS (SELECT c.id, CASE WHEN p.id IS NULL THEN 'not planned' WHEN n.n > 1 THEN 'twice' WHEN c.arm IS DISTINCT FROM p.arm THEN 'differs' WHEN exit_code <> 0 THEN 'failed' WHEN c.sha256 <> p.sha256 THEN 'changed' END AS fault FROM c LEFT JOIN p ON c.id = p.id JOIN n ON c.id = n.id) SELECT DISTINCT id, fault FROM x WHERE fault IS NOT NULL",
    ),
    "rep5_streamed": (
        lambda spark, d: V.streamed(_streams(spark, d)),
        f"""SELECT request, purpose, CAST(coalesce(sum(CASE WHEN ms % 4 = 0 THEN ms END), 0) AS BIGINT) AS prompt_tokens, CAST(2 * count_if(ms % 4 = 0) AS BIGINT) AS output_tokens, CAST(count_if(ms % 4 = 0) AS BIGINT) AS usages, CAST(count_if(ms % 4 = 1) AS BIGINT) AS cut, min(ms) AS first_ms FROM ({STREAMS}) WHERE line LIKE 'data: {{%' GROUP BY request, purpose""",
    ),
    "rep6_answers": (lambda spark, d: V.answer_checks(_replies(spark, d), {"owner": "en", "region": "r1"}), "SELECT doc_id AS job, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (lang = 'en')::INT + (doc_id % 2 = 1)::INT END AS BIGINT) AS passed, CAST(2 AS BIGINT) AS total FROM documents"),
    "rep7_usage_bounds": (lambda spark, d: V.usage_bounds(_requests(spark, d)), f"SELECT job, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS reported, CAST(sum(CASE WHEN tokens IS NULL THEN counted + cap ELSE tokens END) AS BIGINT) AS upper, CAST(count_if(tokens IS NULL) AS BIGINT) AS unknown FROM ({REQUESTS}) GROUP BY job"),
    "rep8_paired_timings": (
        lambda spark, d: V.paired_timings(_timings(spark, d)),
        f"WITH t AS (SELECT *, candidate / baseline AS ratio FROM ({TIMINGS})), g AS (SELECT name, list(baseline ORDER BY baseline) AS a, list(candidate ORDER BY candidate) AS b, list(ratio ORDER BY ratio) AS c, count_if(ratio < 1)::BIGINT AS wins, count(*) AS pairs FROM t GROUP BY name) SELECT name, a[pairs // 2 + 1] AS baseline, b[pairs // 2 + 1] AS candidate, round(c[pairs // 2 + 1], 9) AS ratio, wins, pairs FROM g",
    ),
    "rep9_output_digest": (_docs(V.output_digest), "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(doc_id || ':' || coalesce(text, '')), 1, 12) AS BIGINT)) AS BIGINT) AS digest FROM documents"),
    "rep11_committers": (
        _docs(lambda x: x.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "GitHub").otherwise("dev").alias("name"), F.when(F.col("doc_id") % 2 == 0, "noreply" + "@github.com").otherwise(F.concat("lang", F.lit("@users.noreply.github.com"))).alias("email")).select("doc_id", R.committer_allowed(F.col("name"), F.col("email"), True).alias("allowed"))),
        "SELECT doc_id, doc_id % 2 = 1 OR doc_id % 3 = 0 AS allowed FROM documents",
    ),
    "str1_pressure_log": (lambda spark, d: P.pressure_log(measured(spark, d), LIMITS), None),
    "str5_verified": (lambda spark, d: Z.verified(_signed(spark, d), _SECRET, 1700000100), "SELECT CAST(event_id AS STRING) AS event_id, CASE event_id % 5 WHEN 1 THEN 'bad_signature' WHEN 2 THEN 'stale_timestamp' WHEN 3 THEN 'malformed_signature' END AS reason FROM events"),
    "str5_signatures": (lambda spark, d: _signed(spark, d).select("event_id", Z.mac(Z.signed_text(), _SECRET).alias("mac")), f"WITH {_MACS} SELECT id AS event_id, mac FROM h"),
    "str6_admitted": (lambda spark, d: Z.admitted(_deliveries(spark, d).select("key", "n", "id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("stamp"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("now")), 300), None),
    "str9_current": (
        lambda spark, d: Z.current(B.table(spark, d, "conversations").selectExpr("conv_id AS session", "turn % 3 AS generation", "turn"), B.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session")).agg((F.max("turn") % 3).alias("generation"))),
        "WITH s AS (SELECT conv_id AS session, max(turn) % 3 AS g FROM conversations GROUP BY conv_id) SELECT session, turn % 3 AS generation, turn FROM conversations JOIN s ON conv_id = session WHERE turn % 3 = g",
    ),
    "str10_first_tokens": (
        lambda spark, d: V.first_tokens(B.table(spark, d, "events")),
        "WITH e AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s FROM events) SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, min(epoch_us(ts) - epoch_us(s)) / 1e6 AS seconds FROM e GROUP BY user_id, event_type",
    ),
}


def _payloads(spark: SparkSession, d: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tool outputs that sessions repeat, as messages."""
    rows = spark.sql(
        "SELECT conv_id AS session, turn AS pos, turn AS seq, 'tool' AS role, 'tool' AS source, 'c' AS call_id, CAST(NULL AS BOOLEAN) AS is_error, 0L AS ix, 'text' AS type, CAST(NULL AS STRING) AS block_call, concat('payload ', CAST(turn % 2 AS STRING), repeat('x', CAST(150 + conv_id % 5 * 150 AS INT))) AS text FROM {c}",
        c=B.table(spark, d, "conversations"),
    )
    return f(M.messages(rows))
