"""Registered queries over messages, credentials, stored contents and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import anchors as N
from ledgerloom.operators import artifacts as A
from ledgerloom.operators import redaction as R
from ledgerloom.operators import reports as P
from ledgerloom.sources import tables as T

BUDGET = 120
_q = lambda s: "'" + s.replace("'", "''") + "'"
_PATTERNS = ", ".join(f"({_q(k)}, {_q(p)})" for k, p in N.PATTERNS)
D_ = f"""WITH d AS ({T.DRAFTS_SQL}), l0 AS (SELECT session, seq, role, string_split(text, chr(10)) AS l FROM d), l AS (SELECT session, seq, role, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM l0),
 p(kind, re) AS (VALUES {_PATTERNS}),
 marked AS (SELECT DISTINCT session, seq, line_no, kind, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM l, p WHERE regexp_matches(CASE kind WHEN 'user_pins' THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') ELSE line END, re) AND (kind <> 'user_pins' OR (role = 'user' AND NOT regexp_matches(line, '[?？]\\s*$')))),
 files AS (SELECT session, seq, line_no, 'files' AS kind, regexp_replace(m, '^[\\s"''`(]', '') AS text FROM (SELECT session, seq, line_no, unnest(regexp_extract_all(line, {_q(N.FILE)})) AS m FROM l)),
 a AS (SELECT * FROM marked UNION ALL SELECT * FROM files),
 u AS (SELECT session, kind, text, CASE WHEN kind = 'user_pins' THEN max(seq) ELSE min(seq) END AS seq, count(*) AS seen FROM a GROUP BY session, kind, text, CASE WHEN kind = 'deliverables' THEN seq ELSE -1 END)"""
_rank = lambda order: f"list_position([{', '.join(map(_q, order))}], kind)"
_NORMAL = "regexp_replace(regexp_replace(lower({}), '\\s+', '', 'g'), '^question', 'q')"
_RANGES = f"rr AS (SELECT session, seq, unnest(range(a, b + 1)) AS i FROM (SELECT session, seq, TRY_CAST(regexp_extract(subject, {_q(N.RANGE)}, 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(subject, {_q(N.RANGE)}, 2) AS BIGINT) AS b FROM d) WHERE b >= a AND b - a <= {N.SPAN})"
_R = f"r AS ({T.REFS_SQL})"
_L = "['public', 'internal', 'confidential', 'secret']"


def _messages(f, *more):
    return lambda spark, d: f(T.drafts(spark, d), *more)


def _anchors(f, *more):
    return lambda spark, d: f(N.distinct_anchors(N.anchors(T.drafts(spark, d))), *more)


def _unresolved(spark, d):
    m = T.drafts(spark, d)
    return N.unresolved(N.line_anchors(m), N.label_ranges(m.filter("role = 'assistant'")))


def _missing(spark, d):
    m = T.drafts(spark, d)
    return N.missing(N.distinct_anchors(N.anchors(m)), m)


def _on(read, f):
    return lambda spark, d: f(read(spark, d))


def _hashed(df):
    return df.withColumn("sha256", F.sha2("text", 256)).drop("text")


def _redact_sql() -> str:
    """The rules one after another, in RE2, which has no look-around."""
    steps, last = [f"x0 AS (SELECT doc_id, text, 0 AS h FROM ({T.SECRETS_SQL}))"], "x0"
    for i, (name, before, pattern) in enumerate(R.RULES, 1):
        re = _q(pattern.replace(R._B, r"\b").replace(R._E, r"\b"))
        hit = f"len(regexp_extract_all(text, {re}))"
        secret = f"regexp_replace(m, {_q(before)}, '')" if before else "m"
        kept = f"regexp_extract(m, {_q(before)})" if before else "''"
        new = f"concat({kept}, '[REDACTED:{name}:', substr(sha256({secret}), 1, 4), ']')"
        steps.append(f"x{i} AS (SELECT doc_id, {_zip(re, new)} AS text, h + {hit} AS h FROM {last})")
        last = f"x{i}"
    token = r"\b[A-Za-z0-9+/_-]{32,}={0,2}\b"
    chars = "string_split(m, '')"
    bits = f"list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda y: y = c)) / length(m)) * log2(len(list_filter({chars}, lambda y: y = c)) / length(m))))"
    re = _q(R.URI + "|" + token)
    safe = f"starts_with(m, {_q('artifact://')}) OR {bits} < 4.0"
    new = f"CASE WHEN {safe} THEN m ELSE concat({_q('[REDACTED:high_entropy:')}, substr(sha256(m), 1, 4), {_q(']')}) END"
    return f"WITH {', '.join(steps)} SELECT doc_id, CAST(h + len(list_filter(regexp_extract_all(text, {re}), lambda m: NOT ({safe}))) AS BIGINT) AS hits, sha256({_zip(re, new)}) AS sha256 FROM {last}"


def _zip(re: str, new: str) -> str:
    return f"array_to_string(list_transform(list_zip(string_split_regex(text, {re}), list_append(list_transform(regexp_extract_all(text, {re}), lambda m: {new}), '')), lambda z: concat(z[1], coalesce(z[2], ''))), '')"


CATALOGUE = {
    "anc3_line_anchors": (_messages(N.line_anchors), f"{D_} SELECT session, seq, line_no, kind, text FROM marked"),
    "anc5_file_anchors": (_messages(N.file_anchors), f"{D_} SELECT session, seq, line_no, kind, text FROM files"),
    "anc10_distinct_anchors": (_anchors(lambda a: a), f"{D_} SELECT * FROM u"),
    "anc12_budget_fold": (
        _anchors(N.budgeted, BUDGET),
        f"""{D_}, g AS (SELECT session, count(*) AS found, list({{'u': CAST(ceil(length(text) / 4.0) AS BIGINT) + {N.OVERHEAD}, 'k': [concat(kind, ': ', text)]}} ORDER BY {_rank(N.PROTECTED)}, seq DESC, text) AS l FROM u GROUP BY session),
 f AS (SELECT session, found, list_reduce(list_prepend({{'u': CAST(0 AS BIGINT), 'k': CAST([] AS VARCHAR[])}}, l), lambda a, b: CASE WHEN a.u + b.u <= {BUDGET} THEN {{'u': a.u + b.u, 'k': list_concat(a.k, b.k)}} ELSE a END) AS o FROM g)
SELECT session, found, o.u AS used, CAST(len(o.k) AS BIGINT) AS n_kept, array_to_string(o.k, chr(10)) AS kept FROM f""",
    ),
    "anc14_rendered": (_anchors(N.rendered), f"{D_} SELECT session, string_agg(concat('- ', kind, ': ', text), chr(10) ORDER BY {_rank(N.RENDERED)}, seq, text) AS body FROM u GROUP BY session"),
    "enc10_missing_anchors": (_missing, f"{D_}, z AS (SELECT session, arg_max(text, seq) AS answer FROM d GROUP BY session) SELECT u.session, kind, text, seq FROM u JOIN z ON u.session = z.session WHERE NOT contains(answer, text)"),
    "dlv1_labels": (_messages(N.labels), f"{D_} SELECT session, seq, {_NORMAL.format('label')} AS label FROM (SELECT session, seq, regexp_extract(text, {_q(N.LABEL)}, 2) AS label FROM d) WHERE label <> ''"),
    "dlv3_label_ranges": (_messages(N.label_ranges), f"{D_}, {_RANGES} SELECT session, seq, concat('q', CAST(i AS STRING)) AS label FROM rr"),
    "dlv5_unresolved": (
        _unresolved,
        f"""{D_}, {_RANGES}, t AS (SELECT DISTINCT rr.session, concat('q', CAST(i AS STRING)) AS label FROM rr JOIN d ON rr.session = d.session AND rr.seq = d.seq WHERE d.role = 'assistant'),
 i AS (SELECT session, {_NORMAL.format(f"regexp_extract(text, {_q(N.LABEL)}, 2)")} AS label, count(*) AS n, min(seq) AS seq FROM marked WHERE kind = 'deliverables' GROUP BY ALL)
SELECT i.session, i.label, n, seq FROM i LEFT JOIN t ON i.session = t.session AND i.label = t.label WHERE t.label IS NULL OR n > 1""",
    ),
    "red1_redact": (_on(T.secrets, lambda df: _hashed(R.redacted(df).drop("by_rule"))), _redact_sql()),
    "red11_publication_report": (
        _on(T.secrets, R.publication_report),
        f"""WITH s AS ({T.SECRETS_SQL}), p(rule, re) AS (VALUES {', '.join(f'({_q(n)}, {_q(p)})' for n, p in R.REPORT if n != R.EMAIL[0])}), m AS (SELECT doc_id, unnest(list_zip(string_split(text, '@')[:-2], string_split(text, '@')[2:])) AS x FROM s)
SELECT doc_id, rule FROM s, p WHERE regexp_matches(text, re) UNION ALL SELECT DISTINCT doc_id, '{R.EMAIL[0]}' FROM m WHERE regexp_matches(x[1], '\\w[A-Za-z0-9._%+-]*$') AND regexp_matches(x[2], '^[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') AND NOT regexp_matches(x[2], '^(users\\.noreply\\.github\\.com|example\\.(com|org|net|invalid))\\b')""",
    ),
    "uri2_found": (_on(T.cited, A.uris), f"WITH c AS ({T.CITED_SQL}) SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'artifact://sha256/([0-9a-f]{{64}})', 1))) AS sha256 FROM c"),
    "uri3_scrubbed": (
        lambda spark, d: _hashed(A.scrubbed(T.cited(spark, d), A.visible(T.references(spark, d), "t1", "confidential", 200))),
        f"""WITH c AS ({T.CITED_SQL}), {_R}, v AS (SELECT list(DISTINCT sha256) AS known FROM r WHERE tenant = 't1' AND retain_until > 200 AND list_position({_L}, label) <= 3)
SELECT doc_id, sha256({_zip("'artifact://sha256/[0-9a-f]{64}'", "CASE WHEN list_contains(known, substr(m, 19, 64)) THEN m ELSE '(artifact reference removed: not readable from this session)' END")}) AS sha256 FROM c, v""",
    ),
    "acl4_authorized": (
        lambda spark, d: A.authorized(T.table(spark, d, "documents"), T.references(spark, d), "t1", "confidential", 200),
        f"WITH {_R}, v AS (SELECT DISTINCT sha256 FROM r WHERE tenant = 't1' AND retain_until > 200 AND list_position({_L}, label) <= 3) SELECT doc_id, CASE WHEN v.sha256 IS NOT NULL THEN 'OK' ELSE 'MISSING' END AS status FROM documents LEFT JOIN v ON sha256(text) = v.sha256",
    ),
    "lif1_released": (
        lambda spark, d: A.released(T.references(spark, d), T.table(spark, d, "labels").filter("toxic = 1").withColumnRenamed("doc_id", "ref_id")).select("ref_id", "tenant", "sha256"),
        f"WITH {_R} SELECT ref_id, tenant, sha256 FROM r WHERE NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND labels.doc_id = r.ref_id)",
    ),
    "lif2_expired": (_on(T.references, lambda r: A.expired(r, 300)), f"WITH {_R} SELECT sha256, count(*) AS dropped FROM r WHERE retain_until <= 300 GROUP BY sha256"),
    "lif5_totals": (lambda spark, d: A.totals(T.table(spark, d, "documents")), "SELECT count(*) AS blobs, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT sha256(text) AS s, octet_length(encode(text)) AS b FROM documents)"),
    "enc1_folded": (
        _on(T.runs, lambda df: _hashed(A.folded_all(df))),
        f"""WITH t AS ({T.RUNS_SQL}), l0 AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM t WHERE NOT contains(text, '[adaptive-repeat:v1 additional=')), x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM l0),
 y AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS g FROM x), z AS (SELECT doc_id, min(i) AS i, line, count(*) AS n FROM y GROUP BY doc_id, line, g),
 w AS (SELECT *, concat('[adaptive-repeat:v1 additional=', CAST(n - 1 AS STRING), ']', chr(10)) AS mark FROM z), v AS (SELECT *, n >= 4 AND line LIKE '%' || chr(10) AND length(line) * (n - 1) > length(mark) + 32 AS worth FROM w),
 f AS (SELECT doc_id, CAST(sum(CAST(worth AS INT)) AS BIGINT) AS folds, string_agg(CASE WHEN worth THEN concat(line, mark) ELSE repeat(line, n) END, '' ORDER BY i) AS text FROM v GROUP BY doc_id)
SELECT t.doc_id, coalesce(folds, 0) AS folds, sha256(coalesce(f.text, t.text)) AS sha256 FROM t LEFT JOIN f ON t.doc_id = f.doc_id""",
    ),
    "enc2_round_trip": (_on(T.runs, lambda df: _hashed(A.unfolded(A.folded_all(df)))), f"WITH t AS ({T.RUNS_SQL}) SELECT doc_id, sha256(text) AS sha256 FROM t"),
    "enc5_payload_groups": (
        _on(T.payloads, A.payload_groups),
        f"""WITH m AS ({T.PAYLOADS_SQL}), g AS (SELECT session, payload, count(*) AS n, min(pos) AS a, max(pos) AS z FROM m GROUP BY session, payload HAVING count(*) > 1 AND (count(*) - 1) * length(payload) >= 128),
 i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY a) AS id FROM g) SELECT m.session, pos, id, CASE WHEN pos = z THEN 'define' ELSE 'refer' END AS part FROM m JOIN i ON m.session = i.session AND m.payload = i.payload""",
    ),
    "src12_delivered": (_on(T.drafts, lambda m: P.delivered(m)), f"WITH d AS ({T.DRAFTS_SQL}) SELECT session, max(seq) AS last_answer, count(*) AS answers FROM d WHERE role = 'assistant' AND regexp_matches(text, '\\S') GROUP BY session"),
    "pol11_admission": (_on(T.surface, P.admission), f"WITH s AS ({T.SURFACE_SQL}), g AS (SELECT session, CAST(sum(tokens) AS BIGINT) AS before, CAST(coalesce(sum(CASE WHEN is_checkpoint THEN tokens END), 0) AS BIGINT) AS after FROM s GROUP BY session) SELECT *, before - after >= 64 AS saves, before + 512 <= 2000 AS fits, greatest(0, least(1024, CAST(floor(before * 0.25) AS BIGINT))) AS anchor_budget FROM g"),
    "str4_low_savings_runs": (
        lambda spark, d: P.low_savings(T.table(spark, d, "events"), 20.0),
        """WITH e AS (SELECT *, value < 20 AS low FROM events), g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
 k AS (SELECT event_id, user_id, low, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g) SELECT event_id, user_id, coalesce(b, 0) >= 2 AS suppressed FROM k""",
    ),
    "str5_late_filter": (
        lambda spark, d: P.on_time(T.table(spark, d, "events"), 300),
        "SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS now FROM events) WHERE ts >= now - INTERVAL 300 SECOND",
    ),
    "rep10_inventory": (
        lambda spark, d: P.inventory(T.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256")), T.table(spark, d, "labels").selectExpr("doc_id AS path", "sha2(CAST(quality AS STRING), 256) AS sha256").distinct()),
        "WITH a AS (SELECT doc_id AS path, sha256(text) AS s FROM documents), b AS (SELECT DISTINCT doc_id AS path, sha256(CAST(quality AS STRING)) AS s FROM labels) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'left' WHEN a.path IS NULL THEN 'right' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.s IS DISTINCT FROM b.s",
    ),
}
