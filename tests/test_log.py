"""Messages, condensed sessions, the store, policies and streams on small made cases."""

import hashlib
import hmac
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import condense as C
from ledgerloom.functions import text as T
from ledgerloom.operators import artifacts as A
from ledgerloom.operators import condensed
from ledgerloom.operators import encodings as E
from ledgerloom.operators import messages as M
from ledgerloom.operators import policy as P
from ledgerloom.operators import redaction as R
from ledgerloom.operators import store as S
from ledgerloom.streaming import state as Z

H = "0123456789abcdef" * 4
WORD = "aB3dE5fGhJ7kL9mNpQrStUvWxYz012456789ACDF"
MESSAGE = "session long, pos long, seq long, role string, source string, call_id string, is_error boolean, ix long, type string, block_call string, text string"


def blocks(spark, *messages):
    """Each message: role, source, call_id, is_error, and its blocks (type, block_call, text)."""
    rows = [(1, p, p * 10, role, source, call, error, ix, *b) for p, (role, source, call, error, *own) in enumerate(messages) for ix, b in enumerate(own)]
    return M.messages(spark.createDataFrame(rows, MESSAGE))


def test_text_and_provenance(spark):
    found = blocks(
        spark, ("user", "user", None, None, ("text", None, "a"), ("reasoning", None, "b"), ("image", None, None), ("text", None, "c")), ("user", "tool", "c1", False, ("tool-result", "c1", "out")), ("user", "tool", "c1", False, ("tool-result", "c2", "out")),
        ("user", None, None, None, ("text", None, "x")), ("tool", "tool", "c1", None, ("text", None, "")), ("assistant", "assistant", None, None, ("reasoning", None, "only")), ("assistant", "assistant", None, None, ("text", None, "ok"), ("tool-call", "c9", "{}")),
        ("assistant", "assistant", None, None, ("text", None, "ok")), ("user", "compact-checkpoint", None, None, ("text", None, "## An"), ("text", None, M.HEADING[5:] + "\nx")),
    )
    got = {r.pos: r for r in M.profile(found).collect()}
    assert [got[i].text for i in range(6)] == ["ab\nc", "out", "out", "x", "", "only"]
    assert [got[i].tool_output for i in range(5)] == [False, True, False, False, True]
    assert [got[i].human for i in (0, 1, 3)] == [True, False, False] and [got[i].delivered for i in (5, 6, 7)] == [False, False, True] and got[8].checkpoint
    neutral = {r.pos: r for r in M.neutralized(found).collect()}
    assert neutral[8].text == "the Anchors section\nx" and neutral[8].n_blocks == 1 and neutral[0].n_blocks == 4


def test_credentials_cut_over_blocks(spark):
    key = "sk-" + "A" * 32
    found = blocks(spark, ("user", "user", None, None, ("text", None, "k " + key[:13]), ("text", None, key[13:] + " end")), ("user", "user", None, None, ("text", None, key[:13]), ("reasoning", None, key[13:])), ("assistant", "a", None, None, ("tool-call", "c", f'{{"k":"{key}"}}')))
    got = {r.pos: r for r in M.redacted_runs(found).collect()}
    assert got[0].changed and len(got[0].blocks) == 1 and got[0].blocks[0].text.startswith("k [REDACTED:api_key:") and got[0].blocks[0].text.endswith("] end")
    assert not got[1].changed and len(got[1].blocks) == 2 and "[REDACTED:api_key:" in got[2].blocks[0].text


@pytest.mark.parametrize(
    ("text", "want"),
    [("x sk-" + "a1" * 12 + "- y", "x # y".replace("#", "#-")), ("tok /" + WORD + "== z", "tok /#== z"), ("tok " + WORD + "==z", "tok #z"), ("[REDACTED:aws_key:0000] plain", "[REDACTED:aws_key:0000] plain")],
)
def test_edges_of_tokens(spark, text, want):
    got = R.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert __import__("re").sub(r"\[REDACTED:(?:api_key|high_entropy):[0-9a-f]{4}\]", "#", got.text) == want and got.hits == want.count("#")


def test_work_items():
    text = "Q1: do\nmore\n```\nQ9: no\n```\n2. other\nnot kept\n- Q2) list:\n1. a\n\n2. b\n Task 3:\n    Q4: code\nquestion 5. last"
    assert C.deliverables(text) == ["Q1: do\nmore\n```\nQ9: no\n```", "Q2) list:\n1. a\n\n2. b", "Task 3:\n    Q4: code", "question 5. last"]
    assert C.deliverables("Q1:\nQ2: ") == [] and C.deliverables("- ```\nQ1: a\n   ```\nQ2: b") == ["Q2: b"]


def test_quota_length_overflow_and_chronology():
    lines = "\n".join(f"error: e{i}" for i in range(5))
    m = [C.Message(1, lines, True), C.Message(2, lines + "\nerror: late"), C.Message(3, "MUST: a\nMUST: " + "x" * 400, True), C.Message(4, "said", delivered=True), C.Message(5, "MUST: a\nQ1: after", True)]
    found = C.extract(m, 10_000, quota=3)
    assert [a.text for a in found.kept if a.kind == "errors"] == ["error: e0", "error: e1", "error: e2", "error: e3", "error: e4", "error: late"]  # a match that a full quota turned away comes again
    assert [(a.text, a.seq) for a in found.kept if a.kind == "user_pins"] == [("MUST: a", 5)] and [a.seq for a in found.overflow] == [3]
    assert found.last_answer == 4 and "- deliverable_pending: Q1: after" in C.render(found) and "- constraint: MUST: xxx" in C.render(found)
    small = C.extract(m, 20)
    assert sum(map(C.cost, small.kept)) <= 20 and f"- overflow: {len(small.overflow)} more anchors → u" in C.render(small, "u")
    assert C.extract([C.Message(-1, "see a/b.py"), C.Message(-1, "a/b.py")], 99).kept[0].text == "a/b.py"


def test_checkpoints_hand_on():
    found = C.extract([C.Message(1, "Q1: a\\b\nsecond line", True)], 0)
    body = C.render_summary(C.parse('{"schema_version": 1, "task_state": {}}'), found, "artifact://sha256/" + H)
    assert f"- deliverable_ref: Q1 (full text: artifact://sha256/{H})" in body
    back = C.carried(body, 7)
    assert [(a.kind, a.pointer, a.stub, a.seq) for a in back] == [("deliverables", "artifact://sha256/" + H, True, -700_001)]
    again = C.extract([C.Message(7, body, checkpoint=True)], 10_000)
    assert [a.text for a in again.kept] == [f"Q1 (full text: artifact://sha256/{H})"]
    whole = C.render(C.extract([C.Message(1, "Q1: a\\b\nsecond line", True)], 10_000))
    assert C.carried(f"{C.HEADING}\n{whole}", 2)[0].text == "Q1: a\\b\nsecond line"


def test_documents():
    doc = {"schema_version": 1, "task_state": {"goal": 3, "open": ["Q1-Q3: later", 4]}, "files": [{"path": "a", "artifact": "zz"}, 5], "errors": [{"message": "m", "resolved": "yes"}]}
    got = C.parse(f"so {json.dumps(doc)} end }}")
    assert got["task_state"] == {"goal": "", "current_plan": [], "completed": [], "open": ["Q1-Q3: later"]} and got["files"][1] == {"path": "", "operation": "touched", "artifact": None} and got["errors"][0]["resolved"] is False
    assert C.ground(got, ["a zz b"])["files"][0]["artifact"] == "zz" and C.ground(got, ["z z"])["files"][0]["artifact"] is None
    for bad in ("none", '{"schema_version": 2, "task_state": {}}', '{"schema_version": 1, "task_state": []}', '{"schema_version": 1, "task_state": {}, "tests": "x"}', '{"a": '):
        with pytest.raises(C.Refused):
            C.parse(bad)
    assert not C.has_content(C.parse('{"schema_version": 1, "task_state": {"goal": " "}, "files": [{"operation": "touched"}], "tests": [{}]}')) and C.has_content(C.parse('{"schema_version": 1, "task_state": {}, "tests": [{"failing": ["x"]}]}'))
    fixed, done = C.repair('```json\n{"schema_version":1,"task_state":{"goal":"g","completed":"c","next_step":"n"}\n```')
    assert done == ["closed-outer-object", "promoted-next_step", "wrapped-completed"] and C.parse(fixed)["next_step"] == "n"
    assert C.repair('{"schema_version":1,"task_state":{"next_step":"a"},"next_step":"b"}')[1] == [] and C.repair('{"schema_version":1,"task_state":{}')[1] == ["closed-outer-object"]
    found = C.extract([C.Message(1, "Q1: a\nQ2: b", True), C.Message(2, "x", delivered=True)], 10_000)
    notes = C.open_work(C.parse('{"schema_version": 1, "task_state": {"completed": ["Q1: done"]}}'), found)
    assert len(notes) == 1 and notes[0].startswith("Q2: not reflected")
    flat = {"schema_version": 1, "goal": "g", "completed": [], "open": [], "state": ["s"], "constraints": [], "next_step": ""}
    assert C.parse_flat(json.dumps(flat))["critical_facts"] == ["s"]
    for change in ({"x": 1}, {"goal": 1}, {"goal": " ", "state": []}, {"open": [1]}):
        with pytest.raises(C.Refused):
            C.parse_flat(json.dumps(flat | change))
    assert C.canonical({"b": 1.0, "a": [None, {"é": "\n", "z": True}]}) == '{"a":[null,{"z":true,"é":"\\n"}],"b":1}'


def test_reads_widen_to_characters_and_lines(spark):
    docs = spark.createDataFrame([(1, "aé€\n🎉b\nc\n"), (2, ""), (3, "x")], "doc_id long, text string")
    read = lambda *a: {r.doc_id: r for r in S.read_range(docs, *a).collect()}
    got = read("byte", 2, 4)[1]
    assert (got.text, got.line_start, got.line_end, got.truncated) == ("é€", 1, 1, False)
    assert read("byte", 8, 9)[1].text == "🎉" and read("byte", 8, 9)[1].line_start == 2
    assert read("line", 2, 99)[1].text == "🎉b\nc\n" and read("line", 2, 99)[1].line_end == 3 and read("line", 0, 1)[1].text == "aé€\n"
    cut = read("line", 1, 3, 2)[1]
    assert (cut.text, cut.truncated, cut.line_end) == ("aé", True, 1)
    assert read("line", 1, 1)[2].text == "" and read("byte", 5, 9)[3].text == "" and read("byte", 0, 9)[3].byte_length == 1


def test_writing_redacts_cuts_and_claims(spark):
    refs = spark.createDataFrame([(1, H, "t1", 1, "secret", 9)], "ref_id long, sha256 string, tenant string, session long, label string, retain_until long")
    docs = spark.createDataFrame([(1, f"see artifact://sha256/{H} AKIA{'A1' * 8}"), (2, "é" * 30), (3, "ok")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.put(docs, refs, "t1", "internal", 5, 41).collect()}
    assert got[1].text.startswith("see (artifact reference removed") and got[1].redacted and got[1].truncated
    assert got[2].text == "é" * 21 and got[2].truncated and not got[2].redacted and got[3].sha256 == got[3].original_sha256 and got[3].retain_until == 5 + 30 * 86_400_000
    assert S.put(docs, refs, "t1", "internal", 5, 41, retention_days=0).first().retain_until == S.FOREVER


def test_payloads_are_encoded_and_decoded(spark):
    out = lambda text, error=None: ("tool", "tool", "c", error, ("text", None, text))
    body, other = "p" * 900, "q" * 200
    found = blocks(spark, out(body), out(other), ("user", "user", None, None, ("text", None, "between")), out(body), out(body, True), out(other), out(body), out("short"), out("short"))
    encoded = {r.pos: r.text for r in E.encoded_payloads(found).collect()}
    assert encoded[0] == encoded[3] == "[adaptive-tool:v1 ref=1]" and encoded[6] == "[adaptive-tool:v1 define=1]\n" + body and encoded[4] == body and encoded[7] == "short"
    assert (encoded[1], encoded[5]) == ("[adaptive-tool:v1 ref=2]", "[adaptive-tool:v1 define=2]\n" + other)
    assert {r.pos: r.text for r in E.decoded_payloads(E.encoded_payloads(found)).collect()} == {0: body, 1: other, 3: body, 4: body, 5: other, 6: body, 7: "short", 8: "short"}
    assert {r.text for r in E.encoded_payloads(blocks(spark, out(other), out(other))).collect()} == {other}  # too little for the rule
    assert E.encoded_payloads(blocks(spark, out(body), out(body), ("user", "user", None, None, ("text", None, "[adaptive-"), ("text", None, "tool:v1 x")))).count() == 0
    for bad in ([("r", "[adaptive-tool:v1 ref=3]")], [("a", "[adaptive-tool:v1 define=1]\nx"), ("b", "[adaptive-tool:v1 define=1]\ny")]):
        with pytest.raises(Exception, match="payload def|defined twice"):
            E.decoded_payloads(spark.createDataFrame([(1, i, t) for i, (_, t) in enumerate(bad)], "session long, pos long, text string")).collect()


def test_unfolding_refuses_large_counts(spark):
    docs = spark.createDataFrame([(1, f"a\n{A.FOLD}2000000]\n")], "doc_id long, text string")
    with pytest.raises(Exception, match="outside its bound"):
        A.unfolded(docs).collect()


def test_settings_are_checked():
    assert P.PROFILES["cloud-l"].release_ratio == 0.55 and P.StoreSettings().chunk_lines == 120
    for bad in ({"threshold_ratio": 1.5}, {"release_ratio": 0.9}, {"max_passes": 0}, {"kinds": ("x",)}, {"local_providers": ("",)}, {"absorb_floor": 1.1}):
        with pytest.raises(ValueError, match="must|holds"):
            P.Policy(**bad)
    assert P.Policy(absorb_floor=1.0).absorb_floor == 1.0
    with pytest.raises(ValueError, match="overlap"):
        P.StoreSettings(chunk_overlap=120)


def machine_rows(n=400):
    r = random.Random(6)
    return [(s, e, e // 6, e // 2, float(r.randrange(100)), float(r.choice([0, 10, 30])), r.choice([None, None, "busy", "low-savings", "other"]), r.choice(["k1", "k2", None])) for s in range(4) for e in range(1, n // 4)]


def test_machine():
    limits = P.Limits(50, 40, 2, 0, 2)
    s = P.State()
    assert P.decide(s, 1, 1, 1, 49, 5, None, None, limits) == ("below", 49) and P.decide(s, 2, 1, 1, 60, 15, None, None, limits) == ("released", 30)
    assert P.decide(s, 3, 1, 1, 60, 15, None, None, limits)[0] == "cooldown" and P.decide(s, 4, 1, 2, 80, 15, None, None, limits) == ("exhausted", 50) and s.passes == 2
    assert P.decide(s, 6, 1, 2, 80, 15, None, None, limits) == ("exhausted", 80)  # the step has no pass left
    for event in (8, 10):
        assert P.decide(s, event, 2, event, 80, 1, "low-savings", "k", limits)[0] == "failed"
    assert P.decide(s, 12, 2, 12, 80, 1, None, "k", limits) == ("suppressed", 80) and P.decide(s, 14, 2, 14, 80, 50, None, "other", limits) == ("released", 30)


def test_stream_decides_like_the_batch(spark, tmp_path):
    schema = "session long, event long, turn long, step long, total double, saving double, failed string, key string"
    rows = machine_rows(160)
    limits = P.Limits(50, 40, 2, 0, 2)
    cut = [20, 30, 99]
    for i, stop in enumerate(cut):
        part = [x for x in rows if (cut[i - 1] if i else 0) < x[1] <= stop]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = Z.pressure_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), limits).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, P.pressure_log(spark.createDataFrame(rows, schema), limits).collect()))
    assert got == want and len({x[2] for x in got}) >= 5


def test_replay_guard_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.unionAll(events.limit(100)).coalesce(1).write.parquet(str(tmp_path / "in"))
    guarded = Z.replay_guard(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = guarded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(60) and spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_admission_against_a_plain_guard(spark):
    r = random.Random(1)
    rows, now = [], 0
    for n in range(300):
        now += r.randrange(60)
        rows.append(("k", n, r.randrange(6), now - r.randrange(200), now))
    seen, want = {}, {}
    for _, n, i, stamp, at in rows:
        seen = {k: v for k, v in seen.items() if at - v <= 300}
        want[n] = i not in seen
        if want[n]:
            seen[i] = stamp
    got = {x.n: x.admitted for x in Z.admitted(spark.createDataFrame(rows, "key string, n long, id long, stamp long, now long"), 300).collect()}
    assert got == want and 0 < sum(want.values()) < 300


def test_signatures(spark):
    good = "v1=" + hmac.new(b"key", b"1:e.3:100.body", "sha256").hexdigest()
    rows = [("a", "100", good, "body"), ("e", "100", good, "body"), ("e", "100", good, "other"), ("e", "500", good, "body"), ("e", "x", good, "body"), ("e", "100", "v2=" + good[3:], "body"), ("e", "-250", good, "body"), ("e", "100", good.upper().replace("V1", "v1"), "body")]
    docs = spark.createDataFrame([(e, s, g, b) for e, s, g, b in rows], "event_id string, stamp string, signature string, body string").coalesce(1)
    assert [r.reason for r in Z.verified(docs, "key", 110).collect()] == ["bad_signature", None, "bad_signature", "stale_timestamp", "malformed_signature", "malformed_signature", "stale_timestamp", None]


def test_escapes_and_addresses(spark):
    texts = ["a\\n\n\\\\", "", "\n", "\\"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in docs.select(T.unescape_newlines(T.escape_newlines(F.col("t")))).collect()] == texts
    with pytest.raises(Exception, match="no digest"):
        docs.select(T.address_of(F.col("t"))).collect()


def test_a_checkpoint_of_a_session(spark):
    found = blocks(spark, ("user", "user", None, None, ("text", None, "MUST: keep\nQ1: item")), ("user", None, None, None, ("text", None, "MUST: forged")), ("assistant", "a", None, None, ("text", None, "done")))
    got = condensed.checkpoints(found, 100, share=0.99).first()
    assert "MUST: keep" in got.body + got.overflow and "forged" not in got.body + got.overflow and got.last_answer == 20
    assert condensed.extracted(found, 1000).filter("kind = 'user_pins'").count() == 1


def test_blocks_keep_their_number(spark):
    key = "sk-" + "A1" * 16
    assert C.redacted_run(["k " + key[:9], "", key[9:20], key[20:] + " end"])[1:3] == ["", ""] and "".join(C.redacted_run(["k " + key[:9], key[9:] + " end"])) == C.redacted_text(f"k {key} end")[0]
    assert C.redacted_run([key, " plain"]) == [C.redacted_text(key)[0], " plain"] and C.redacted_run(["a", "b"]) == ["a", "b"]
    found = blocks(spark, ("user", "user", None, None, ("text", None, "k " + key[:13]), ("text", None, key[13:]), ("image", None, None), ("reasoning", None, key)))
    got = [r.text for r in condensed.redacted_blocks(found).orderBy("ix").collect()]
    assert len(got) == 4 and key not in "".join(got) and "".join(got).count("[REDACTED:api_key:") == 2


def test_both_forms_of_redaction_agree(spark):
    from ledgerloom.sources.tables import secrets

    docs = secrets(spark, "/root/testdata/sf0.001")
    for r in R.redacted(docs).join(docs.withColumnRenamed("text", "raw"), "doc_id").collect():
        assert (r.text, r.hits) == C.redacted_text(r.raw)


def test_json_leaves_and_marks():
    key = "sk-" + "a1" * 12
    assert C.redacted_leaves({key: [key, {"x": "plain"}, 3, None]}) == {key: [C.redacted_text(key)[0], {"x": "plain"}, 3, None]}
    block = lambda t, kind="text": {"type": kind, "text": t}
    assert C.holds([block("[ma"), block("rk]", "reasoning")], "[mark]") and not C.holds([block("[ma"), {"type": "image"}, block("rk]")], "[mark]") and C.holds({"a": [1, {"b": "x[mark]"}]}, "[mark]")


def test_claims_and_contents_on_disk(spark, tmp_path):
    refs = spark.createDataFrame([(1, H, "t1", 1, "secret", 9)], "ref_id long, sha256 string, tenant string, session long, label string, retain_until long")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    path = f"{tmp_path}/claims"
    assert S.read_claims(spark, path).count() == 0 and S.read_contents(spark, f"{tmp_path}/blobs").count() == 0
    claims = S.put(docs, refs, "t1", "internal", 5, 99).drop("text", "doc_id").withColumn("session", F.lit("s"))
    for _ in range(2):
        S.add_claims(claims, path)
        A.store(docs, f"{tmp_path}/blobs")
    got = S.read_claims(spark, path)
    assert got.count() == 6 and got.select("ref_id").distinct().count() == 6 and S.read_contents(spark, f"{tmp_path}/blobs").count() == 2
    assert A.sweep(S.read_contents(spark, f"{tmp_path}/blobs"), got, 2**62).count() == 2


def test_signatures_with_long_and_empty_secrets(spark):
    docs = spark.createDataFrame([("é", "0", "v1=" + hmac.new(b"k" * 70, "1:é.1:0.b".encode(), "sha256").hexdigest(), "b"), ("é", "NaN", None, None), ("é", "0", None, None)], "event_id string, stamp string, signature string, body string").coalesce(1)
    assert [r.reason for r in Z.verified(docs, "k" * 70, 0).collect()] == [None, "malformed_signature", "malformed_signature"]
    assert {r.reason for r in Z.verified(docs, "", 0).collect()} == {"bad_signature"}


def test_calls_without_results_stay_open(spark):
    call = lambda i: ("tool-call", i, "{}")
    found = blocks(
        spark, ("system", "system", None, None, ("text", None, "s")), ("assistant", "a", None, None, call("c1"), call("c2"), call("c1")), ("tool", "tool", "c2", None, ("text", None, "x")), ("user", "tool", "c1", False, ("tool-result", "c1", "y")),
        ("assistant", "a", None, None, call("c1")), ("user", "compact-checkpoint", None, None, ("text", None, "12345")), ("user", "tool", "c1", False, ("tool-result", "other", "y")),
    )
    got = M.priced(found).orderBy("pos").collect()
    assert [r.open_calls for r in got] == [0, 0, 2, 1, 0, 1, 1] and [r.balanced for r in got] == [True, True, False, False, True, False, False]
    assert all(r.has_system for r in got) and [r.pos for r in got if r.is_checkpoint] == [5] and got[5].tokens == 2


def test_exempt_addresses(spark):
    texts = ["a@example.com", "a@users.noreply.github.com x", "a@example.community", "a@example.com@b.org", "%@b.org", "é%@b.org", "a@b.c", "x.a%@b.org!", "a@b.org_"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in R.publication_report(docs).collect()) == [2, 3, 7]


def test_paths_of_local_data(spark):
    paths = ["private/a.py", "a/private/b.py", "tests/fixtures/x.py", "a/.env/b", "a/.envrc", "a.json", "ok.json", ".json", "b.tgz", "a.txt", "a.py"]
    got = [r.path for r in R.unpublishable(spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1), ["private"], ["ok.json"]).collect()]
    assert got == ["private/a.py", "tests/fixtures/x.py", "a/.env/b", "a/.envrc", "a.json", "b.tgz", "a.txt"]


def test_info_files_and_stale_temporaries(spark, tmp_path):
    folder = tmp_path / "sha256" / "01"
    folder.mkdir(parents=True)
    for v in (1, 2):
        name = S.write_info(spark, str(folder), H, {"v": v})
    assert json.loads((folder / f"{H}.info.json").read_text()) == {"v": 2} and name.endswith(f"{H}.info.json") and not list(folder.glob(".*.tmp"))
    (folder / f".{H}.x.tmp").write_text("12345")
    now = int(time.time() * 1000)
    assert S.sweep_temps(spark, str(tmp_path), now) == (0, 0) and S.sweep_temps(spark, str(tmp_path / "none"), now) == (0, 0)
    assert S.sweep_temps(spark, str(tmp_path), now + 2 * S.TEMP_AGE) == (1, 5) and S.sweep_temps(spark, str(tmp_path), now + 2 * S.TEMP_AGE) == (0, 0)


def test_a_timer_sweeps(spark, tmp_path):
    folder = tmp_path / "sha256" / "01"
    folder.mkdir(parents=True)
    (folder / ".a.tmp").write_text("123")
    seen = []
    query = Z.sweep_on_timer(spark, str(tmp_path), "1 second", 0, seen)
    try:
        end = time.time() + 60
        while not any(n for n, _ in seen) and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert (1, 3) in seen and not list(folder.iterdir())


def test_running_states_of_one_key_over_hours(spark):
    from ledgerloom.operators import evidence, reports

    r = random.Random(3)
    rows, at = [], 0
    for i in range(400):
        at += r.choice([1, 30, 4000, 9000])
        rows.append((i * 40_000 % 999_983, r.choice([1, None]), at, r.choice([5.0, 10.0, 15.0, 70.0, None])))
    events = spark.createDataFrame(rows, "event_id long, user_id int, at long, value double").withColumn("ts", F.timestamp_seconds("at"))
    low, active, late = {}, {}, {}
    for user in (1, None):
        own = sorted((x for x in rows if x[1] == user), key=lambda x: (x[2], x[0]))
        on = False
        for k, (i, _, _, v) in enumerate(own):
            low[i] = k >= 2 and all(x[3] is not None and x[3] < 20 for x in own[k - 2 : k + 1])
            on = on if v is None or 10 <= v < 60 else v >= 60
            active[i] = on
        now = 0
        for i, _, t, _ in sorted(own):
            now = max(now, t)
            late[i] = t < now - 5000
    assert {x.event_id: x.suppressed for x in reports.low_savings(events, 20.0).collect()} == low and 5 < sum(low.values()) < 300
    assert {x.event_id: x.active for x in Z.hysteresis(events, 60.0, 10.0).collect()} == active and 5 < sum(active.values()) < 395
    assert {x.event_id for x in reports.on_time(events, 5000).collect()} == {i for i, v in late.items() if not v} and any(late.values())
    kinds = events.withColumn("event_type", F.lit("k"))
    assert {x.user_id: x.seconds for x in evidence.first_tokens(kinds).collect()} == {1: 0.0, None: 0.0}


def test_output_digest_of_many_rows(spark):
    from ledgerloom.operators.evidence import output_digest

    def want(ids):
        total = sum(int(hashlib.sha256(f"{i}:{i % 7 or ''}".encode()).hexdigest()[:12], 16) for i in ids)
        return total, (total + 2**63) % 2**64 - 2**63

    rows = spark.range(150_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("text"))
    for n, least in (60_000, 0), (100_000, 2**63), (150_000, 2**64):
        total, digest = want(range(n))
        assert least < total < 2 * max(least, 2**62) and output_digest(rows.filter(F.col("doc_id") < n)).collect() == [(n, digest)]
    few = rows.limit(0).unionByName(spark.createDataFrame([(None, "x"), (3, "3")], "doc_id long, text string"))
    assert output_digest(few).collect() == [(2, want([3])[0])]
    assert output_digest(few.filter("doc_id is null")).collect() == [(1, None)] and output_digest(rows.limit(0)).collect() == [(0, None)]
