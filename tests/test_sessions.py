"""Operators over messages and credentials on small made tables."""

import pytest

from ledgerloom.operators import anchors as N
from ledgerloom.operators import artifacts as A
from ledgerloom.operators import redaction as R

H = "0123456789abcdef" * 4


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("k AKIA" + "A1" * 8, "aws_key"), ("ghp_" + "a1B2" * 9, "github_token"), ("Sk-" + "ab_1" * 6, "api_key"), ("eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "jwt"),
        ('{"h":"Authorization: Bearer abc.def"}', "bearer_header"), ("-----BEGIN " + "PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "private_key"), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", "high_entropy"),
    ],
)
def test_each_rule_catches(spark, text, rule):
    got = R.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.hits == 1 and f"[REDACTED:{rule}:" in got.text


def test_publication_report_names_credentials(spark):
    texts = ["ghp_" + "a1B2" * 8, "github_pat_" + "a_B2" * 10, "sk-proj-" + "ab_1" * 6, "AKIA" + "A1" * 8, "-----BEGIN EC " + "PRIVATE KEY-----", "ghp_short sk-short AKIA1", None]
    got = R.publication_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, "GitHub token"), (1, "GitHub token"), (2, "API key"), (3, "API key"), (4, "private key")]


def test_kept_texts(spark):
    same = ["", "plain words", H[:40], f"artifact://sha256/{H}", "sk-short"]
    got = R.redacted(spark.createDataFrame([(i, t) for i, t in enumerate([*same, None])], "doc_id long, text string"))
    assert [r.text for r in got.orderBy("doc_id").collect()] == [*same, None]


def test_bearer_keeps_its_quotes(spark):
    got = R.redacted(spark.createDataFrame([(1, '{"h":"Authorization: Bearer abc"}')], "doc_id long, text string")).first().text
    assert got.startswith('{"h":"Authorization: Bearer [REDACTED') and got.endswith(']"}')


def test_pins_come_from_users_and_budget_passes_over_the_large(spark):
    rows = [("s", 0, "user", "MUST a\nMUST b?\n" + "never " + "x" * 400), ("s", 1, "assistant", "MUST c"), ("s", 2, "user", "MUST a"), ("t", 0, None, None)]
    found = N.distinct_anchors(N.anchors(spark.createDataFrame(rows, "session string, seq long, role string, text string")))
    assert {(r.text[:8], r.seq) for r in found.collect()} == {("MUST a", 2), ("never xx", 0)}
    kept = N.budgeted(found, 20).first()
    assert (kept.found, kept.n_kept, kept.kept) == (2, 1, "user_pins: MUST a")


def test_folding_inverts_and_leaves_marks_alone(spark):
    texts = [(1, "a line of text\n" * 6 + "b"), (2, "x\ny"), (3, "a line of text\n" * 3 + "z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folded = A.folded(docs)
    assert {r.doc_id: r.folds for r in folded.collect()} == {1: 1, 2: 0, 3: 0}
    assert sorted(map(tuple, A.unfolded(folded).collect())) == texts
    assert A.folded(spark.createDataFrame([(1, A.FOLD)], "doc_id long, text string")).count() == 0


def test_folding_loses_no_text(spark):
    run = "a line of text that repeats\n"
    texts = [(1, run * 6), (2, "a\nb\n"), (3, ""), (4, None), (5, "\n" * 70), (6, f"{run * 6}{A.FOLD}3]\nx\n"), (7, f"{A.FOLD}"), (8, run * 5 + "\n")]
    folded = A.folded_all(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.folds for r in folded.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 1}
    assert sorted(map(tuple, A.unfolded(folded).collect())) == texts
    other = [(1, f"{A.FOLD}x] is kept\n")]
    assert list(map(tuple, A.unfolded(spark.createDataFrame(other, "doc_id long, text string")).collect())) == other


@pytest.mark.parametrize(
    ("subject", "want"),
    [
        ("Q1, Q3: done", "q1 q3"), ("Question 2 done", "q2"), ("Task 4", "task4"), ("Q1-Q3 and Q5-7 done", "q1 q2 q3 q5 q6 q7"), ("Q2: compare with Q1", "q2"), ("Q2 - compare with Q1", "q2"), ("Q2 — as Q1", "q2"),
        ("Q1 - Q3: answered, not Q9", "q1 q2 q3"), ("1. Q1: answered", "q1"), ("Q1) as Q2", "q1"), ("Q1 (API) and Q2: completed", "q1 q2"), ("Q3-Q1", "q1 q3"), ("Q1-Q99", "q1 q99"), ("Q4-Q4 done", "q4"), ("FAQ1 moved", ""), (None, ""),
    ],
)
def test_labels_of_a_subject(spark, subject, want):
    got = N.label_ranges(spark.createDataFrame([("s", 0, subject)], "session string, seq long, subject string"))
    assert sorted(r.label for r in got.collect()) == want.split()


def test_store_adds_a_content_once(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    assert [A.store(docs, f"{tmp_path}/blobs") for _ in range(2)] == [2, 0]
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/blobs").collect()) == ["a", "b"]
