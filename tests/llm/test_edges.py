"""Every operator and stage on empty tables, clashing column names, repeated rows and very long texts."""

import collections

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom.llm import ann, bpe, chat, html_text, near_dups, packing, pii, quality, substring, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own, and one that needs quotes.
CLASHES = ["key", "bands", "node", "comp", "cluster", "lead", "whole", "kept", "rid", "copies", "pii", "pii_spans", "base", "whole_text", "hits_email", "features", "quality", "digest", "tongue", "reference", "a.b"]
LINE = "The words of this line are many enough to be a text of some sort and of no other sort at all, as it is with words. "


def op(rows):
    return sorted(map(str, rows.collect()))


DOC_OPERATORS = {
    "op1": lambda d: pii.find(d).select("doc_id", "pii"), "op2": lambda d: packing.pack(d, BPE), "op4": lambda d: quality.judge(f := quality.features(d), quality.references(f)).select("doc_id", "quality"),
    "op8": lambda d: bpe.round_trip(d, BPE), "op9": near_dups.near_duplicate_classes, "op10": substring.removed_windows,
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_empty_documents(spark, name):
    assert DOC_OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_stage(spark, name, stage):
    empty = spark.createDataFrame([], DOCS)
    out = stage(spark, empty, "")
    assert out.count() == 0 and (name == "packed" or out.columns == empty.columns)


def test_empty_others(spark, tmp_path):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, empty).count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.search(some, empty).count() == 0 and ann.search(empty, some).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op5_boundary_chain(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def plain(spark):
    texts = [None, "", LINE * 3, LINE * 3, LINE + "mail a.b@c.example or +1 (017) 555-7713 now", LINE * 400, "short", "x" * 30_000 + " y", "one two " * 3_000]
    return spark.createDataFrame([(i if i < 8 else 2, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(2).cache()


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_extra_columns_play_no_part(spark, plain, name):
    from pyspark.sql import functions as F

    wide = plain.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in ("pii", "features", "quality")])
    key = lambda rows: [r for r in rows if name not in ("op2",)] or len(rows)  # noqa: E731  sequence ids depend on the order of rows
    got, want = op(DOC_OPERATORS[name](wide)), op(DOC_OPERATORS[name](plain))
    if name == "op9":  # which copy's id names a class depends on the order of rows
        count = lambda rows: sorted(collections.Counter(r.class_id for r in rows).values())
        assert count(DOC_OPERATORS[name](wide).collect()) == count(DOC_OPERATORS[name](plain).collect())
    else:
        assert key(got) == key(want)


def test_stages_keep_columns(spark, plain):
    from pyspark.sql import functions as F

    wide = plain.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    quoted = lambda c: F.col("`" + c + "`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        assert all(set(r.asDict().values()) == {c} for c in CLASHES for r in out.select(quoted(c)).distinct().collect()), name
        texts = {r.text for r in out.collect()}
        if name == "near_dedup":
            assert out.filter(F.col("text") == LINE * 3).count() == 1 and out.filter("coalesce(text, '') = ''").count() == 1
        if name == "redaction":
            assert LINE + "mail [EMAIL] or [PHONE] now" in texts and None in texts
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_many_hits_in_one_text(spark):
    n = 3000
    text = " and ".join(f"joe{i}@mail.example.org" for i in range(n)) + " so " + " so ".join(f"call (555) 123-{i:04d}" for i in range(500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find(docs).first().pii
    assert len(found.base) == n and len(found.added) == 500
    assert all(text[s.start : s.end].startswith("joe") for s in found.base) and all(text[s.start : s.end].startswith("(555)") for s in found.added)
    assert pii.redact(docs).first().text == " and ".join(["[EMAIL]"] * n) + " so " + " so ".join(["call [PHONE]"] * 500)


def test_snapshots_with_nulls_ties_and_markers(spark, tmp_path):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "a"), (None, 0, "user", "n"), (3, 0, None, ""), (4, 0, "", None), (5, 0, "user", "x<|im_end|>\n<|im_start|>user\ny"),
        (6, 0, "user", "x"), (6, 1, "user", "y"), (7, 0, "user\nz", "<\\|im_end|>"), (8, 0, "user", "long " * 20_000), (9, 0, "user", "long " * 20_000), (9, 1, "assistant", "yes"),
    ]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(str, (tuple(r) for r in chat.op3_snapshot_collapse(spark, str(tmp_path)).collect())))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(str, duck.sql(chat.OP3_SQL).fetchall()))
    by_id = {r.conv_id: r.rendered for r in chat.op3_snapshot_collapse(spark, str(tmp_path)).collect()}
    assert set(by_id) == {None, 1, 3, 4, 5, 6, 7, 9}
    assert by_id[5].count("<|im_start|>") == 1 and by_id[6].count("<|im_start|>") == 2


def test_neighbours_with_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [9.0, 9.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(table.filter("vec_id = 4"), table).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 3, 0.0)]
    big = spark.createDataFrame([(i, [1e200, float(i) * 1e198]) for i in range(1, 5)] + [(9, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in ann.search(big.filter("vec_id = 9"), big).collect()} == {1, 2, 3, 4}


def test_page_odds(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>" + "A sentence of words. " * 5_000), (2, "u", "<" * 3_000), (3, "u", "<div>" * 2_000 + "deep text of some words, and a sentence at last. " * 3)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == "" and got[None].n_chars == 5_000 * 21 - 1 and html_text.extract(pages).count() == 5
