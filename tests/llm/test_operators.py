"""The subpackage's operators on small tables with odd cases, each against a brute-force version."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import ann, bpe, chat, html_text, near_dups, packing, pii, quality, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the cat sat on a mat and looked at the moon while it was rising over hills of sand with no one there to see what came from that".split()
TEXTS = [
    None, "", " \n\t", "one two three", " ".join(PROSE * 3), " ".join(PROSE * 3), " ".join(PROSE * 3 + ["extra", "words"]), " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(20, 90)),
    "mail joe.x@mail.example.org or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.0.0.255 é🎉", "x" * 20_000, "a\nb\na\nb\n" * 30, "<|endoftext|> and ½ <|endoftext|>", " ".join(["same"] * 200),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1, 2), (None, "null id of this row", "xx", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(3)


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_duplicates(docs):
    rows = docs.collect()
    by_text = {r.text or "": shingles(r.text) for r in rows}
    root = {t: t for t in by_text}

    def top(t):
        return t if root[t] == t else top(root[t])

    for a in by_text:
        for b in by_text:
            both, all_ = sum((by_text[a] & by_text[b]).values()), sum((by_text[a] | by_text[b]).values())
            if a < b and all_ and both >= 0.8 * all_:
                root[top(b)] = top(a)
    want = collections.Counter(collections.Counter(top(r.text or "") for r in rows).values())
    got = near_dups.near_duplicates(docs)[0].collect()
    assert len(got) == len(rows)
    assert collections.Counter(collections.Counter(r.comp for r in got).values()) == want
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(want.values())


@pytest.mark.parametrize("hot", [1, 1000])
def test_substring(docs, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    rows = docs.collect()
    seen = collections.Counter(tuple(words(r.text)[i : i + 35]) for r in rows for i in range(len(words(r.text)) - 34))
    want = []
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in substring.removed_windows(docs).collect())
    assert substring.strip_repeats(docs).columns == docs.columns


def test_bpe_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = {str(r.doc_id): r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs, path).collect():
        ids = t.encode(rows[str(r.doc_id)], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).toPandas()
    for r in docs.filter("doc_id is not null and doc_id <> 4").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in pieces[pieces.doc_id == r.doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_pii(docs):
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    got = [(pii.KINDS[s.kind], TEXTS[9][s.start : s.end]) for s in found[9].pii.base]
    assert got == [("email", "joe.x@mail.example.org"), ("phone", "+1 (017) 555-7713"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255")]
    assert not any(found[i].pii.base for i in (0, 1, 2, 3, 10))
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[9] == "mail [EMAIL] or [PHONE], card [CARD], ip [IP] é🎉" and out[0] is None and out[10] == TEXTS[10]


def test_quality(docs):
    for r in quality.judge(f := quality.features(docs), quality.references(f)).collect():
        w = words(r.text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        n = len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        assert (r.quality.n_words, r.quality.n_repeat_words, r.quality.word_chars) == (len(w), n, sum(map(len, w)))
        assert r.quality.base_failed == (len(w) < 20 or 100 * n > 30 * len(w))
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_references_hold_against_junk(spark):
    clean = [" ".join(np.random.default_rng(i).permutation(PROSE * 3)) for i in range(80)]
    shout = ["A LINE OF CAPITALS NUMBER " * 2 + " ".join(f"W{chr(65 + j % 26)}{chr(65 + (j * k) % 26)}" for j in range(60)) for k in range(24)]
    far = [" ".join("".join(map(chr, word)) for word in np.random.default_rng(i).integers(1072, 1104, (70, 5))) for i in range(60)]
    texts = [("en", t, "clean") for t in clean] + [("en", shout[0], "junk")] * 60 + [("en", t, "junk") for t in shout]
    texts += [("ru", t, "clean") for t in far] + [("nl", t, "clean") for t in clean] + [(None, t, "clean") for t in [*clean, *far]]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string, kind string").repartition(3)
    kept = quality.keep_good(docs).groupBy("lang", "kind").count().collect()
    assert {(r.lang, r.kind): r["count"] for r in kept} == {("en", "clean"): 80, ("ru", "clean"): 60, ("nl", "clean"): 80, (None, "clean"): 140}


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    inner = "<p>WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" + "x" * 5000 + "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(1, "u\n x", "é" * 60), (2, None, "é" * 60), (3, "u", None), (5, "u", inner), (7, "u", inner), (8, "u", "\r\n\r\n" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, warc.op5_boundary_chain(spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.sql(warc.OP5_SQL).fetchall())


def test_snapshots(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, 0, "user", "z")]
    got = {r.conv_id: r.n_turns for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: 2, 4: 1, 5: 1}


def test_main_text():
    page = "<body><header><p>Site name here.</p></header><nav><a href=x>Home</a></nav><div id=content><h1>A title</h1><p>Words of the <b>article</b> &amp; more.<br>They go on.<p>Short.</div><div class=comments><p>Nice article, thanks a lot!</p></div><footer>(c)</footer>"
    assert html_text.main_text(page) == "A title\n\nWords of the article & more. They go on.\n\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == ""


@pytest.mark.parametrize("place", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<main><div class='layout sidebar-right'><article>{}</article></div></main>", "<article><div class='entry-content share-on'>{}</div></article>"])
def test_main_text_leaves_insets_out(place):
    words = " ".join(["The lines of this text are long enough to be content."] * 4)
    insets = ["<div class=ad>A sentence.</div>", f"<div class='comments'><p>{words * 20}</p></div>", f"<ol class=comment-list><li><article class='comment-body'><p>{words}</p></article></li></ol>", f"<div id=newsletter><h2>News</h2><p>{words}</p></div>", f"<section class='notice'>{words}</section>"]
    for inset in insets:
        assert html_text.main_text(f"<body>{place.format(f'<p>First. {words}</p>{inset}<p>Last. {words}</p>')}</body>") == f"First. {words}\n\nLast. {words}"


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[100:200] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for row in ann.search(table.filter("vec_id % 20 = 0"), table).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    hit = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(got[q]) & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit / (20 * 75) >= 0.9 and 5020 not in got


def test_neighbours_of_each_length(spark):
    x = np.random.default_rng(4).normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [9.0] * 12), (101, [1.0] * 12), (102, [5.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.query_id: r.vec_id for r in ann.search(table, table, top=1).collect()}
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    assert got == dict(enumerate(near.argmax(axis=1).tolist())) | {100: 101, 101: 100}


def test_neighbours_beyond_twenty_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_SHARDS", 1)
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [a.vec_id for a in ann.search(table.filter("vec_id = 7"), table, top=150).orderBy("rank").collect()]
    s = x.astype(float) @ x[7].astype(float)
    s[7] = -np.inf
    assert len(got) == 150 and len(set(got) & set(np.argsort(-s)[:150].tolist())) >= 140
    tied = spark.createDataFrame([(1000 - i, [1.0, float(i)]) for i in range(1, 91)], "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [a.vec_id for a in ann.search(asked, tied, top=5).orderBy("rank").collect()] == list(range(910, 915))
