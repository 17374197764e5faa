"""The operators that SQL can't express, and the pipeline, against brute-force versions."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import ann, html_text, near_dups, packing, pii, quality, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = [
        None, "", "a@b.c@d.e.f +1 2 3 4 5 6 7 8 9 0", "1.2.3.4.5.6 256.1.1.1 001.02.3.255", "4111-1111 1111-1111 4111 1111 1111 1112", "x.y@z..w é@ü.de 🎉q@r.st", "+49 (0)30 1234-5678; +12 3; ++1 555 555 5555 1",
        "joe [at] mail [dot] example [dot] org, host fe80::1:2:3:4:5:6, tel. (555) 123-4567, card 4111 1111 1111 1111 1", "a" * 50 + " at " + "b" * 80 + " dot com", "+1 (017) 555-7713 " * 30,
    ]
    return spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_personal_data(spark, odd_docs, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_docs)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in pii.op1_boosted_candidates(spark, str(tmp_path)).collect():
        base = base_spans(text[r.doc_id])
        listed = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, _, k, _ in base) for kind in KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and len(spans) == len(base) + r.n_added
        place = [(int(a), list(KINDS).index(k), int(b)) for k, a, b in (x.split(":") for x in spans)]
        assert place == sorted(place)
        more = [(a, b) for (a, _, b), x in zip(place, spans, strict=True) if x not in listed]
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(more)) and not any(a < e and s < b for a, b in more for s, _, _, e in base)
    got = {r.doc_id: r.spans for r in pii.op1_boosted_candidates(spark, str(tmp_path)).filter("doc_id <= 0").collect()}
    whole = "a" * 50 + " at " + "b" * 80 + " dot com"
    assert got[-8] == f"email:0:{len(whole)}" and got[-7].startswith("email:0:37,ip:44:61") and ",phone:" in got[-7]


def test_boosted_trees_match_their_case_expressions(spark):
    from pyspark.sql import functions as F

    trees, least = pii.model(spark)
    rows = spark.createDataFrame(pii._templates()[:300], "kind int, match string, before string, label int")
    f = rows.select(pii._features(F.col("kind"), F.col("match"), F.col("before")).alias("f"), "label")
    got = f.select("f.*", sum((pii.RATE * pii._case(t, F.col("f")) for t in trees), F.lit(0.0)).alias("score"), "label").collect()
    x = np.array([tuple(r)[: len(pii.FEATURES)] for r in got], float)
    assert np.allclose([r.score for r in got], sum(pii.RATE * pii._value(t, x) for t in trees))
    assert len(least) == 4 and np.mean([(r.score >= least[int(r.kind)]) == bool(r.label) for r in got]) > 0.9


def distance(counts, reference):
    p = [c / sum(counts) for c in counts]
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, reference, strict=True))))


def test_quality_verdicts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    featured = quality.features(docs)
    refs = {r.tongue: r for r in quality.references(featured).collect()}
    for r in quality.judge(featured, quality.references(featured)).collect():
        t, q = r.text or "", r.quality
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert q.n_symbols == sum(c in "#*$%&|<>" for c in t) and q.n_dup_lines == len(lines) - len(set(lines))
        space = sum(c in " \t\n\x0b\x0c\r" for c in t)
        classes = [sum(a <= c <= b for c in t) for a, b in ("az", "AZ", "09")]
        symbols = sum(c in "#*$%&|<>" for c in t)
        signs = sum("!" <= c <= "~" for c in t) - sum(classes) - symbols
        counts = [*classes, symbols, signs, len(t) - space - sum(classes) - symbols - signs, space]
        far = False
        if r.lang in refs and len(t) >= quality.MIN_CHARS:
            d = distance(counts, refs[r.lang].class_ref)
            assert math.isclose(d, q.class_distance, abs_tol=1e-9)
            far |= d > quality.CLASS_LIMIT + quality.CLASS_SLACK / math.sqrt(len(t))
        if r.lang in quality.COMMON and len(w) >= quality.MIN_COMMON_WORDS:
            low = collections.Counter(re.split(r"[\x20\x09-\x0D.,;:!?]+", t.lower()))
            common = [low[x] for x in quality.COMMON[r.lang]]
            d = distance([*common, len(w) - sum(common)], refs[r.lang].word_ref)
            assert math.isclose(d, q.word_distance, abs_tol=1e-9)
            far |= d > quality.WORD_LIMIT + quality.WORD_SLACK / math.sqrt(len(w))
        assert q.kept == (not q.base_failed and not far)


def shingles(t):
    w = WORD.findall(t or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def classes_of(texts, least=0.8):
    bags = {t: shingles(t) for t in dict.fromkeys(texts)}
    root = {t: t for t in bags}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(bags, 2):
        all_ = sum((bags[a] | bags[b]).values())
        if all_ and sum((bags[a] & bags[b]).values()) >= least * all_:
            root[top(b)] = top(a)
    return {t: top(t) for t in bags}


def test_near_copies_about_the_limit(spark):
    """Copies of one text with few to many words changed, most pairs being between 0.7 and 0.9 alike; the clusters' inner links all count."""
    r = random.Random(5)
    pool = [f"w{i}" for i in range(5000)]
    texts = []
    for n, copies in ((90, 110), (250, 30), (40, 25)):
        master = r.sample(pool, n)
        for _ in range(copies):
            w = list(master)
            for i in r.sample(range(n), r.choice([0, 1, 1, 2, 2, 2, 3, 4, n // 6])):
                w[i] = f"v{r.randrange(10**6)}" if r.random() < 0.8 else "same"
            texts.append(" ".join(w[: n - r.choice([0, 0, 3])]))
    texts += [texts[0]] * 40 + ["alone " * 3, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = classes_of([t or "" for t in texts])
    rows, links = near_dups.near_duplicates(docs)
    rows = rows.collect()
    got = collections.defaultdict(set)
    for x in rows:
        got[x.comp].add(x.doc_id)
    expect = collections.defaultdict(set)
    for i, t in enumerate(texts):
        expect[want[t or ""]].add(i)
    assert set(map(frozenset, got.values())) == set(map(frozenset, expect.values()))
    distinct = len(set(texts))
    assert links.count() < 6 * distinct  # though the texts hold thousands of links
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.count() == len(expect)


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(240)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2100 + i) for i in range(50)] + [(3100 + i, 3500) for i in range(50)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.comp for x in near_dups.components(spark.createDataFrame(pairs, "a long, b long")).df.collect()}
    assert got == {x: top(x) for x in root}


def test_neighbours_rank_score_and_ties(spark):
    r = np.random.default_rng(8)
    x = r.integers(-3, 4, (700, 12)).astype(float)  # whole numbers: many ties, and exact products
    x[x.any(axis=1) == 0, 0] = 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(table.filter("vec_id % 20 = 0"), table).orderBy("query_id", "rank").collect()
    hits = 0
    for q, got in itertools.groupby(rows, lambda a: a.query_id):
        got = list(got)
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:20]
        assert [a.rank for a in got] == list(range(1, 21)) and q not in [a.vec_id for a in got]
        assert all(a.score == s[a.vec_id] for a in got)
        assert [(-a.score, a.vec_id) for a in got] == sorted((-a.score, a.vec_id) for a in got)
        hits += len({a.vec_id for a in got} & set(best.tolist()))
    assert hits >= 0.9 * 20 * 35


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(30):
        body = "".join(r.choice(["<p>{}</p>", "<div class=ad>{}</div>", "<li>{}</li>", "<div><p>{}</p><p><a href=x>link</a></p></div>", "<h2>{}</h2>"]).format(" ".join(["word"] * r.choice([1, 3, 8, 20])) + r.choice(["", "."])) for _ in range(r.randrange(2, 6)))
        found = [b for b in html_text.blocks(f"<body>{body}</body>") if b.text()]
        texts = [b.text() for b in found]
        w = html_text.fitted()
        lean = [html_text.odds(b, t, w) for b, t in zip(found, texts, strict=True)]

        def cost(side):
            total = sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(lean, side, strict=True))
            total += sum(html_text.NEIGHBOUR for a, b in itertools.pairwise(side) if a != b)
            for place in {b.path for b in found}:
                own = [s for s, b in zip(side, found, strict=True) if b.path == place]
                total += html_text.SIBLING * min(sum(own), len(own) - sum(own))
            return total

        best = min(map(cost, itertools.product([False, True], repeat=len(found))))
        assert math.isclose(cost(html_text.label(found, texts, w)), best, abs_tol=1e-9)


def test_pages_against_a_plain_reader(spark):
    """The made pages hold their text in one article of headings and paragraphs, which a few patterns can read."""
    import html

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.op7_min_cut(spark, SMALL).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)\b[^>]*>", article[1])] if article else []
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_a_form_that_holds_the_page_and_one_that_does_not():
    words = " ".join(["The lines of this text are long enough to be content."] * 4)
    assert html_text.main_text(f"<body><form><input type=hidden name=v><article><h1>T</h1><p>{words}</p></article></form></body>") == f"T\n\n{words}"
    assert html_text.main_text(f"<body><article><p>{words}</p><form><label>Your mail address</label><input name=x><button>Go</button></form></article></body>") == words
    assert html_text.main_text(f"<body><article><p>{words}</p><p class=legal>Terms apply to this offer.</p></article></body>") == f"{words}\n\nTerms apply to this offer."


def test_archive_larger_than_its_segments(spark, tmp_path):
    r = random.Random(3)
    magic = ["WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\n", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    rows = [(i, "u", "".join(r.choice(["x" * r.randrange(3000), r.choice(magic), "é\r\n\r\n"]) for _ in range(r.randrange(8)))) for i in range(300)]
    rows += [(1000, "u", ("y" * 700 + magic[1]) * 200), (1001, "u", "z" * 200_000), (1002, "u", "z" * 200_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # the archive has one file of some 80 segments
        got = sorted(map(tuple, warc.op5_boundary_chain(spark, str(tmp_path)).collect()))
        table = spark.read.parquet(str(tmp_path / "pages.parquet")).coalesce(1)
        warc.write(table, str(tmp_path / "archive"))
        back = {r.record_id: r.html for r in warc.read(spark, str(tmp_path / "archive"), html=warc.F.col("payload").cast("string")).filter("record_type = 'response'").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(duck.sql(warc.OP5_SQL).fetchall())
    assert got == want
    text = {i: h for i, _, h in rows}
    assert back == {f"<urn:page:{i}>": text[i] for i, _, _, kind, _ in want if kind == "response"}


def test_a_broken_archive_keeps_what_stands_before(spark, tmp_path):
    record = lambda i, body, n=None: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body) if n is None else n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.warc").write_bytes((record(1, "one") + record(2, "two", 7) + record(3, "three")).encode())
    (tmp_path / "a" / "2.warc").write_bytes((record(4, "four") + record(5, "five")[:-6]).encode())
    (tmp_path / "a" / "3.warc").write_bytes(b"junk" + record(6, "six").encode())
    assert [r.record_id for r in warc.read(spark, str(tmp_path / "a")).collect()] == ["<urn:page:1>", "<urn:page:4>"] or {r.record_id for r in warc.read(spark, str(tmp_path / "a")).collect()} == {"<urn:page:1>", "<urn:page:4>"}


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    pieces = packing.pack(docs, BPE).toPandas()
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.95


def test_pipeline(spark, tmp_path):
    """The five stages, one brute-force version after another, on documents with copies, shared passages and personal data."""
    small = [x.asDict() for x in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    good = sorted((x for x in small if x["lang"] == "en"), key=lambda x: -len(x["text"] or ""))[:8]
    half = lambda x: " ".join(WORD.findall(x["text"])[: len(WORD.findall(x["text"])) // 2])
    passage = " ".join(WORD.findall(good[4]["text"])[10:70])
    extra = [good[0]["text"] + " more", good[1]["text"], f"{half(good[2])} {passage}", f"{passage} {half(good[3])} write to x.y@z.example or call (555) 123-4567 now"]
    rows = [tuple(x[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for x in small] + [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    featured = quality.features(docs)
    kept = {x.doc_id: x.text for x in quality.judge(featured, quality.references(featured)).collect() if x.quality.kept}  # its verdicts are tested above
    text = {x[0]: x[1] for x in rows}
    assert all(kept[i] == text[i] for i in kept) and {10_000, 10_001, 10_002, 10_003} <= set(kept)

    stage = {name: f for name, f in corpus_pipeline.STAGES}
    first = stage["quality_rules"](spark, docs, "").cache()
    assert {x.doc_id for x in first.collect()} == set(kept)
    second = stage["near_dedup"](spark, first, "").cache()
    of = classes_of(list(kept.values()))
    left = {x.doc_id: x.text for x in second.collect()}
    assert len(left) == second.count() == len(set(of.values())) == len({of[t] for t in left.values()}) and all(left[i] == kept[i] for i in left)

    seen = collections.Counter(tuple(w[i : i + 35]) for t in left.values() for w in [WORD.findall(t)] for i in range(len(w) - 34))
    stripped = {}
    for i, t in left.items():
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        stripped[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    assert any(passage in t for t in left.values()) and not any(passage in t for t in stripped.values())
    third = stage["substring_dedup"](spark, second, "").cache()
    assert {x.doc_id: (x.text, x.n_chars) for x in third.collect()} == {i: (t, len(t)) for i, t in stripped.items()}

    spans = {x.doc_id: [(s.start, s.end, s.kind) for s in sorted([*x.pii.base, *x.pii.added])] for x in pii.find(third).collect()}
    clean = {}
    for i, t in stripped.items():
        assert {(a, e) for a, _, _, e in base_spans(t)} <= {(a, e) for a, e, _ in spans[i]}
        at, parts = 0, []
        for a, e, k in spans[i]:
            if a >= at:
                parts += [t[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        clean[i] = "".join(parts) + t[at:]
    fourth = stage["redaction"](spark, third, "").cache()
    assert {x.doc_id: (x.text, x.n_chars) for x in fourth.collect()} == {i: (t, len(t)) for i, t in clean.items()}
    assert any("[EMAIL]" in t and "[PHONE]" in t for t in clean.values())

    token = Tokenizer.from_file(BPE)
    pieces = collections.defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x.doc_id].append(x)
    assert set(pieces) == set(clean)
    for i, t in clean.items():
        ids = np.array([*token.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    assert bisect.bisect(sorted(clean), -1) == 0
