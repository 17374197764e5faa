"""Personal data: candidate spans from high-recall generators, selected by gradient-boosted trees. DataFrame operations only.

Base spans (e-mail, IPv4, card, phone in international form) come from fixed patterns and checks and always stay. Further
generators propose spelled-out e-mail addresses, national phone numbers, long digit groups and IPv6 addresses; boosted trees over
format features (digits, groups, brackets, checksum) and context features (cue words before the span) score them, and a
threshold calibrated on held-out rows selects. The trees are fitted on SAMPLE rows made from templates with a fixed seed, whose
features pass through the same expressions as the documents', and are compiled to CASE expressions.

Proposals that touch a base span go; of proposals that overlap each other the one with the higher score stays, from the text's
start on. The threshold of each kind is calibrated by itself.

All work on a document stays in its row; nothing is shuffled. Lists of spans are folded in blocks of about the square root of
their number, so a text with n spans costs n ** 1.5 small steps, not n * n copies.

Defined cases: null is the empty text and has no spans; spans that touch or overlap are redacted as one, under the first
one's kind; a very long text is one value, searched whole; repeated rows are handled alike; an empty table gives an empty table; other
columns, whatever their names, are untouched.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import free_name, own

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Their loops are possessive, which matches the same spans without recursion; a match of the
# first two begins where a run of its characters begins, or where the match before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: High-recall generators of further spans, with the kind each proposes.
MORE = [
    ("email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++(?: ?[\[({]at[\])}] ?| at )[A-Z0-9-]++(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Z0-9-]++){1,126}"),  # a domain has at most 127 labels
    ("phone", r"(?<![0-9A-Za-z+.:/-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z:/-]|\.[0-9])"),
    ("card", r"(?<![0-9A-Za-z.-])[0-9]{3,6}(?:[ -]?[0-9]{3,6}){2,5}(?![0-9A-Za-z-]|\.[0-9])"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}::|(?:[0-9A-Fa-f]{1,4}:){2,7}:?)(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
]
CUES = {
    "email": r"mail|contact|write to|reach", "ip": r"\bip\b|ipv6|host|server|address|node|gateway", "card": r"card|visa|credit|debit|amex|payment",
    "phone": r"tel\b|tel[.:]|phone|call|fax|mobile|cell|sms|dial",
}
AGAINST = r"version|order|isbn|invoice|serial|part|page|date|\bref|sku|model|build|score|\bid\b|time|release|chapter|figure|years?|lot"
CONTEXT = 28
SAMPLE, TREES, DEPTH, RATE, PRECISION, SEED = 4000, 30, 3, 0.3, 0.99, 20240229
FEATURES = ["kind", "digits", "groups", "brackets", "colons", "letters", "luhn", "same", "date", "first", "last", "spelled", "cue", "against", "length"]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(v: Column) -> Column:
    """A list that is not empty in slices of about the square root of its size."""
    wide = F.ceil(F.sqrt(F.size(v))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / wide).cast("int")), lambda b: F.slice(v, b * wide + 1, wide))


def _fold(items: Column, state: Column, none: Column, step, last=None) -> Column:
    """The elements that step(state, item) = (next state, elements) gives for each item in order, and last(state) at the end. none: an empty array of such elements.

    Blocks of items are folded one after another and joined at the end, so no array grows by copies of itself.
    """

    def one(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(part, start, one, lambda inner: F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out")))

    def whole(v: Column) -> Column:
        start = F.struct(state.alias("state"), F.slice(F.array(none), 1, 0).alias("out"))
        end = (lambda acc: F.flatten(acc["out"])) if last is None else lambda acc: F.concat(F.flatten(acc["out"]), last(acc["state"]))
        return F.when(F.size(v) > 0, F.aggregate(_blocks(v), start, block, end)).otherwise(none)

    return _let(items, whole)


def _spans(text: Column, hits: Column, pattern: str) -> Column:
    """start, end (code points), the match and the text just before it, for hits of pattern in order. hits: the matches."""
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(pieces, hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n"), h.alias("match"), F.lower(F.right(p, F.lit(CONTEXT))).alias("before")))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + x["n"]
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before")))

    return F.when(F.size(hits) > 0, _fold(steps, F.lit(0), none, add)).otherwise(none)


def _apart(spans: Column, none: Column) -> Column:
    """Of base and proposed spans together, the proposed ones that overlap no base span. spans: structs of start, base, end, ..."""
    alone = lambda keep, x: F.when(keep, F.array(x)).otherwise(none)
    forward = lambda at, x: (F.when(x["base"], F.greatest(at, x["end"])).otherwise(at), alone(x["base"] | (x["start"] >= at), x))
    backward = lambda at, x: (F.when(x["base"], F.least(at, x["start"])).otherwise(at), alone(~x["base"] & (x["end"] <= at), x))
    left = _fold(F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["base"].cast("int") - a["base"].cast("int"))), F.lit(0), none, forward)
    return F.reverse(_fold(F.reverse(left), F.lit(2**31 - 1), none, backward))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check."""
    d = F.reverse(_digits(x))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(x)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _features(kind: Column, x: Column, before: Column) -> Column:
    """The features of a candidate, as a struct of doubles."""
    d = _digits(x)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    number = lambda c: c.cast("double")
    cue = reduce(lambda a, k: a | ((kind == KINDS.index(k)) & before.rlike(CUES[k])), CUES, F.lit(False))
    made = [
        number(kind), number(F.length(d)), number(F.length(F.regexp_replace(x, r"[0-9A-Za-z]+", "x")) - F.length(F.regexp_replace(F.regexp_replace(x, r"[0-9A-Za-z]+", "x"), "x", ""))),
        yes(x.rlike(r"[()\[\]{}]")), number(F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit("")))), number(F.length(F.regexp_replace(x, "[^A-Za-z]", ""))),
        yes((F.length(d) >= 13) & _luhn(x)), yes(d.rlike(r"^(.)\1*$")),
        yes(x.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][0-3]?[0-9][ .-](?:19|20)?[0-9]{2})$") | x.rlike(r"^97[89]")),
        number(F.length(F.regexp_extract(x, "[0-9]+", 0))), number(F.length(F.regexp_extract(x, "([0-9]+)[^0-9]*$", 1))),
        yes(x.rlike(r"(?i)[\[({]at[\])}]")) + yes(x.rlike(r"(?i)(?:[\[({]dot[\])}]| dot )")), yes(cue), yes(before.rlike(AGAINST)), number(F.length(x)),
    ]
    return F.struct(*[c.alias(n) for n, c in zip(FEATURES, made, strict=True)])


def _templates() -> list[tuple[int, str, str, int]]:
    """Labelled candidates: kind, match, the text before it, whether it is personal data."""
    r = random.Random(SEED)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 8)))
    hexa = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(1, 5)))
    cues = {"email": ["e-mail: ", "mail me: ", "contact ", "reach us "], "ip": ["ip ", "host ", "server ", "ipv6 address "], "card": ["card ", "visa ", "credit card no. ", "payment by "], "phone": ["tel. ", "phone: ", "call ", "fax ", "mobile "]}
    against = ["version ", "order ", "isbn ", "invoice ", "serial ", "page ", "date: ", "ref ", "sku ", "model ", "build ", "time ", "lot "]

    def luhn(k: int) -> str:
        body = n(k - 1)
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    four = lambda s: r.choice([" ", "-"]).join(s[i : i + 4] for i in range(0, len(s), 4))

    def one() -> tuple[int, str, str, int]:
        kind, good = r.randrange(4), r.random() < 0.5
        own = f"{word()} {word()} " + (r.choice(cues[KINDS[kind]]) if r.random() < (0.7 if good else 0.05) else f"{word()} ")
        if not good and r.random() < 0.6:
            own = f"{word()} " + r.choice(against)
        s, b = r.choice([" ", ".", "-"]), r.random()
        if kind == 0:
            at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", ".")])
            x = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()}.{word()}"
        elif kind == 1:
            x = ":".join(hexa() for _ in range(r.randrange(6, 9))) if good else ":".join(n(2) for _ in range(r.randrange(3, 5)))
            x = x.replace(":", "::", 1) if good and b < 0.2 else x
        elif kind == 2:
            x = (four(luhn(16)) if b < 0.8 else luhn(13)) if good else r.choice([four(n(16)), n(13), "978" + n(10), n(r.randrange(13, 20)), " ".join(n(r.randrange(3, 6)) for _ in range(r.randrange(3, 6)))])
        elif good:
            x = f"({n(3)}) {n(3)}-{n(4)}" if b < 0.4 else f"{r.choice('23456789')}{n(2)}{s}{n(3)}{s}{n(4)}" if b < 0.8 else f"0{n(r.randrange(2, 4))}{s}{n(3)}{s}{n(4)}"
        else:
            x = r.choice([f"{r.choice(['19', '20'])}{n(2)}{s}{r.randrange(1, 13):02}{s}{r.randrange(1, 29):02}", f"{r.randrange(1, 29):02}{s}{r.randrange(1, 13):02}{s}20{n(2)}", f"{n(2)}{s}{n(3)}{s}{n(2)}", f"{n(4)}{s}{n(4)}{s}{n(2)}", s.join(n(2) for _ in range(r.randrange(3, 6))), f"{n(3)} {n(3)} {n(3)}"])
        return kind, x, own.lower()[-CONTEXT:], int(good)

    return [one() for _ in range(SAMPLE)]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on gradients: a leaf's value, or (feature, bound, at most, above)."""
    leaf = float(g[rows].sum() / (h[rows].sum() + 1))
    if not depth or len(rows) < 20:
        return leaf
    base, best = g[rows].sum() ** 2 / (h[rows].sum() + 1), (1e-6, None)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for bound in np.unique(v)[:-1]:
            left = v <= bound
            gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - base
            if gain > best[0]:
                best = gain, (f, float(bound), left)
    if best[1] is None:
        return leaf
    f, bound, left = best[1]
    return f, bound, _tree(x, g, h, rows[left], depth - 1), _tree(x, g, h, rows[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, _value(low, x), _value(high, x))


_MODEL: dict[str, tuple] = {}


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """The trees and, for each kind, the score from which a candidate is selected: the least at which PRECISION of the held-out half's are personal data."""
    if "fitted" not in _MODEL:
        rows = spark.createDataFrame(_templates(), "kind int, match string, before string, label int")
        got = rows.select(_features(F.col("kind"), F.col("match"), F.col("before")).alias("f"), "label").select("f.*", "label").collect()  # SAMPLE rows
        data = np.array([tuple(r) for r in got], float)
        x, y, half = data[:, :-1], data[:, -1], len(data) // 2
        trees, score = [], np.zeros(half)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            trees.append(_tree(x[:half], y[:half] - p, p * (1 - p), np.arange(half), DEPTH))
            score += RATE * _value(trees[-1], x[:half])
        held = sum(RATE * _value(t, x[half:]) for t in trees)
        least = []
        for kind in range(len(KINDS)):
            own = x[half:, 0] == kind
            order = np.argsort(-held[own], kind="stable")
            precision = np.cumsum(y[half:][own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(precision >= PRECISION)
            least.append(max(0.0, float(held[own][order][good[-1]])) if len(good) else float("inf"))
        _MODEL["fitted"] = trees, least
    return _MODEL["fitted"]


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    name, bound, low, high = FEATURES[tree[0]], *tree[1:]
    return F.when(f[name] <= bound, _case(low, f)).otherwise(_case(high, f))


def find(docs: DataFrame, text: str = "text", at: str = "pii") -> DataFrame:
    """docs and a struct column `at`: base and added, arrays of (start, kind as its place in KINDS, end, score), each by start; added is disjoint from base and from itself."""
    trees, least = model(docs.sparkSession)
    name = lambda x: free_name(docs.columns, x)
    t = name("whole_text")
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    base = []
    for kind, pattern in BASE.items():
        out = out.withColumn(name(f"hits_{kind}"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        spans = F.filter(_spans(F.col(t), F.col(name(f"hits_{kind}")), pattern), _valid_span(kind))
        out = out.withColumn(name(f"base_{kind}"), F.transform(spans, _tagged(kind)))
        base.append(F.col(name(f"base_{kind}")))
    out = out.withColumn(name("base"), F.array_sort(F.concat(*base)))
    more = []
    for i, (kind, pattern) in enumerate(MORE):
        out = out.withColumn(name(f"hits_more_{i}"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        spans = _spans(F.col(t), F.col(name(f"hits_more_{i}")), pattern)
        out = out.withColumn(name(f"more_{i}"), F.transform(spans, _proposed(kind)))
        more.append(F.col(name(f"more_{i}")))
    out = out.withColumn(name("proposed"), F.concat(*more))
    # Proposals that overlap a base span go before they are scored.
    b = F.col(name("base"))
    kind_of = f"start:int,base:boolean,end:int,kind:int,f:struct<{','.join(f'{x}:double' for x in FEATURES)}>"
    none = F.array().cast(f"array<struct<{kind_of}>>")
    given = F.transform(b, lambda s: F.struct(s["start"].alias("start"), F.lit(True).alias("base"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast(f"struct<{','.join(f'{x}:double' for x in FEATURES)}>").alias("f")))
    tried = F.transform(name("proposed"), lambda c: F.struct(c["start"].alias("start"), F.lit(False).alias("base"), c["end"].alias("end"), c["kind"].alias("kind"), c["f"].alias("f")))
    out = out.withColumn(name("together"), F.when(F.size(name("proposed")) > 0, F.concat(given, tried)).otherwise(none))
    out = out.withColumn(name("free"), F.when(F.size(name("together")) > 0, _apart(F.col(name("together")), none)).otherwise(none))
    total = lambda c: reduce(lambda x, y: x + y, [RATE * _case(tree, c["f"]) for tree in trees])
    scored = F.transform(name("free"), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), total(c).alias("score")))
    limit = F.array(*map(F.lit, least))
    out = out.withColumn(name("scored"), F.array_sort(F.filter(scored, lambda c: c["score"] >= F.element_at(limit, c["kind"] + 1))))
    span = "struct<start:int,kind:int,end:int,score:double>"
    empty = F.array().cast(f"array<{span}>")

    def best(held: Column, c: Column) -> tuple[Column, Column]:
        """held: the span that stands last so far."""
        clear = held.isNull() | (c["start"] >= held["end"])
        return F.when(clear | (c["score"] > held["score"]), c).otherwise(held), F.when(clear & held.isNotNull(), F.array(held)).otherwise(empty)

    added = _fold(F.col(name("scored")), F.lit(None).cast(span), empty, best, lambda held: F.array(held))
    added = F.when(F.size(name("scored")) > 0, added).otherwise(empty)
    return out.withColumn(at, F.struct(b.alias("base"), added.alias("added"))).select(*own(docs), at)


def _valid_span(kind: str):
    return lambda s: _valid(kind, s["match"])


def _tagged(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("score"))


def _proposed(kind: str):
    k = KINDS.index(kind)
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), _features(F.lit(k), s["match"], s["before"]).alias("f"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in square brackets; a text without spans is unchanged."""
    at, spans = free_name(docs.columns, "pii"), free_name(docs.columns, "pii_spans")
    found = find(docs, text, at).withColumn(spans, F.array_sort(F.concat(f"{at}.base", f"{at}.added")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    t = F.col(text)

    # What stands before each span that begins a redaction, and after the last: its place, its length, and the kind that follows.
    empty = F.array().cast("array<struct<at:int,n:int,kind:int>>")
    gap = lambda at_, n, kind: F.array(F.struct(at_.alias("at"), n.alias("n"), kind.alias("kind")))

    def cut(at_: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(s["end"], at_), F.when(s["start"] >= at_, gap(at_, s["start"] - at_, s["kind"])).otherwise(empty)

    gaps = _fold(F.col(spans), F.lit(0), empty, cut, lambda at_: gap(at_, F.length(t) - at_, F.lit(len(KINDS))))

    def joined(block: Column) -> Column:
        """A block's gaps out of the one stretch of text that holds them, as finding a place in a text takes time in proportion to it."""
        first, last = F.get(block, F.lit(0)), F.get(block, F.size(block) - 1)
        part = F.substring(t, first["at"] + 1, last["at"] + last["n"] - first["at"])
        return _let(part, lambda x: F.array_join(F.transform(block, lambda g: F.concat(F.substring(x, g["at"] - first["at"] + 1, g["n"]), F.element_at(names, g["kind"] + 1))), ""))

    whole = F.array_join(_let(gaps, lambda v: F.transform(_blocks(v), joined)), "")
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t)).select(*own(docs))


def op1_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = [F.size(F.filter("pii.base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *count, F.sha2(_listed(F.col("pii.base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("pii.base", "pii.added"))).alias("spans"), F.size("pii.added").cast("long").alias("n_added"),
        (F.size("pii.base") + F.size("pii.added")).cast("long").alias("n_spans"),
    )


def _of_kind(i: int):
    return lambda s: s["kind"] == i
