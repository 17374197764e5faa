"""Document quality by base rules and by divergence from language references. DataFrame operations only.

A document's histogram of character classes and its histogram of common words are compared by Jensen-Shannon
distance (base 2, so between 0 and 1) with reference histograms of its language. Each comparison applies only
from a minimum length on, and its limit is widened by a term that falls with the square root of the length, because a short
clean text strays from the reference by chance.

A reference counts each distinct text that passes the base rules once, however many rows hold it. It is the mean over those
texts that lie near the medians of all of them, so neither copies nor a minority of differing junk texts move it.

Every base figure comes from a document's own row; shuffled are the distinct texts' counts (some 30 numbers and a digest) and the
sums behind the references.

Defined cases: null texts have no words and fail the base rules; a language without a list of common words has a reference of
its own from LEAST_TEXTS distinct texts on and no class comparison below that, and no common words to compare; texts of a null or empty
language are taken as two languages, by whether most of their characters are ASCII; repeated rows are scored alike; a very long text is one value, judged whole; an empty table
gives an empty table; columns of docs, whatever their names, are never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut, digest, free_name, own

# Frequent function words of each known language.
COMMON = {
    "de": ["das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "in", "mit", "nicht", "sich", "und", "von", "zu", "auf"],
    "en": ["a", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un", "une"],
}
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: Lengths from which the two comparisons apply, their limits on long texts, and the widening at one character or word.
MIN_CHARS, CLASS_LIMIT, CLASS_SLACK = 100, 0.14, 1.9
MIN_COMMON_WORDS, WORD_LIMIT, WORD_SLACK = 40, 0.14, 1.5
#: Times the limits within which of the medians a text counts for its reference, distinct texts that a language without a list needs, and the medians' accuracy.
NEAR, LEAST_TEXTS, ACCURACY = 1.5, 50, 1000


def _with_later(hashes: Column, n: int):
    return lambda x, i: F.xxhash64(x, F.get(hashes, i + n))


def _share_of(total: Column):
    return lambda v: v / total


def features(docs: DataFrame, text: str = "text", lang: str = "lang", at: str = "features", windows: bool = True) -> DataFrame:
    """docs and a struct column `at`: the base figures, the counts of character classes and of common words, the language, and the text's digest. windows: whether repeated windows are counted."""
    t = F.coalesce(F.col(text), F.lit(""))
    chain = [("words", SPACE), ("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("sign", r"[\x21-\x7E]+")]
    more = ("tongue", "list", "word_list", "hits", "one", "two", "four", "eight", "in_order", "places", "repeats")
    c = {n: free_name(docs.columns, f"left_{n}") for n, _ in chain} | {n: free_name(docs.columns, n) for n in more}
    out, left = docs, t
    for n, pattern in chain:  # each class is what its pattern takes off the text that the ones before it left
        out = out.withColumn(c[n], F.regexp_replace(left, pattern, ""))
        left = F.col(c[n])
    script = F.when(2 * F.length(c["sign"]) > F.length(c["words"]), "?other").otherwise("?ascii")
    out = out.withColumn(c["tongue"], F.coalesce(F.when(F.col(lang) != "", F.col(lang)), script))
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = out.withColumn(c["list"], F.coalesce(lists[F.col(c["tongue"])], F.array().cast("array<string>")))
    out = out.withColumn(c["word_list"], F.filter(F.split(t, SPACE), lambda w: w != ""))
    every = sorted({w for v in COMMON.values() for w in v})
    out = out.withColumn(c["hits"], F.filter(F.split(F.lower(t), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: w.isin(every)))
    size = {n: F.length(c[n]) for n, _ in chain}
    classes = [size["words"] - size["lower"], size["lower"] - size["upper"], size["upper"] - size["digit"], size["digit"] - size["symbol"], size["symbol"] - size["sign"], size["sign"], F.length(t) - size["words"]]
    counted = F.transform(c["list"], lambda x: F.size(c["hits"]) - F.size(F.array_remove(F.col(c["hits"]), x)))
    n_words = F.size(c["word_list"])
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    fields = [
        n_words.cast("long").alias("n_words"), size["words"].cast("long").alias("word_chars"), (size["digit"] - size["symbol"]).cast("long").alias("n_symbols"), F.length(t).alias("n_chars"),
        F.array(*classes).alias("classes"), counted.alias("common"), F.col(c["tongue"]).alias("tongue"), digest(F.col(text)).alias("digest"),
    ]
    if windows:
        # The hash of a window from those of its halves; windows are compared as text only where two hashes agree.
        out = out.withColumn(c["one"], F.transform(c["word_list"], lambda w: F.xxhash64(w)))
        for whole, half, n in (("two", "one", 1), ("four", "two", 2), ("eight", "four", 4)):
            out = out.withColumn(c[whole], F.transform(c[half], _with_later(F.col(c[half]), n)))
        hashes = F.slice(c["eight"], F.lit(1), F.greatest(n_words - (WINDOW - 1), F.lit(0)))
        starts = F.sequence(F.lit(1), n_words - (WINDOW - 1))
        out = out.withColumn(c["eight"], F.when(n_words >= WINDOW, hashes))
        ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(c["word_list"], i, WINDOW), " ").alias("w"), i.alias("i"))))
        out = out.withColumn(c["in_order"], F.when(F.size(F.array_distinct(c["eight"])) < F.size(c["eight"]), ordered))
        same = lambda k, w: F.coalesce(F.get(F.col(c["in_order"]), k)["w"] == w, F.lit(False))
        out = out.withColumn(c["places"], F.transform(c["in_order"], lambda e, k: F.when(same(k - 1, e["w"]) | same(k + 1, e["w"]), e["i"])))
        out = out.withColumn(c["repeats"], F.array_sort(F.filter(c["places"], lambda i: i.isNotNull())))
        covered = F.aggregate(F.transform(c["repeats"], lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(c["repeats"]), k + 1), i + WINDOW) - i)), F.lit(0), lambda x, y: x + y)
        fields += [(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")]
    return out.withColumn(at, F.struct(*fields)).select(*own(docs), at)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _words(f: str) -> Column:
    """Counts of the common words, and of all others."""
    common = F.transform(F.col(f"{f}.common"), lambda x: x.cast("double"))
    return F.concat(common, F.array(F.col(f"{f}.n_words") - _total(common)))


def _classes(f: str) -> Column:
    return F.transform(F.col(f"{f}.classes"), lambda x: x.cast("double"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts, as shares, from reference shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    total = _total(counts)
    terms = F.zip_with(counts, reference, lambda c, q: F.struct((c / total).alias("p"), q.alias("q")))
    halves = F.transform(terms, lambda x: (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2)
    return F.sqrt(F.greatest(_total(halves), F.lit(0.0)))


def _failed(f: str) -> Column:
    return (F.col(f"{f}.n_words") < MIN_WORDS) | (100 * F.col(f"{f}.n_repeat_words") > MAX_REPEATED * F.col(f"{f}.n_words"))


def _limits(n_chars: Column, n_words: Column) -> tuple[Column, Column]:
    return CLASS_LIMIT + CLASS_SLACK / F.sqrt(n_chars), WORD_LIMIT + WORD_SLACK / F.sqrt(n_words)


def references(featured: DataFrame, at: str = "features") -> DataFrame:
    """tongue, class_ref, word_ref: for each language, the mean shares of its distinct texts near their medians; the medians where none is near."""
    width = {"class": 7, "word": max(map(len, COMMON.values())) + 1}
    names = {c: [f"{c}_{i}" for i in range(n)] for c, n in width.items()}
    every = [x for c in names for x in names[c]]
    g = lambda c: F.col(f"{at}.{c}").alias(c)
    # Written, as else the filter and each count would compute the features anew.
    rows = Cut(featured.select(at), "counts").df.filter(~_failed(at)).select(g("tongue"), g("digest"), g("n_chars"), g("n_words"), _classes(at).alias("class"), _words(at).alias("word"))
    flat = rows.select("tongue", "digest", "n_chars", "n_words", *[F.get(c, F.lit(i)).alias(x) for c in names for i, x in enumerate(names[c])])
    counts = ("n_chars", "n_words", *every)
    listed = lambda c: F.filter(F.array(*names[c]), lambda v: v.isNotNull()).alias(c)
    # The arrays are written, so that no expression over them computes them anew.
    texts = Cut(flat.groupBy("tongue", "digest").agg(*[F.first(x).alias(x) for x in counts]).select("tongue", "n_chars", "n_words", *map(listed, names)), "texts").df
    shares = {"class": lambda i: F.get("class", F.lit(i)) / F.col("n_chars"), "word": lambda i: F.get("word", F.lit(i)) / F.col("n_words")}
    each = lambda f: [f(shares[c](i)).alias(x) for c in names for i, x in enumerate(names[c])]
    middle = texts.groupBy("tongue").agg(F.count("*").alias("n"), *each(lambda x: F.percentile_approx(x, 0.5, ACCURACY)))
    middle = Cut(middle.filter(F.col("tongue").isin(*COMMON) | (F.col("n") >= LEAST_TEXTS)).select(F.col("tongue").alias("of"), *map(listed, names)), "medians").df
    middle = middle.select("of", *[F.transform(c, _share_of(_total(F.col(c)))).alias(f"{c}_mid") for c in names])
    class_most, word_most = _limits(F.col("n_chars"), F.col("n_words"))
    near = texts.join(F.broadcast(middle), F.col("tongue") == F.col("of")).filter((distance(F.col("class"), F.col("class_mid")) <= NEAR * class_most) & (distance(F.col("word"), F.col("word_mid")) <= NEAR * word_most))
    means = near.groupBy("tongue").agg(*each(F.avg)).select("tongue", *[listed(c).alias(f"{c}_mean") for c in names])
    both = middle.join(means, F.col("tongue") == F.col("of"), "left")
    return both.select(F.col("of").alias("tongue"), *[F.coalesce(f"{c}_mean", f"{c}_mid").alias(f"{c}_ref") for c in names])


def judge(featured: DataFrame, refs: DataFrame, f: str = "features", at: str = "quality") -> DataFrame:
    """featured with a struct column `at` in place of the features: base figures, both distances (null below their lengths), base_failed and kept."""
    names = [c for c, x in zip(own(featured), featured.columns, strict=True) if x != f]
    r, t, m = (free_name(featured.columns, x) for x in ("reference", "ref_tongue", "measured"))
    # One row for each language.
    ref_row = F.broadcast(refs.select(F.col("tongue").alias(t), F.struct("class_ref", "word_ref").alias(r)))
    out = featured.join(ref_row, F.col(f"{f}.tongue") == F.col(t), "left")
    g = lambda c: F.col(f"{f}.{c}")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    wordy = (g("n_words") >= MIN_COMMON_WORDS) & g("tongue").isin(*COMMON)
    out = out.withColumn(m, F.struct(F.when(g("n_chars") >= MIN_CHARS, distance(_classes(f), F.col(f"{r}.class_ref"))).alias("class_distance"), F.when(wordy, distance(_words(f), F.col(f"{r}.word_ref"))).alias("word_distance")))
    failed = _failed(f)
    class_most, word_most = _limits(g("n_chars"), g("n_words"))
    far = (F.col(f"{m}.class_distance") > class_most) | (F.col(f"{m}.word_distance") > word_most)
    verdict = F.struct(*[g(c).alias(c) for c in base], failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), F.col(f"{m}.class_distance").alias("class_distance"), F.col(f"{m}.word_distance").alias("word_distance"))
    return out.select(*names, verdict.alias(at))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, their columns unchanged.

    Documents and features are written once: they serve the references and the verdicts, and a filter on a verdict is not
    moved below the features, where each of its mentions of one would compute it anew.
    """
    f, at = free_name(docs.columns, "features"), free_name(docs.columns, "quality")
    featured = Cut(features(docs, text, lang, f), "featured").df
    return judge(featured, references(featured, f), f, at).filter(F.col(f"{at}.kept")).select(*own(docs))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each document, some 30 numbers, are written once and serve the references and the verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    featured = Cut(features(docs).select("doc_id", "features"), "features").df
    return judge(featured, references(featured)).select("doc_id", "quality.*")
