"""Lines, chunks, search, content addresses, claims and lossless runs over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import lines
from ledgerloom.operators.redaction import replace_each
from ledgerloom.sources.tables import LABELS

# What opens the mark of a folded run, which a count and a bracket end; the most repeats that are expanded; what stands for an address without a claim.
FOLD = "[adaptive-repeat:v1 additional="
MOST_REPEATS = 1_000_000
UNRESOLVABLE = "(artifact reference removed: not readable from this session)"


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def line_offsets(docs: DataFrame) -> DataFrame:
    """The byte at which each line begins."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split_lines(docs).select("doc_id", "line_no", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long").alias("byte_start"))


def chunk_lines(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of `size` lines that step by size less overlap; the last one ends with the text."""
    n = F.size("l")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))
    rows = docs.select("doc_id", lines(F.col("text")).alias("l")).filter(n > 0).select("doc_id", "l", F.explode(starts).alias("s"))
    end = F.least(F.col("s") + size, n)
    chunk = F.array_join(F.slice("l", F.col("s") + 1, F.lit(size)), "\n")
    return rows.select("doc_id", (F.col("s") + 1).cast("long").alias("line_start"), end.cast("long").alias("line_end"), F.sha2(chunk, 256).alias("sha256"))


def read_lines(docs: DataFrame, first: int, last: int) -> DataFrame:
    part = F.slice(lines(F.col("text")), F.lit(first), F.lit(last - first + 1))
    return docs.select("doc_id", F.array_join(part, "\n").alias("slice"), F.size(part).cast("long").alias("n_lines"))


def grep(docs: DataFrame, pattern: str, around: int = 0, regex: bool = False, most: int = 50) -> DataFrame:
    """The first `most` lines of each text that hold a literal or match a regular expression, each with the lines around it; contexts are not merged. Only hits leave the text's row."""
    held = (lambda x: x.rlike(pattern)) if regex else lambda x: F.contains(x, F.lit(pattern))
    some = docs.filter(F.contains("text", F.lit(pattern))) if not regex else docs
    rows = some.select("doc_id", lines(F.col("text")).alias("l")).withColumn("at", F.slice(F.filter(F.transform("l", lambda x, i: F.when(held(x), i)), lambda i: i.isNotNull()), 1, most))
    first, last = lambda i: F.greatest(i - around, F.lit(0)), lambda i: F.least(i + around, F.size("l") - 1)
    hit = lambda i: F.struct((i + 1).cast("long").alias("line_no"), (first(i) + 1).cast("long").alias("line_start"), (last(i) + 1).cast("long").alias("line_end"), F.array_join(F.slice("l", first(i) + 1, last(i) - first(i) + 1), "\n").alias("context"))
    return rows.select("doc_id", F.explode(F.transform("at", hit)).alias("h")).select("doc_id", "h.*")


def grep_report(docs: DataFrame, pattern: str, around: int = 2, regex: bool = False, most: int = 50) -> DataFrame:
    """Each text's hits as a tool shows them, at most 200 with at most 20 lines around: a count, the hits, and a line if there may be more."""
    most, around = min(most, 200), min(around, 20)
    found = grep(docs, pattern, around, regex, most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_no", "context"))).alias("h"))
    n = F.size("h")
    body = F.array_join(F.transform("h", lambda x: F.concat(x["line_start"].cast("string"), F.lit(": "), x["context"])), "\n")
    more = F.when(n >= most, "\n(hit limit reached; narrow the pattern)").otherwise("")
    shown = docs.select("doc_id").join(found, "doc_id", "left")
    return shown.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("hits"), F.coalesce(F.concat(n.cast("string"), F.lit(" match(es)\n"), body, more), F.lit("no matches")).alias("report"))


def content_address(docs: DataFrame) -> DataFrame:
    """One row a content: its address, copies, first holder and bytes saved. Copies combine on the map side."""
    d = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return d.groupBy("sha256", "bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).withColumn("saved", (F.col("copies") - 1) * F.col("bytes"))


def fold_runs(docs: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` equal consecutive lines: where they begin and how long they are."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = split_lines(docs).withColumn("new", F.when(F.lag("line").over(order).eqNullSafe(F.col("line")) & (F.col("line_no") > 1), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.count("*").alias("length"), F.first("line").alias("line"))
    return runs.filter(F.col("length") >= least).select("doc_id", "line_no", "length", F.length("line").cast("long").alias("line_chars"))


def rank(label):
    return F.array_position(F.array(*map(F.lit, LABELS)), label)


def visible(refs: DataFrame, tenant: str, most: str, now: int) -> DataFrame:
    """The claims that a principal of this tenant and highest label may use now."""
    return refs.filter((F.col("tenant") == tenant) & (F.col("retain_until") > now) & (rank(F.col("label")) <= LABELS.index(most) + 1))


def effective_label(refs: DataFrame, tenant: str, most: str, now: int) -> DataFrame:
    """The most restrictive label among a principal's visible claims on each content."""
    high = visible(refs, tenant, most, now).groupBy("sha256").agg(F.max(rank(F.col("label"))).alias("r"), F.count("*").alias("claims"))
    return high.select("sha256", F.element_at(F.array(*map(F.lit, LABELS)), F.col("r").cast("int")).alias("label"), "claims")


def authorized(docs: DataFrame, refs: DataFrame, tenant: str, most: str, now: int) -> DataFrame:
    """doc_id, status: a text without a visible claim is missing, whatever else claims it."""
    held = visible(refs, tenant, most, now).select("sha256").distinct().withColumn("seen", F.lit(True))
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256")).join(held, "sha256", "left").select("doc_id", F.when(F.col("seen"), "OK").otherwise("MISSING").alias("status"))


def expired(refs: DataFrame, now: int) -> DataFrame:
    """Contents that lose claims now, and how many."""
    return refs.filter(F.col("retain_until") <= now).groupBy("sha256").agg(F.count("*").alias("dropped"))


def released(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims that are left once those of `gone` (ref_id) are given up."""
    return refs.join(gone.select("ref_id"), "ref_id", "left_anti")


def sweep(blobs: DataFrame, refs: DataFrame, now: int) -> DataFrame:
    """Contents (sha256, bytes) that no live claim holds, also such as were never claimed."""
    live = refs.filter(F.col("retain_until") > now).select("sha256").distinct()
    return blobs.join(live, "sha256", "left_anti").select("sha256", "bytes")


def sweep_report(blobs: DataFrame, refs: DataFrame, now: int, most: int) -> DataFrame:
    """One row: contents and claims that go, bytes freed, bytes left, and whether these exceed the store's bound (which evicts nothing)."""
    live = refs.filter(F.col("retain_until") > now).select("sha256").distinct().withColumn("live", F.lit(True))
    per = blobs.join(live, "sha256", "left").agg(
        F.count_if(F.col("live").isNull()).alias("blobs_removed"), F.coalesce(F.sum(F.when(F.col("live").isNull(), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_freed"),
        F.coalesce(F.sum(F.when(F.col("live"), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_left"),
    )
    return per.join(refs.agg(F.count_if(F.col("retain_until") <= now).alias("refs_removed"))).withColumn("over", F.col("bytes_left") > most)


def totals(docs: DataFrame) -> DataFrame:
    """Distinct contents and their bytes."""
    return content_address(docs).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def uris(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 of the addresses that a text cites, each once."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("artifact://sha256/([0-9a-f]{64})"), 1))
    return docs.select("doc_id", F.explode(found).alias("sha256"))


def scrubbed(docs: DataFrame, refs: DataFrame, mark: str = UNRESOLVABLE) -> DataFrame:
    """Texts whose cited addresses without a claim in `refs` give way to a mark. Texts that cite none pass without a join's rows."""
    known = uris(docs).join(refs.select("sha256").distinct(), "sha256", "left_semi").groupBy("doc_id").agg(F.collect_set("sha256").alias("known"))
    pattern = "artifact://sha256/[0-9a-f]{64}"
    keep = lambda m: F.when(F.array_contains(F.coalesce("known", F.array().cast("array<string>")), F.substring(m, 19, 64)), m).otherwise(mark)
    return docs.join(known, "doc_id", "left").select("doc_id", replace_each(F.col("text"), pattern, keep).alias("text"))


def _ended(text: str) -> Column:
    """The lines of a text with their line ends; the last may have none."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), 0)


def folded_all(docs: DataFrame, least: int = 4) -> DataFrame:
    """Texts in which a run of equal lines is one line and its count, where that is shorter, and how many runs were folded.

    Null texts and those that hold the mark already are unchanged; every line end stays. All is done in the text's own row.
    """
    whole = F.col("text").isNull() | F.contains("text", F.lit(FOLD))
    rows = docs.select("doc_id", "text", F.when(~whole, _ended("text")).alias("l")).withColumn("s", F.when(F.size("l") > 0, F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | (F.get("l", i) != F.get("l", i - 1)))))
    run = lambda i, k: F.struct(F.get("l", i).alias("line"), (F.coalesce(F.get("s", k + 1), F.size("l")) - i).alias("n"))
    mark = lambda r: F.concat(F.lit(FOLD), (r["n"] - 1).cast("string"), F.lit("]\n"))
    worth = lambda r: (r["n"] >= least) & F.endswith(r["line"], F.lit("\n")) & (F.length(r["line"]) * (r["n"] - 1) > F.length(mark(r)) + 32)
    rows = rows.withColumn("r", F.transform("s", run))
    text = F.array_join(F.transform("r", lambda r: F.when(worth(r), F.concat(r["line"], mark(r))).otherwise(F.repeat(r["line"], r["n"]))), "")
    return rows.select("doc_id", F.coalesce(F.when(F.size("r") > 0, text), F.col("text")).alias("text"), F.coalesce(F.when(F.col("r").isNotNull(), F.size(F.filter("r", worth))), F.lit(0)).cast("long").alias("folds"))


def folded(docs: DataFrame, least: int = 4) -> DataFrame:
    """`folded_all` of the texts that can be folded: those that are null or hold the mark already have no row."""
    return folded_all(docs.filter(~F.contains("text", F.lit(FOLD))), least)


def unfolded(docs: DataFrame) -> DataFrame:
    """The inverse of `folded_all`: each line that is a mark repeats the line before it. Null texts, and those of which `folds` says that nothing was folded, are unchanged; a count above MOST_REPEATS is an error."""
    mark = r"\A\[adaptive-repeat:v1 additional=(\d+)\]\n\z"
    whole = F.col("text").isNull() | ((F.col("folds") == 0) if "folds" in docs.columns else F.lit(False))
    count = lambda x: F.regexp_extract(x, mark, 1)
    times = lambda c: F.when(F.length(c) > 7, F.raise_error(F.lit("repeat count outside its bound")).cast("int")).when(c.cast("int") > MOST_REPEATS, F.raise_error(F.lit("repeat count outside its bound")).cast("int")).otherwise(c.cast("int"))
    rows = docs.select("doc_id", "text", F.when(~whole, _ended("text")).alias("l"))
    text = F.array_join(F.transform("l", lambda x, i: F.when((i > 0) & (count(x) != ""), F.repeat(F.get("l", i - 1), times(count(x)))).otherwise(x)), "")
    return rows.select("doc_id", F.coalesce(F.when(F.size("l") > 0, text), F.col("text")).alias("text"))


def payload_groups(messages: DataFrame, least: int = 128) -> DataFrame:
    """Payloads that a session repeats: the last place defines one, earlier places refer to it; groups that save too little stay as they are."""
    groups = messages.groupBy("session", "payload").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    groups = groups.filter((F.col("n") > 1) & ((F.col("n") - 1) * F.length("payload") >= least))
    ids = groups.withColumn("id", F.row_number().over(Window.partitionBy("session").orderBy("first")).cast("long"))
    rows = messages.select("session", "pos", "payload").join(ids, ["session", "payload"])
    return rows.select("session", "pos", "id", F.when(F.col("pos") == F.col("last"), "define").otherwise("refer").alias("part"))


def store(docs: DataFrame, path: str) -> int:
    """Appends to the Parquet table at `path` the contents (sha256, text, bytes) that it lacks; returns how many. Running it again adds none."""
    spark = docs.sparkSession
    new = docs.select(F.sha2("text", 256).alias("sha256"), "text", F.octet_length("text").cast("long").alias("bytes")).filter("text is not null").dropDuplicates(["sha256"])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    seen = Observation()
    new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]
