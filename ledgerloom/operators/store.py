"""Stored contents: byte and line reads, opening by claim, writing with redaction and truncation, retention, and labels of whole contexts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.artifacts import LABELS, rank, scrubbed, visible
from ledgerloom.operators.redaction import redacted

FOREVER = 9007199254740991
#: Most bytes that the reading tool returns.
READ_BYTES = 32 * 1024
#: Milliseconds that a temporary file may belong to a write that goes on.
TEMP_AGE = 3_600_000
SECRET_MARK = "<!-- secret-provenance: true -->"


def _hex(text: Column) -> Column:
    """The bytes of a text, two digits each."""
    return F.hex(F.encode(text, "UTF-8"))


def _inside(h: Column, at: Column) -> Column:
    """Whether a byte goes on with a character that another one began."""
    return F.substring(h, 2 * at + 1, F.lit(1)).isin("8", "9", "A", "B")


def _step(h: Column, at: Column, by: int, end: Column) -> Column:
    out = at
    for _ in range(3):  # a character has at most four bytes
        out = F.when((out != end) & _inside(h, out), out + by).otherwise(out)
    return out


def _cut(h: Column, a: Column, b: Column) -> Column:
    return F.decode(F.unhex(F.substring(h, 2 * a + 1, 2 * (b - a))), "UTF-8")


def _line_at(h: Column, at: Column) -> Column:
    """The line that holds a byte; a final line end opens no line."""
    n = F.length(h) / 2
    head = F.unhex(F.substring(h, F.lit(1), 2 * at)).cast("string")  # may end inside a character
    ends = F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit("")))
    return (ends + 1 - F.when((at >= n) & F.endswith(head, F.lit("\n")), 1).otherwise(0)).cast("long")


def read_range(docs: DataFrame, unit: str, start: int, end: int, most: int | None = None) -> DataFrame:
    """doc_id, text, line_start, line_end, truncated, byte_length of a slice: of lines (from 1, the end included) or bytes (from 0, the end excluded, widened to whole characters).

    most: a ceiling of bytes, widened likewise.
    """
    rows = docs.filter("text is not null").select("doc_id", _hex(F.col("text")).alias("h"), "text").withColumn("n", (F.length("h") / 2).cast("int"))
    h, n = F.col("h"), F.col("n")
    if unit == "line":
        body = F.when(F.endswith("text", F.lit("\n")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
        rows = rows.withColumn("l", F.split(body, "\n", -1)).withColumn("line_start", F.greatest(F.lit(1), F.least(F.lit(start), F.size("l"))))
        rows = rows.withColumn("line_end", F.greatest(F.col("line_start"), F.least(F.lit(end), F.size("l"))))
        upto = lambda k: F.octet_length(F.array_join(F.slice("l", 1, k), "\n")) + F.when(k > 0, 1).otherwise(0)
        rows = rows.withColumn("a", F.least(upto(F.col("line_start") - 1), n)).withColumn("b", F.when(F.col("line_end") >= F.size("l"), n).otherwise(upto(F.col("line_end"))))
    else:
        a = F.greatest(F.lit(0), F.least(F.lit(start), n))
        rows = rows.withColumn("a0", a).withColumn("b0", F.greatest(F.col("a0"), F.least(F.lit(end), n)))
        rows = rows.withColumn("a", _step(h, F.col("a0"), -1, F.lit(0))).withColumn("b", _step(h, F.col("b0"), 1, n))
        rows = rows.withColumn("line_start", _line_at(h, F.col("a"))).withColumn("line_end", _line_at(h, F.greatest(F.col("a"), F.col("b") - 1)))
    over = (F.col("b") - F.col("a") > most) if most is not None else F.lit(False)
    rows = rows.withColumn("over", over).withColumn("z", F.when(F.col("over"), _step(h, F.col("a") + (most or 0), 1, n)).otherwise(F.col("b")))
    last = F.when(F.col("over"), _line_at(h, F.greatest(F.col("a"), F.col("z") - 1))).otherwise(F.col("line_end"))
    return rows.select("doc_id", _cut(h, F.col("a"), F.col("z")).alias("text"), F.col("line_start").cast("long").alias("line_start"), last.cast("long").alias("line_end"), F.col("over").alias("truncated"), (F.col("z") - F.col("a")).cast("long").alias("byte_length"))


def read_report(docs: DataFrame, unit: str = "line", start: int | None = None, end: int | None = None, most: int = READ_BYTES) -> DataFrame:
    """A slice as the reading tool shows it; by default from the first line or byte to the last, at most READ_BYTES."""
    part = read_range(docs, unit, (1 if unit == "line" else 0) if start is None else start, 2**31 - 1 if end is None else end, min(most, READ_BYTES))
    head = F.format_string("artifact lines %d-%d%s\n", "line_start", "line_end", F.when(F.col("truncated"), " (truncated)").otherwise(""))
    return part.select("doc_id", F.concat(head, F.col("text")).alias("report"), "byte_length", "truncated")


def raw_range(docs: DataFrame, start: int, end: int) -> DataFrame:
    """The bytes from start to end of each content, clamped, in hex."""
    h = _hex(F.col("text"))
    n = F.length(h) / 2
    a = F.greatest(F.lit(0), F.least(F.lit(start), n)).cast("int")
    b = F.greatest(a, F.least(F.lit(end), n).cast("int"))
    return docs.select("doc_id", F.substring(h, 2 * a + 1, 2 * (b - a)).alias("bytes"))


def line_range(docs: DataFrame, at: int) -> DataFrame:
    """Each text's line that holds a byte."""
    return docs.filter("text is not null").select("doc_id", _line_at(_hex(F.col("text")), F.least(F.lit(at), F.octet_length("text"))).alias("line"))


def opened(blobs: DataFrame, refs: DataFrame, tenant: str, most: str, now: int) -> DataFrame:
    """doc_id and status of contents (doc_id, sha256, body, encoding): MISSING without a visible claim, CORRUPT where the bytes don't have the digest, NOT_TEXT, or OK."""
    held = visible(refs, tenant, most, now).select("sha256").distinct().withColumn("seen", F.lit(True))
    status = F.when(F.col("seen").isNull(), "MISSING").when(F.sha2("body", 256) != F.col("sha256"), "CORRUPT").when(F.col("encoding") != "utf-8", "NOT_TEXT").otherwise("OK")
    return blobs.join(held, "sha256", "left").select("doc_id", status.alias("status"))


def audit(blobs: DataFrame) -> DataFrame:
    """Contents whose bytes don't have the digest that they are stored under."""
    return blobs.filter(F.sha2("body", 256) != F.col("sha256")).select("doc_id", "sha256")


def stats(blobs: DataFrame) -> DataFrame:
    """What is known of a content without a claim: bytes, lines, kind and encoding."""
    text = F.col("body").cast("string")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(F.length(text) == 0, 0).otherwise(n + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))
    head = F.regexp_replace(F.substring(F.col("body"), 1, 512).cast("string"), r"\A\s+", "")
    kind = F.when(F.col("encoding") != "utf-8", "application/octet-stream").when(head.rlike(r"\A[{\[]"), "application/json").otherwise("text/plain")
    return blobs.select("doc_id", "sha256", F.octet_length("body").cast("long").alias("byte_length"), F.when(F.col("encoding") == "utf-8", lines).cast("long").alias("line_count"), kind.alias("mime"), "encoding")


def put(docs: DataFrame, refs: DataFrame, tenant: str, label: str, now: int, most: int, retention_days: int = 30, retain_for: int | None = None) -> DataFrame:
    """The claims (with the stored text) that writing texts for one tenant makes: addresses without a claim and credentials go, then what is over `most` bytes at a whole character.

    Contents that are stored already are told by `store`; a claim is made for every write.
    """
    safe = redacted(scrubbed(docs.select("doc_id", "text"), visible(refs, tenant, label, now))).select("doc_id", F.col("text").alias("safe"))
    rows = docs.select("doc_id", F.col("text").alias("raw")).join(safe, "doc_id").withColumn("h", _hex(F.col("safe"))).withColumn("n", (F.length("h") / 2).cast("int"))
    cut = _step(F.col("h"), F.lit(most), 1, F.col("n"))
    rows = rows.withColumn("truncated", F.col("n") > most).withColumn("stored", F.when(F.col("truncated"), _cut(F.col("h"), F.lit(0), cut)).otherwise(F.col("safe")))
    until = F.lit(now + retain_for if retain_for is not None else FOREVER if retention_days == 0 else now + retention_days * 86_400_000).cast("long")
    return rows.select(
        "doc_id", F.sha2("stored", 256).alias("sha256"), F.lit(tenant).alias("tenant"), F.lit(label).alias("label"), (F.col("safe") != F.col("raw")).alias("redacted"), "truncated", F.sha2("raw", 256).alias("original_sha256"),
        F.octet_length("raw").cast("long").alias("original_bytes"), until.alias("retain_until"), F.col("stored").alias("text"),
    )


def spilled(overflow: DataFrame, most: int, secret: bool) -> DataFrame:
    """The address of each session's overflow (session, text); null where the text would be cut, as it could then not be recovered whole."""
    fits = F.octet_length("text") <= most
    return overflow.select("session", F.when(fits, F.concat(F.lit("artifact://sha256/"), F.sha2("text", 256))).alias("uri"), F.lit("secret" if secret else "internal").alias("label"))


def tainted(contexts: DataFrame, refs: DataFrame, tenant: str, now: int) -> DataFrame:
    """Whether a context (doc_id, text, checkpoint) is secret: a checkpoint that holds the mark, or a cited content whose visible claims go up to secret."""
    secret = visible(refs, tenant, "secret", now).groupBy("sha256").agg(F.max(rank(F.col("label"))).alias("r")).filter(F.col("r") == len(LABELS)).select("sha256")
    cited = contexts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("artifact://sha256/([0-9a-f]{64})"), 1))).alias("sha256"))
    hit = cited.join(secret, "sha256", "left_semi").select("doc_id").distinct().withColumn("cites", F.lit(True))
    marked = F.col("checkpoint") & F.contains("text", F.lit(SECRET_MARK))
    return contexts.join(hit, "doc_id", "left").select("doc_id", (F.coalesce(marked, F.lit(False)) | F.coalesce("cites", F.lit(False))).alias("tainted"))


def downgrade(taint: DataFrame, targets: DataFrame, local: list[str]) -> DataFrame:
    """Whether each context (doc_id, tainted) may go to its target (doc_id, provider): a secret one only to a local provider."""
    return taint.join(targets, "doc_id", "left").select("doc_id", (F.col("tainted") & ~F.coalesce(F.col("provider").isin(local), F.lit(False))).alias("refused"))


def with_provenance(text: Column, taint: Column) -> Column:
    """A summary that ends in the mark where its context is secret."""
    return F.when(taint, F.concat(text, F.lit("\n" + SECRET_MARK))).otherwise(text)


CLAIM = "ref_id string, sha256 string, tenant string, session string, label string, redacted boolean, truncated boolean, original_sha256 string, original_bytes long, retain_until long"


def add_claims(claims: DataFrame, path: str) -> None:
    """Appends claims to the JSON lines at `path`, one folder for each first byte of a digest. A claim without an id gets a random one."""
    rows = claims if "ref_id" in claims.columns else claims.withColumn("ref_id", F.uuid())
    rows.withColumn("part", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("part").json(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """The claims at `path`; none where nothing was written yet."""
    return _read(spark, path, lambda: spark.read.schema(f"{CLAIM}, part string").json(path).drop("part"), CLAIM)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """The digests and sizes of the contents that `artifacts.store` wrote to `path`; none where nothing was written yet. The contents themselves aren't read."""
    return _read(spark, path, lambda: spark.read.parquet(path).select("sha256", "bytes"), "sha256 string, bytes long")


def _read(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read() if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_info(spark: SparkSession, folder: str, digest: str, info: dict) -> str:
    """Publishes what is known of a content as JSON beside it, whole or not at all: a file of its own gives way to the final name. Returns that name; of two writers the last one's stands."""
    name, temp = f"{folder}/{digest}.info.json", f"{folder}/.{digest}.{uuid.uuid4()}.info.tmp"
    (to, fs), (temporary, _) = _files(spark, name), _files(spark, temp)
    try:
        with_bytes = fs.create(temporary, True)
        try:
            with_bytes.write(bytearray(json.dumps(info).encode()))
        finally:
            with_bytes.close()
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = spark._sc._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, to, how)
    except Exception:
        fs.delete(temporary, False)
        raise
    return name


def sweep_temps(spark: SparkSession, root: str, now: int, least: int = TEMP_AGE) -> tuple[int, int]:
    """Removes the *.tmp files in the folders sha256/* below root that were last written `least` milliseconds before now or earlier; how many this call removed, and their bytes.

    Only temporary files are listed, by the file system: their number follows from crashes, not from the store's size. A file that is gone already counts for nothing.
    """
    pattern, fs = _files(spark, f"{root}/sha256/*/*.tmp")
    removed = freed = 0
    for found in fs.globStatus(pattern) or []:
        if found.isFile() and now - found.getModificationTime() >= least and fs.delete(found.getPath(), False):
            removed, freed = removed + 1, freed + found.getLen()
    return removed, freed
