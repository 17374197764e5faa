"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing: each page is a record; of equal payloads of at least 100 bytes, the page with the least id is the response and the others
are revisits without payload. Spark's text writer puts the records into files, so a file is committed whole or not at all.

Reading: files are split at the version line, in parallel and also inside a file. Each piece is a candidate for a record
and names its successor: its own offset plus what its header says it is long. Pointer jumping over these links runs in two
levels. In every segment, that is a split of a file, it leads each candidate to the last one before the segment's end, whose
successor lies beyond. Of each file, only the candidates that some segment leads to meet in one task, a few a
segment; following them from the file's start tells where the chain enters each segment. Pointer jumping from
there keeps the candidates that are reached and rejects the others, which are version lines inside payloads. So no task holds
more candidates than one segment, however large a file. A record whose payload holds version lines is put together again
from its pieces, which alone are read twice.

Defined cases: null html is an empty payload; null urls leave their header line out; white space and control characters in
urls are escaped; null page_ids are written as such; pages that share both the least id and the payload are all responses;
a very long payload is one value, as in its row; a record that ends before its length, and what follows a broken link, is left out;
other columns, whatever their names, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut, new_path

MAGIC = "WARC/1.1\r\n"
MIN_REVISIT = 100
#: Fixed capture date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def write(pages: DataFrame, path: str) -> None:
    """Writes page_id, url, html as WARC records to files under path."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = p.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    shared = Cut(groups, "payloads")
    marked = p.join(shared.small("digest", "least"), "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("least")) & F.col("least").isNotNull(), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    payload = F.when(F.col("revisit"), "").otherwise(F.col("html"))
    head = [
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", urn(F.col("page_id"))), ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Payload-Length", F.col("bytes").cast("string")),
        ("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("least")))), ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length(payload).cast("string")),
    ]
    lines = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in head])), "\r\n")
    marked.select(F.concat(F.lit(MAGIC), lines, F.lit("\r\n\r\n"), payload).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


PLACE = "path string, block long, mid long"
FIELDS = "record_type string, record_id string, target_uri string, refers_to string, header_digest string, header_payload_bytes long"


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields and the payload of the piece `value`, as far as it reaches."""
    p = pieces.withColumn("head", F.substring_index("value", "\r\n\r\n", 1)).withColumn("head_bytes", F.octet_length("head").cast("long"))
    p = p.withColumn("content", F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1).try_cast("long")).withColumn("bytes", F.octet_length("value").cast("long"))
    names = [("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("refers_to", "WARC-Refers-To")]
    p = p.withColumns({k: _field(v) for k, v in names} | {"header_digest": F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", ""), "header_payload_bytes": _field("WARC-Payload-Length").try_cast("long")})
    return p.withColumn("payload", F.expr("substring(cast(value as binary), cast(head_bytes + 5 as int), cast(content as int))"))


SEGMENT = "path string, block long, start long, size long"
HOOK = "path string, block long, offset long, exit long, last long"
PLAN = f"{SEGMENT}, entry long, leaves boolean, cover long, until long"


def _candidates(rows: pa.Table, start: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A segment's pieces in order, their offsets, the successors they name (-1: none), their ends, and the successors' places (their own: not in this segment)."""
    rows = rows.sort_by("mid")
    bytes_, content, head = (np.asarray(rows.column(c).fill_null(-1)) for c in ("bytes", "content", "head_bytes"))
    end = start + np.cumsum(bytes_ + len(MAGIC))
    offset = end - bytes_ - len(MAGIC)
    ahead = np.where(content >= 0, offset + len(MAGIC) + head + 4 + content + 4, -1)
    place = np.minimum(np.searchsorted(offset, ahead), len(offset) - 1)
    return rows, offset, ahead, end, np.where(offset[place] == ahead, place, np.arange(len(offset)))


def _jumped(step: np.ndarray) -> np.ndarray:
    """Where each candidate gets to."""
    for _ in range(len(step).bit_length()):
        step = step[step]
    return step


def _ends(rows: pa.Table, segment: pa.Table) -> pa.Table:
    """Of each candidate: the offset beyond the segment that its chain leads to, and the last candidate before."""
    names = [x.split(" ")[0] for x in HOOK.split(", ")]
    if not rows.num_rows:
        return pa.table([pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4], names)
    rows, offset, ahead, _, step = _candidates(rows, segment.column("start")[0].as_py())
    to = _jumped(step)
    out = np.flatnonzero(ahead[to] > offset[-1])
    return pa.table([rows.column("path").take(out), rows.column("block").take(out), pa.array(offset[out]), pa.array(ahead[to][out]), pa.array(offset[to][out])], names)


def _walk(hooks: pa.Table, segments: pa.Table) -> pa.Table:
    """Of one file's segments: where the chain enters each, whether the way out is good, and the record that reaches into it from before."""
    at = dict(zip(hooks.column("offset").to_pylist(), zip(*(hooks.column(c).to_pylist() for c in ("block", "exit", "last")), strict=True), strict=True))
    rows = sorted(segments.to_pylist(), key=lambda x: x["block"])
    plan = {x["block"]: x | {"entry": None, "leaves": False, "cover": None, "until": None} for x in rows}
    order = [x["block"] for x in rows]
    place, now = {x: i for i, x in enumerate(order)}, 0
    while now in at:
        block, exit_, last = at[now]
        plan[block]["entry"] = now
        if exit_ not in at and exit_ != rows[0]["size"]:
            break
        plan[block]["leaves"] = True
        for b in order[place[block] + 1 : place[at[exit_][0]] + 1 if exit_ in at else len(order)]:
            plan[b] |= {"cover": last, "until": exit_}
        now = exit_
    names = [x.split(" ")[0] for x in PLAN.split(", ")]
    kinds = {"path": pa.string(), "leaves": pa.bool_()}
    return pa.table([pa.array([plan[b][n] for b in order], kinds.get(n, pa.int64())) for n in names], names)


def _chain(names: list[str]):
    """Of one segment's pieces, those of reached records, with the record's offset and whether it is in one piece."""

    def run(rows: pa.Table, segment: pa.Table) -> pa.Table:
        p = segment.to_pylist()[0]
        rows, offset, ahead, end, step = _candidates(rows, p["start"])
        n = len(offset)
        good = np.append((step != np.arange(n)) | ((ahead > offset[-1]) & p["leaves"]), False)
        reached = np.zeros(n + 1, bool)
        reached[np.searchsorted(offset, p["entry"]) if p["entry"] is not None else n] = True
        jump = np.append(np.where(step != np.arange(n), step, n), n)
        for _ in range(n.bit_length()):
            reached[jump[reached]] = True
            jump = jump[jump]
        heads = np.flatnonzero(reached[:n])
        of = np.searchsorted(heads, np.arange(n), "right") - 1  # the last reached candidate up to each piece
        head = heads[np.maximum(of, 0)] if len(heads) else np.zeros(n, np.int64)
        inside = (of >= 0) & good[head] & (offset < ahead[head]) if len(heads) else np.zeros(n, bool)
        covered = (of < 0) & (offset < p["until"]) if p["cover"] is not None else np.zeros(n, bool)
        record = np.where(covered, p["cover"] or 0, offset[head])
        keep = np.flatnonzero(inside | covered)
        kept = rows.take(pa.array(keep))
        single = (record[keep] == offset[keep]) & (ahead[keep] == end[keep])
        return pa.table([*(kept.column(c) for c in ("path", "block", "mid")), pa.array(record[keep]), pa.array(offset[keep]), pa.array(single), *(kept.column(c) for c in names)], ["path", "block", "mid", "offset", "at", "single", *names])

    return lambda rows, segment: run(rows, segment) if rows.num_rows else pa.table([*rows.select(["path", "block", "mid"]).columns, *[pa.array([], pa.int64())] * 2, pa.array([], pa.bool_()), *rows.select(names).columns], ["path", "block", "mid", "offset", "at", "single", *names])


def read(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """path, offset and the header fields of each record, with the derived columns, each an expression over `payload` (binary)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    pieces = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").cast("long").alias("block")).withColumn("mid", F.monotonically_increasing_id())
    parsed = _parsed(pieces)
    whole = F.col("bytes") == F.col("head_bytes") + 8 + F.col("content")
    fields = [x.split(" ")[0] for x in FIELDS.split(", ")]
    narrow = Cut(parsed.select("path", "block", "mid", "bytes", "head_bytes", "content", *fields, *[F.when(whole, e).alias(k) for k, e in derived.items()]), "pieces")
    types = {f.name: f.dataType.simpleString() for f in narrow.df.schema}
    spans = narrow.df.groupBy("path", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("span"))
    file = Window.partitionBy("path")  # a row for each segment of a file
    before = F.sum("span").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # A file's first piece is what stands before its first version line: nothing, in an archive that begins with a record.
    segments = Cut(spans.select("path", "block", (F.coalesce(before, F.lit(0)) - len(MAGIC)).alias("start"), (F.sum("span").over(file) - len(MAGIC)).alias("size")), "segments")
    links = narrow.df.select("path", "block", "mid", "bytes", "head_bytes", "content")
    ends = Cut(links.groupBy("path", "block").cogroup(segments.df.groupBy("path", "block")).applyInArrow(_ends, HOOK), "ends")
    led = ends.df.select("path", F.col("exit").alias("offset")).union(ends.df.select("path", F.lit(0).cast("long"))).distinct()
    hooks = ends.df.join(led, ["path", "offset"], "left_semi").select(*[x.split(" ")[0] for x in HOOK.split(", ")])
    plan = Cut(hooks.groupBy("path").cogroup(segments.df.groupBy("path")).applyInArrow(_walk, PLAN), "plan")
    schema = f"{PLACE}, offset long, at long, single boolean, {FIELDS}" + "".join(f", {k} {types[k]}" for k in derived)
    chained = Cut(narrow.df.groupBy("path", "block").cogroup(plan.df.groupBy("path", "block")).applyInArrow(_chain([*fields, *derived]), schema), "chain")
    single = chained.df.filter("single").select("path", "offset", *fields, *derived)
    # Records that hold version lines: their pieces meet by record.
    broken = Cut(chained.df.filter("not single").select("path", "block", "mid", "offset", "at"), "broken")
    for x in (narrow, segments, ends, plan):
        x.drop()
    if not broken.rows:
        return single
    gathered = pieces.join(broken.small(), ["path", "block", "mid"]).groupBy("path", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    again = _parsed(gathered.select("path", "offset", F.array_join(F.col("p.value"), MAGIC).alias("value")))
    return single.unionByName(again.select("path", "offset", *fields, *[e.alias(k) for k, e in derived.items()]))


def _page(c: str) -> Column:
    return F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op5_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read(spark, path, read_bytes=F.octet_length("payload").cast("long"), read_digest=F.sha2("payload", 256))
    revisit = F.col("record_type") == "revisit"
    return got.select(
        _page("record_id").alias("page_id"), F.when(revisit, F.col("header_payload_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("read_digest")).alias("payload_digest"), "record_type", F.when(revisit, _page("refers_to")).alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM r
"""
