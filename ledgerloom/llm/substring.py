"""Exact removal of word windows that occur more than once in a corpus, by super-k-mer partitioning.

A window is 35 consecutive words of one text. Its minimiser is the least hash among its 8-word runs, so equal windows
have equal minimisers, and consecutive windows that share one occurrence of theirs form a super-k-mer. Minimisers that start at one place
only can't belong to a repeated window: they are counted first, as narrow rows, and only the super-k-mers of the others
travel, each as one packed string, to the bucket of their minimiser, where sorting their windows counts them exactly.
A hot bucket, of a minimiser with more than HOT super-k-mers, is split: equal super-k-mers of it count once, and their windows go
by their own 128-bit fingerprints instead of by the minimiser, in aggregations that combine on the map side, so that a
passage that a third of all texts share spreads over all tasks. HOT sets who counts a window, not whether it is counted.

A text that occurs in several rows is handled once; all its windows occur elsewhere, so from 35 words on it loses all words.

Defined cases: null texts have no words; texts of fewer than 35 words lose none; null and repeated doc_ids are
rows of their own; a very long text is scanned like any other, and packed in pieces as long as its super-k-mers; an empty table gives
an empty table; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut, digest, free_name, own
from ledgerloom.llm._words import U, Words, slices

WINDOW = 35
RUN = 8
#: Super-k-mers of one minimiser that one bucket takes.
HOT = 1000


def super_kmers(w: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each super-k-mer: its text, the first word of its first window (counted in the text), its windows, its minimiser."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    least = np.full(n + window, np.iinfo(np.uint64).max, U)
    at, h = w.windows(run)
    least[at] = h
    place = np.arange(len(least))  # of the leftmost least run
    width, want = 1, window - run + 1
    while width < want:
        step = min(width, want - width)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        width += step
    owner = w.owner()
    starts = np.flatnonzero(np.repeat(w.first + w.count, w.count) - np.arange(n) >= window)
    if not len(starts):
        return none, none, none, none
    where = place[starts]
    new = (np.diff(where) != 0) | (np.diff(owner[starts]) != 0)
    head = np.concatenate([[0], np.flatnonzero(new) + 1])
    count = np.diff(np.concatenate([head, [len(starts)]]))
    text = owner[starts[head]]
    return text, starts[head] - w.first[text], count, least[starts[head]].astype(np.int64)


def joined(text: str | None) -> bytes:
    """The words of a text joined by one space."""
    return b" ".join((text or "").encode().split())  # bytes.split() takes exactly the six ASCII white-space characters


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # at most one entry for each row of this task
    for batch in batches:
        for part in slices(batch, "text"):
            keys = part.column("key").to_pylist()
            fresh = [i for i, x in enumerate(keys) if x not in seen and not seen.add(x)]
            w = Words(part.column("text"))
            text, at, n, mini = super_kmers(Words(part.column("text").take(pa.array(fresh, pa.int64()))))
            bounds = np.searchsorted(text, np.arange(len(fresh) + 1))
            offsets = np.zeros(len(keys) + 1, np.int32)
            offsets[np.array(fresh, np.int64) + 1] = np.diff(bounds)
            grams = pa.ListArray.from_arrays(
                pa.array(np.cumsum(offsets, dtype=np.int32)),
                pa.StructArray.from_arrays([pa.array(mini), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["mini", "at", "n"]),
            )
            kept = [hashlib.sha256(joined(x)).hexdigest() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(w.count.astype(np.int64)), pa.array(kept), grams], ["doc_id", "key", "n_words", "kept_sha256", "grams"])


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes], list[dict]]]:
    for key, text, spans in zip(*(batch.column(x).to_pylist() for x in ("key", "text", "spans")), strict=True):
        yield key, text.encode().split(), spans


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            rows = [(x["mini"], key, x["at"], x["n"], b" ".join(words[x["at"] : x["at"] + x["n"] + WINDOW - 1])) for key, words, spans in _lists(part) for x in spans]
            yield _table(rows, [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()], ["mini", "key", "at", "n", "packed"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each super-k-mer with 128-bit fingerprints of its words and of each of its windows."""

    def of(words: list[bytes]) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()

    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            rows = []
            for key, words, spans in _lists(part):
                for x in spans:
                    a, n = x["at"], x["n"]
                    rows.append((of(words[a : a + n + WINDOW - 1]), key, a, [of(words[i : i + WINDOW]) for i in range(a, a + n)]))
            yield _table(rows, [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary())], ["span", "key", "at", "windows"])


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser: one bucket after another, each sorted by window."""

    def bucket(rows: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[bytes, int]]:
        windows = []
        for key, at, packed in rows:
            words = packed.split(b" ")
            windows += [(b" ".join(words[i : i + WINDOW]), key, at + i) for i in range(len(words) - WINDOW + 1)]
        windows.sort()
        for i, (x, key, at) in enumerate(windows):
            if (i and windows[i - 1][0] == x) or (i + 1 < len(windows) and windows[i + 1][0] == x):
                yield key, at

    now, rows = None, []
    for batch in batches:
        out: list[tuple[bytes, int]] = []
        for mini, key, at, packed in zip(*(batch.column(x).to_pylist() for x in ("mini", "key", "at", "packed")), strict=True):
            if mini != now:
                out += bucket(rows)
                now, rows = mini, []
            rows.append((key, at, packed))
        yield _table(out, [pa.binary(), pa.int32()], ["key", "at"])
    yield _table(list(bucket(rows)), [pa.binary(), pa.int32()], ["key", "at"])


def covered(starts: list[int]) -> np.ndarray:
    """Places of the words that windows at these starts cover."""
    return np.unique(np.add.outer(np.unique(starts), np.arange(WINDOW)))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, starts in zip(*(batch.column(x).to_pylist() for x in ("key", "text", "starts")), strict=True):
            words = text.encode().split()
            gone = covered(starts)
            keep = np.ones(len(words), bool)
            keep[gone] = False
            kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
            rows.append((key, len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield _table(rows, [pa.binary(), pa.int64(), pa.string(), pa.string()], ["key", "n_removed", "kept_sha256", "kept"])


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, key, n_words, kept_sha256 (of all words), copies of every row; changed: key, n_removed, kept_sha256, kept of single texts that lose words."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = base.mapInArrow(_scan, "doc_id long, key binary, n_words long, kept_sha256 string, grams array<struct<mini:long,at:int,n:int>>")
    found = Cut(scanned.withColumn("rid", F.monotonically_increasing_id()), "grams")
    grams = found.df.filter("size(grams) > 0").select("rid", "key", F.inline("grams"))
    place = F.xxhash64("key", "at")
    # Written, so that the joins with them deal out both sides anew and Spark can split a minimiser or text that many rows hold.
    repeated = Cut(grams.groupBy("mini").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("mini"), "repeated")
    travel = Cut(grams.drop("key").join(repeated.small("mini"), "mini", "left_semi"), "travel")
    rows = found.df.select("doc_id", "key", "n_words", "kept_sha256")
    copies = Cut(rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    rows = rows.join(copies.small("key", "copies"), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    hot = Cut(travel.df.groupBy("mini").count().filter(F.col("count") > HOT).select("mini", F.lit(True).alias("hot")), "hot")
    flagged = travel.df.join(hot.small("mini", "hot"), "mini", "left")
    lists = flagged.groupBy("rid").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.struct("mini", "at", "n"))).alias("cold_spans"), F.collect_list(F.when(F.col("hot"), F.struct("mini", "at", "n"))).alias("hot_spans")
    )
    keyed = lists.join(found.df.select("rid", "key"), "rid")
    # Copies in several tasks list the same spans; one list of each text goes on.
    spans = Cut(keyed.groupBy("key").agg(F.first(F.struct("cold_spans", "hot_spans")).alias("s")).select("key", "s.*"), "spans")
    texts = Cut(base.join(spans.small("key"), "key").groupBy("key").agg(F.first("text").alias("text")).join(spans.df, "key"), "texts").df
    cold = texts.select("key", "text", F.col("cold_spans").alias("spans")).filter("size(spans) > 0").mapInArrow(_pack, "mini long, key binary, at int, n int, packed binary")
    marks = cold.select("mini", "key", "at", "packed").repartition("mini").sortWithinPartitions("mini").mapInArrow(_count, "key binary, at int")
    marks = marks.select("key", F.array("at").alias("starts"))
    warm = Cut(texts.select("key", "text", F.col("hot_spans").alias("spans")).filter("size(spans) > 0").mapInArrow(_fingerprints, "span binary, key binary, at int, windows array<binary>"), "warm")
    if warm.rows:
        # Equal super-k-mers count once; all windows of one that starts at two places are repeated, and so are those that two of them share.
        place = F.xxhash64("key", "at")
        kinds = warm.df.groupBy("span").agg((F.min(place) != F.max(place)).alias("twice"), F.first("windows").alias("windows"))
        each = Cut(kinds.select("span", "twice", F.posexplode("windows").alias("i", "window")), "windows").df
        again = each.groupBy("window").agg(F.min("span").alias("x"), F.max("span").alias("y"), F.bool_or("twice").alias("twice")).filter("twice or x <> y").select("window")
        # Written, so that the join deals out both sides and Spark can split a super-k-mer that many texts hold.
        found_in = Cut(each.join(again, "window", "left_semi").groupBy("span").agg(F.collect_list("i").alias("i")), "found")
        marks = marks.unionByName(warm.df.join(found_in.small("span", "i"), "span").select("key", F.transform("i", lambda i: i + F.col("at")).alias("starts")))
    starts = marks.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    changed = texts.select("key", "text").join(starts, "key").mapInArrow(_strip, "key binary, n_removed long, kept_sha256 string, kept string")
    return rows, changed


_NOTHING = hashlib.sha256(b"").hexdigest()


def removed_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, changed = repeated_windows(docs)
    changed = changed.select("key", "n_removed", F.col("kept_sha256").alias("less"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return rows.join(changed, "key", "left").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, _NOTHING).otherwise(F.coalesce("less", "kept_sha256")).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated windows taken out of text; a text that loses nothing is unchanged to the byte, one that loses words holds the others joined by one space."""
    rows, changed = repeated_windows(docs, text, doc_id)
    gone = rows.filter((F.col("copies") > 1) & (F.col("n_words") >= WINDOW)).select("key").distinct().select("key", F.lit("").alias("kept"))
    verdict = Cut(changed.select("key", "kept").join(gone.select("key"), "key", "left_anti").unionByName(gone), "stripped")
    k, kept = (free_name(docs.columns, x) for x in ("key", "kept"))
    joined_rows = docs.withColumn(k, digest(F.col(text))).join(verdict.df.withColumnsRenamed({"key": k, "kept": kept}), k, "left")
    return joined_rows.withColumn(text, F.coalesce(F.col(kept), F.col(text))).select(*own(docs))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
     d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM g) WHERE c > 1),
     gone AS (SELECT DISTINCT doc_id, i + j AS k FROM d, (SELECT unnest(range(35)) AS j)),
     each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
