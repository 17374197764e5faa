"""MinHash near-duplicate classes by weighted signatures of word shingles.

Signatures follow BagMinHash: the weight axis is cut at 0, 1, 2, 4, 8, ...; every shingle runs one Poisson process for
each interval that its count reaches into, whose points carry a time, a signature slot and a place on the weight axis.
Points above the count are passed over, and a slot holds the earliest point that is left, so two texts agree in a slot
with the probability of their weighted Jaccard similarity. Points later than a text's time horizon can't win a slot, so
only K log K of them are made whatever the text's length.

Equal bands of slots put texts in buckets. Pairs out of buckets are verified on their multisets of 64-bit shingle hashes, first each
text against the least member of its buckets. Buckets that share texts form a cluster, and a cluster that still holds several
classes is searched for all links between them, without comparing its members with one another:

* The shingles that more than half of the cluster's texts hold are its core, and each text is encoded as its difference d from
  the core. Two texts of sizes a and b are linked just if their differences differ in at most c (a + b) shingles, where
  c = (1 - s) / (1 + s); with v = d - c a, if their differences share at least (v + v') / 2 shingles.
* Texts with v + v' <= 0 are thus linked whatever they hold; all of them are linked to the cluster's text of least v.
* Any other link shares one of the rarest shingles of both differences: rare first, a text's d - need + 1 are enough, where
  need is the least of (v + v') / 2 over the other classes. Only texts that share one of these, and whose later shingles
  can still make up the need, are pairs to verify.

So no link within a cluster is lost, while near copies of one text, which hold most shingles in common, meet by what sets
them apart. A cluster of mutual copies costs one comparison a member.

Defined cases: null or empty texts, and texts without a word, form no links but to equal texts (exact copies are one
class); texts of fewer than five words have the one shingle of all their words; repeated rows are copies of one class;
an empty table gives an empty table; null doc_ids are kept as rows of their own; very long texts are cut into shingles one at a
time; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut, digest, free_name, own
from ledgerloom.llm._words import U, Words, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
#: Bits of a shingle's hash that seed its processes; links are verified on 64 bits.
_KEY_BITS = 44


def _shingles(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the 64-bit hash of every shingle of a batch."""
    at, h = w.windows(shingle)
    who = w.owner()[at]
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    if len(short):
        whole = np.array([mix(np.array([hash_run(w, i)], U))[0] for i in short], U)
        who, h = np.concatenate([who, short]), np.concatenate([h, whole])
    return who, h


def shingle_keys(w: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a batch as text index << 44 | 44 bits of the shingle's hash, sorted, and their counts."""
    who, h = _shingles(w, shingle)
    return np.unique((who.astype(U) << U(_KEY_BITS)) | (h >> U(64 - _KEY_BITS)), return_counts=True)


def shingle_sets(w: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 64-bit hash and count of the distinct shingles of each text, in this order."""
    who, h = _shingles(w, shingle)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])])) if len(who) else np.zeros(0, np.int64)
    return who[first], h[first], np.diff(np.append(first, len(who)))


def elements(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and element: a multiset as a set, whose elements are a shingle's first, second, ... occurrence. In order of the texts."""
    who, h, count = shingle_sets(w)
    at = np.repeat(np.arange(len(h)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return who[at], np.where(nth > 0, mix(h[at] ^ mix(nth)), h[at]).astype(np.int64)


def hash_run(w: Words, i: int) -> int:
    total = int(w.count[i])
    for x in w.hash[w.first[i] : w.first[i] + w.count[i]]:
        total = (total * 0x5851F42D4C957F2D + int(x)) & (1 << 64) - 1
    return total


def signatures(who: np.ndarray, what: np.ndarray, count: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Winner of each slot of each text, as 64-bit ids. who, what, count: the shingle multisets; a text without shingles has zeros."""
    best = np.full(texts * slots, np.inf)
    winner = np.zeros(texts * slots, U)
    weight = np.bincount(who, count, texts)
    horizon = np.divide(slots * (math.log(slots) + 4), weight, out=np.zeros(texts), where=weight > 0)
    level = [np.zeros(len(who), np.int64)]
    index = [np.arange(len(who))]
    k = 1
    while len(i := np.flatnonzero(count > 1 << (k - 1))):
        level.append(np.full(len(i), k))
        index.append(i)
        k += 1
    level, index = np.concatenate(level), np.concatenate(index)
    own, low = who[index], np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(low, 1).astype(float)  # an interval (low, 2 low], or (0, 1], has this length
    seed = mix(what[index] ^ (level.astype(U) << U(58)))
    room = np.where(level > 0, (count[index] - low) / rate, 1.0)  # the share of the interval below the count
    now, made, live = np.zeros(len(own)), 0, np.arange(len(own))
    open_texts = weight > 0
    while open_texts.any():
        live, waiting, step = live, [], 1
        while len(live):
            n = np.arange(made, made + step, dtype=U)
            raw = mix(seed[live][:, None] + n[None, :] * U(0xA24BAED4963EE407))
            time = now[live][:, None] + np.cumsum(-np.log(((raw >> U(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / rate[live][:, None]
            more = mix(raw ^ U(0x6A09E667F3BCC909))
            slot = ((more >> U(32)) * U(slots) >> U(32)).astype(np.int64)
            take = (time <= horizon[own[live]][:, None]) & ((more & U(0xFFFFFFFF)).astype(float) * 2.0**-32 < room[live][:, None])
            r, c = np.nonzero(take)
            flat, t, ids = own[live][r] * slots + slot[r, c], time[r, c], raw[r, c]
            np.minimum.at(best, flat, t)
            won = best[flat] == t
            winner[flat[won]] = ids[won]
            now[live] = time[:, -1]
            made += step
            waiting.append(live[now[live] > horizon[own[live]]])
            live = live[now[live] <= horizon[own[live]]]
            step = min(2 * made, 64)
            if len(live) * step > 1 << 20:
                step = max(1, (1 << 20) // len(live))
        missing = np.isinf(best.reshape(texts, slots)).any(axis=1) & (weight > 0)
        if not missing.any():
            break
        # A rare text with an unfilled slot begins anew with twice the horizon: its points are the same, only more of them.
        horizon = np.where(missing, horizon * 2, 0)
        live, made = np.flatnonzero(missing[own]), 0
        now[live] = 0
        open_texts = missing
    return winner.reshape(texts, slots)


def _banded(bands: int, rows: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # at most one entry for each row of this task
        for batch in batches:
            for part in slices(batch, column):
                keys = part.column("key").to_pylist()
                fresh = []
                for i, x in enumerate(keys):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                w = Words(part.column(column).take(pa.array(fresh, pa.int64())))
                pairs, count = shingle_keys(w)
                who = (pairs >> U(_KEY_BITS)).astype(np.int64)
                sig = signatures(who, pairs & U((1 << _KEY_BITS) - 1), count, len(fresh), bands * rows).reshape(len(fresh), bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(fresh), bands)).copy()
                for j in range(rows):
                    band = mix(band ^ sig[:, :, j])
                lists: list = [None] * len(keys)
                for j, i in enumerate(fresh):
                    if w.count[j]:
                        lists[i] = band[j].astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                sides = [shingle_sets(Words(part.column(x))) for x in ("text_a", "text_b")]
                size = sum(np.bincount(who, n, part.num_rows) for who, _, n in sides)
                who, h, n = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((h, who))
                who, h, n = who[order], h[order], n[order]
                both = np.flatnonzero((who[1:] == who[:-1]) & (h[1:] == h[:-1]))  # a shingle of one text stands there once
                common = np.bincount(who[both], np.minimum(n[both], n[both + 1]), part.num_rows)
                joint = size - common
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array((joint > 0) & (common >= least * joint - 1e-9))], ["a", "b", "linked"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each text, with its cluster."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            who, e = elements(Words(part.column("text")))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([part.column("cluster").take(at), part.column("n").take(at), pa.array(e)], ["cluster", "n", "element"])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with each text's size and the size of its difference from the core, and a row for each element of the difference."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            who, e = elements(Words(part.column("text")))
            bounds = np.searchsorted(who, np.arange(part.num_rows + 1))
            size = np.diff(bounds)
            apart = []
            for i in range(part.num_rows):
                own, core = e[bounds[i] : bounds[i + 1]], part.column("core")[i]
                core = np.asarray(core.values) if core.is_valid else own[:0]
                apart.append(np.setxor1d(own, core, assume_unique=True) if len(core) else own)
            d = np.array([len(x) for x in apart], np.int64)
            at = pa.array(np.repeat(np.arange(part.num_rows), d))
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("node"), pa.array(size.astype(np.int64)), pa.array(d), none], ["cluster", "node", "size", "d", "element"])
            more = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("cluster").take(at), part.column("node").take(at), more, more, pa.array(np.concatenate(apart) if len(at) else np.zeros(0, np.int64))], ["cluster", "node", "size", "d", "element"])


def components(links: DataFrame) -> Cut:
    """node, comp: the least node that can be reached over links a, b.

    Each round hangs every node below its least neighbour, follows the trees to their roots, and goes on with the links between roots,
    so a group that hangs on few texts is one node after the first round.
    """
    edges = Cut(links.select(*_ordered("a", "b")).filter("a <> b").distinct(), "ends")
    labels = None
    while labels is None or edges.rows:
        roots = Cut(edges.df.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")), "roots")
        while True:
            up = roots.df.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            after = Cut(roots.df.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"), F.col("up").isNotNull().alias("moved")), "roots", "moved")
            roots.drop()
            roots = after
            if not after.flagged:
                break
        to = lambda x: roots.df.select(F.col("node").alias(x), F.col("comp").alias(f"root_{x}"))
        known = roots.df.select("node", "comp")
        if labels is not None:
            known = known.unionByName(labels.df.join(to("comp"), "comp", "left").select("node", F.coalesce("root_comp", "comp").alias("comp")))
        left = edges.df.join(to("a"), "a", "left").join(to("b"), "b", "left").select(*_ordered(F.coalesce("root_a", "a"), F.coalesce("root_b", "b")))
        now, rest = Cut(known, "labels"), Cut(left.filter("a <> b").distinct(), "ends")
        for x in (roots, edges, *([labels] if labels else [])):
            x.drop()
        labels, edges = now, rest
    edges.drop()
    whole = Cut(labels.df.unionByName(labels.df.select(F.col("comp").alias("node"), "comp").distinct()), "labels")
    labels.drop()
    return whole


def merged(labels: Cut, links: DataFrame) -> Cut:
    """labels after further links, found on the links between classes only."""
    of = lambda x: labels.df.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    joined = components(between.filter("a <> b").distinct()).df.withColumnsRenamed({"node": "was", "comp": "now"})
    old = labels.df.join(joined, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    new = joined.join(labels.df, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("comp"))
    return Cut(old.unionByName(new), "labels")


def _rivals(nodes: DataFrame) -> DataFrame:
    """nodes (cluster, node, class, v, ...) with other: the least v among the cluster's texts of other classes. Texts of clusters of one class go."""
    least = nodes.groupBy("cluster", "class").agg(F.min("v").alias("v"))
    first = least.groupBy("cluster").agg(F.min(F.struct("v", "class")).alias("first"))
    second = least.join(first, "cluster").filter(F.col("class") != F.col("first.class")).groupBy("cluster").agg(F.first("first").alias("first"), F.min("v").alias("second"))
    other = F.when(F.col("class") == F.col("first.class"), F.col("second")).otherwise(F.col("first.v"))
    return nodes.join(second, "cluster").withColumn("other", other).drop("first", "second")


def _need(v: str, other: str) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col(v) + F.col(other)) / 2 - 1e-6))


def cluster_pairs(texts: DataFrame, opened: Cut, relabel, similarity: float) -> None:
    """Finds all links between classes of the open clusters: relabel(pairs) verifies pairs a, b and gives the classes (node, comp) after it.

    texts: node, text; opened: cluster, n (its texts), node, class.
    """
    slack = (1 - similarity) / (1 + similarity)
    held = Cut(texts.join(opened.small("node", "cluster", "n"), "node"), "open-texts")
    core = held.df.mapInArrow(_exploded, "cluster long, n long, element long").groupBy("cluster", "n", "element").count().filter(2 * F.col("count") > F.col("n"))
    core = Cut(core.groupBy("cluster").agg(F.collect_list("element").alias("core")), "core")  # at most twice the mean size of the cluster's texts
    encoded = Cut(held.df.select("cluster", "node", "text").join(core.small("cluster", "core"), "cluster", "left").mapInArrow(_encoded, "cluster long, node long, size long, d long, element long"), "encoded")
    sized = Cut(encoded.df.filter("element is null").join(opened.small("node", "class"), "node").select("cluster", "node", "class", "d", (F.col("d") - slack * F.col("size")).alias("v")), "sized")

    # Texts that no difference could keep from the text of least v.
    least = sized.df.groupBy("cluster").agg(F.min(F.struct("v", "node", "class")).alias("least"))
    sure = sized.df.join(least, "cluster").filter("v + least.v <= 1e-6 and class <> least.class").select(*_ordered("node", "least.node"))
    labels = relabel(sure)
    nodes = sized.df.drop("class").join(labels.df.withColumnRenamed("comp", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    shares = encoded.df.filter("element is not null").select("cluster", "node", "element")
    nodes = Cut(_rivals(nodes).select("cluster", "node", "class", "d", "v", "other"), "rivals")
    if not nodes.rows:
        return

    # Twice: elements that only one text holds can't be shared, and texts that lack elements to share lend them to no other.
    for _ in range(2):
        shared = shares.join(shares.groupBy("cluster", "element").agg(F.count("*").alias("f")).filter("f > 1"), ["cluster", "element"])
        shared = Cut(shared, "shared")
        able = nodes.df.select("cluster", "node", "class", "d", "v", "other").join(shared.df.groupBy("node").agg(F.count("*").alias("s")), "node").filter(_need("v", "other") <= F.col("s"))
        nodes = Cut(_rivals(able.drop("other")), "able")  # with s, the elements that a text may share
        if not nodes.rows:
            return
        shares = shared.df.join(nodes.df.select("node"), "node", "left_semi").select("cluster", "node", "element")
    last = shares.join(shares.groupBy("cluster", "element").agg(F.count("*").alias("f")).filter("f > 1"), ["cluster", "element"])
    order = Window.partitionBy("node").orderBy("f", "element")  # a text's elements
    ranked = last.withColumn("r", F.row_number().over(order)).join(nodes.df, ["cluster", "node"])
    # s counts the elements of the pass before, which is no less than now, so no prefix is too short.
    prefix = Cut(ranked.filter(F.col("r") <= F.col("s") - _need("v", "other") + 1).select("cluster", "element", "node", "class", "v", (F.col("s") - F.col("r")).alias("rest")), "prefix")
    a = prefix.df.select("cluster", "element", *[F.col(x).alias(f"{x}_a") for x in ("node", "class", "v", "rest")])
    b = prefix.df.select("cluster", "element", *[F.col(x).alias(f"{x}_b") for x in ("node", "class", "v", "rest")])
    met = a.join(b, ["cluster", "element"]).filter("node_a < node_b and class_a <> class_b and (v_a + v_b) / 2 <= 1 + least(rest_a, rest_b) + 1e-6")
    relabel(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    for x in (held, core, encoded, sized, nodes, shared, prefix):
        x.drop()


def _ordered(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, rid, node, comp, links) of all documents and pairs (a, b) of linked nodes.

    key: 128-bit digest of the text; node: the least rid of the text's copies; comp: the least node of the class; links:
    how many verified links the class's texts hold at this node.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    banded = base.mapInArrow(_banded(BANDS, BAND_ROWS, "text"), "doc_id long, key binary, bands array<long>")
    signed = Cut(banded.withColumn("rid", F.monotonically_increasing_id()), "signed")
    repeated = Cut(signed.df.groupBy("key").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "repeated")
    rows = signed.df.join(repeated.small("key", "first"), "key", "left").withColumn("node", F.coalesce("first", "rid")).drop("first")
    nodes = rows.filter("rid = node and bands is not null").select("node", "key", "bands")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("bucket", "centre")
    # Each text with the least texts of its buckets: the edges that span the clusters.
    edges = Cut(placed.join(shared, "bucket").filter("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    out = rows.select("doc_id", "key", "rid", "node")
    if not edges.rows:
        result = Cut(out.select("doc_id", "key", "rid", "node", F.col("node").alias("comp"), F.lit(0).cast("long").alias("links")), "classes")
        signed.drop()
        return result.df, edges.df
    wanted = Cut(nodes.select("node", "key").join(edges.df.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "wanted")
    texts = Cut(base.join(wanted.small("node", "key"), "key").groupBy("node").agg(F.first("text").alias("text")), "texts")
    found: list[Cut] = []
    labels: list[Cut] = []

    def relabel(pairs: DataFrame) -> Cut:
        """Verifies pairs a < b on the texts' multisets of shingles; the classes after it."""
        asked = Cut(pairs, "pairs")
        if labels and not asked.rows:
            return labels[-1]
        side = [texts.df.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
        found.append(Cut(asked.df.join(side[0], "a").join(side[1], "b").mapInArrow(_similar(similarity), "a long, b long, linked boolean"), "verified", "linked"))
        asked.drop()
        if labels and not found[-1].flagged:
            return labels[-1]
        linked = found[-1].df.filter("linked")
        labels.append(merged(labels[-1], linked) if labels else components(linked))
        return labels[-1]

    relabel(edges.df.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    clusters = components(edges.df)
    state = clusters.df.select("node", F.col("comp").alias("cluster")).join(labels[-1].df, "node", "left").select("cluster", "node", F.coalesce("comp", "node").alias("class"))
    # A cluster of two texts has had its one pair compared.
    several = state.groupBy("cluster").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).filter("n > 2 and x < y").select("cluster", "n")
    opened = Cut(state.join(several, "cluster"), "open")
    if opened.rows:
        cluster_pairs(texts.df, opened, relabel, similarity)
    links = found[0].df
    for x in found[1:]:
        links = links.unionByName(x.df)
    links = Cut(links.filter("linked").select("a", "b").distinct(), "links").df
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    end = labels[-1].df.select("node", "comp").join(degree, "node", "left")
    result = Cut(out.join(end, "node", "left").select("doc_id", "key", "rid", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    for x in (signed, repeated, edges, wanted, texts, clusters, opened, *found, *labels):
        x.drop()
    return result.df, links


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the doc_id of the class's first row), links, keep (true for one row of each class)."""
    kept, _ = near_duplicates(docs)
    first = kept.filter("rid = comp").select("comp", F.col("doc_id").alias("class_id"))
    return kept.join(first, "comp").select("doc_id", "class_id", "links", (F.col("rid") == F.col("comp")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class; its columns unchanged. Rows of unlinked, single texts pass through untouched."""
    kept, _ = near_duplicates(docs, text, doc_id)
    per_text = kept.groupBy("key").agg(F.count("*").alias("n"), F.first(F.col("node") == F.col("comp")).alias("lead"))
    verdict = Cut(per_text.filter("n > 1 or not lead").select("key", "lead"), "verdict")
    k, lead, whole = (free_name(docs.columns, x) for x in ("key", "lead", "whole"))
    marked = docs.withColumn(k, digest(F.col(text))).join(verdict.small("key", "lead").withColumnsRenamed({"key": k, "lead": lead}), k, "left")
    single = marked.filter(F.col(lead).isNull()).select(*own(docs))
    one = marked.filter(F.col(lead)).groupBy(k).agg(F.min_by(F.struct(*own(docs)), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))).alias(whole))
    return single.unionByName(one.select(f"{whole}.*"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
