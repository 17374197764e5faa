"""Byte-level BPE by a backtracking encoder, and decoding through an offset table.

Encoding: an Aho-Corasick automaton over the vocabulary gives the longest token that begins at a byte. The encoder
goes forward with longest matches; a token may follow another only if the two, encoded alone as one string, would stay
those two tokens (the pair-compatibility test, kept in a table). If not, the token is shortened to the longest token
that is its prefix; if none is left, the last token is taken back and its end marked dead. No end is tried twice, so
the work is linear, and the only chain of compatible tokens over a text is its BPE encoding.

Decoding: all tokens' bytes lie in one buffer; a table of offsets gives each id's place, and a text is gathered in one step.

Defined cases: null is the empty text, which has no ids; the special token's string in a text is its id, as in the
library; a very long text is encoded whole; repeated rows and null doc_ids are rows of their own; other columns play no part; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose ids one worker keeps, twice, and tested pairs; beyond that they are found anew.
CACHE = 500_000


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            table[chr(256 + len(table) - len(plain))] = b
    return table


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.token = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}  # two ids to the merge's rank and id
        self.parts: dict[int, tuple[int, int, int]] = {}  # an id to its own merge's rank and halves
        for rank, (a, b) in enumerate((raw(a), raw(b)) for a, b in merges):
            pair = vocab[a], vocab[b]
            self.pair[pair] = rank, vocab[a + b]
            self.parts.setdefault(vocab[a + b], (rank, *pair))
        self.vocab = vocab
        self.trie = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.trie.add_word(b.decode("latin-1"), (len(b), i))
        self.trie.make_automaton()
        self.shorter: dict[int, int] = {}
        for b, i in vocab.items():
            for n in range(len(b) - 1, 0, -1):
                if (p := vocab.get(b[:n])) is not None:
                    self.shorter[i] = p
                    break
        size = max(self.token) + 1
        self.length = np.array([len(self.token.get(i, b"")) for i in range(size)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.buffer = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undoing the later of the merges at their border, step by step, shows no merge over it that would have come first."""
        got = self.compatible.get((a, b))
        if got is not None:
            return got
        left, right, until, fits = a, b, len(self.pair) + 1, True
        while True:
            if self.pair.get((left, right), (until, 0))[0] < until:
                fits = False
                break
            lr, rr = self.parts.get(left, (-1,))[0], self.parts.get(right, (-1,))[0]
            if lr > rr:
                until, left = lr, self.parts[left][2]
            elif rr >= 0:  # of two equal merges the left one runs first
                until, right = rr + 1, self.parts[right][1]
            else:
                break
        if len(self.compatible) >= CACHE:
            self.compatible.clear()
        self.compatible[a, b] = fits
        return fits

    def longest(self, data: bytes) -> list[int]:
        """The longest token that begins at each byte, from one pass of the automaton."""
        out, best = [self.vocab[data[i : i + 1]] for i in range(len(data))], [1] * len(data)
        for end, (n, i) in self.trie.iter(data.decode("latin-1")):
            if n > best[at := end - n + 1]:
                best[at], out[at] = n, i
        return out

    def encode_word(self, data: bytes) -> list[int]:
        """The ids of one word of the pre-tokenizer."""
        if (whole := self.vocab.get(data)) is not None:
            return [whole]
        ahead = self.longest(data)
        alive = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        pos, token = 0, ahead[0]
        while pos < len(data):
            while True:
                end = pos + len(self.token[token])
                if alive[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = ahead[pos] if pos < len(data) else token
                    break
                if token in self.shorter:
                    token = self.shorter[token]
                    continue
                alive[pos] = 0
                token = out.pop()
                pos -= len(self.token[token])
                break
        return out

    def _word(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = np.array(self.encode_word(word.encode()), "<u4").tobytes()
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        self.known[word] = got
        return got

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for part in self.apart.split(text or "") if self.apart else [text or ""]:
            if part in self.specials:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            else:
                out += [self.known.get(w) or self._word(w) for w in self.words.findall(part)]
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the token buffer."""
        ids = np.asarray(ids, np.int64)
        n = self.length[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self.buffer[np.repeat(self.offset[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            ids = [b.encode(x.as_py()).astype(np.int32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows doc_id, ids; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_decoded(b.decode(x or [])) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = b.encode(text.as_py())
                shown = ",".join([b.decimal[i] for i in ids.tolist()])
                rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(_decoded(b.decode(ids)).encode()).hexdigest()))
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
