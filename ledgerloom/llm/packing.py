"""Packing token ids into sequences with bounded space.

Every task keeps at most OPEN open windows. A document's ids are cut into full sequences, and the rest is placed in the
open window with the least room that still holds it; where none does, the fullest open window goes out and a new one
opens. What is open at a task's end, a bounded number of windows, is merged over groups of MERGE tasks: their pieces are
laid end to end and cut where a sequence is full, so that one sequence a group is padded.

Stage one is written to the shared folder before its leftovers are merged, so a lost executor repeats its own
tasks only, and sequence ids, which are made of the task's number, stay as written.

Defined cases: null is the empty text, which still has its end id; any number of ids is cut as it needs; repeated rows and
null doc_ids are documents of their own; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm._shared import Cut

LENGTH = 1024
OPEN = 64
MERGE = 32
END = 0
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Ids as the tokenizers library gives them; the same ranks in tiktoken are some five times as fast."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        ranks = {self._raw(t): i for t, i in self.slow.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    @staticmethod
    def _raw(token: str) -> bytes:
        from ledgerloom.llm.bpe import byte_chars

        return bytes(byte_chars()[c] for c in token)

    def __call__(self, text: str | None) -> np.ndarray:
        try:
            got = self.fast.encode(text or "", allowed_special=self.special)
        except BaseException as e:  # its regex engine gives up on some very long runs, by a panic that is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            got = self.slow.encode(text or "", add_special_tokens=False).ids
        return np.array([*got, END], "<u4")


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


class Packer:
    """Bounded-space best fit. Pieces go out as (document, start, ids, sequence, offset)."""

    def __init__(self, first_sequence: int, length: int = LENGTH, windows: int = OPEN):
        self.next, self.length, self.windows = first_sequence, length, windows
        self.rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple]:
        full = len(ids) // self.length * self.length
        for at in range(0, full, self.length):
            yield (*doc, at, ids[at : at + self.length], self.next, 0)
            self.next += 1
        rest = ids[full:]
        if not len(rest):
            return
        i = bisect_left(self.rooms, (len(rest), -1))
        if i < len(self.rooms):
            room, sequence = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.windows:
                yield from self.held.pop(self.rooms.pop(0)[1])
            room, sequence = self.length, self.next
            self.next += 1
            self.held[sequence] = []
        self.held[sequence].append((*doc, full, rest, sequence, self.length - room))
        if room == len(rest):
            yield from self.held.pop(sequence)
        else:
            insort(self.rooms, (room - len(rest), sequence))

    def rest(self) -> Iterator[tuple]:
        for _, sequence in self.rooms:
            yield from self.held.pop(sequence)
        self.rooms = []


def _first(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = ids_of(path), TaskContext.get().partitionId()
        packer = Packer(part << 32)

        def table(pieces: list[tuple], left: bool) -> pa.RecordBatch:
            doc, total, start, ids, sequence, offset = zip(*pieces, strict=True) if pieces else ((),) * 6
            raw = [x.tobytes() for x in ids]
            arrays = [
                pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array([part // MERGE] * len(raw), pa.int64()), pa.array(raw if left else [None] * len(raw), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "merge", "ids"])

        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py())
                out += packer.add((doc, len(ids)), ids)
            yield table(out, False)
        yield table(list(packer.rest()), True)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """The leftovers of one group of tasks, laid end to end; a piece that crosses a sequence's end is cut there."""
    group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    base, at, out = -1 - (group.column("merge")[0].as_py() << 32), 0, []
    for row in group.to_pylist():
        ids, done = np.frombuffer(row["ids"], "<u4"), 0
        while done < len(ids):
            take = min(len(ids) - done, LENGTH - at % LENGTH)
            piece = ids[done : done + take]
            out.append((row["doc_id"], row["start"] + done, take, zlib.crc32(piece.tobytes()), row["doc_tokens"], base - at // LENGTH, at % LENGTH))
            done, at = done + take, at + take
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [x.split(" ")[0] for x in FIELDS.split(", ")])


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece. A sequence's ids are its pieces' by offset; those of a merged sequence have negative sequence_ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = Cut(rows.mapInArrow(_first(path), f"{FIELDS}, merge long, ids binary"), "placed").df
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]
    merged = placed.filter("ids is not null").groupBy("merge").applyInArrow(_merge, FIELDS)
    return placed.filter("ids is null").select(*names).unionByName(merged)


def op2_bounded_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
