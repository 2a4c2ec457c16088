"""Token-id files in Simple-8b words.

A 64-bit word holds a 4-bit selector above 60 bits: selectors 0 to 13 pack
1 to 60 ids of 60 to 1 bits each, selector 14 is an escape, after which the
next word holds one id of up to 64 bits. Ids lie in blocks of BLOCK ids; each
block starts on a word, and the footer has the word offset of every block and
the id and token count of every document. A block is decoded by whole arrays:
ids of a block go to their places by selector.

File: MAGIC, words, then the footer (block offsets, block sizes, document ids,
a null mask of those, token counts, as little-endian int64 arrays), its length
and crc32, MAGIC. Files get their names when complete.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files
from tessera.llm.files import frugal
from tessera.llm.word_ids import loaded
from tessera.session import shared_dir

MAGIC = b"TS8BIDS1"
BLOCK = 1 << 16
#: Ids a word and bits an id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = 60 // COUNTS
ESCAPE = 14
PARTS = "file string, shard int, n_docs bigint, n_tokens bigint"
OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of one block: each word takes as many ids as still fit."""
    v = np.asarray(ids, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    take, sel = np.ones(n, np.int64), np.full(n, ESCAPE, np.int64)
    for s in range(len(COUNTS) - 1, -1, -1):  # the later, fuller selectors win
        if COUNTS[s] > n:
            continue
        small = np.append(0, np.cumsum(v >> np.uint64(BITS[s]) == 0))
        fits = np.flatnonzero(small[COUNTS[s] :] - small[: n + 1 - COUNTS[s]] == COUNTS[s])
        if not len(fits):
            break
        take[fits], sel[fits] = COUNTS[s], s
    starts, i, steps = [], 0, take.tolist()
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    sel = sel[starts]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(size.sum(), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[sel == ESCAPE] + 1] = v[starts[sel == ESCAPE]]
    for s in np.unique(sel[sel < ESCAPE]):
        own = sel == s
        for k in range(COUNTS[s]):
            words[place[own]] |= v[starts[own] + k] << np.uint64(k * BITS[s])
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    marked = np.flatnonzero(sel == ESCAPE)
    raw = np.zeros(len(words), bool)
    if len(marked):  # a raw word may look like an escape itself: walk the marks
        last = -2
        for i in marked.tolist():
            if i != last + 1:
                raw[i + 1] = True
                last = i
        sel[raw] = -1
    count = np.where(sel == ESCAPE, 1, COUNTS[np.clip(sel, 0, 13)])
    count[raw] = 0
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(sel[sel >= 0]):
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[place[own]] = words[own + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        out[place[own][:, None] + np.arange(COUNTS[s])] = (words[own][:, None] >> shifts) & mask
    if len(out) != n:
        raise ValueError(f"a block holds {len(out)} ids; its footer says {n}")
    return out


class Writer:
    """Writes documents' ids to a stream, block by block."""

    def __init__(self, out):
        self.out, self.wait, self.waiting = out, [], 0
        self.offsets, self.sizes, self.docs, self.nulls, self.tokens, self.words = [], [], [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens.append(len(ids))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self.flush(False)

    def flush(self, final: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.empty(0, np.uint64)
        whole = len(ids) if final else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            words = pack(ids[at : min(at + BLOCK, whole)])
            self.offsets.append(self.words)
            self.sizes.append(min(BLOCK, whole - at))
            self.words += len(words)
            self.out.write(words.astype("<u8").tobytes())
        self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        self.flush(True)
        foot = b"".join(struct.pack("<q", len(x)) + np.array(x, "<i8").tobytes() for x in (self.offsets, self.sizes, self.docs, self.nulls, self.tokens))
        self.out.write(foot + struct.pack("<qI", len(foot), zlib.crc32(foot)) + MAGIC)
        return sum(self.tokens)


class Reader:
    """Reads documents' ids back, a block at a time."""

    def __init__(self, f):
        self.f, size = f, f.size()
        if f.read_at(8, 0) != MAGIC or f.read_at(8, size - 8) != MAGIC:
            raise ValueError("not a token-id file")
        length, crc = struct.unpack("<qI", f.read_at(12, size - 20))
        foot = f.read_at(length, size - 20 - length)
        if zlib.crc32(foot) != crc:
            raise ValueError("the footer is damaged")
        parts, at = [], 0
        while at < length:
            n = struct.unpack_from("<q", foot, at)[0]
            parts.append(np.frombuffer(foot, "<i8", n, at + 8))
            at += 8 + 8 * n
        self.offsets, self.sizes, self.docs, self.nulls, self.tokens = parts
        self.ends = np.append(self.offsets[1:], (size - 20 - length - 8) // 8)

    def block(self, k: int) -> np.ndarray:
        raw = self.f.read_at(8 * int(self.ends[k] - self.offsets[k]), 8 + 8 * int(self.offsets[k]))
        return unpack(np.frombuffer(raw, "<u8"), int(self.sizes[k]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k, empty = np.empty(0, np.uint64), 0, np.empty(0, np.uint64)
        for doc, null, n in zip(self.docs.tolist(), self.nulls.tolist(), self.tokens.tolist(), strict=True):
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.block(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield None if null else doc, held[:n] if n else empty
            held = held[n:]


def _write(folder: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"{folder}/ids-{shard:06d}.s8b"
        words, docs = loaded(tokenizer), 0
        gc.disable()  # millions of small strings, and no cycles among them
        first = next(batches, None)
        if first is None:
            return
        with files.writing(name) as out:
            w = Writer(out)
            batch = first
            while batch is not None:
                texts = batch.column("text").to_pylist()
                for at in range(0, len(texts), 500):
                    for k, ids in enumerate(words.encode(texts[at : at + 500], end_id)):
                        w.add(batch.column("doc_id")[at + k].as_py(), ids)
                docs += len(texts)
                batch = next(batches, None)
            n = w.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "shard": pa.array([shard], pa.int32()), "n_docs": [docs], "n_tokens": [n]})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            start = row["base"]
            rows: list[tuple] = []
            with files.opened(row["file"]) as f:
                for doc, ids in Reader(f).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ids of all texts below folder in ascending id order; returns the list of files.

    One row per file: file, shard, n_docs, n_tokens. Null texts are empty,
    null ids come first, rows of one id lie in the order of their texts.
    One range shuffle; a shard is one task's range of ids. A file is named by
    its shard, so a repeated task replaces it by the same content.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sorted_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    listed = sorted_docs.mapInArrow(frugal(_write(folder, tokenizer, end_id)), PARTS)
    listed.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(PARTS).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files.

    The first token of each shard is known from the list, which has one row
    per file: the sum runs over that list only.
    """
    from pyspark.sql import Window

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file", "shard", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    # by number, so that the few rows of the list are not brought to one task
    return placed.repartition(max(1, manifest.count())).mapInArrow(frugal(_read), OUT)


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the files and reports on every document as read back from them."""
    return read_token_files(write_token_files(docs, folder or shared_dir(docs.sparkSession, "token-ids"), tokenizer, end_id))
