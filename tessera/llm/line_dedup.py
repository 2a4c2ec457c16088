"""Line dedup on a sharded minimal perfect hash.

1. Every document's lines are hashed in its scan task (two 64-bit hashes of the
   normal form of each line) and shrink to one row per distinct line and task;
   a grouped sum gives, for each distinct line, its count, its smallest and
   its largest document id.
2. Lines of at least two documents are dealt to shards by their first hash.
   For each shard a minimal perfect hash is built (levels of bit arrays: a key
   stays where it falls alone, the others go on to the next level); rank in
   the bit arrays is the key's place in three flat arrays: fingerprint
   (second hash), count, and holder (smallest document id).
3. Documents are scanned again; each task probes the shard files for its
   lines, in blocks of documents, a shard at a time through a bounded cache.
   Texts are never shuffled, and lines are never joined.

Lines of a single document need no entry: a probe that finds no fingerprint
keeps the line.

Contract: a null or empty text is one empty line. A null id counts as one
document that comes after all others. Rows that repeat an id count as one
document, so each of them keeps its lines where the id is the smallest. Lines
whose normal form has fewer than min_chars code points always stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import files
from tessera.llm.files import frugal
from tessera.session import column, shared_dir

BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1
#: Distinct repeated lines a shard should hold, bytes of shards a worker keeps, and bytes of batches that are probed together.
SHARD_KEYS, KEPT_BYTES, BLOCK_BYTES = 400_000, 128 << 20, 48 << 20
GAMMA = 2.0
MAGIC = b"TMPHLIN2"
OUT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    n = len(key)
    if n < min_chars or n < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def line_hashes(text: str, min_chars: int) -> tuple[list[int], list[int], list[int]]:
    """Places and both hashes of the lines that have a key."""
    at, one, two = [], [], []
    for i, line in enumerate(text.encode().lower().split(b"\n")):  # bytes.lower() changes A-Z only
        if (key := line_key(line, min_chars)) is not None:
            x = xxhash.xxh3_128_intdigest(key)
            at.append(i)
            one.append(x >> 64)
            two.append(x & 0xFFFFFFFFFFFFFFFF)
    return at, one, two


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of h for each level."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; foreign keys get some place or -1."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest, self.ranks, base = sizes, bits, rest, [], 0
        for b in bits:
            ones = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.n = base + len(rest)
        self.rest_base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left, level = [], [], keys, 0
        while len(left) and level < 40:
            size = max(64, int(GAMMA * len(left)) // 64 * 64 + 64)
            place = mixed(left, level) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size)[place.astype(np.int64)] == 1
            words = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(words, (place[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place[alone] & np.uint64(63)))
            sizes.append(size)
            bits.append(words)
            left = left[~alone]
            level += 1
        return cls(sizes, bits, np.sort(left))

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(open_):
                return out
            place = mixed(keys[open_], level) % np.uint64(size)
            w, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[w] >> bit) & np.uint64(1) == 1
            below = words[w[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = ranks[w[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[k] == keys[open_]
            out[open_[same]] = self.rest_base + k[same]
        return out


class Shard:
    """A perfect hash with its fingerprint, count and holder arrays.

    Of lines that share their first hash, one is in the arrays; the others, if
    there are any, are rows of `more`: both hashes, count, holder.
    """

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray, more: np.ndarray):
        self.mph, self.prints, self.counts, self.holders, self.more = mph, prints, counts, holders, more
        self.size = 8 * (sum(map(len, mph.bits)) * 2 + len(mph.rest)) + 20 * mph.n + more.nbytes

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> Shard:
        keys, at = np.unique(one, return_index=True)
        counts, holders = np.minimum(counts, 0xFFFFFFFF).astype(np.uint64), np.asarray(holders, np.int64)
        clash = np.delete(np.arange(len(one)), at)
        more = np.stack([one[clash], two[clash], counts[clash], holders[clash].view(np.uint64)], 1)
        mph = PerfectHash.build(keys)
        where = mph.places(keys)
        out = cls(mph, np.empty(mph.n, np.uint64), np.empty(mph.n, np.uint32), np.empty(mph.n, np.int64), more)
        out.prints[where], out.counts[where], out.holders[where] = two[at], counts[at], holders[at]
        return out

    def dump(self) -> bytes:
        m = self.mph
        head = np.array([m.n, len(m.rest), len(self.more), *m.sizes], "<i8")
        return b"".join([MAGIC, struct.pack("<q", len(head)), head.tobytes(), *(b.astype("<u8").tobytes() for b in m.bits), m.rest.astype("<u8").tobytes(), self.prints.astype("<u8").tobytes(), self.holders.astype("<i8").tobytes(), self.more.astype("<u8").tobytes(), self.counts.astype("<u4").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a line index")
        n_head = struct.unpack_from("<q", data, 8)[0]
        head = np.frombuffer(data, "<i8", n_head, 16).tolist()
        at = 16 + 8 * n_head

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        bits = [take("<u8", s // 64) for s in head[3:]]
        mph = PerfectHash(head[3:], bits, take("<u8", head[1]))
        prints, holders, more = take("<u8", head[0]), take("<i8", head[0]), take("<u8", 4 * head[2]).reshape(-1, 4)
        return cls(mph, prints, take("<u4", head[0]), holders, more)

    def probe(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not here) and holders."""
        at = self.mph.places(one)
        known = at >= 0
        known[known] = self.prints[at[known]] == two[known]
        counts, holders = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        counts[known], holders[known] = self.counts[at[known]], self.holders[at[known]]
        for row in self.more:
            same = (one == row[0]) & (two == row[1])
            counts[same], holders[same] = int(row[2]), int(row[3:].view(np.int64)[0])
        return counts, holders


def _lines(min_chars: int):
    """Each batch's distinct lines: both hashes, lines, smallest and largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, ids = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                _, x, y = line_hashes(text.as_py(), min_chars)
                one += x
                two += y
                ids += [NO_ID if doc is None else doc] * len(x)
            if not one:
                continue
            h = np.array([one, two], np.uint64)
            ids = np.array(ids, np.int64)
            order = np.lexsort((ids, h[1], h[0]))
            h, ids = h[:, order], ids[order]
            first = np.flatnonzero(np.append(True, (h[:, 1:] != h[:, :-1]).any(0)))
            last = np.append(first[1:], len(ids)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[0][first].view(np.int64)), pa.array(h[1][first].view(np.int64)), pa.array((last - first + 1).astype(np.int64)), pa.array(ids[first]), pa.array(ids[last])], ["one", "two", "n", "low", "high"])

    return run


def _build(folder: str, shards: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        col = lambda name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        built = Shard.build(col("one").view(np.uint64), col("two").view(np.uint64), col("n"), col("low"))
        files.write(f"{folder}/{shard:06d}.mph", built.dump())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([built.mph.n], pa.int64())})

    return run


class Index:
    """The shard files, loaded as they are asked for; the oldest go beyond KEPT_BYTES."""

    def __init__(self, folder: str, shards: int, present: frozenset[int]):
        self.folder, self.shards, self.present, self.held, self.bytes = folder, shards, present, OrderedDict(), 0

    def shard(self, k: int) -> Shard:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        s = self.held[k] = Shard.load(files.read(f"{self.folder}/{k:06d}.mph"))
        self.bytes += s.size
        while self.bytes > KEPT_BYTES and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].size
        return s

    def probe(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, holders = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        own = (one % np.uint64(self.shards)).astype(np.int64)
        for k in np.unique(own).tolist():
            if k in self.present:
                at = np.flatnonzero(own == k)
                counts[at], holders[at] = self.shard(k).probe(one[at], two[at])
        return counts, holders


def _kept(index: Index, ids: list, docs: list[str], min_chars: int) -> tuple[list[str], list[int]]:
    """What stays of each text, and how many of its lines go."""
    found = [line_hashes(t, min_chars) for t in docs]
    sizes = np.array([len(f[0]) for f in found], np.int64)
    counts, holders = index.probe(np.array([x for f in found for x in f[1]], np.uint64), np.array([x for f in found for x in f[2]], np.uint64))
    gone = (counts > 0) & (holders != np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), sizes))
    ends, kept, dropped = np.cumsum(sizes), [], []
    for k, text in enumerate(docs):
        mine = np.flatnonzero(gone[ends[k] - sizes[k] : ends[k]]).tolist()
        dropped.append(len(mine))
        if mine:
            out = {found[k][0][j] for j in mine}
            text = "\n".join([x for j, x in enumerate(text.split("\n")) if j not in out])
        kept.append(text)
    return kept, dropped


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of about BLOCK_BYTES: a block asks each shard once."""
    wait, size = [], 0
    for b in batches:
        wait.append(b)
        size += b.nbytes
        if size > BLOCK_BYTES:
            yield pa.concat_batches(wait)
            wait, size = [], 0
    if wait:
        yield pa.concat_batches(wait)


def _drop(folder: str, shards: int, present: frozenset[int], min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards, present)
        for b in _blocks(batches):
            docs = b.column("text").to_pylist()
            kept, dropped = _kept(index, b.column("doc_id").to_pylist(), docs, min_chars)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.count("\n") + 1 for x in docs], pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def _rewrite(folder: str, shards: int, present: frozenset[int], min_chars: int, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards, present)
        for b in _blocks(batches):
            kept, dropped = _kept(index, b.column(id_at).to_pylist(), [x or "" for x in b.column(text_at).to_pylist()], min_chars)
            columns = list(b.columns)
            columns[text_at] = pa.array([k if d else None if x is None else k for k, d, x in zip(kept, dropped, columns[text_at].to_pylist(), strict=True)], columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int64())], [*b.schema.names, "n_dropped"])

    return run


def build_line_index(docs: DataFrame, folder: str, min_chars: int = 10) -> tuple[int, frozenset[int]]:
    """Writes the index of lines of two documents or more; returns shards, and which of them hold keys.

    docs: doc_id long, text string without nulls. Two hashes tell lines apart,
    128 bits in all.
    """
    lines = docs.mapInArrow(frugal(_lines(min_chars)), "one bigint, two bigint, n bigint, low bigint, high bigint")
    repeated = lines.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    repeated.select("one", "two", "n", "low").write.parquet(f"{folder}/repeated")
    repeated = docs.sparkSession.read.schema("one bigint, two bigint, n bigint, low bigint").parquet(f"{folder}/repeated")
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    # unsigned remainder of the first hash
    shard = F.expr(f"cast(pmod(pmod(one, {shards}) + if(one < 0, pmod(cast(18446744073709551616 % {shards} as bigint), {shards}), 0), {shards}) as int)")
    built = repeated.withColumn("shard", shard).groupBy("shard").applyInArrow(_build(folder, shards), "shard int, n_keys bigint")
    return shards, frozenset(r["shard"] for r in built.select("shard").collect())  # one row per shard file


def _index(docs: DataFrame, id_col: str, text_col: str, min_chars: int, folder: str | None) -> tuple[DataFrame, tuple]:
    folder = folder or shared_dir(docs.sparkSession, "lines")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own, (folder, *build_line_index(own, folder, min_chars), min_chars)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, folder: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; one row per input row."""
    own, built = _index(docs, id_col, text_col, min_chars, folder)
    return own.mapInArrow(frugal(_drop(*built)), OUT)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, folder: str | None = None, count_col: str = "n_dropped_lines") -> DataFrame:
    """docs with the lines that stay as text, all other columns as they are, and the number of lines dropped in count_col, a name that docs hasn't."""
    if count_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {count_col}; name another for the count")
    _, built = _index(docs, id_col, text_col, min_chars, folder)
    names = docs.columns
    numbered = docs.select(*[(column(c).cast("long") if c == id_col else column(c)).alias(f"c{k}") for k, c in enumerate(names)])
    schema = T.StructType([*numbered.schema.fields, T.StructField("n_dropped", T.LongType())])
    out = numbered.mapInArrow(frugal(_rewrite(*built, names.index(id_col), names.index(text_col))), schema)
    return out.select(*[F.col(f"c{k}").cast(docs.schema[k].dataType).alias(c) for k, c in enumerate(names)], F.col("n_dropped").alias(count_col))
