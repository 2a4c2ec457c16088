"""Byte-pair encoding and decoding on contiguous rank arrays.

A pre-token is a row of parts. Beside the parts lies an array with the merge
rank of each adjacent pair. The smallest rank is found by a scan, its right
boundary is deleted, and the ranks left and right of the new part are looked
up anew, until no pair can merge. Short pre-tokens go through this together,
as rows of a matrix of parts and a matrix of ranks; one of more than LONG
parts goes alone, with a heap over linked parts in place of the scan, since
repeated scans would grow with the square of its length.

The tokenizer file (JSON) gives vocabulary, merges, normaliser and split
pattern. Plain words (letters, then marks) are cut and lower-cased here; all
others go through the tokenizers library's own normaliser and pattern, whose
tables of letters, blanks and lower case belong to another Unicode version than
this Python's. Merging and decoding are done here for all. Words between ASCII
blanks, and their lower-case pieces, are encoded once per worker and kept in
bounded tables.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import frugal, tokenizer_path

LONG, ROWS = 48, 4096
KEPT_WORDS, BLOCK = 100_000, 500
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: What may follow a word within the piece after it; no letters, digits, blanks or apostrophes.
AFTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_pieces(raw: bytes) -> tuple[str, str] | None:
    """The lower-case letters and the marks that a plain word consists of; None: it needs the whole pattern."""
    text = raw.decode()
    core = text.rstrip(AFTER)
    if core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and "Σ" not in core and "İ" not in core) or not core:
        return core.lower(), text[len(core) :]
    return None


class PairRanks:
    """Ranks of pairs of ids, looked up for whole arrays in an open hash table."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, pairs: np.ndarray):
        """pairs: n x 2 ids, in order of rank."""
        self.shift = np.uint64(64 - max(10, int(2 * len(pairs)).bit_length() + 1))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, self.NONE, np.int32)
        key = self.key(pairs[:, 0], pairs[:, 1])
        left, slot = np.arange(len(key)), self.slot(key)
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = key[left[free]]
            settled = self.keys[slot[left]] == key[left]
            self.ranks[slot[left[settled]]] = left[settled]
            left = left[~settled]
            slot[left] = (slot[left] + 1) & self.mask

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 31) | b.astype(np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self.key(a, b)
        key[(a < 0) | (b < 0)] = -1
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.NONE)
        out[key < 0] = self.NONE
        left = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class RankArrayBPE:
    """encode(text) -> ids and decode(ids) -> text for a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a word-end BPE tokenizer of the kind known here")
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        by_rank = sorted((rank, a, b, new) for (a, b), (rank, new) in self.merges.items())
        self.new_ids = np.zeros(by_rank[-1][0] + 1, np.int32)
        pair_at = np.full((len(self.new_ids), 2), (1 << 30), np.int64)  # a rank without a pair keeps ids that none has
        pair_at[:, 1] += np.arange(len(self.new_ids))
        for rank, a, b, new in by_rank:
            self.new_ids[rank], pair_at[rank] = new, (a, b)
        self.pairs = PairRanks(pair_at)
        self.inner = [vocab.get(c) for c in byte_symbols()]
        self.last = [vocab.get(c + end) for c in byte_symbols()]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        self.cutter = pre_tokenizers.Split(Regex(cut["pattern"]["Regex"]), cut["behavior"].lower(), cut["invert"])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.inner_ids, self.last_ids = (np.array([-1 if x is None else x for x in ids], np.int32) for ids in (self.inner, self.last))
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.short: dict[str, tuple[bytes, str]] = {}
        self.old_words, self.old_short = self.words, self.short

    def merged_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of short pieces: all rows scan for their smallest rank and merge there, until none has any."""
        width = max(map(len, pieces))
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.inner_ids[raw]
        row = np.arange(len(pieces))
        ids[row, size - 1] = self.last_ids[raw[row, size - 1]]
        ids[np.arange(width) >= size[:, None]] = -1
        out: list[list[int]] = [[]] * len(pieces)
        ranks = np.full((len(pieces), width), PairRanks.NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            done = best == PairRanks.NONE
            if done.any():
                for k, own in zip(row[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = [x for x in own if x >= 0]
                row, ids, ranks, at, best = (x[~done] for x in (row, ids, ranks, at, best))
                if not len(row):
                    return out
            k = np.arange(len(row))
            beyond = np.arange(width - 1) >= at[:, None]
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(beyond, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, PairRanks.NONE
            ids[k, at] = self.new_ids[best]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            left = self.pairs.get(np.where(at > 0, ids[k, before], -1), ids[k, at])
            right = self.pairs.get(ids[k, at], np.where(at + 1 < width, ids[k, after], -1))
            ranks[k[at > 0], before[at > 0]] = left[at > 0]
            ranks[k, at] = right

    def merged_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (*m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def pieces_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, each by itself."""
        raw = [p.encode() for p in pieces]
        out: list[list[int]] = [[]] * len(raw)
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        short = [k for k in order if 0 < len(raw[k]) <= LONG]
        for at in range(0, len(short), ROWS):
            part = short[at : at + ROWS]
            for k, ids in zip(part, self.merged_rows([raw[k] for k in part]), strict=True):
                out[k] = ids
        for k in order:
            if len(raw[k]) > LONG:
                out[k] = self.merged_long([x for x in (*map(self.inner.__getitem__, raw[k][:-1]), self.last[raw[k][-1]]) if x is not None])
        return out

    def split(self, text: str) -> list[int | str]:
        """Pre-tokens of a text in order; special tokens as ids."""
        out: list[int | str] = []
        for k, part in enumerate(self.special_at.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [p for p, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def learn(self, new: list[bytes]) -> None:
        """Puts words between blanks into the table; what was there before the last turn stays at hand."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.short) > KEPT_WORDS:
            self.short, self.old_short = {}, self.short
        words, short, old = self.words, self.short, self.old_words
        rest = []
        for w in new:
            if w in old:
                words[w] = old[w]
            elif w not in words:
                rest.append(w)
        parts = [plain_pieces(w) or self.split(w.decode()) for w in rest]
        short[""] = (b"", "")
        open_ = {p for own in parts for p in own if p not in short and isinstance(p, str)}
        for p in [p for p in open_ if p in self.old_short]:
            short[p] = self.old_short[p]
            open_.discard(p)
        todo = list(open_)
        for p, ids in zip(todo, self.pieces_ids(todo), strict=True):
            short[p] = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        for w, own in zip(rest, parts, strict=True):
            found = [short[p] if isinstance(p, str) else (struct.pack("<I", p), self.tokens[p]) for p in own if p != ""]
            words[w] = found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]]))

    def encode_bytes(self, texts: list[str]) -> Iterator[tuple[bytes, list[str]]]:
        """For each whole text its ids in bytes, and its words' decoded texts."""
        split = [x.encode().split() for x in texts]
        self.learn(list({w for own in split for w in own}.difference(self.words)) if len(self.words) <= KEPT_WORDS else list({w for own in split for w in own}))
        get = self.words.__getitem__
        for own in split:
            found = list(map(get, own))
            yield b"".join([x[0] for x in found]), [x[1] for x in found if x[0]]

    def encode(self, text: str) -> list[int]:
        raw = next(self.encode_bytes([text]))[0]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder. Unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.lru_cache(maxsize=2)
def loaded(tokenizer: str) -> RankArrayBPE:
    return RankArrayBPE(tokenizer_path(tokenizer))


def _digests(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        gc.disable()  # millions of small strings, and no cycles among them
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for at in range(0, b.num_rows, BLOCK):
                for raw, decoded in bpe.encode_bytes(b.column("text").slice(at, BLOCK).to_pylist()):
                    n.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.old_words, bpe.old_short = {}, {}  # the worker lives on: it keeps the last turn's words alone

    return run


def _ids(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for b in batches:
            ids = [bpe.encode(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: one row per input row; a null text is empty. No shuffle."""
    return _input(docs, id_col, text_col).mapInArrow(frugal(_ids(tokenizer)), "doc_id bigint, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text: bpe_encode without shipping the ids back."""
    return _input(docs, id_col, text_col).mapInArrow(frugal(_digests(tokenizer)), OUT)
