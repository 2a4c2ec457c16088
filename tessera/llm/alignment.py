"""Alignment of two tokenizers' tokens, and how often ids meet.

Texts are encoded by both tokenizers, A as byte-level BPE and B as pieces with
byte fallback. For each portion of an Arrow batch, DuckDB holds a table of token
intervals for each side, on one axis on which documents follow each other: an
ASOF join finds the last B token that ends by each A token's end, a range join
the overlapping pairs that end together, and window sums over the common ends
number the groups. Each portion counts its pairs of ids; Spark adds those up,
and a second pass holds each document's links against the totals.

Tokens that end together are suffixes of one another, so the pairs of ids that
can be linked are known from the vocabularies (`pair_bound`, some 10**5): the
table of totals is written as one file and read by each worker. The links
themselves stay with their documents and are never shuffled.

Contract: tokens are those of plain text, without special tokens. Null and empty
texts, and texts whose joined tokens of A or B aren't the text with a blank in
front, have no tokens. Ids may be null or repeat; each input row gives one output
row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files
from tessera.llm.bpe import byte_symbols
from tessera.llm.files import frugal, tokenizer_path
from tessera.session import shared_dir, stored

#: Bytes of text that DuckDB gets at a time; longer texts are cut where tokens of both sides end.
PORTION = 1 << 19
#: Links are kept as a * BASE + b.
BASE = 1 << 20
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>, counts array<struct<pair: bigint, n: bigint>>"
REPORT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def token_bytes_a(path: str) -> list[bytes]:
    """What each id of a byte-level BPE file stands for, in bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {s: b for b, s in enumerate(byte_symbols())}
    found = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
    found |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def token_bytes_b(model) -> list[bytes]:
    """What each id of a sentencepiece model stands for, in bytes."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together: one's bytes end with the other's."""
    many = {}
    for t in b:
        many[t] = many.get(t, 0) + 1
    longer = {}
    for t in b:
        for k in range(1, len(t)):
            longer[t[k:]] = longer.get(t[k:], 0) + 1
    return sum(longer.get(t, 0) + sum(many.get(t[k:], 0) for k in range(len(t))) for t in a if t)


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        path = tokenizer_path(a)
        self.a, self.b = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.bytes_a, self.bytes_b = token_bytes_a(path), token_bytes_b(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

        self.quick = rank_encoding(path)

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A. Texts of old letters and short words go through the same ranks in another library, three times as fast."""
        out = [None] * len(texts)
        if self.quick:
            for k, t in enumerate(texts):
                if usual(t):
                    out[k] = self.quick.encode_ordinary(t)
        left = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(left, self.a.encode_batch_fast([texts[k] for k in left], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int], int]]:
        """Ids of A and B of each text, and their bytes; two empty lists where either doesn't give the text back."""
        out = []
        for t, a, b in zip(texts, self.ids_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + t.encode()
            good = t and b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b])
            out.append((a, b, len(whole)) if good else ([], [], 0))
        return out


#: Letters, digits and blanks of these blocks are the same in every library's Unicode version.
NEWER = re.compile("[^\\x00-\u0377\u0391-\u03a1\u03a3-\u0481\u2010-\u2027\u4e00-\u9fa5]")
#: Runs that an engine for patterns may take long for, or overflow on.
LONG_WORD, LONG_BLANK = 500, re.compile(r"\s{100}")


def usual(text: str) -> bool:
    """Whether both libraries cut the text alike, without doubt."""
    return (text.isascii() or not NEWER.search(text)) and max(map(len, text.split()), default=0) < LONG_WORD and not LONG_BLANK.search(text)


def rank_encoding(path: str):
    """A byte-level BPE file as ranks of byte strings; None where the file says more than that."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, byte = spec["model"], spec["pre_tokenizer"] or {}, {s: b for b, s in enumerate(byte_symbols())}
    plain = model["type"] == "BPE" and not spec["normalizer"] and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if not plain or any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or len({vocab.get(c, 999) for c in byte} & set(range(256))) < 256:
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def loaded(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


@functools.lru_cache(maxsize=1)
def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


#: For each A token, whether a B token ends where it ends; grp is the number of common ends before it. B tokens take the number of the A token that reaches their end.
GROUPS = """
    CREATE OR REPLACE TEMP TABLE ga AS
    SELECT id, lo, hi, both_end, coalesce(sum(both_end) OVER (ORDER BY hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp
    FROM (SELECT a.*, (b.hi IS NOT DISTINCT FROM a.hi)::INT AS both_end FROM a ASOF LEFT JOIN b ON a.hi >= b.hi);
    CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, b.lo, b.hi, ga.grp FROM b ASOF JOIN ga ON b.hi <= ga.hi"""
LINKS = "SELECT ga.hi, ga.id::BIGINT * {base} + gb.id AS pair FROM ga JOIN gb ON ga.lo < gb.hi AND gb.lo < ga.hi AND ga.hi = gb.hi WHERE ga.both_end = 1 ORDER BY ga.hi"
TOKENS = "SELECT side, id, grp FROM (SELECT 0::TINYINT AS side, id, grp, hi FROM ga UNION ALL SELECT 1::TINYINT, id, grp, hi FROM gb) ORDER BY grp, side, hi"


def intervals(ids: list[list[int]], size: np.ndarray) -> pa.Table:
    """id, lo, hi of all tokens; each document starts where the one before ends."""
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(map(len, ids)))
    wide = size[flat]
    hi = np.cumsum(wide)
    kind = np.int32 if not len(hi) or hi[-1] < 2**31 else np.int64
    return pa.table({"id": flat, "lo": (hi - wide).astype(kind), "hi": hi.astype(kind)})


@functools.lru_cache(maxsize=1)
def _marked(size: int) -> np.ndarray:
    return np.array([[f"{m}{i}" for i in range(size)] for m in ",|;"], object)


def _spellings(largest: int) -> np.ndarray:
    """Ids in decimal behind a comma, a bar or a semicolon."""
    return _marked(1 << max(16, (largest + 1).bit_length()))


def spelled(tokens: dict[str, np.ndarray], starts: list[int]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document, from tokens in order of group, side and place."""
    side, grp = tokens["side"], tokens["grp"]
    if not len(side):
        return [""] * (len(starts) - 1)
    mark = np.zeros(len(side), np.int64)
    mark[1:][side[1:] != side[:-1]] = 1
    mark[1:][grp[1:] != grp[:-1]] = 2
    shown = _spellings(int(tokens["id"].max()))[mark, tokens["id"]]
    return ["".join(shown[s:e].tolist())[1:] for s, e in zip(starts[:-1], starts[1:], strict=True)]


def pieces(ids: list[tuple[list[int], list[int], int]], t: Tokenizers) -> Iterator[tuple[int, list[int], list[int], int]]:
    """Document, ids of A and B, bytes: whole documents, and long ones in pieces that end where tokens of A and B both end."""
    for k, (a, b, size) in enumerate(ids):
        if size <= PORTION:
            yield k, a, b, size
            continue
        hi_a, hi_b = (np.cumsum(wide[np.array(x, np.int64)]) for x, wide in ((a, t.size_a), (b, t.size_b)))
        common = np.intersect1d(hi_a, hi_b, assume_unique=True)
        done = at_a = at_b = 0
        while done < hi_a[-1]:
            near = np.searchsorted(common, done + PORTION, side="right") - 1
            end = int(common[near] if common[near] > done else common[near + 1])
            end_a, end_b = int(np.searchsorted(hi_a, end)) + 1, int(np.searchsorted(hi_b, end)) + 1
            yield k, a[at_a:end_a], b[at_b:end_b], end - done
            done, at_a, at_b = end, end_a, end_b


def joined(part: list[tuple[int, list[int], list[int], int]], t: Tokenizers) -> list[dict]:
    """Groups and links of each piece, by DuckDB."""
    con = _duck()
    for k, (name, size) in enumerate((("a", t.size_a), ("b", t.size_b))):
        con.register(name, intervals([x[k + 1] for x in part], size))
    con.execute(GROUPS)
    links, tokens = ({c: x.to_numpy() for c, x in zip(t.column_names, t.columns, strict=True)} for t in (con.sql(q).to_arrow_table() for q in (LINKS.format(base=BASE), TOKENS)))
    for name in "ab":
        con.unregister(name)
    n_a, n_b = (np.array([len(x[k]) for x in part]) for k in (1, 2))
    groups = spelled(tokens, np.append(0, np.cumsum(n_a + n_b)).tolist())
    at = np.searchsorted(links["hi"], np.append(0, np.cumsum([x[3] for x in part])), side="right")
    return [{"doc": x[0], "n_a": len(x[1]), "n_b": len(x[2]), "n_groups": g.count("|"), "groups": g, "links": links["pair"][at[k] : at[k + 1]]} for k, (x, g) in enumerate(zip(part, groups, strict=True))]


def align(texts: list[str], a: str, b: str) -> list[dict]:
    """n_a, n_b, n_groups, groups and links of each text."""
    t = loaded(a, b)
    found: list[list[dict]] = [[] for _ in texts]
    part, size = [], 0
    for piece in [*pieces(t.encode(texts), t), None]:
        if part and (piece is None or size + piece[3] > PORTION):
            for r in joined(part, t):
                found[r["doc"]].append(r)
            part, size = [], 0
        if piece:
            part.append(piece)
            size += piece[3]
    return [{c: sum(r[c] for r in rows) for c in ("n_a", "n_b", "n_groups")} | {"groups": ";".join(r["groups"] for r in rows), "links": np.concatenate([r["links"] for r in rows])} for rows in found]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PORTION:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _align(a: str, b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in _batches(texts):
                rows = align(texts[s:e], a, b)
                flat = np.concatenate([r["links"] for r in rows])
                pairs, n = np.unique(flat, return_counts=True)
                counts = pa.StructArray.from_arrays([pa.array(pairs), pa.array(n, pa.int64())], names=["pair", "n"])
                first = pa.array([0] + [len(pairs)] * len(rows), pa.int32())  # the portion's counts go with its first row
                links = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r["links"]) for r in rows]), pa.int32()), pa.array(flat))
                groups = [hashlib.sha256(r["groups"].encode()).hexdigest() if digest and r["n_a"] else r["groups"] for r in rows]
                numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in ("n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s), *numbers, pa.array(groups, pa.string()), links, pa.ListArray.from_arrays(first, counts)], [x.split(" ")[0] for x in ALIGNED.split(", ")[:6]] + ["counts"])

    return run


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's groups (spelled out, or their sha256) and links, stored, with counts of pairs by portion."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(frugal(_align(a, b, digest)), ALIGNED), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n: how many links of the whole corpus hold a pair of ids."""
    sums = found.select(F.inline("counts")).groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select(F.expr(f"pair div {BASE}").alias("a"), F.expr(f"pair % {BASE}").alias("b"), "n")


@functools.lru_cache(maxsize=1)
def _totals(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their counts, and the highest count of each id of B."""
    pairs, n = np.load(io.BytesIO(files.read(uri)))
    best = np.zeros(int((pairs % BASE).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, pairs % BASE, n)
    return pairs, n, best


def _scored(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = _totals(uri)
        for b in batches:
            links = b.column("links")
            flat, ends = links.flatten().to_numpy(), np.append(0, np.cumsum(links.value_lengths().to_numpy()))
            count = n[np.searchsorted(pairs, flat)] if len(flat) else flat
            sums = [np.append(0, np.cumsum(x))[ends] for x in (count == best[flat % BASE], count)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(np.diff(x), pa.int64()) for x in (ends, *sums)), b.column("groups")], [x.split(" ")[0] for x in REPORT.split(", ")])

    return run


def alignment_report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark = docs.sparkSession
    found = aligned(docs, a, b, digest=True)
    totals = pair_counts(found).toPandas()
    t = loaded(a, b)
    if len(totals) > (bound := pair_bound(t.bytes_a, t.bytes_b)):
        raise RuntimeError(f"{len(totals)} pairs of ids, where vocabularies allow {bound}")
    pair = totals["a"].to_numpy(np.int64) * BASE + totals["b"].to_numpy(np.int64)
    order = np.argsort(pair)
    out = io.BytesIO()
    np.save(out, np.stack([pair[order], totals["n"].to_numpy(np.int64)[order]]))
    uri = f"{shared_dir(spark, 'pair-counts')}/totals.npy"
    files.write(uri, out.getvalue())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "groups", "links").mapInArrow(frugal(_scored(uri)), REPORT)
