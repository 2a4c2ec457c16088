"""Cross-tokenizer alignment against a plain version."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = ["", None, " ", "hello world", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ under", "Σίσυφος 漢字 😀👩‍👩 ẹ́ \x00 \x85", "don't  stop\n\n\tnow", "x" * 5000, "a b c " * 800, "hello world", "2024-01-02 1234567", "\U000e0001", " leading", "trailing "]
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k % 9 if k != 4 else None, t, 1, "x", [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, pos int, `meta.x` string, links array<int>").repartition(3)


def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path(A)), sentencepiece.SentencePieceProcessor(model_file=P.path(B))
    a.encode_special_tokens = True
    table = {c: n for n, c in alignment_bytes().items()}

    def both(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        ta = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        good = b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb)
        return (ta, tb) if good else ([], [])

    return both


def alignment_bytes():
    """byte -> its stand-in, by the published rule for byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain_report(rows):
    both, docs, total = plain_tokens(), [], Counter()
    for doc, text in rows:
        ta, tb = both(text)
        ends = []
        for side in (ta, tb):
            at, out = 0, []
            for i, raw in side:
                at += len(raw)
                out.append((i, at))
            ends.append(out)
        links = [(i, j) for i, e in ends[0] for j, f in ends[1] if e == f]
        cuts = sorted({e for _, e in ends[0]} & {f for _, f in ends[1]})
        spelt, low = [], 0
        for c in cuts:
            spelt.append("|".join(",".join(str(i) for i, e in side if low < e <= c) for side in ends))
            low = c
        total.update(links)
        docs.append((doc, len(ta), len(tb), len(cuts), links, hashlib.sha256(";".join(spelt).encode()).hexdigest() if ta else ""))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return Counter((d, a, b, g, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), sha) for d, a, b, g, x, sha in docs)


def test_alignment(odd):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    got = alignment.alignment_report(odd, A, B)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == plain_report(rows)
    assert alignment.alignment_report(odd.filter("false"), A, B).count() == 0


def test_alignment_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(60)
    assert Counter(map(tuple, alignment.alignment_report(docs, A, B).collect())) == plain_report(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("portion", [1, 7, 100, 1 << 20])
def test_long_texts_are_cut_at_common_ends(monkeypatch, portion):
    texts = [t or "" for t in TEXTS]
    whole = alignment.align(texts, A, B)
    monkeypatch.setattr(alignment, "PORTION", portion)
    for x, y in zip(alignment.align(texts, A, B), whole, strict=True):
        assert x.pop("links").tolist() == y["links"].tolist()
        assert x == {c: y[c] for c in x}


def test_groups_are_text(odd):
    found = alignment.aligned(odd, A, B)
    row = found.filter("n_groups = 2").first()
    assert row["groups"].count(";") == 1 and row["groups"].count("|") == 2
    counts = {(r.a, r.b): r.n for r in alignment.pair_counts(found).collect()}
    assert sum(counts.values()) == sum(len(r.links) for r in found.collect())


def test_pair_bound():
    t = alignment.loaded(A, B)
    a, b = t.bytes_a[:400], t.bytes_b[:900]
    want = sum(bool(x and y) and (x.endswith(y) or y.endswith(x)) for x in a for y in b)
    assert alignment.pair_bound(a, b) == want


def test_rank_encoding_gives_the_librarys_ids():
    t = alignment.loaded(A, B)
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in points for x in (c, f"a{c}b {c} 1{c}{c} '{c}") if alignment.usual(x)]
    texts += ["don't I'LL we've 's", " \n\t x  y\n\n z ", "1234 56,7.8", "x" * 499, "<|endoftext|>"]
    assert len(texts) > 40_000 and t.quick
    assert t.ids_a(texts) == [x.ids for x in t.a.encode_batch_fast(texts, add_special_tokens=False)]
