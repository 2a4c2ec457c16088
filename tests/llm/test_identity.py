"""Exact dedup and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, merkle
from tests.conftest import canon

BLANKS = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, name string, key double, `meta.x` int, m map<string,int>"


def rows_of(texts):
    return [(k % 9 if k % 5 != 4 else None, t, [None, "", "en", "é", "de"][k % 5 if k > 3 else 2], "s" if k % 3 else None, None if k % 7 == 3 else k, 7, "x", 1.5, 2, {"a": 1}) for k, t in enumerate(texts)]


TEXTS = ["", None, " \t\n", "ab", "a b", "a\vb", "ba", "abab", "ab ab", "ab" * 600, "ab" * 601, " ab" * 600, "ab" * 600, "漢字😀", "漢 字😀", "\x00", " ", "ab" * 600 + "a", "a" * 5, "a" * 4, "a" * 3] * 2


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_exact_groups(odd, block):
    got = exact_dedup.exact_groups(odd, block=block).collect()
    groups = defaultdict(list)
    for doc, text in odd.select("doc_id", "text").collect():
        groups[(text or "").translate(str.maketrans("", "", BLANKS))].append((-len(text or ""), doc is None, doc))
    want = Counter()
    for norm, members in groups.items():
        sha, best = hashlib.sha256(norm.encode()).hexdigest(), min(members)
        left = Counter(members)
        for m, n in left.items():
            for j in range(n):
                want[m[2], best[2], len(members), m == best and j == 0, sha] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_groups_of_nothing(spark, odd):
    assert exact_dedup.exact_groups(odd.filter("false")).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert sorted(r.kept for r in exact_dedup.exact_groups(nulls).collect()) == [False, False, True]


def test_names_are_collision_free(spark):
    keys = [bytes([k % 7] * (k % 5)) for k in range(200)]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(keys)], "bundle long, key binary")
    name = {r.bundle: r.name for r in exact_dedup.named(df).collect()}
    assert len({(keys[b], n) for b, n in name.items()}) == len(set(keys)) == len(set(name.values()))


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by the definition."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H("".join(map(show, (r[0], r[3], r[2], n, r[1]))))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: plain_levels([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in langs}
    top = plain_levels([built[t][-1][0] for t in langs])
    out = []
    for k, t in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            folded = leaf(r, r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            sib = ""
            for levels, at in ((built[t], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    sib, folded, at = sib + other, H(other, folded) if at & 1 else H(folded, other), at // 2
            out.append((r[0], own, built[t][-1][0], top[-1][0], H(sib), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("run", [1, 2, 12])
def test_manifest(odd, run):
    rows = [tuple(r) for r in odd.collect()]
    got = merkle.merkle_report(odd, run=run).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert any(not r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 65])
def test_manifest_sizes(spark, n):
    df = spark.createDataFrame(rows_of([f"t{k}" for k in range(n)]), SCHEMA).withColumn("lang", F.lit("en"))
    assert Counter(map(tuple, merkle.merkle_report(df, run=3).collect())) == Counter(plain_manifest([tuple(r) for r in df.collect()]))


def test_manifest_matches_sql(spark, duck, sf):
    got = merkle.merkle_report(spark.read.parquet(f"{sf}/documents.parquet"), run=4).toPandas()
    assert canon(got) == canon(duck.sql(merkle.oracle_sql()).df())


def test_changed_proof_fails():
    a, b, c = (H(x) for x in "abc")
    proof = b"R" + bytes.fromhex(b) + merkle.NONE + b"L" + bytes.fromhex(c)
    want = H(c, H(H(a, b)))
    assert merkle.fold(bytes.fromhex(a), proof).hex() == want
    assert merkle.fold(bytes.fromhex(a), proof.replace(b"L", b"R")).hex() != want
