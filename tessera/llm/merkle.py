"""Merkle manifest of a table: sorted leaf runs, a node store in levels, proofs by coordinate.

A node's coordinate is (tree, level, idx). Leaves of a tree are ranked by a
range sort, so a tree of any size spreads over tasks. The node store is Parquet
partitioned by level. A pass reads one stored level in runs of 2**run
neighbouring nodes, in order, and streams the run levels above each run to
their partitions; the next pass starts from the highest of those. So a task
holds one run, and a tree of n leaves takes log2(n) / run passes.

Proofs go down the same passes. A run's nodes, the leaves asked for and the
proof of the run's top node are merged in order of their coordinates; each
leaf's proof is its siblings within the run, then the proof of the top.

Arity is 2; the last node of a level with no neighbour becomes the digest of
itself alone. A proof is a row of steps of 33 bytes, upwards from the leaf: the
sibling's side (L, R, or - for none) and its digest (zeros for none).

Contract: null trees are trees of their own, before all others. Null order keys
come first; rows of equal keys lie in the order of their leaves. Repeated rows
each have their own leaf. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.files import frugal
from tessera.session import shared_dir, stored

#: Levels of a run, which has 4096 nodes then.
RUN = 12
STEP = 33
NONE = b"-" + bytes(32)
NODES = "tree string, size bigint, level int, idx bigint, digest binary"
PROOFS = "tree string, idx bigint, doc_id bigint, name string, digest binary, proof binary, folded binary, top binary"


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text, or - where null."""
    shown = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*shown), 256))


def ranked(leaves: DataFrame, order: str) -> DataFrame:
    """leaves (tree, rid, digest, order and others) with idx, the rank in the tree, and size, the tree's leaves.

    One range sort over all trees; a partition's rows of a tree have
    consecutive numbers, so one offset for each (partition, tree) gives ranks.
    """
    runs = stored(leaves.repartitionByRange("tree", order, "digest", "rid").sortWithinPartitions("tree", order, "digest", "rid").withColumn("at", F.monotonically_increasing_id()), "leaf-runs")
    run = F.shiftright("at", 33)
    parts = runs.groupBy("tree", run.alias("run")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("run"))
    offsets = parts.select("tree", "run", (before - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return runs.withColumn("run", run).join(offsets, ["tree", "run"]).select(*leaves.columns, (F.col("at") + F.col("shift")).alias("idx"), "size")


def height(size: int) -> int:
    return (size - 1).bit_length()


def _heights() -> Column:
    """height() of the column size, exact for any bigint."""
    return F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).cast("int")


def _top_base(run: int) -> Column:
    """The lowest level of the pass that reaches the root of a tree of the column size."""
    return F.expr(f"int(({run} * ((greatest(h, 1) - 1) div {run})))")


def _above(run: list[bytes], levels: int) -> Iterator[list[bytes]]:
    """The levels above a run, lowest first."""
    for _ in range(levels):
        run = [digest(*run[k : k + 2]) for k in range(0, len(run), 2)]
        yield run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(tree, run number) and rows of each run, as rows come sorted by those."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (k := (r["tree"], r["run"])) != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(r)
    if rows:
        yield key, rows


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    for at in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows[at : at + 2000], strict=True), types, strict=True)], list(names))


def _build(base: int, run: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, number), rows in _runs(batches):
            size = rows[0]["size"]
            levels = _above([r["digest"] for r in rows], min(run, height(size) - base))
            yield from _batches([(tree, size, base + up, (number << (run - up)) + k, d) for up, level in enumerate(levels, 1) for k, d in enumerate(level)], NODES)

    return build


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for at in range(0, len(proof), STEP):
        side, other = proof[at : at + 1], proof[at + 1 : at + STEP]
        leaf = digest(other, leaf) if side == b"L" else digest(leaf, other) if side == b"R" else digest(leaf)
    return leaf


def _prove(base: int, run: int):
    """Runs whose rows are the top's proof, then nodes, then claims -> a row for each claim."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _runs(batches):
            above, top = rows[0]["proof"], rows[0]["digest"]
            nodes = {(r["level"], r["idx"]): r["digest"] for r in rows if r["kind"] == 1}
            out = []
            for r in rows:
                if r["kind"] < 2:
                    continue
                steps, at = [], r["idx"]
                for level in range(base, base + min(run, height(r["size"]) - base)):
                    other = nodes.get((level, at ^ 1))
                    steps.append(NONE if other is None else (b"L" if at & 1 else b"R") + other)
                    at >>= 1
                proof = b"".join(steps) + above
                out.append((tree, r["idx"], r["doc_id"], r["name"], r["digest"], proof, fold(r["claimed"] or r["digest"], proof), top))
            yield from _batches(out, PROOFS)

    return prove


@dataclass
class Forest:
    """Merkle trees over leaves (tree, doc_id, name, digest, claimed, idx, size), with the node store of their upper levels in folder."""

    leaves: DataFrame
    folder: str
    tallest: int
    run: int

    def nodes(self, low: int, high: int) -> DataFrame:
        """Stored nodes of levels low to high - 1."""
        out = self.leaves.select("tree", "size", F.lit(0).alias("level"), "idx", "digest")
        upper = self.leaves.sparkSession.read.schema(NODES).parquet(self.folder).filter(F.col("level").between(max(low, 1), high - 1)) if self.tallest else out.filter("false")
        return upper if low else out.unionByName(upper)

    def roots(self) -> DataFrame:
        """tree, size, digest of each tree."""
        return self.nodes(0, self.tallest + 1).filter(F.col("level") == _heights()).select("tree", "size", "digest")

    def proofs(self, heads: DataFrame) -> DataFrame:
        """Each leaf's proof, and the root that its claimed digest (or else its own) leads to; top is the digest of its head.

        heads (tree, size, proof, digest) give each tree's digest and how the proof goes on above its root.
        """
        upper = None
        for base in reversed(range(0, max(self.tallest, 1), self.run)):
            proof = heads.withColumn("h", _heights()).filter(_top_base(self.run) == base).select("tree", F.lit(0).cast("long").alias("run"), "proof", "digest")
            if upper is not None:
                proof = proof.unionByName(upper.select("tree", F.col("idx").alias("run"), "proof", F.col("top").alias("digest")))
            own = self.nodes(base, min(base + self.run, self.tallest)).filter(F.col("level") < _heights())
            own = own.withColumn("run", F.expr(f"shiftright(idx, {self.run + base} - level)"))
            claims = self.leaves if not base else self.nodes(base, base + 1).filter(_heights() > base)
            claims = claims.withColumn("run", F.shiftright("idx", self.run))
            rows = proof.withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1)), True).unionByName(claims.withColumn("kind", F.lit(2)), True)
            for name, kind in (("doc_id", "bigint"), ("name", "string"), ("claimed", "binary")):  # nodes that are claims themselves have none
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(None).cast(kind))
            found = rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "kind", "level", "idx").mapInArrow(frugal(_prove(base, self.run)), PROOFS)
            upper = stored(found, "proofs") if base else found
        return upper


def forest(leaves: DataFrame, order: str, run: int = RUN) -> Forest:
    """Builds the trees over leaves (tree, doc_id, name, digest, claimed, rid), in the order of a column; rid tells equal rows apart."""
    own = stored(ranked(leaves, order).select("tree", "doc_id", "name", "digest", "claimed", "idx", "size"), "leaves")
    tallest = own.agg(F.max(_heights())).first()[0] or 0
    out = Forest(own, shared_dir(leaves.sparkSession, "nodes"), tallest, run)
    for base in range(0, tallest, run):
        below = (out.leaves if not base else out.nodes(base, base + 1)).filter(_heights() > base)
        runs = below.select("tree", "size", "idx", "digest", F.shiftright("idx", run).alias("run")).repartition("tree", "run").sortWithinPartitions("tree", "run", "idx")
        runs.mapInArrow(frugal(_build(base, run)), NODES).write.mode("append").partitionBy("level").parquet(out.folder)
    return out


def manifest(leaves: DataFrame, run: int = RUN) -> DataFrame:
    """Trees over leaves in order of doc_id, one tree over their roots in order of names, and every leaf's proof up to its root.

    leaves: tree, doc_id, digest, claimed (the digest to verify, null: its own).
    Returns tree, idx, doc_id, digest, subroot, root, proof, folded (the root that the claimed digest leads to).
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    trees = forest(stored(leaves.select("tree", "doc_id", nothing("string").alias("name"), "digest", "claimed", F.monotonically_increasing_id().alias("rid")), "rows"), "doc_id", run)
    roots = stored(trees.roots(), "roots")
    above = forest(roots.select(F.lit("").alias("tree"), nothing("bigint").alias("doc_id"), F.col("tree").alias("name"), "digest", nothing("binary").alias("claimed"), F.lit(0).alias("rid")), "name", run)
    head = above.roots().withColumn("proof", F.lit(b""))
    root = head.first()
    up = above.proofs(head).select(F.col("name").alias("tree"), "proof")
    heads = stored(roots.join(up, "tree"), "heads")
    return trees.proofs(heads).withColumnRenamed("top", "subroot").withColumn("root", F.lit(root and root["digest"]).cast("binary"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """A leaf for each document in its language's tree; tampered rows claim the digest of a row with one more in n_chars."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    claimed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(*more))
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*fields).alias("digest"), claimed.alias("claimed"))


def merkle_report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Digests of the manifest of docs, verified where every seventh document (by crc32 of its id) is tampered with."""
    found = manifest(document_leaves(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0), run)
    text = lambda c: F.lower(F.hex(c))
    siblings = F.regexp_replace(text("proof"), "(?:4c|52)([0-9a-f]{64})|2d0{64}", "$1")  # steps follow each other without gaps
    return found.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The report in SQL: levels, then folds, one step a level."""
    value = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    row = lambda n: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    shift = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    paired = "sha256(CASE WHEN o.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN o.h || f.h ELSE f.h || o.h END), f.sib || coalesce(o.h, '')"
    return f"""
        WITH RECURSIVE bytes AS (SELECT list(list_reduce([b] || range(8), lambda x, k: {shift}) ORDER BY b) AS t FROM range(256) r(b)),
        l AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, {row("n_chars")} AS leaf, {row("n_chars + 1")} AS other, n_chars,
              xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x // 256, t[xor(x, b) % 256 + 1]))) AS crc FROM documents, bytes),
        r AS (SELECT tree, doc_id, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS claimed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        up AS (SELECT tree, 0 AS level, pos AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM r
               UNION ALL SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, i // 2),
        sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (SELECT 0 AS level, i, h, n FROM sub UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2),
        fold AS (SELECT tree, pos, 0 AS level, pos AS i, claimed AS h, '' AS sib FROM r
                 UNION ALL SELECT f.tree, f.pos, f.level + 1, f.i // 2, {paired}
                 FROM fold f JOIN up u ON u.tree = f.tree AND u.level = f.level AND u.i = f.i AND u.n > 1 LEFT JOIN up o ON o.tree = f.tree AND o.level = f.level AND o.i = xor(f.i, 1)),
        rest AS (SELECT f.tree, f.pos, 0 AS level, s.i, f.h, f.sib FROM fold f JOIN up u ON u.tree = f.tree AND u.level = f.level AND u.n = 1 JOIN sub s ON s.tree = f.tree
                 UNION ALL SELECT f.tree, f.pos, f.level + 1, f.i // 2, {paired}
                 FROM rest f JOIN top u ON u.level = f.level AND u.i = f.i AND u.n > 1 LEFT JOIN top o ON o.level = f.level AND o.i = xor(f.i, 1))
        SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(e.sib) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
        FROM r JOIN sub s ON s.tree = r.tree JOIN top t ON t.n = 1 JOIN rest e ON e.tree = r.tree AND e.pos = r.pos AND e.level = t.level"""
