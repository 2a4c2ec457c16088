"""Exact dedup by deterministic block naming.

Normalised texts are cut into blocks of a fixed size. Blocks are sorted, and
each distinct one gets an integer name; then adjacent names are paired, pairs
are sorted and named likewise, until each document has one name. Equal names
of one round mean equal blocks beneath, and equal blocks give equal names, so
(round, name) is an identity of the text that no two texts share, without any
hash that could collide.

Texts travel once: one shuffle of blocks by content, sorted
in each partition; a name is the partition's number and the block's rank in it.
All later rounds move integers. A block or pair that many documents share is
bundled first, one row a batch of documents (or range of 1024 row numbers), and
the names come back to the bundles by the bundle's own number, so no key gathers
more rows than there are batches.

Contract: null texts count as empty, and empty texts equal each other. Of equal
texts the row with the most code points stays, then the one with the smallest
id; null ids come after all others, and of rows that tie in both, the first one
read. Ids may repeat or be null; each input row gives one output row. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import frugal
from tessera.session import stored

BLANKS = b" \t\n\v\f\r"
BLOCK = 4096
REFS = pa.struct([("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])
FACTS = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("sha", pa.binary())])
BUNDLES = "bundle bigint, key binary, refs array<struct<row: bigint, pos: int, n: int>>, facts array<struct<row: bigint, doc_id: bigint, n_points: bigint, sha: binary>>"


def _cut(block: int):
    """Texts -> one row per distinct block of a batch: the block, where it stands, and what is known of documents that begin with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = bundle = TaskContext.get().partitionId() << 33
        for b in batches:
            points = pc.utf8_length(b.column("text")).to_pylist()
            found: dict[bytes, tuple[list, list]] = {}
            for doc, raw, n_points in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), points, strict=True):
                text = raw.translate(None, BLANKS)
                n = max(1, -(-len(text) // block))
                for pos in range(n):
                    refs, facts = found.setdefault(text[pos * block : (pos + 1) * block], ([], []))
                    refs.append((row, pos, n))
                    if not pos:
                        facts.append((row, doc, n_points, hashlib.sha256(text).digest()))
                row += 1
            if found:
                lists = [[], []]
                for kind, typ in enumerate((REFS, FACTS)):
                    sizes = [len(x[kind]) for x in found.values()]
                    flat = [y for x in found.values() for y in x[kind]]
                    fields = list(zip(*flat, strict=True)) if flat else [[]] * typ.num_fields
                    items = pa.StructArray.from_arrays([pa.array(f, typ.field(k).type) for k, f in enumerate(fields)], fields=list(typ))
                    lists[kind] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), items)
                yield pa.RecordBatch.from_arrays([pa.array(range(bundle, bundle + len(found)), pa.int64()), pa.array(list(found), pa.binary()), *lists], ["bundle", "key", "refs", "facts"])
                bundle += len(found)

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> a name for each: the partition's number above the key's rank in it."""
    name, last = (TaskContext.get().partitionId() << 33) - 1, None
    for b in batches:
        names = []
        for key in b.column("key").to_pylist():
            if key != last:
                name, last = name + 1, key
            names.append(name)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64())], ["bundle", "name"])


def named(bundles: DataFrame) -> DataFrame:
    """bundle, name of each of (bundle, key): equal names for equal keys, and for no others."""
    by_key = bundles.select("bundle", "key").repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(frugal(_name), "bundle bigint, name bigint")


def _paired(level: DataFrame) -> DataFrame:
    """Names of blocks -> bundles of equal pairs of neighbours; a last name without a neighbour pairs with nothing."""
    left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
    pairs = level.filter("n > 1").groupBy("row", F.shiftright("pos", 1).alias("half")).agg(left.alias("a"), right.alias("b"), F.first("n").alias("n"))
    ref = F.struct("row", F.col("half").alias("pos"), F.shiftright(F.col("n") + 1, 1).alias("n"))
    key = F.unhex(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex(F.coalesce("b", F.lit(-1))), 16, "0")))
    shared = pairs.groupBy(key.alias("key"), F.shiftright("row", 10).alias("part")).agg(F.collect_list(ref).alias("refs"))
    return shared.select(F.monotonically_increasing_id().alias("bundle"), "key", "refs")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """row, doc_id, n_points, sha, round, name of every row of docs: rows have equal (round, name) where their normalised texts are equal."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bundles = stored(texts.mapInArrow(frugal(_cut(block)), BUNDLES), "blocks")
    facts = bundles.select(F.inline("facts"))
    longest = bundles.select(F.array_max(F.transform("refs", lambda r: r["n"])).alias("n")).agg(F.max("n")).first()[0] or 1
    found = None
    for k in range((longest - 1).bit_length() + 1):
        if k:
            bundles = stored(_paired(level), "pairs")
        level = stored(bundles.select("bundle", "refs").join(named(bundles), "bundle").select("name", F.inline("refs")), "names")
        ended = level.filter("n = 1").select("row", F.lit(k).alias("round"), "name")
        found = ended if found is None else found.unionByName(ended)
    return facts.join(found, "row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Documents of one identity come in bundles of up to 1024 row numbers, each
    with its size and best row; sums and minima over bundles settle the group,
    and come back to its bundles.
    """
    best = F.struct((-F.col("n_points")).alias("less"), F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    group = ["round", "name"]
    known = identities(docs, id_col, text_col, block).groupBy(*group, F.shiftright("row", 10).alias("part"))
    bundles = stored(known.agg(F.collect_list(F.struct("row", "doc_id", "sha")).alias("docs"), F.count(F.lit(1)).alias("size"), F.min(best).alias("best")), "groups")
    settled = bundles.groupBy(*group).agg(F.sum("size").alias("group_size"), F.min("best").alias("best"))
    placed = bundles.select(*group, "part").join(settled, group)
    rows = bundles.select(*group, "part", "docs").join(placed, [*group, "part"]).select("group_size", "best", F.inline("docs"))
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
