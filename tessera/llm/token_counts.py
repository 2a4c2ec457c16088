"""Token counts through a digest cache.

The cache is a Parquet table, one row per (tokenizer digest, content digest).
A call joins its texts' digests to the cache, encodes each distinct miss once
and appends the new counts, so later calls and other corpora reuse them.

Contract: a null text counts as the empty text (0 tokens). Ids may be null or
repeat; each input row gives one output row. Other columns are ignored. An
empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.llm.files import frugal, tokenizer_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(tokenizer: str) -> str:
    """Stands for the tokenizer's file and the version of the library that runs it."""
    path = tokenizer_path(tokenizer)
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}|plain".encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def counter(tokenizer: str):
    """texts -> token counts, without begin, end or added special tokens."""
    path = tokenizer_path(tokenizer)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(tokenizer: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(tokenizer)
        for b in batches:
            texts, counts = b.column("text").to_pylist(), []
            for at in range(0, len(texts), 64):
                counts += count(texts[at : at + 64])
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), b.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def cached(spark, cache: str) -> DataFrame:
    """What the cache holds; an absent cache holds nothing."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; new counts go to the cache.

    Repeated texts shrink to one before the shuffle (partial aggregation), so
    a text that holds a third of all rows reaches one task as a few rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = cached(spark, cache).filter(F.col("tokenizer") == version)
    misses = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(frugal(_encode(tokenizer, version)), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = cached(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return own.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
