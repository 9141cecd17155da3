"""Token counts with a digest cache: each different text is encoded once for a tokenizer, ever.

Digests. A text's digest is the SHA-256 of its normalised content: null becomes empty, nothing else changes, as any other change could
change the count. A tokenizer's digest is that of the bytes of its file, with the name and version of its library.

Counting. Digests are taken where the texts are (a scan, no shuffle) and joined to the counts that the cache has for the tokenizer. Of each digest that
it lacks one row is chosen; those rows' texts are encoded and the counts appended. Then all rows read their count from the table of counts. What is shuffled is
digests; texts move only where more than common.SMALL different ones are missing, and then each once. Copies are reduced to one
before the shuffle, and rows that share a digest are joined to a broadcast table or, where that is too large, in a join
that adaptive execution splits.

Cache. A folder of Parquet files, a row for each digest under the tokenizer's folder. Appends are committed as Spark's outputs
are: a job that dies leaves nothing behind, two that append the same digest leave it twice, which reading reduces. Counts of other tokenizers are not read.

Defined results: null and empty texts have 0 bytes and what the library gives for an empty text; repeated rows each have a row; a null or
repeated key is a value like any other; an empty table gives no rows and appends none. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, join_ids, landed, numbered, read_table, scratch, work_path
from .tokens import default_tokenizer, encoder_of, release_later

LIMIT = 512
CACHE = "digest binary, n_bytes long, n_tokens long, tokenizer string"
#: The setting that names a cache to use again; without it each call of the query has its own.
CACHE_SETTING = "spark.wayfold.tokenCounts"


def library_of(path: str) -> str:
    """The library that reads a tokenizer's file."""
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_digest(path: str) -> str:
    """SHA-256 in hex of a tokenizer: its file, and its library's name and version."""
    library = library_of(path)
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + file.read()).hexdigest()


def counter_of(path: str) -> Callable[[list[str]], list[int]]:
    """The function that counts the tokens of texts: no begin, end or added tokens, no truncation, no padding."""
    if library_of(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    encoder = encoder_of(path)
    encoder.tokenizer.no_truncation()
    encoder.tokenizer.no_padding()
    return lambda texts: [sum(map(len, parts)) // 4 for parts in encoder.encode(texts)]


def _counted(misses: DataFrame, path: str, version: str) -> DataFrame:
    """`misses` (digest, n_bytes, text) with their counts, texts left out."""

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        if tokenizer_digest(path) != version:
            raise RuntimeError(f"{path} here isn't the driver's: their counts would be mixed")
        count = counter_of(path)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            try:
                return [pa.array(count(batch.column("text").to_pylist()), pa.int64())]
            finally:
                release_later(path)

        return compute

    return append_columns(misses, ["text"], [T.StructField("n_tokens", T.LongType())], make, keep=["digest", "n_bytes"])


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of what the cache has for a tokenizer, each digest once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, *, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """For each row of `docs`: the columns of `keep`, n_bytes (UTF-8), n_tokens, and over_limit (more than `limit` tokens). Counts come from the
    folder `cache`, to which those of new texts are appended."""
    spark = docs.sparkSession
    path = path or default_tokenizer()
    version = tokenizer_digest(path)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = numbered(docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), content.alias("text")), "place")
    digests = landed(rows.select(*kept, "place", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests", keep=True)
    with scratch(spark):
        known = stored_counts(spark, cache, version)
        chosen = digests.groupBy("digest", "n_bytes").agg(F.min("place").alias("place")).join(known, "digest", "left_anti")
        chosen = landed(chosen, "misses")
        misses = join_ids(rows.select("place", "text"), chosen, "place", "inner").select("digest", "n_bytes", "text")
        counted = _counted(misses, path, version).withColumn("tokenizer", F.lit(version))
        counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored_counts(spark, cache, version).join(digests.select("digest").distinct(), "digest", "left_semi")
    counts = landed(counts, "counts", keep=True)
    out = join_ids(digests, counts, "digest", "inner")
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the cache that spark.wayfold.tokenCounts names, else by a new one of this call."""
    cache = spark.conf.get(CACHE_SETTING, None) or work_path(spark, "token-counts")
    return count_tokens(read_table(spark, sf_dir, "documents"), cache)
