"""Token counts through a digest cache: every distinct content is encoded once per tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import scratch_dir

CACHE = "version string, digest string, n_tokens long"
TOKEN_LIMIT = 4096

_models: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: a changed file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts as the tokenizer's library gives them; it is loaded once per Python worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _models[path] = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _models[path](texts)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; misses are appended to the cache.

    The content digest is SHA-256 of the text with null as empty text; the tokenizer sees the text itself, so no other
    normalisation may join two contents.  ``cache_path`` is a Parquet folder that grows from run to run (a new one in the
    shared scratch folder if none is given).  Null ids, empty texts and repeated rows give one row each; an empty table
    gives none; other input columns are not read.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_dir(spark, "token-cache")
    version = tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), content.alias("text")).withColumn("digest", F.sha2("text", 256))

    # One carrier per distinct content; only carriers of contents that the cache lacks send their text on.
    carriers = keyed.groupBy("digest").agg(F.min("doc_id").alias("carrier"))
    known = _known(spark, cache_path, version)
    missing = carriers if known is None else carriers.join(known, "digest", "left_anti")
    texts = (
        keyed.join(missing.withColumnRenamed("digest", "d"), F.expr("doc_id <=> carrier AND digest = d"))
        .select("digest", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = pa.array(count_tokens(part.column(1).to_pylist(), tokenizer_path), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], ["digest", "n_tokens"])

    found = texts.mapInArrow(encode, "digest string, n_tokens long")
    found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    counts = _known(spark, cache_path, version)
    sized = docs.select(F.col("doc_id").cast("long"), content.alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")
    )
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _known(spark, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts of this tokenizer version, one row per digest; None before the first run.

    A run that was repeated after a failure may have stored a digest twice, with the same count.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
