"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import materialize

#: Bytes of text handled at once inside a task; a longer text is handled alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called like that or begins so."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def texts_of(column: pa.Array) -> pa.Array:
    """The array with nulls as empty texts."""
    return pc.fill_null(column, "") if column.null_count else column


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, end row, UTF-8 bytes, offsets)."""
    column = texts_of(column)
    n = len(column)
    if n == 0:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = known = np.multiply.accumulate(steps)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial as a difference of prefix sums modulo 2**64.

    The base is odd, so its power at the range's start can be divided out.
    """
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", _POWER, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _table("down", _INVERSE, n)[start])


def word_hashes(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block as 64-bit hashes, without a loop over words.

    ``inside`` marks the bytes that belong to words; words never cross a text's end.
    Returns (hash, text index, start byte, end byte) of each word in order.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return range_hashes(data, start, end), np.searchsorted(offsets, start, "right") - 1, start, end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: The six white-space bytes of ASCII.
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True


def star_components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of (a, b) links by alternating large and small stars.

    Returns (node, component) with the smallest node of each component, for every node of a link.  Each round is
    one or two group-bys on small rows and is written to the shared folder, so a lost executor repeats one
    round.  A node with very many links only ever hands on pairs: its smallest neighbour is a map-side minimum.
    """
    spark = edges.sparkSession
    current = materialize(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), name)
    before = None
    while True:
        # Large star: each node links its larger neighbours to the smallest of its neighbourhood.
        both = current.unionByName(current.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("m AS a", "b").where("a <> b").distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        current = materialize(small, name)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state == before:
            break
        before = state
    roots = current.selectExpr("a AS node", "a AS component").distinct()
    return current.selectExpr("b AS node", "a AS component").unionByName(roots)
