"""Order MinHash fingerprints, in two forms with equal results.

``fingerprint`` uses DataFrame operations only; ``fingerprint_in_batches`` draws the minima with numpy inside the tasks, at a
fraction of the time, as higher-order functions evaluate each of 32 hashes of every k-mer without compiled code.

Every run of ``K`` code points is numbered among its equals in the text.  For each of ``HASHES`` hash functions the ``2`` smallest
of all numbered k-mers are put in text order and hashed as a tuple.  Unlike plain MinHash the tuples change when the same k-mers
stand in another order or number.  All steps work inside the document's own row, in time n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.functions.collections import with_once
from tickerloom.session import materialize

K = 8
HASHES = 32
#: Low bits of a packed long hold the position, the others the k-mer's hash.
POSITION_BITS = 26
#: Numbered k-mers that each hash function draws from: all, as many as positions tell apart.
POOL = 1 << POSITION_BITS
_POSITION = (1 << POSITION_BITS) - 1
#: Document ids in one window; the texts of a bucket meet in one task.
BUCKET = 1024


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _packed(h: Column, position: Column) -> Column:
    return h.bitwiseAND(_long(~_POSITION)).bitwiseOR(position.cast("long").bitwiseAND(_long(_POSITION)))


def _mark(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the array of tuple hashes (32-bit, as longs) of a non-null text column.

    A text shorter than ``K`` code points is one k-mer; an empty one has none, and all its tuples are the hash of nothing.
    (A k-mer is also taken at the second half of a code point beyond the 16-bit range: one more per such character, equal for
    equal texts.)
    """
    kmers, repeats, pool, drawn = f"_{name}_kmers", f"_{name}_repeats", f"_{name}_pool", f"_{name}_drawn"
    whole = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(F.col(text)))
    runs = F.when(F.length(text) < K, whole).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{K}}}))"), F.lit(1)))
    df = with_once(df, **{kmers: F.sort_array(F.transform(runs, lambda x, i: _packed(F.xxhash64(x), i)))})
    s = F.col(kmers)
    # Sorted by (hash, position), equal k-mers stand together in text order; a repeat has its like before it.
    df = with_once(df, **{repeats: F.filter(s, lambda x, j: _mark(x) == _mark(F.get(s, j - 1)))})
    again = F.col(repeats)

    def other(j: Column, k: Column) -> Column:
        return F.coalesce(_mark(F.get(again, j)) != _mark(F.get(again, k)), F.lit(True))

    # The others, still in order, are numbered from 1 within their run.
    places = F.when(F.size(again) > 0, F.sequence(F.lit(0), F.size(again) - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda j: other(j, j - 1))
    ends = F.filter(places, lambda j: other(j, j + 1))
    spans = F.arrays_zip(begins.alias("b"), ends.alias("e"))
    later = F.flatten(F.transform(spans, lambda r: F.transform(
        F.slice(again, r["b"] + 1, r["e"] - r["b"] + 1), lambda x, o: _packed(F.xxhash64(_mark(x), o + 1), x))))
    # The first of equals has number 0 and keeps its hash.
    df = with_once(df, **{pool: F.concat(F.array_except(s, again), later)}).drop(kmers, repeats)

    def component(j: int) -> Column:
        return F.slice(F.sort_array(F.transform(F.col(pool), lambda x: _packed(F.xxhash64(_mark(x), F.lit(j)), x))), 1, 2)

    def tuple_hash(drawn: Column) -> Column:
        ordered = F.transform(F.sort_array(F.transform(drawn, lambda x: F.struct(x.bitwiseAND(_long(_POSITION)).alias("p"), _mark(x).alias("h")))), lambda t: t["h"])
        return F.xxhash64(ordered).bitwiseAND(_long(0xFFFFFFFF))

    # A projection, as only there longs are sorted without a comparison of objects.
    df = df.select("*", F.array(*[component(j) for j in range(HASHES)]).alias(drawn)).drop(pool)
    return with_once(df, **{name: F.transform(F.col(drawn), tuple_hash)}).drop(drawn)


def as_text(signature: Column) -> Column:
    """Eight hex digits per tuple."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples: an estimate of likeness in content and order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(HASHES))


def _buckets_before(rows: DataFrame) -> DataFrame:
    """(bucket, before): the bucket that comes before each one; before the first comes the last.

    Two levels, so that one task sorts only a 4096th of the buckets.
    """
    keys = rows.select("bucket").distinct().withColumn("group", F.expr("bucket div 4096"))
    inner = keys.withColumn("before", F.lag("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    tops = keys.groupBy("group").agg(F.max("bucket").alias("last"))
    whole = Window.partitionBy(F.lit(0)).orderBy("group")
    tops = tops.withColumn("carried", F.coalesce(
        F.lag("last").over(whole), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inner.join(tops.select("group", "carried"), "group").select("bucket", F.coalesce("before", "carried").alias("before"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and what orders the rows: ``bucket`` of ids and ``tie``, a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    spread = _long(1 << 55) + F.pmod("tie", F.lit(4096))
    return rows.withColumn("bucket", F.coalesce(F.floor(F.col("doc_id") / BUCKET).cast("long"), spread))


def with_next(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the column's value of the row with the next doc_id; after the last row comes the first.

    Rows without an id come last; equal ids and missing ids are ordered by ``tie``.  One shuffle by id bucket; a bucket's last row
    gets its next from the following bucket's first row.
    """
    order = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    first = rows.select("bucket", "doc_id", "tie", column).withColumn("n", F.row_number().over(order)).where("n = 1")
    first = first.join(_buckets_before(rows), "bucket").select(F.col("before").alias("bucket"), F.col(column).alias("_first"))
    inner = rows.select("*", F.lead(column).over(order).alias("_lead"))
    return inner.join(first, "bucket", "left").withColumn(name, F.coalesce("_lead", "_first")).drop("_lead", "_first")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    In the edited text the last quarter of the code points gives way to as many of the next document's first ones.  A null text
    counts as empty; equal texts have equal fingerprints; repeated rows get a row each; an empty table gives none; other columns
    are not read.
    """
    rows = edited_rows(docs)
    rows = with_signature(with_signature(rows, "text", "signature"), "edited", "edited_signature")
    return _compared(rows.select(
        "bucket", "doc_id", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "signature", "edited_signature"))


def edited_rows(docs: DataFrame) -> DataFrame:
    """``placed`` rows with the edited text."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    return with_once(with_next(placed(docs), "text", "next_text"), edited=edited).drop("next_text")


def _compared(rows: DataFrame) -> DataFrame:
    """Digits and likenesses of signed rows."""
    # Small rows without texts: every signature is computed once, whoever reads it.
    rows = with_next(materialize(rows, "order-minhash"), "signature", "next_signature")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


# --- the same with numpy ------------------------------------------------------------

#: K-mers whose hashes are held at once, for all hash functions.
BLOCK = 4096
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the primes of XXH64
_SEED = np.uint64(42)
_NONE = np.iinfo(np.int64).max


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _finished(h: np.ndarray) -> np.ndarray:
    """Last mixing of XXH64, in place."""
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _of_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """``xxhash64`` of longs, each with its seed."""
    h = seed + (_P5 + np.uint64(8)) ^ _turned(x.view(np.uint64) * _P2, 31) * _P1
    return _finished(_turned(h, 27) * _P1 + _P4)


def _of_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of non-negative ints, each with its seed."""
    h = seed + (_P5 + np.uint64(4)) ^ x.astype(np.uint64) * _P1
    return _finished(_turned(h, 23) * _P2 + _P3)


def _of_bytes(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """``xxhash64`` of the ``n`` bytes from each start on; ``n`` is at most 32, ``data`` is 8 bytes longer than needed."""
    at8 = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at4 = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    done = 0
    if n == 32:
        begin = np.array([_SEED, _SEED, _SEED, _SEED]) + np.array([_P1, _P2, np.uint64(0), ~_P1 + np.uint64(1)]) + np.array([_P2, 0, 0, 0], np.uint64)
        lanes = [_turned(v + at8[start + 8 * k] * _P2, 31) * _P1 for k, v in enumerate(begin)]
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _turned(lane * _P2, 31) * _P1) * _P1 + _P4
        h += np.uint64(32)
        done = 32
    else:
        h = np.full(len(start), _SEED + _P5 + np.uint64(n))
    while done + 8 <= n:
        h = _turned(h ^ _turned(at8[start + done] * _P2, 31) * _P1, 27) * _P1 + _P4
        done += 8
    if done + 4 <= n:
        h = _turned(h ^ at4[start + done].astype(np.uint64) * _P1, 23) * _P2 + _P3
        done += 4
    for k in range(done, n):
        h = _turned(h ^ data[start + k].astype(np.uint64) * _P5, 11) * _P1
    return _finished(h)


def kmer_marks(text: np.ndarray) -> np.ndarray:
    """Marks of the numbered k-mers of a text's UTF-8 bytes, in text order."""
    if not len(text):
        return np.zeros(0, np.int64)
    data = np.concatenate([text, np.zeros(8, np.uint8)])
    starts = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
    k = min(K, len(starts) - 1)
    first, sizes = starts[:-k], starts[k:] - starts[:-k]
    hashes = np.empty(len(first), np.uint64)
    for n in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == n)
        hashes[same] = _of_bytes(data, first[same], n)
    marks = hashes.view(np.int64) >> POSITION_BITS
    if len(marks) <= _POSITION:
        # Mark and position in one number sort faster than an order of marks.
        packed = np.sort(marks << POSITION_BITS | np.arange(len(marks)))
        order, by_mark = packed & _POSITION, packed >> POSITION_BITS
    else:
        order = np.argsort(marks, kind="stable")
        by_mark = marks[order]
    again = np.append(False, by_mark[1:] == by_mark[:-1])
    if again.any():
        place = np.arange(len(order))
        number = place - np.maximum.accumulate(np.where(again, 0, place))
        later = _of_int(number[again], _of_long(by_mark[again], _SEED))
        marks[order[again]] = later.view(np.int64) >> POSITION_BITS
    return marks


def two_least(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the two smallest hashes of each hash function, in order; ties go to the earlier position."""
    least, where = np.full((HASHES, 2), _NONE), np.full((HASHES, 2), -1)
    number = np.arange(HASHES, dtype=np.uint64)[:, None] * _P1
    rows = np.arange(HASHES)
    seeds = _of_long(marks, _SEED) + (_P5 + np.uint64(4))
    both = np.empty((2, HASHES * min(BLOCK, len(marks))), np.uint64)
    for lo in range(0, len(marks), BLOCK):
        seed = seeds[lo : lo + BLOCK]
        h, x = (buffer[: HASHES * len(seed)].reshape(HASHES, -1) for buffer in both)
        # ``_of_int`` and the last mixing, in two buffers that stay in the processor's cache.
        np.bitwise_xor(seed, number, out=h)
        np.left_shift(h, np.uint64(23), out=x)
        h >>= np.uint64(41)
        h |= x
        h *= _P2
        h += _P3
        for bits, prime in ((33, _P2), (29, _P3), (32, None)):
            np.right_shift(h, np.uint64(bits), out=x)
            h ^= x
            if prime is not None:
                h *= prime
        g = h.view(np.int64)
        g >>= POSITION_BITS
        found, places = [least], [where]
        for _ in range(min(2, len(seed))):
            at = g.argmin(axis=1)
            found.append(g[rows, at][:, None])
            places.append(at[:, None] + lo)
            g[rows, at] = _NONE
        if lo == 0:
            least, where = (np.hstack([*x[1:], x[0]])[:, :2] for x in (found, places))
        else:
            least, where = _two_of(np.hstack(found), np.hstack(places))
    return least, where


def _two_of(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest of candidates that stand in text order where they tie."""
    best = np.argsort(hashes, axis=1, kind="stable")[:, :2]
    return np.take_along_axis(hashes, best, 1), np.take_along_axis(places, best, 1)


def _tuples(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Tuple hashes of the minima in text order."""
    order = np.argsort(places, axis=1, kind="stable")
    hashes, places = np.take_along_axis(hashes, order, 1), np.take_along_axis(places, order, 1)
    h = np.full(len(hashes), _SEED)
    for k in range(2):
        h = np.where(places[:, k] < 0, h, _of_long(np.ascontiguousarray(hashes[:, k]), h))
    return (h & np.uint64(0xFFFFFFFF)).view(np.int64)


def signatures(pairs: Iterator[tuple[np.ndarray, np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tuple hashes of ``n`` texts and of their edited forms, one after the other.

    ``pairs`` gives UTF-8 bytes of both, and how many k-mers at their beginnings are equal: those are drawn from once.
    """
    hashes, places = np.empty((2, 3, n * HASHES, 2), np.int64)
    for i, (text, edited, shared) in enumerate(pairs):
        own, other = kmer_marks(text), kmer_marks(edited)
        for part, (marks, begin) in enumerate(((own[:shared], 0), (own[shared:], shared), (other[shared:], shared))):
            at = slice(i * HASHES, (i + 1) * HASHES)
            h, p = two_least(marks)
            hashes[part, at], places[part, at] = h, np.where(p < 0, p, p + begin)
    return tuple(_tuples(*_two_of(np.hstack([hashes[0], hashes[k]]), np.hstack([places[0], places[k]]))) for k in (1, 2))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bytes_of = lambda x: np.frombuffer(x.as_buffer(), np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        plain = [batch.column(c) for c in ("bucket", "doc_id", "tie", "n_chars", "edited_sha256")]
        texts = zip(batch.column("text"), batch.column("edited"), plain[3].to_pylist(), strict=True)
        own, other = signatures(((bytes_of(t), bytes_of(e), max(0, n - n // 4 - K + 1)) for t, e, n in texts), batch.num_rows)
        ends = np.arange(0, len(own) + 1, HASHES, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (own, other)]
        yield pa.RecordBatch.from_arrays([*plain, *lists], ["bucket", "doc_id", "tie", "n_chars", "edited_sha256", "signature", "edited_signature"])


def fingerprint_in_batches(docs: DataFrame) -> DataFrame:
    """``fingerprint`` with numpy: the same columns and values, and the same result for nulls, repeats, empty and clashing tables.

    Only texts with code points beyond the 16-bit range differ: here each is one character of a k-mer and no k-mer begins inside
    it.  Positions have 64 bits, so texts may have any length; a task holds some numbers per code point of one text at a time.
    """
    rows = edited_rows(docs).select(
        "bucket", "doc_id", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    return _compared(rows.mapInArrow(
        _signed, "bucket long, doc_id long, tie long, n_chars long, edited_sha256 string, signature array<long>, edited_signature array<long>"))
