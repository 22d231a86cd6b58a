"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are made in the scan.  Distinct fingerprints are dealt into tiles by the population counts of their two halves
and compared tile by tile with numpy; a tile meets only tiles whose counts differ by no more than the radius, as two
fingerprints differ in at least as many bits as their counts do.  Nothing is missed and nothing is hashed into bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import free_name, star_components, texts_of
from tickerloom.session import materialize

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in one tile; a full tile pair needs a few MB.
TILE = 8192


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text over ``k``-word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(k, len(words))
    hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    h = np.array(hashed, "<u8")
    for lo in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every document; a null text counts as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1)).cast(pa.binary())
            marks = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row each."""
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)]).astype(np.int8)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints at most ``radius`` bits apart, in bounded portions."""
    groups = []
    for x in (a, b):
        q = _quarters(x)
        kinds, inverse = np.unique(q, axis=1, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(inverse, minlength=kinds.shape[1])))
        groups.append((kinds, order, bounds))
    (kinds_a, order_a, bounds_a), (kinds_b, order_b, bounds_b) = groups
    for g in range(kinds_a.shape[1]):
        rows = order_a[bounds_a[g] : bounds_a[g + 1]]
        reachable = np.abs(kinds_b - kinds_a[:, g : g + 1]).sum(axis=0) <= radius
        columns = np.concatenate([order_b[bounds_b[k] : bounds_b[k + 1]] for k in np.flatnonzero(reachable)] or [order_b[:0]])
        step = max(1, (1 << 20) // max(1, len(columns)))
        for lo in range(0, len(rows) if len(columns) else 0, step):
            part = rows[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(a[part, None] ^ b[None, columns]) <= radius)
            if len(i):
                yield part[i], columns[j]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component label of each of ``n`` nodes; only label pairs not yet joined are looked at one by one."""
    label = np.arange(n)
    for i, j in pairs:
        li, lj = label[i], label[j]
        differ = li != lj
        if not differ.any():
            continue
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for x, y in np.unique(np.stack([li[differ], lj[differ]]), axis=1).T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        old = np.array(list(parent), np.int64)
        table = np.arange(n)
        table[old] = [root(x) for x in old.tolist()]
        label = table[label]
    return label


def _bits(c: Column) -> Column:
    return F.bit_count(c).cast("int")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all pairs at most ``radius`` bits apart.

    Of each tile pair a spanning forest is returned, so that a large group gives no more links than members; the connected
    components are those of all pairs.
    """
    cells = prints.select(
        "fp", _bits(F.shiftrightunsigned("fp", 32)).alias("hi"), _bits(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("lo")
    )
    # At most 33 * 33 cells.
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        cells.join(F.broadcast(sizes), ["hi", "lo"])
        .groupBy("hi", "lo", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "parts")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialize(tiles, "simhash-tiles")
    keys = tiles.select("hi", "lo", "part")
    near = F.explode(F.array(*[
        F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"))
        for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)
        if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)
    ]))
    # Each unordered pair of tiles once: neighbours in one direction, and in the own cell the parts from the own on.
    pairs = (
        keys.select("hi", "lo", "part", near.alias("d"))
        .select("hi", "lo", "part", (F.col("hi") + F.col("d.dx")).alias("hi2"), (F.col("lo") + F.col("d.dy")).alias("lo2"))
        .join(sizes.selectExpr("hi AS hi2", "lo AS lo2", "parts"), ["hi2", "lo2"])
        .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
        .where("hi <> hi2 OR lo <> lo2 OR part <= part2")
        .drop("parts")
    )
    both = (
        pairs.join(tiles.select("hi", "lo", "part", F.col("fps").alias("left")), ["hi", "lo", "part"])
        .join(tiles.selectExpr("hi AS hi2", "lo AS lo2", "part AS part2", "fps AS right"), ["hi2", "lo2", "part2"])
        .select("left", "right", F.expr("hi = hi2 AND lo = lo2 AND part = part2").alias("same"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(k)[row].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                nodes, shift = (a, 0) if batch.column(2)[row].as_py() else (np.concatenate([a, b]), len(a))
                label = forest(len(nodes), ((i, j + shift) for i, j in near_pairs(a, b, radius)))
                moved = np.flatnonzero(label != np.arange(len(nodes)))
                if len(moved):
                    ends = [pa.array(nodes[x].view(np.int64)) for x in (label[moved], moved)]
                    yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    # Few bytes, much work: keep as many tasks as the session deals out.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, F.xxhash64("left", "right")).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    ``component_id`` is the smallest doc_id that a chain of fingerprints at most ``radius`` bits apart reaches.  Null and
    empty texts have fingerprint zero and are linked like any other; a null id gets its row, and a component of null ids
    alone has a null id; repeated rows each get one; an empty table gives none; other columns are not read.
    """
    return _grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component (its smallest fingerprint) and component_id of every document."""
    marked = materialize(fingerprints(docs), "simhash")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    members = star_components(links(prints, radius), "simhash-stars")
    found = prints.join(members.withColumnRenamed("node", "fp"), "fp", "left")
    smallest = found.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first_id").alias("component_id"))
    named = found.select("fp", F.coalesce("component", "fp").alias("component")).join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    All columns are kept as they are.  Where an id repeats, rows are told apart by their fingerprints: each component keeps
    one row of its smallest id (a null id only among null ids), of several the one with the smallest fingerprint, then hash.  So a
    repeated id with unlike texts keeps a row for each component that it leads.  Null and empty texts are copies of each
    other; ties and very long texts need no rule of their own; an empty table stays empty.
    """
    grouped = materialize(_grouped(docs.select("doc_id", "text"), radius), "simhash-groups")
    led = grouped.where("doc_id <=> component_id").groupBy("component").agg(F.min("doc_id").alias("kept_id"), F.min("fp").alias("kept_fp"))
    leaders = materialize(led, "simhash-leaders")
    counts = grouped.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(leaders.join(counts, F.expr("kept_id <=> doc_id"), "left_semi").select(F.col("kept_id").alias("again")).distinct(), "simhash-repeated")
    tag = free_name(docs, "_row")
    key = f"{tag}_id"
    once = leaders.join(repeated, F.expr("kept_id <=> again"), "left_anti").select(F.col("kept_id").alias(key))
    same_id = F.col("doc_id").eqNullSafe(F.col(key))
    kept = docs.join(once, same_id, "left_semi")
    if repeated.isEmpty():
        return kept
    # Only rows of a repeated id are marked a second time; they carry a number until their fingerprint is known.
    several = materialize(docs.join(repeated.select(F.col("again").alias(key)), same_id, "left_semi").withColumn(tag, F.monotonically_increasing_id()), "simhash-rows")
    marks = fingerprints(several.select(F.col(tag).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("fp").alias(f"{tag}_fp"))
    marked = several.join(marks, F.col(tag) == F.col(key)).drop(key)
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "array", "struct"))]
    first = Window.partitionBy("doc_id", f"{tag}_fp").orderBy(F.xxhash64(*plain), tag)
    marked = marked.withColumn(f"{tag}_n", F.row_number().over(first)).where(F.col(f"{tag}_n") == 1)
    keeps = leaders.select(F.col("kept_id").alias(key), F.col("kept_fp").alias(f"{tag}_kept"))
    chosen = marked.join(keeps, same_id & (F.col(f"{tag}_fp") == F.col(f"{tag}_kept")), "left_semi")
    return kept.unionByName(chosen.select(*docs.columns))


def brute_force(ids: list[int], texts: list[str | None], radius: int = RADIUS) -> pd.DataFrame:
    """Every pair compared on one machine; for tests on small fixtures."""
    marks = [fingerprint((t or "").encode()) for t in texts]
    component = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (marks[i] ^ marks[j]).bit_count() <= radius and component[j] < component[i]:
                    component[i], changed = component[j], True
    return pd.DataFrame({"doc_id": ids, "fingerprint": [f"{m:016x}" for m in marks], "component_id": component})
