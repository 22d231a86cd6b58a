"""Conversation prefix trie: which first turns conversations share, and what sharing them saves.

Only digests and byte counts of turns travel.  A conversation is cut into bands of ``BAND`` turns, one cell each; equal cells with the
same turns before them are one row with a count.  Cells sorted by (band, what stands before, content) are dealt to range shards, so a
node with a third of all conversations spreads over many.  A shard writes its part of the trie as balanced parentheses; range min-max
blocks over their excess find the closing one, which delimits a subtree; ranks count leaf pairs and cumulative arrays give savings.
Nodes on a shard's first and last path may go on in its neighbours: these spines are merged and encoded again, until few are left.
Subtrees that hang below a band reach the ones above by pointer doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import materialize

#: Turns in a cell; bytes of a turn's digest.
BAND, DIGEST = 64, 16
#: Bands whose digests are combined in one window.
SUPER = 1024
#: Spine nodes that one task may finish, and about how many a shard of spine nodes holds.
FINAL, SPINE_SHARD = 100_000, 50_000
#: Positions of the parentheses in a block of the min-max tree.
_BLOCK = 64
_NONE = np.int64(2**63 - 1)


# Balanced parentheses of a forest, given as the depths of its nodes in preorder; the first node is a root at depth 0.


def parentheses(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(+1 for an opening, -1 for a closing one; place of each node's opening one)."""
    closes = np.concatenate([[0], depth[:-1] - depth[1:] + 1])
    opens = np.arange(len(depth)) + np.cumsum(closes)
    bits = np.full(2 * len(depth), -1, np.int64)
    bits[opens] = 1
    return bits, opens


def min_max_blocks(excess: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The excess in blocks, and the least excess of each block, of each pair of blocks, and so on."""
    blocks = -(-len(excess) // _BLOCK)
    padded = np.full(blocks * _BLOCK, _NONE)
    padded[: len(excess)] = excess
    tree = [padded.reshape(blocks, _BLOCK).min(axis=1)]
    while len(tree[-1]) > 1:
        level = tree[-1]
        level = np.append(level, _NONE) if len(level) % 2 else level
        tree.append(level.reshape(-1, 2).min(axis=1))
    return padded.reshape(blocks, _BLOCK), tree


def find_close(excess: np.ndarray, opens: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Place of the closing parenthesis of each opening one: the first later place with less excess than before it."""
    blocks, tree = min_max_blocks(excess)
    close = np.empty(len(opens), np.int64)
    for k in range(0, len(opens), step):
        at = opens[k : k + step]
        wanted = excess[at] - 1
        block = at // _BLOCK
        hit = (blocks[block] <= wanted[:, None]) & (np.arange(_BLOCK) > (at % _BLOCK)[:, None])
        inside = hit.any(axis=1)
        place = np.where(inside, block * _BLOCK + hit.argmax(axis=1), -1)
        far = np.flatnonzero(~inside)
        # Up the tree until the right neighbour's least excess is small enough, then down to its first such block.
        node, found = block[far], np.full(len(far), -1)
        for level, least in enumerate(tree):
            right = np.minimum(node + 1, len(least) - 1)
            here = (found < 0) & (node % 2 == 0) & (node + 1 < len(least)) & (least[right] <= wanted[far])
            found[here] = level
            node = np.where(here, right, np.where(found < 0, node // 2, node))
        for level in range(len(tree) - 1, 0, -1):
            down = found == level
            left = 2 * node
            first = tree[level - 1][np.minimum(left, len(tree[level - 1]) - 1)] <= wanted[far]
            node = np.where(down, np.where(first, left, left + 1), node)
            found[down] = level - 1
        place[far] = node * _BLOCK + (blocks[node] <= wanted[far][:, None]).argmax(axis=1)
        close[k : k + step] = place
    return close


def subtree_ends(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one past the last node of each node's subtree, whether its parentheses are a leaf pair)."""
    bits, opens = parentheses(depth)
    excess = np.cumsum(bits)
    close = find_close(excess, opens)
    # Of the places up to the closing one, half, and half the excess there, are opening ones.
    return (close + 1 + excess[close]) // 2, close == opens + 1


def parents(depth: np.ndarray) -> np.ndarray:
    """Index of each node's parent in preorder, -1 for roots."""
    up = np.full(len(depth), -1)
    above = np.flatnonzero(depth == 0)
    for d in range(1, int(depth.max(initial=0)) + 1):
        here = np.flatnonzero(depth == d)
        up[here] = above[np.searchsorted(above, here) - 1]
        above = here
    return up


def _finish(depth: np.ndarray, size: np.ndarray, n: np.ndarray, kids: np.ndarray, leaves: np.ndarray, saved: np.ndarray, spine: np.ndarray) -> tuple[np.ndarray, ...]:
    """Subtree figures of the nodes off the spine, and what hangs on each spine node.

    ``kids``, ``leaves`` and ``saved`` hold what hangs on a node from outside; returns (parent, kids, leaves, saved).
    """
    end, pair = subtree_ends(depth)
    up = parents(depth)
    inner = up >= 0
    own_leaf = (pair & (kids == 0)).astype(np.int64)
    leaf_rank = np.concatenate([[0], np.cumsum(own_leaf + leaves)])
    saving = np.concatenate([[0], np.cumsum((n - 1) * size + saved)])
    here = np.arange(len(depth))
    all_leaves, all_saved = leaf_rank[end] - leaf_rank[here], saving[end] - saving[here]
    all_kids = kids + np.bincount(up[inner], minlength=len(depth))
    # A spine node only takes over what is complete: the children off the spine.
    whole = inner & ~spine
    whole[whole] = spine[up[whole]]
    hung = [kids.copy(), leaves.copy(), saved.copy()]
    for sums, more in zip(hung, (np.ones(len(depth), np.int64), all_leaves, all_saved), strict=True):
        np.add.at(sums, up[whole], more[whole])
    return up, np.where(spine, hung[0], all_kids), np.where(spine, hung[1], all_leaves), np.where(spine, hung[2], all_saved)


def _paths(depth: np.ndarray, first: int) -> np.ndarray:
    """Marks the first path, ``first`` nodes long, and the path to the last node."""
    spine = np.zeros(len(depth), bool)
    spine[:first] = True
    for d in range(int(depth[-1]) + 1):
        spine[np.flatnonzero(depth == d)[-1]] = True
    return spine


_NODE = (
    "spine boolean, block string, idx int, band int, entry string, prefix binary, depth int, size long, n long, m long, "
    "kids long, leaves long, saved long, entry_min long, parent long, up int, cell binary"
)
_SCHEMA = pa.schema([(c.split(" ")[0], {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]]) for c in _NODE.split(", ")])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _new_trees(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose (band, entry) differs from the row before."""
    band = _column(batch, "band")
    entry = np.array(batch.column("entry").to_pylist(), object)
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (entry[1:] != entry[:-1])
    return new


def _encode_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted cells; each batch is a block with spines of its own."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        count = batch.num_rows
        if count == 0:
            continue
        contents = batch.column("content").to_pylist()
        length = np.array([len(c) // DIGEST for c in contents])
        most = max(1, int(length.max()))
        turns = np.frombuffer(b"".join(c.ljust(most * DIGEST, b"\0") for c in contents), np.uint64).reshape(count, most, DIGEST // 8)
        new = _new_trees(batch)
        same = (turns[1:] == turns[:-1]).all(axis=2) & (np.arange(most) < np.minimum(length[1:], length[:-1])[:, None])
        shared = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])
        # A row opens what it does not share with the row before; the first of a tree opens the root, too.
        first = np.where(new, 0, shared + 1)
        opened = length - first + 1
        row = np.repeat(np.arange(count), opened)
        last = np.cumsum(opened) - 1
        depth = np.arange(len(row)) - np.repeat(last + 1 - opened, opened) + np.repeat(first, opened)
        n_row, m_row = _column(batch, "n"), _column(batch, "m")
        sizes = batch.column("sizes")
        flat, begin = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()[:-1]
        size = np.where(depth > 0, np.append(flat, 0)[np.where(depth > 0, begin[row] + depth - 1, len(flat))], 0)
        hung = []
        for name in ("kids", "leaves", "saved"):
            hung.append(np.zeros(len(row), np.int64))
            hung[-1][last] = _column(batch, name)
        end, _ = subtree_ends(depth)
        until = row[end - 1] + 1
        counts = np.concatenate([[0], np.cumsum(n_row)])
        n = counts[until] - counts[row]
        m = np.minimum.reduceat(np.append(m_row, _NONE), np.stack([row, until], axis=1).ravel())[::2]
        spine = _paths(depth, int(opened[0]))
        up, kids, leaves, saved = _finish(depth, size, n, *hung, spine)
        entry_min = _column(batch, "entry_min")[row]
        deep = depth > 1
        parent = np.where(deep, m[up], entry_min)
        pending = deep & spine[up]  # the least id of a spine node is known later
        block = f"{part}-{number}"
        ids = np.flatnonzero(spine)
        prefix = pa.array([contents[row[i]][: depth[i] * DIGEST] if s else None for i, s in enumerate(spine)], pa.binary())
        cells = np.full(len(row), None, object)
        cells[last] = np.array([*batch.column("cell").to_pylist(), None], object)[:-1]
        arrays = [
            pa.array(spine), pa.array([block] * len(row)), pa.array(np.arange(len(row), dtype=np.int32)), batch.column("band").take(pa.array(row)),
            batch.column("entry").take(pa.array(row)), prefix, pa.array(depth.astype(np.int32)), pa.array(size), pa.array(n), pa.array(m), pa.array(kids),
            pa.array(leaves), pa.array(saved), pa.array(entry_min), pa.array(parent, mask=pending), pa.array(up.astype(np.int32), mask=~pending),
            pa.array(cells, pa.binary()),
        ]
        assert len(ids)
        yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _encode_spines(whole: bool):
    """Nodes of sorted spine nodes; ``whole``: one task has all of them, none goes on elsewhere."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            parts = list(batches)
            joined = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
            batches = iter([pa.RecordBatch.from_arrays([c.combine_chunks() for c in pa.Table.from_batches(joined).columns], schema=joined[0].schema)] if joined else [])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Ancestors of the first node that stand in another block: empty stand-ins, merged with the nodes later.
            missing = int(batch.column("depth")[0].as_py())
            if missing:
                head = batch.slice(0, 1).to_pylist()[0]
                blank = {"size": 0, "n": 0, "m": int(_NONE), "kids": 0, "leaves": 0, "saved": 0, "cell": None}
                rows = [head | blank | {"depth": d, "prefix": head["prefix"][: d * DIGEST]} for d in range(missing)]
                table = pa.Table.from_batches([pa.RecordBatch.from_pylist(rows, schema=batch.schema), batch]).combine_chunks()
                batch = table.to_batches()[0]
            depth = _column(batch, "depth")
            spine = np.zeros(len(depth), bool) if whole else _paths(depth, missing + 1)
            kids, leaves, saved = _finish(depth, *(_column(batch, c) for c in ("size", "n", "kids", "leaves", "saved")), spine)[1:]
            put = {"spine": pa.array(spine), "kids": pa.array(kids), "leaves": pa.array(leaves), "saved": pa.array(saved)}
            yield pa.RecordBatch.from_arrays([put.get(f.name, batch.column(f.name) if f.name in batch.schema.names else pa.nulls(len(depth), f.type)) for f in _SCHEMA], schema=_SCHEMA)

    return encode


_SORTED = ["band", "entry", "prefix"]


def _merged(spines: DataFrame) -> DataFrame:
    """Each spine node once."""
    return spines.groupBy(*_SORTED, "depth").agg(
        F.max("size").alias("size"), F.sum("n").alias("n"), F.min("m").alias("m"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.min("entry_min").alias("entry_min"), F.max("cell").alias("cell"),
    )


def _nodes(cells: DataFrame, name: str) -> DataFrame:
    """All nodes of the cells' bands: band, entry, depth in the band, n, m, kids, leaves, saved, parent, cell."""
    order = ["band", "entry", "content"]
    first = materialize(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encode_cells, _NODE), f"{name}-nodes")
    spines = first.where("spine")
    known = left = materialize(_merged(spines), f"{name}-spines")
    done = []
    while (count := left.count()) > FINAL:
        shards = left.repartitionByRange(-(-count // SPINE_SHARD), *_SORTED).sortWithinPartitions(*_SORTED)
        level = materialize(shards.mapInArrow(_encode_spines(False), _NODE), f"{name}-level")
        done.append(level.where("NOT spine"))
        left = materialize(_merged(level.where("spine")), f"{name}-left")
        if left.count() >= count:
            raise ValueError("spines of a shard hold as many nodes as the shard: SPINE_SHARD is too small for BAND")
    done.append(left.repartition(1).sortWithinPartitions(*_SORTED).mapInArrow(_encode_spines(True), _NODE))
    given = ["band", "entry", "depth", "n", "m", "kids", "leaves", "saved"]
    of = known.select("band", "entry", F.col("prefix").alias("above"), F.col("m").alias("above_m"))
    finished = done[0]
    for more in done[1:]:
        finished = finished.unionByName(more)
    finished = finished.withColumn("above", F.expr(f"substring(prefix, 1, length(prefix) - {DIGEST})")).join(of, ["band", "entry", "above"], "left")
    finished = finished.select(*given, F.when(F.col("depth") > 1, F.col("above_m")).otherwise(F.col("entry_min")).alias("parent"), "cell")
    # A node below a spine looks its parent up by block and place: at most a block's nodes have one key.
    places = spines.select("block", F.col("idx").alias("up"), *_SORTED).join(known.select(*_SORTED, F.col("m").alias("up_m")), _SORTED).select("block", "up", "up_m")
    rest = first.where("NOT spine")
    below = rest.where("up IS NOT NULL").join(places, ["block", "up"]).select(*given, F.col("up_m").alias("parent"), "cell")
    return rest.where("up IS NULL").select(*given, "parent", "cell").unionByName(below).unionByName(finished)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, the place in the conversation from 0.  A range sort deals a long conversation to many tasks."""
    order = ["conv_id", "turn", "digest", "tie"]  # nulls first

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0
        for batch in batches:
            conv = _column(batch, "conv_id")
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = before is None or conv[0] != before
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, at, -seen))
            pos = at - start
            before, seen = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "conv_id", "digest", "size")), pa.array(pos.astype(np.int64))], names=["part", "conv_id", "digest", "size", "pos"])

    sorted_rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        sorted_rows.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "size").mapInArrow(counted, "part int, conv_id long, digest binary, size long, pos long"),
        "trie-turns",
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("conv_id", "part").agg((F.max("pos") + 1).alias("n")).withColumn("carry", F.sum("n").over(before)).where("carry IS NOT NULL").drop("n")
    # A range partition goes on with at most one conversation: no more rows than partitions.
    return placed.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", "digest", "size", (F.col("pos") + F.coalesce("carry", F.lit(0))).alias("pos"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, bytes of the text; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")
    )


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: (turns: conv_id, depth, digest, size, total; turnless: conv_id).

    Conversation c begins with the first ``crc32(c) % heads`` turns of conversation ``c - c % group`` (the remainder has the sign of c)
    and goes on with its own turns after as many.  Rows of a conversation stand in order of turn, null first, then of the digest of
    role and text.
    """
    turns = _numbered(turn_rows(conversations))
    lengths = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "trie-lengths")
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = lengths.withColumn("base", base).withColumn("h", h).join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("total")), "trie-convs")
    own = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", "taken", "total"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "size", "total"
    )
    # At most ``heads`` rows of a base meet at most 2 * ``group`` conversations.
    first = turns.where((F.col("pos") < heads) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    taken = first.join(convs, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "size", "total")
    return own.unionByName(taken), convs.where("total = 0").select("conv_id")


def _cells(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """conv_id, band, entry, content, sizes, total, lanes a and b of the digest of everything up to the cell's end."""
    band = F.floor((F.col("depth") - 1) / BAND).cast("int")
    # At most BAND turns of a conversation have a band.
    rows = turns.groupBy("conv_id", band.alias("band"), "total").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "size"))).alias("turns"))
    rows = rows.select("conv_id", "band", F.expr("aggregate(turns, cast('' AS binary), (a, t) -> concat(a, t.digest))").alias("content"), F.col("turns.size").alias("sizes"), "total")
    empty = turnless.select("conv_id", F.lit(0).alias("band"), F.lit(b"").alias("content"), F.array().cast("array<bigint>").alias("sizes"), F.lit(0).cast("long").alias("total"))
    digest = F.sha2(F.concat(F.col("band").cast("string").cast("binary"), F.lit(b":"), F.col("content")), 256)
    lanes = {"a": 1, "b": 9}
    rows = rows.unionByName(empty).select("*", *[F.conv(F.substring(digest, k, 8), 16, 10).cast("long").alias(f"{x}{i}") for x, s in lanes.items() for i, k in enumerate((s, s + 16, s + 32, s + 48))])
    rows = materialize(rows, "trie-cells")
    names = [f"{x}{i}" for x in lanes for i in range(4)]
    long = rows.where(F.col("total") >= BAND).select("conv_id", "band", F.floor(F.col("band") / SUPER).alias("super"), *names)
    inner = Window.partitionBy("conv_id", "super").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    carry = long.groupBy("conv_id", "super").agg(*[F.bit_xor(c).alias(c) for c in names])
    carry = carry.select("conv_id", "super", *[F.coalesce(F.bit_xor(c).over(outer), F.lit(0)).alias(f"c_{c}") for c in names])
    before = long.join(carry, ["conv_id", "super"]).select("conv_id", "band", *[F.coalesce(F.bit_xor(c).over(inner), F.lit(0)).bitwiseXOR(F.col(f"c_{c}")).alias(f"p_{c}") for c in names])
    short = rows.where(F.col("total") < BAND).select("conv_id", "band", "content", "sizes", "total", F.lit("").alias("entry"), F.lit("").alias("next"))
    def key(columns) -> F.Column:  # noqa: E306
        return F.concat_ws("", *[F.lpad(F.hex(c), 8, "0") for c in columns])

    joined = rows.where(F.col("total") >= BAND).join(before, ["conv_id", "band"]).select(
        "conv_id", "band", "content", "sizes", "total",
        F.when(F.col("band") == 0, F.lit("")).otherwise(key([F.col(f"p_{c}") for c in names])).alias("entry"),
        key([F.col(f"p_{c}").bitwiseXOR(F.col(c)) for c in names]).alias("next"),
    )
    cell = F.unhex(F.sha2(F.concat_ws(":", F.col("band"), F.col("entry"), F.hex("content")), 256))
    return short.unionByName(joined).withColumn("cell", cell)


def _member_digests(ends: DataFrame) -> DataFrame:
    """cell, ends_sha256: SHA-256 of the cell's conversation ids in order, comma-joined.

    Ids are sorted and written out by ranges; a cell's pieces then stream through one hash, as SHA-256 has no parts to merge.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(cell)) if i == 0 or cell[i] != cell[i - 1]]
            runs = list(zip(starts, [*starts[1:], len(cell)], strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array([cell[a] for a, _ in runs], pa.binary()), pa.array([conv[a] for a, _ in runs], pa.int64()),
                pa.array([",".join(map(str, conv[a:b])) for a, b in runs], pa.large_string()).cast(pa.string()),
            ], ["cell", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for cell, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if cell != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = cell, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["cell", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["cell", "ends_sha256"])

    order = ["cell", "conv_id"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "cell binary, first long, piece string")
    return parts.repartition("cell").sortWithinPartitions("cell", "first").mapInArrow(hashed, "cell binary, ends_sha256 string")


def _hung(cells: DataFrame) -> DataFrame:
    """cells with kids, leaves, saved of the subtrees that hang below them in deeper bands."""
    none = F.lit(0).cast("long")
    going = F.col("going") > 0
    marked = cells.select("*", going.cast("long").alias("kids"), none.alias("leaves"), none.alias("saved"))
    if not cells.where("band > 0").limit(1).count():
        return marked
    roots = _nodes(marked, "trie-bands").where("depth = 0 AND band > 0").select("band", "entry", "kids", "leaves", "saved")
    above = cells.where(going & (F.col("band") > 0)).select((F.col("band") + 1).alias("band"), F.col("next").alias("entry"), F.struct("band", "entry").alias("up"))
    current = materialize(roots.join(above, ["band", "entry"], "left").select(F.struct("band", "entry").alias("id"), "up", "kids", "leaves", "saved"), "trie-hung")
    # Sums over all that hang below, by pointer doubling: as many rounds as the number of bands has bits.
    while current.where("up IS NOT NULL").limit(1).count():
        add = current.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        on = current.select(F.col("id").alias("up"), F.col("up").alias("further"))
        moved = current.where("up IS NOT NULL").join(on, "up").select("id", "further", "kids", "leaves", "saved")
        moved = moved.unionByName(current.where("up IS NULL").select("id", F.col("up").alias("further"), "kids", "leaves", "saved"))
        current = materialize(
            moved.join(add, "id", "left").select("id", F.col("further").alias("up"), "kids", (F.col("leaves") + F.coalesce("l", none)).alias("leaves"), (F.col("saved") + F.coalesce("s", none)).alias("saved")),
            "trie-hung",
        )
    below = current.select((F.col("id.band") - 1).alias("band"), F.col("id.entry").alias("next"), F.col("kids").alias("k"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
    hanging = cells.where(going).join(below, ["band", "next"]).select(*cells.columns, F.col("k").alias("kids"), F.col("l").alias("leaves"), F.col("s").alias("saved"))
    return marked.where(~going).unionByName(hanging)


def prefix_trie(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """Every node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (from 1, without gaps), digest, size and total (the conversation's turns), as from ``rebuilt``;
    ``turnless`` the ids of conversations without turns, members of the root only.  A node is named by its smallest member; the root has
    depth 0 and no parent.  An empty table gives no node.  Equal turns are known by 128 bits of SHA-256.
    """
    members = _cells(turns, turnless)
    members = materialize(members, "trie-members")
    stays = F.col("total") <= (F.col("band") + 1) * BAND
    cells = members.groupBy("band", "entry", "content", "sizes", "next", "cell").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("m"), F.count_if(~stays).alias("going")
    )
    cells = materialize(cells, "trie-groups")
    # Everything that reaches a band's end belongs to the node there, also what ends with it.
    roots = cells.where(F.size("sizes") == BAND).groupBy((F.col("band") + 1).alias("band"), F.col("next").alias("entry")).agg(F.min("m").alias("entry_min"))
    least = members.agg(F.min("conv_id")).first()[0]
    if least is None:
        least = 0
    cells = cells.where("band = 0").withColumn("entry_min", F.lit(least).cast("long")).unionByName(cells.where("band > 0").join(roots, ["band", "entry"]))
    cells = materialize(cells, "trie-groups")
    nodes = materialize(_nodes(_hung(cells).drop("next", "going"), "trie"), "trie-all").where("depth > 0 OR band = 0")
    ends = _member_digests(members.where(stays).select("cell", "conv_id"))
    shown = [
        F.col("m").alias("conv_id"), (F.col("band").cast("long") * BAND + F.col("depth")).alias("depth"),
        F.when((F.col("band") > 0) | (F.col("depth") > 0), F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    ]
    empty = hashlib.sha256(b"").hexdigest()
    ended = nodes.where("cell IS NOT NULL").join(ends, "cell", "left").select(*shown, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    return nodes.where("cell IS NULL").select(*shown, F.lit(empty).alias("ends_sha256")).unionByName(ended)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    Null role and text count as empty; rows without conv_id are left out; repeated rows are turns of their own; long texts travel as
    digests; other columns are not read.
    """
    return prefix_trie(*rebuilt(conversations))


#: The same over the table ``conversations``; DuckDB has no crc32, so it is computed bit by bit.
SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
),
h AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
),
r AS (
  SELECT h.c, t.role, t.text, row_number() OVER (PARTITION BY h.c ORDER BY t.c <> h.c - h.c % 5 OR t.p > h.h, t.p) AS d
  FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.p <= h.h OR t.c = h.c AND t.p > h.h
),
w AS (SELECT c, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS prefix FROM r),
cn AS (
  SELECT c, d, min(c) OVER (PARTITION BY d, prefix) AS m, count(*) OVER (PARTITION BY d, prefix) AS n, octet_length(encode(text)) AS size FROM w
  UNION ALL SELECT c, 0, (SELECT min(c) FROM ids), (SELECT count(*) FROM ids), 0 FROM ids
),
nodes AS (SELECT m, d, n, size FROM cn WHERE c = m),
lengths AS (SELECT c, max(d) AS d FROM cn GROUP BY c),
ends AS (
  SELECT cn.m, cn.d, sha256(string_agg(CAST(cn.c AS VARCHAR), ',' ORDER BY cn.c)) AS digest FROM cn JOIN lengths USING (c, d) GROUP BY cn.m, cn.d
),
family AS (SELECT u.m, u.d, p.m AS parent FROM nodes u LEFT JOIN cn p ON p.c = u.m AND p.d = u.d - 1),
kids AS (SELECT parent AS m, d - 1 AS d, count(*) AS kids FROM family WHERE parent IS NOT NULL GROUP BY ALL),
below AS (
  SELECT a.m, a.d, sum(CASE WHEN k.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM nodes u JOIN cn a ON a.c = u.m AND a.d <= u.d LEFT JOIN kids k ON k.m = u.m AND k.d = u.d GROUP BY a.m, a.d
)
SELECT n.m AS conv_id, CAST(n.d AS BIGINT) AS depth, f.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN family f USING (m, d) JOIN below b USING (m, d) LEFT JOIN kids k USING (m, d) LEFT JOIN ends e USING (m, d)
"""
