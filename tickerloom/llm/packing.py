"""Best-fit packing of tokenized documents with swap-based local search.

Documents become token ids in the scan.  Pieces are dealt to shards of bounded size; each shard packs best-fit decreasing and
then improves its underfull bins by moves and swaps.  Bins that are full enough are final; the documents of the others meet in
fewer shards in the next round, until one shard is left.  No shard ever holds more than ``shard_rows`` times two pieces or so.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import SPACE_BYTE, range_hashes, text_blocks, texts_of
from tickerloom.session import materialize

CAPACITY = 2048
SEPARATOR_ID = 0
#: Pieces that one task packs; also the size of the last round.
SHARD_ROWS = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, final boolean"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of the ``tokenizers`` library for a byte-level BPE file.

    The pre-tokenizer ends a token at certain places whatever stands around them, so the chunks between such places can be
    encoded alone: each distinct chunk once, by a byte-pair encoder built from the same file.  Known chunks are found by
    sorted 64-bit hashes and compared byte by byte; their ids stand in one flat array.  Texts where a place is unsure (a
    space inside a longer gap), a special token's text occurs or a chunk only shares another one's hash, and all texts where
    the file is of another kind, go through the library whole.
    """

    def __init__(self, path: str, most: int = 3_000_000, most_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.pairs, self.most, self.most_bytes = byte_pairs(path), most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.hashes, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.raw, self.place, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids if text else [], np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order."""
        for first, end, data, offsets in text_blocks(texts):
            if self.pairs is None:
                yield from (self.whole(t) for t in texts_of(texts.slice(first, end - first)).to_pylist())
                continue
            flat, bounds, odd = self._block(data, offsets)
            for k in range(end - first):
                yield self.whole(texts[first + k].as_py()) if odd[k] else flat[bounds[k] : bounds[k + 1]]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block, each text's bounds in them, and the texts that must be encoded whole."""
        starts, unsure = cuts(data, offsets)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, unsure, "right") - 1] = True
        raw = data.tobytes() if self.special else b""
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        if not len(starts):
            return self.ids[:0], np.zeros(len(offsets), np.int64), odd
        ends = np.append(starts[1:], len(data))
        h, one, inverse = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        row, other = self._known(h, starts[one], ends[one], data)
        first = one[inverse]
        unlike = other[inverse] | ~same_bytes(data, starts, ends - starts, data, starts[first], (ends - starts)[first])
        odd[np.searchsorted(offsets, starts[unlike], "right") - 1] = True
        size, start = self.size[row][inverse], self.start[row][inverse]
        done = np.cumsum(size)
        flat = self.ids[np.arange(done[-1]) - np.repeat(done - size - start, size)]
        bounds = np.append(0, done)[np.searchsorted(starts, offsets, "left")]
        return flat, bounds, odd

    def _known(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted hashes ``h`` in the store, after the unknown chunks have been encoded; which rows hold other bytes."""
        if len(self.hashes) > self.most or len(self.raw) > self.most_bytes:
            self.forget()
        at = np.searchsorted(self.hashes, h)
        missing = np.flatnonzero((at == len(self.hashes)) | (self.hashes[np.minimum(at, len(self.hashes) - 1)] != h) if len(self.hashes) else np.ones(len(h), bool))
        if len(missing):
            raw = data.tobytes()
            new = [self.pairs(raw[a:b].decode()) for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            size = np.array(list(map(len, new)), np.int64)
            where = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array(list(chain.from_iterable(new)), np.uint32)])
            self.start, self.size = np.insert(self.start, at[missing], where), np.insert(self.size, at[missing], size)
            self.hashes = np.insert(self.hashes, at[missing], h[missing])
            long = (end - start)[missing]
            self.place = np.insert(self.place, at[missing], len(self.raw) + np.cumsum(long) - long)
            self.length = np.insert(self.length, at[missing], long)
            self.raw = np.concatenate([self.raw, *(data[a:b] for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True))])
            at = np.searchsorted(self.hashes, h)
        return at, ~same_bytes(data, start, end - start, self.raw, self.place[at], self.length[at])


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether the byte ranges of ``a`` and ``b`` are the same, pair by pair; about ``step`` bytes are compared at once."""
    same = a_size == b_size
    rows = np.flatnonzero(same & (a_size > 0) & ~((a_start == b_start) & (a is b)))
    done = np.cumsum(a_size[rows])
    k = 0
    while k < len(rows):
        end = max(k + 1, int(np.searchsorted(done, done[k] - a_size[rows[k]] + step, "right")))
        part = rows[k:end]
        size = a_size[part]
        if len(part) == 1:
            same[part] = np.array_equal(a[a_start[part[0]] : a_start[part[0]] + size[0]], b[b_start[part[0]] : b_start[part[0]] + size[0]])
        else:
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(first, size)
            same[part] = np.logical_and.reduceat(a[np.repeat(a_start[part], size) + at] == b[np.repeat(b_start[part], size) + at], first)
        k = end
    return same


_GAP = SPACE_BYTE
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Lead bytes of the characters beyond ASCII that are white space (U+0085 to U+3000).
_WIDE_GAP = np.zeros(256, bool)
_WIDE_GAP[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where a token always starts, and the spaces where that is not sure.

    Sure places: the start of a text; a space after or before something that is not white space; a comma or full stop
    after an ASCII letter; both sides of a single line break between ASCII characters that are not white space.
    """
    n = len(data)
    # Neighbours across a text's end count as white space, so nothing there is called sure by mistake.
    before, after = np.full(n, 32, np.uint8), np.full(n, 32, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[offsets[:-1][offsets[:-1] < n]] = 32
    after[offsets[1:][offsets[1:] > 0] - 1] = 32
    space = data == 32
    unsure = space & (_GAP[before] | (before >= 128)) & (_GAP[after] | _WIDE_GAP[after])
    line = (data == 10) & ~_GAP[before] & ~_GAP[after] & (before < 128) & (after < 128)
    start = space | (_MARK[data] & _LETTER[before]) | line
    start[1:] |= line[:-1]
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    # A space before a wide character that may be white space after one that may be, too, is rare; look closer there.
    near = np.flatnonzero(unsure)
    return np.flatnonzero(start), near[[_gap_follows(data, i) for i in near]] if len(near) else near


def _gap_follows(data: np.ndarray, i: int) -> bool:
    """Whether white space or nothing may follow the space at ``i``; True in doubt."""
    tail = data[i + 1 : i + 4].tobytes()
    if tail[:1] and tail[0] >= 128:
        return tail.decode("utf-8", "ignore")[:1].isspace() or len(tail) < 3
    return True


def byte_pairs(path: str):
    """A fast encoder for a byte-level BPE file whose ids follow its merge order; None for any other file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    import tiktoken

    # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    extra = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in extra}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # Contractions, letters, digits, other marks, white space: the byte-level pre-tokenizer's fixed pattern.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of all documents: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and gives the separator alone.  Null and repeated ids give rows of their own.
    Other input columns are not read.
    """
    last = np.array([SEPARATOR_ID], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode(batch.column(1)), strict=True):
                for k, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                    code = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    code = zlib.crc32(last, code) if start + length > len(ids) else code
                    for column, value in zip(rows, (doc, k, start, length, code), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenize, PIECES)


class Bins:
    """Bins of one shard: sizes only; ``bins[b]`` lists (size, row)."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity, self.bins, self.room = capacity, [], []
        self.best_fit(sizes)

    def best_fit(self, sizes: np.ndarray) -> None:
        """Largest first, each into the bin that it fills best."""
        by_room: dict[int, list[int]] = defaultdict(list)
        mask = 0  # bit r: some bin has r places left
        for row in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[row])
            fitting = mask >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
            else:
                b, room = len(self.bins), self.capacity
                self.bins.append([])
                self.room.append(room)
            self.bins[b].append((size, row))
            self.room[b] = left = room - size
            if left:
                by_room[left].append(b)
                mask |= 1 << left

    def improve(self, passes: int) -> None:
        """Local search: moves and swaps that raise the sum of squared fills until bins empty.

        Every step shifts ``d`` tokens from a donor to a receiver where that raises the sum of squares, so the search
        ends by itself; ``passes`` only bounds the effort spent on small gains.
        """
        for _ in range(passes):
            if not self._one_pass():
                break

    def _one_pass(self) -> bool:
        under = [b for b, room in enumerate(self.room) if room and self.bins[b]]
        under.sort(key=lambda b: self.room[b])
        if len(under) < 2:
            return False
        singles, pairs = self._index(under)
        changed = False
        for a in under:
            while self.room[a] and self.bins[a]:
                found = self._exchange(a, singles, pairs)
                if found is None:
                    break
                donor, give, take = found
                self._apply(a, donor, give, take, singles, pairs)
                changed = True
        return changed

    def _sums(self, b: int) -> list[int]:
        sizes = [s for s, _ in self.bins[b]]
        # Pair sums only for bins of a few documents: many small documents already offer all moves.
        return [x + y for i, x in enumerate(sizes) for y in sizes[i + 1 :]] if len(sizes) <= 24 else []

    def _index(self, under: list[int]):
        singles, pairs = Index(), Index()
        for b in under:
            for s, _ in self.bins[b]:
                singles.add(s, b)
            for s in self._sums(b):
                pairs.add(s, b)
        return singles, pairs

    def _exchange(self, a: int, singles: Index, pairs: Index):
        """The exchange that brings most tokens into bin ``a``: (donor, sizes from a, sizes to a)."""
        room, mine = self.room[a], [s for s, _ in self.bins[a]]
        best, gain = None, 0
        offers = [((), 0)] + [((s,), s) for s in set(mine)]
        if len(mine) <= 24:
            offers += [((x, y), x + y) for i, x in enumerate(mine) for y in mine[i + 1 :]]
        for give, given in offers:
            for index, parts in ((singles, 1), (pairs, 2)):
                if len(give) + parts > 3 or (parts == 2 and not give):
                    continue
                for wanted in index.below(given + room, given + gain):
                    d = wanted - given
                    donor = next((b for b in index.owners(wanted) if b != a and self.room[b] > room - d), None)
                    if donor is not None:
                        best, gain = (donor, give, wanted if parts == 1 else self._pair(donor, wanted)), d
                        break
                if gain == room:
                    return self._final(best)
        return self._final(best)

    @staticmethod
    def _final(best):
        if best is None:
            return None
        donor, give, take = best
        return donor, list(give), [take] if isinstance(take, int) else list(take)

    def _pair(self, b: int, total: int) -> tuple[int, int]:
        sizes = [s for s, _ in self.bins[b]]
        return next((x, y) for i, x in enumerate(sizes) for y in sizes[i + 1 :] if x + y == total)

    def _apply(self, a: int, donor: int, give: list[int], take: list[int], singles: Index, pairs: Index) -> None:
        for b in (a, donor):
            for s, _ in self.bins[b]:
                singles.drop(s, b)
            for s in self._sums(b):
                pairs.drop(s, b)
        for sizes, source, target in ((take, donor, a), (give, a, donor)):
            for size in sizes:
                k = next(i for i, (s, _) in enumerate(self.bins[source]) if s == size)
                self.bins[target].append(self.bins[source].pop(k))
        for b in (a, donor):
            self.room[b] = self.capacity - sum(s for s, _ in self.bins[b])
            if self.room[b] and self.bins[b]:
                for s, _ in self.bins[b]:
                    singles.add(s, b)
                for s in self._sums(b):
                    pairs.add(s, b)


class Index:
    """Sizes on offer and the underfull bins that offer them."""

    def __init__(self):
        self.where: dict[int, Counter] = defaultdict(Counter)
        self.sizes: list[int] = []

    def add(self, size: int, b: int) -> None:
        if not self.where[size]:
            insort(self.sizes, size)
        self.where[size][b] += 1

    def drop(self, size: int, b: int) -> None:
        owners = self.where[size]
        owners[b] -= 1
        if not owners[b]:
            del owners[b]
        if not owners:
            self.sizes.remove(size)

    def below(self, most: int, least: int, tries: int = 8) -> Iterator[int]:
        """The largest sizes in (least, most], at most ``tries`` of them."""
        at = bisect_right(self.sizes, most)
        for k in range(at - 1, max(at - 1 - tries, -1), -1):
            if self.sizes[k] <= least:
                return
            yield self.sizes[k]

    def owners(self, size: int, tries: int = 32) -> Iterator[int]:
        for k, b in enumerate(self.where[size]):
            if k == tries:
                return
            yield b


def pack_shard(sizes: np.ndarray, capacity: int, passes: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset and 'bin is full' of every row of one shard."""
    bins = Bins(sizes, capacity)
    bins.improve(passes)
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.zeros(len(sizes), bool)
    for b, content in enumerate(bins.bins):
        at = 0
        for size, row in sorted(content, key=lambda x: x[1]):
            number[row], offset[row], full[row] = b, at, bins.room[b] == 0
            at += size
    return number, offset, full


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All pieces with their sequence and the place in it.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Sequences are gapless from 0 and hold at most
    ``capacity`` tokens.  Empty and null texts are one separator token; an empty table gives no rows; repeated rows are
    packed as often as they stand; ties between equal sizes are broken by the order of (doc_id, piece) in a shard.
    """
    parts, current = [], materialize(pieces(docs, tokenizer_path, capacity), "pieces")
    round_no, last = 0, False
    while not last:
        rows = current.count()
        shards = max(1, -(-rows // shard_rows))
        last = shards == 1
        # Leftovers keep shrinking; a round that fails to halve them closes the search.
        current = materialize(_packed_round(current, shards, capacity, round_no, last), f"packed-{round_no}")
        parts.append(current.where("final"))
        left = current.where("NOT final")
        if not last and left.count() > rows // 2:
            parts.append(left)
            break
        current = left.select("doc_id", "piece", "start", "length", "ids_crc32")
        round_no += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("final")


def _packed_round(rows: DataFrame, shards: int, capacity: int, round_no: int, last: bool) -> DataFrame:
    def shard(part: pd.DataFrame) -> pd.DataFrame:
        base = (round_no << 54) | (int(part["shard"].iloc[0]) << 26) if len(part) else 0
        part = part.drop(columns="shard").sort_values(["doc_id", "piece"], kind="stable", na_position="first").reset_index(drop=True)
        number, offset, full = pack_shard(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=number + base, offset=offset, final=full | last)

    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    if shards == 1:
        keyed = rows.withColumn("shard", F.lit(0).cast("long"))
    return keyed.groupBy("shard").applyInPandas(shard, PACKED)
