"""Benchmark decontamination by latent semantic retrieval.

Passages of the documents are TF-IDF vectors over the words of the benchmark; all other words have no part in any
product with a benchmark passage.  One pass over the corpus counts document frequencies and sketches the passages' second
moments (a randomised SVD in its Nystroem form: one product with a random matrix, summed by partition).  A second pass
projects the windows of every stretch that holds enough of an item's words to be a leak, finds the benchmark windows that are
near by cosine, and confirms them with the longest common subsequence of words and the item's answer words.

Which stretches these are follows from the leak rule and loses nothing: a leak may lack ``n - need`` of an item's ``n`` words, so
of its ``n - need + m`` rarest words at least ``m`` stand in the leak's region, in whatever order and with whatever between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import LOWER, WORD_BYTE, free_name, text_blocks, word_hashes

#: Latent dimensions kept, and random vectors of the sketch.
RANK = 48
SKETCH = 64
#: Lanes in which the sketch's parts of all tasks are added up first.
LANES = 256
#: Words of a search window, and of a sketched passage.
WINDOW = 12
PASSAGE = 32
#: Cosine of two windows that makes a candidate.
COSINE = 0.6
#: Share of an item's words that is asked for in advance, beyond those that a leak may lack; the rarest words are taken.
RARE = 0.3
#: Share of an item's words in the common subsequence, and of its answer words near it, that make a leak.
SUBSEQUENCE = 0.8
ANSWER = 0.6
#: A passage copied in part: this many words of the subsequence of a long item, in nearly unbroken order.
PARTIAL_WORDS = 40
#: Benchmark items searched at once; more are searched in several rounds, so what is broadcast stays bounded.
ITEMS_AT_ONCE = 5_000
#: Latest words of an item that count as its answer.
ANSWER_WORDS = 5


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts as (first row, end row, word hashes, owner): letters, digits and wide characters, lower case."""
    for first, end, data, offsets in text_blocks(column):
        h, owner, _, _ = word_hashes(LOWER[data], WORD_BYTE[data], offsets)
        yield first, end, h, owner


def common_subsequence(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place in ``text`` where it could stand.

    Bit-parallel over the item's words: one big integer holds a row of the table.
    """
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | (1 << k)
    full = (1 << len(item)) - 1
    row, found = full, []
    for k, w in enumerate(text.tolist()):
        match = places.get(w, 0)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
            found.append(k)
    length = len(item) - row.bit_count()
    return length, found[0] if found else 0, found[-1] if found else -1


@dataclass
class Benchmark:
    """The items searched at once: bounded by ITEMS_AT_ONCE and the items' lengths."""

    ids: list
    items: list[np.ndarray]
    vocabulary: np.ndarray = field(init=False)

    def __post_init__(self):
        self.vocabulary = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Number in the vocabulary of each word; -1 for words outside.  A bit table answers for most words."""
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 20, bool)
            self._bits[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self._bits[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), max(len(self.vocabulary) - 1, 0))
        if len(maybe):
            out[maybe] = np.where(self.vocabulary[at] == h[maybe], at, -1)
        return out

    def __getstate__(self):
        return {"ids": self.ids, "items": self.items, "vocabulary": self.vocabulary}


def random_matrix(rows: int, columns: int, seed: int = 3) -> np.ndarray:
    """Made anew from its seed in each worker instead of being sent."""
    return np.random.default_rng(seed).normal(size=(rows, columns)).astype(np.float32)


def sketch(docs: DataFrame, bench: Benchmark, lines: int = 512) -> tuple[int, np.ndarray, np.ndarray]:
    """Documents, document frequency of every word, and C'C R for passage counts C and a random R; over all documents."""
    size = len(bench.vocabulary)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        frequency, moment, n = np.zeros(size), np.zeros((size, SKETCH), np.float32), 0
        test = random_matrix(size, SKETCH)
        for batch in batches:
            n += batch.num_rows
            for _, _, h, owner in words_of(batch.column(0)):
                place = bench.places(h)
                inside = np.flatnonzero(place >= 0)
                if not len(inside):
                    continue
                word, doc = place[inside], owner[inside]
                first = np.unique(doc * size + word)
                frequency += np.bincount(first % size, minlength=size)
                # Passages tile each text: PASSAGE words from its start on.
                begin = np.searchsorted(owner, doc, "left")
                passage = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | ((inside - begin)[1:] // PASSAGE != (inside - begin)[:-1] // PASSAGE))) - 1
                starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                rows = np.add.reduceat(test[word], starts, axis=0)
                order = np.argsort(word, kind="stable")
                ordered = word[order]
                heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                moment[ordered[heads]] += np.add.reduceat(rows[passage[order]], heads, axis=0)
        blocks = range(0, size, lines)
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([
            pa.array([lane] * (len(blocks) + 1), pa.int32()),
            pa.array([*(b // lines for b in blocks), -1], pa.int32()),
            pa.array([*(np.column_stack([frequency[b : b + lines], moment[b : b + lines]]).astype("<f8").tobytes() for b in blocks), np.array([n], "<f8").tobytes()], pa.binary()),
        ], ["lane", "block", "part"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for part in frame["part"]:
            values = np.frombuffer(part, "<f8")
            total = values.copy() if total is None else total + values
        return pd.DataFrame({"block": [key[-1]], "part": [total.tobytes()]})

    # Added up in two steps: a group holds a share of the input parts, then a row of each lane.
    parts = docs.select(F.col("text").cast("string")).mapInArrow(sums, "lane int, block int, part binary")
    lanes = parts.groupBy("lane", "block").applyInPandas(add, "block int, part binary")
    found = lanes.groupBy("block").applyInPandas(add, "block int, part binary").collect()
    parts = {r["block"]: np.frombuffer(r["part"], "<f8") for r in found}
    if not parts:
        return 0, np.zeros(size), np.zeros((size, SKETCH))
    whole = np.concatenate([parts[b].reshape(-1, 1 + SKETCH) for b in sorted(parts) if b >= 0])
    return int(parts[-1][0]), whole[:, 0], whole[:, 1:]


def latent_space(n: int, frequency: np.ndarray, moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies, and the whitened projection of weighted counts to the leading singular directions.

    With D the weights, A = C D the TF-IDF passages and R' = D**-1 R, A'A R' = D (C'C R); the Nystroem form of the randomised
    SVD needs this product alone.
    """
    idf = np.log((1 + n) / (1 + frequency)) + 1
    product = moment * idf[:, None]
    test = random_matrix(len(idf), SKETCH).astype(float) / idf[:, None]
    shift = 1e-6 * max(np.linalg.norm(product), 1e-12)
    product = product + shift * test
    core = test.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    half = product @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    rank = min(RANK, int((s > 1e-6 * max(s.max(), 1e-300)).sum()))
    # Columns of u are right singular vectors of A, s its singular values; dividing by s gives every direction equal spread.
    return idf, (u[:, :rank] / s[:rank] * s[0]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def needed(n: int) -> int:
    """Common words without which an item of ``n`` words is no leak."""
    return min(int(np.ceil(SUBSEQUENCE * n - 1e-9)), PARTIAL_WORDS)


def reach(n: int) -> int:
    """Words of a text in which an item of ``n`` words is looked for: half of it may be inserted."""
    return n + 2 * (n // 4 + 2)


class Finder:
    """Latent vectors of the benchmark's words and windows, and the confirmation of candidates."""

    def __init__(self, bench: Benchmark, vectors: np.ndarray, frequency: np.ndarray):
        self.bench, self.vectors, self.units = bench, vectors, {}
        words, items, self.least = [], [], np.ones(len(bench.items), np.int64)
        for k, item in enumerate(bench.items):
            n, place = len(item), bench.places(item)
            self.least[k] = max(1, min(needed(n), int(RARE * n)))
            rare = np.unique(place[np.argsort(frequency[place], kind="stable")[: n - needed(n) + self.least[k]]])
            words.append(rare)
            items.append(np.full(len(rare), k, np.int64))
        word, item = np.concatenate(words), np.concatenate(items)
        self.posted = item[np.argsort(word, kind="stable")]
        self.postings = np.append(0, np.cumsum(np.bincount(word, minlength=len(bench.vocabulary))))
        self.reach = np.array([reach(len(x)) for x in bench.items], np.int64)

    def stretches(self, place: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): the places where the region of a leak can begin; every leak's region begins in one of them."""
        at = np.flatnonzero(place >= 0)
        counts = self.postings[place[at] + 1] - self.postings[place[at]]
        at, counts = at[counts > 0], counts[counts > 0]
        if not len(at):
            return
        ends = np.cumsum(counts)
        inner = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        item, pos = self.posted[np.repeat(self.postings[place[at]], counts) + inner], np.repeat(at, counts)
        # Ordered by item; places stay in order.
        order = np.argsort(item.astype(np.int16 if len(self.reach) < 1 << 15 else np.int64), kind="stable")
        item, pos = item[order], pos[order]
        last = np.arange(len(item)) + self.least[item] - 1
        k = np.flatnonzero(last < len(item))
        k = k[(item[last[k]] == item[k]) & (pos[last[k]] - pos[k] < self.reach[item[k]])]
        k = k[owner[pos[last[k]]] == owner[pos[k]]]
        if not len(k):
            return
        item, first, final = item[k], np.maximum(pos[last[k]] - self.reach[item[k]] + 1, begin[pos[k]]), pos[k]
        new = np.append(True, (item[1:] != item[:-1]) | (first[1:] > final[:-1]))
        heads = np.flatnonzero(new)
        yield from zip(item[heads].tolist(), first[heads].tolist(), final[np.append(heads[1:], len(item)) - 1].tolist(), strict=True)

    def cosine(self, item: int, place: np.ndarray) -> float:
        """Largest cosine of a window of these words and one of the item."""
        size = min(WINDOW, len(self.bench.items[item]), len(place))

        def windows(place: np.ndarray) -> np.ndarray:
            rows = np.where((place >= 0)[:, None], self.vectors[place], 0)
            sums = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=float)])
            return _unit(sums[size:] - sums[:-size])

        if (item, size) not in self.units:
            self.units[item, size] = windows(self.bench.places(self.bench.items[item]))
        return float((windows(place) @ self.units[item, size].T).max())

    def search(self, h: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """Confirmed leaks in a block: (text, item, common words, share of the item, cosine)."""
        if not len(h):
            return []
        place = self.bench.places(h)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        stop = np.append(first[1:], len(h))
        begin, finish = np.repeat(first, stop - first), np.repeat(stop, stop - first)
        best: dict[tuple[int, int], tuple[int, float, float]] = {}
        for item, lo, hi in self.stretches(place, owner, begin):
            words, size = self.bench.items[item], int(self.reach[item])
            end = min(hi + size, int(finish[hi]))
            common = lo + np.flatnonzero(np.isin(h[lo:end], words))
            starts = common[common <= hi]
            # So many words at most are common to the item and the region that begins here.
            bound = np.searchsorted(common, starts + size) - np.searchsorted(common, starts)
            starts, bound = starts[bound >= needed(len(words))], bound[bound >= needed(len(words))]
            if not len(starts):
                continue
            near = self.cosine(item, place[starts[0] : min(starts[-1] + size, end)])
            if near < COSINE:
                continue
            key = int(owner[hi]), item
            for s, n in zip(starts.tolist(), np.minimum(bound, len(words)).tolist(), strict=True):
                if key in best and n <= best[key][0]:
                    continue
                length, share, leak = self.confirm(words, h[s : min(s + size, end)])
                if leak and (key not in best or length > best[key][0]):
                    best[key] = length, share, max(near, best[key][2] if key in best else near)
        return [(*key, *found) for key, found in sorted(best.items())]

    def confirm(self, item: np.ndarray, region: np.ndarray) -> tuple[int, float, bool]:
        """Common words, their share of the item, and whether this is a leak.

        Either nearly the whole item stands here in order, with its answer (its last words), or a long part of it does.
        """
        length, a, e = common_subsequence(item, region)
        share = length / max(len(item), 1)
        answer = np.unique(item[-ANSWER_WORDS:])
        answered = np.isin(answer, region[a : e + 1]).mean() >= ANSWER if len(answer) else False
        return length, share, bool((share >= SUBSEQUENCE and answered) or length >= PARTIAL_WORDS)


def leaks(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, common_words, share, cosine of every benchmark item found in a document.

    Null and empty texts hold no leak; items without words are never found; repeated document rows give repeated leaks, and
    repeated items are found under each id; null ids are kept.  An empty table on either side gives no rows.  A document that
    holds an item twice gives one row with the longest match.
    """
    schema = "doc_id long, item_id long, common_words int, share double, cosine double"
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    rounds = max(1, -(-benchmark.count() // items_at_once))
    for k in range(rounds):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k) if rounds > 1 else benchmark
        rows = part.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").collect()
        texts = pa.array([r["text"] for r in rows], pa.string())
        items = [h[owner == i] for _, _, h, owner, n in ((*x, x[1] - x[0]) for x in words_of(texts)) for i in range(n)]
        filled = [(r["item_id"], w) for r, w in zip(rows, items, strict=True) if len(w)]
        if not filled:
            continue
        bench = Benchmark([i for i, _ in filled], [w for _, w in filled])
        n, frequency, moment = sketch(slim, bench)
        if not frequency.any():
            continue
        idf, projection = latent_space(n, frequency, moment)
        finder = Finder(bench, (projection * idf[:, None]).astype(np.float32), frequency)

        def search(batches: Iterator[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_of = batch.column(0)
                rows = [(docs_of[first + t].as_py(), finder.bench.ids[i], n, s, c) for first, _, h, owner in words_of(batch.column(1)) for t, i, n, s, c in finder.search(h, owner)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "common_words", "share", "cosine"])

        found = slim.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns unchanged, that hold no benchmark item.

    Null and empty texts hold none; all rows of an id go with the one that holds an item, null ids together; an empty table, or one
    without benchmark items, stays as it is; columns of any name may be there.
    """
    name = free_name(docs, "_leak")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
