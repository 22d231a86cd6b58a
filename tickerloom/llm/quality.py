"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import LOWER, WORD_BYTE, fold, free_name, range_hashes, text_blocks, word_hashes
from tickerloom.session import materialize

#: Labelled rows that the fit may use, chosen by id hash: the bound of the training sample.
TRAINING_ROWS = 20_000
FOURIER = 256
RIDGE = 1e-3
#: Parts of the training rows that are scored by a model fitted on the others, for calibration.
PARTS = 4
#: Steps of the raw score over [-1, 2] that calibration sees.
STEPS = 3000
ACCEPT = 0.3

_CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "comma", "shout", "symbol", "bar", "mark", "other", "tail", "lead"]
_CLASS = np.full(256, 11, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[10], _CLASS[46], _CLASS[44] = 3, 4, 5, 6
_CLASS[[33, 63]] = 7
_CLASS[[35, 36, 37, 38, 42, 94, 126]] = 8
_CLASS[124] = 9
_CLASS[[34, 39, 40, 41, 45, 47, 58, 59, 60, 61, 62, 64, 91, 92, 93, 95, 96, 123, 125]] = 10
_CLASS[128:192], _CLASS[192:] = 12, 13
STATISTICS = [
    "bytes", "words", "word_length", "word_spread", "short_words", "distinct_words", "top_word", "echoes", "distinct_triples",
    "lines", "line_length", "distinct_lines", "words_per_stop",
    *(f"share_{c}" for c in _CLASSES),
]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the count of the most frequent one, for each of ``n`` owners."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    owners = (key[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owners, np.diff(np.append(first, len(key))))
    return np.bincount(owners, minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Document statistics of a block of texts, one row per text; all zero for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    one = np.maximum(size, 1)
    text = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(text * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    h, owner, start, end = word_hashes(LOWER[data], WORD_BYTE[data], offsets)
    length = (end - start).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    w = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / w - mean**2, 0))
    short = np.bincount(owner, length <= 2, n) / w
    kinds, top = _distinct(owner, h, n)
    same = owner[1:] == owner[:-1]
    echoes = np.bincount(owner[1:][same & (h[1:] == h[:-1])], minlength=n) / w
    triple = owner[2:] == owner[:-2]
    mixed = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
    triples = np.bincount(owner[2:][triple], minlength=n)
    fresh, _ = _distinct(owner[2:][triple], mixed[triple], n)
    edge = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1][size > 0], edge + 1]))
    begin = np.unique(begin[begin < len(data)])
    whose = np.searchsorted(offsets, begin, "right") - 1
    finish = np.append(begin[1:], len(data))
    lines = np.bincount(whose, minlength=n).astype(float)
    line_kinds, _ = _distinct(whose, range_hashes(data, begin, finish), n) if len(begin) else (np.zeros(n), None)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, spread, short, kinds / w, top / w, echoes, fresh / np.maximum(triples, 1),
        np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), line_kinds / np.maximum(lines, 1),
        np.log1p(words / (1 + shares[:, 5])), shares / one[:, None],
    ])


@dataclass
class Model:
    """A fitted classifier: a few hundred numbers, whatever the size of the data."""

    centre: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Constant, standardised statistics, and Fourier features of a Gaussian kernel."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(z), 1)), z, waves])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.expand(x) @ self.weight, self.knots, self.levels), 0, 1)


def isotonic(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for y, w in zip(level.tolist(), weight.tolist(), strict=True):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), y) for y, _, n in blocks]) if blocks else level


def fit(docs: DataFrame, labels: DataFrame, train_fold: tuple[int, int] = (5, 0), rows: int = TRAINING_ROWS, seed: int = 7) -> Model:
    """Fit on labelled documents outside the held-out fold.

    A document's label is the mean of its non-null labels.  At most ``rows`` labelled ids take part, those with the smallest
    hash.  Without any labelled document every score is 0.5.
    """
    folds, held = train_fold
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # ``rows`` ids at most: bounded by the parameter, so the broadcast is, too.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column("text")):
                values = pa.FixedSizeListArray.from_arrays(pa.array(statistics(data, offsets).ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values, part.column("quality")], ["doc_id", "x", "y"])

    rows_df = materialize(texts.mapInArrow(measure, "doc_id long, x array<double>, y double"), "quality-rows")
    moments = rows_df.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    # The kernel's width grows with the number of statistics, as squared distances do.
    model = Model(
        np.array([r["m"] for r in moments]) if moments else np.zeros(d),
        np.array([max(r["s"], 1e-6) for r in moments]) if moments else np.ones(d),
        rng.normal(0, 1 / np.sqrt(d), (d, FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER),
        np.zeros(1 + d + FOURIER), np.array([0.0, 1.0]), np.array([0.5, 0.5]),
    )
    if not moments:
        return model
    return _calibrated(rows_df, model)


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """Normal equations summed by partition and part; ridge weights; isotonic levels of out-of-part scores."""
    width = len(model.weight)
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")).select("part", "x", "y")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((PARTS, width, width + 2))
        for frame in frames:
            for part, own in frame.groupby("part"):
                z = model.expand(np.stack(own["x"].to_list()))
                y = own["y"].to_numpy()
                total[part] += np.column_stack([z.T @ z, z.T @ y, np.full(width, float(len(y)))])
        yield pd.DataFrame({"part": np.repeat(np.arange(PARTS), width), "line": np.tile(np.arange(width), PARTS), "v": list(total.reshape(-1, width + 2))})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "line": [key[1]], "v": [np.sum(np.stack(frame["v"].to_list()), axis=0)]})

    schema = "part int, line int, v array<double>"
    # A fixed number of partial sums, so that their volume doesn't grow with the number of input files.
    lines = keyed.coalesce(8).mapInPandas(sums, schema).groupBy("part", "line").applyInPandas(add, schema).collect()
    gram = np.zeros((PARTS, width, width + 2))
    for r in lines:
        gram[r["part"], r["line"]] = r["v"]
    whole = gram.sum(axis=0)

    def solve(g: np.ndarray) -> np.ndarray:
        return np.linalg.solve(g[:, :width] + RIDGE * max(g[0, -1], 1) * np.eye(width), g[:, width])

    weights = np.stack([solve(whole - gram[p]) if whole[0, -1] > gram[p][0, -1] else solve(whole) for p in range(PARTS)])
    model.weight = solve(whole)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                raw = (model.expand(np.stack(frame["x"].to_list())) * weights[frame["part"].to_numpy()]).sum(axis=1)
                step = np.clip(np.floor((raw + 1) / 3 * STEPS), 0, STEPS - 1).astype(int)
                yield pd.DataFrame({"step": step, "y": frame["y"]})

    counts = keyed.mapInPandas(scored, "step int, y double").groupBy("step").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    n = np.array([r["n"] for r in counts], float)
    level = isotonic(np.array([r["y"] for r in counts]) / n, n)
    model.knots = (np.array([r["step"] for r in counts]) + 0.5) / STEPS * 3 - 1
    model.levels = level
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; null and empty texts are scored as empty."""
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(statistics(data, offsets)) for _, _, data, offsets in text_blocks(batch.column(place))]
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Repeated rows and null ids give a row each (a null id counts as empty text for the fold); other columns are not read.
    """
    model = fit(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(slim, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents, all columns unchanged, that the classifier accepts.

    Null and empty texts are scored like any other; repeated rows and null ids stay or go with their text; an empty table stays
    empty; columns of any name may be there.
    """
    model, name = fit(docs, labels), free_name(docs, "_quality")
    return score(docs, model, name).where(F.col(name) >= accept).drop(name)
