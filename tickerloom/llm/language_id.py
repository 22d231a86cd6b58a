"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.common import fold, free_name, text_blocks

#: Training documents per language, chosen by id hash, and passages taken from each: the bound of the sample.
DOCUMENTS_PER_LANGUAGE = 400
PASSAGES = 4
PASSAGE_CHARS = 80
#: Units of each direction, bytes of a training passage, bytes of a window in prediction.
UNITS = 8
TRAIN_BYTES = 64
WINDOW = 128
#: Windows that run side by side.
LANES = 2048
EPOCHS = 8
BATCH = 128
UNKNOWN = "und"
#: Byte value that fills short windows.
FILL = 32


class Direction:
    """One direction of the network; arrays are (features, lanes).

    Gates use the piecewise-linear sigmoid clip(x / 4 + 1/2, 0, 1); the candidate's recurrent part is gated after its product.
    """

    def __init__(self, rng: np.random.Generator, units: int):
        self.table = rng.normal(0, 0.3, (3 * units, 256)).astype(np.float32)
        self.inner = (rng.normal(0, 1, (3 * units, units)) / np.sqrt(units)).astype(np.float32)
        self.bias = np.zeros((units, 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias]

    def step(self, codes: np.ndarray, state: np.ndarray, kept: list | None = None) -> np.ndarray:
        u = len(state)
        own = np.take(self.table, codes, axis=1)
        back = self.inner @ state
        gates = own[: 2 * u]
        gates += back[: 2 * u]
        if kept is not None:
            live = (np.abs(gates) < 2).astype(np.float32) * np.float32(0.25)
        gates *= np.float32(0.25)
        gates += np.float32(0.5)
        np.clip(gates, 0, 1, out=gates)
        update, reset = gates[:u], gates[u:]
        back = back[2 * u :]
        back += self.bias
        new = own[2 * u :]
        new += reset * back
        np.tanh(new, out=new)
        out = state - new
        out *= update
        out += new
        if kept is not None:
            kept.append((codes, state, update, reset, back, new, live))
        return out

    def backward(self, kept: list, grads: list[np.ndarray]) -> list[np.ndarray]:
        """Backpropagation through time: gradients of the parameters from those of the states, in run order."""
        table, inner, bias = (np.zeros_like(p) for p in self.parameters())
        u, flow = self.inner.shape[1], 0.0
        for (codes, state, update, reset, back, new, live), grad in zip(reversed(kept), reversed(grads), strict=True):
            d = grad + flow
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (state - new) * live[:u]
            d_reset = d_new * back * live[u:]
            d_back = d_new * reset
            inside = np.concatenate([d_update, d_reset, d_back])
            inner += inside @ state.T
            bias += d_back.sum(axis=1, keepdims=True)
            outside = np.concatenate([d_update, d_reset, d_new])
            for row in range(3 * u):
                table[row] += np.bincount(codes, outside[row], 256).astype(np.float32)
            flow = d * update + self.inner.T @ inside
        return [table, inner, bias]


class Network:
    def __init__(self, languages: list[str], seed: int = 11, units: int = UNITS):
        rng = np.random.default_rng(seed)
        self.languages, self.units, self.rng = languages, units, rng
        self.ahead, self.behind = Direction(rng, units), Direction(rng, units)
        self.out = (rng.normal(0, 1, (len(languages), 2 * units)) / np.sqrt(2 * units)).astype(np.float32)
        self.base = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.behind.parameters(), self.out, self.base]

    def label(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(position, probabilities (languages, lanes)) of every position of windows ``codes`` (positions, lanes), last first."""
        steps, lanes = codes.shape
        u = self.units
        state = np.zeros((u, lanes), np.float32)
        ahead = np.empty((steps, len(self.languages), lanes), np.float32)
        for t in range(steps):
            state = self.ahead.step(codes[t], state)
            np.matmul(self.out[:, :u], state, out=ahead[t])
        state = np.zeros((u, lanes), np.float32)
        for t in reversed(range(steps)):
            state = self.behind.step(codes[t], state)
            p = ahead[t]
            p += self.out[:, u:] @ state
            p += self.base
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, p

    def gradients(self, codes: np.ndarray, answer: np.ndarray) -> tuple[float, list[np.ndarray]]:
        steps, lanes = codes.shape
        u = self.units
        kept_a, kept_b, states_a, states_b = [], [], [], [None] * steps
        state = np.zeros((u, lanes), np.float32)
        for t in range(steps):
            state = self.ahead.step(codes[t], state, kept_a)
            states_a.append(state)
        state = np.zeros((u, lanes), np.float32)
        for t in reversed(range(steps)):
            states_b[t] = state = self.behind.step(codes[t], state, kept_b)
        d_out, d_base = np.zeros_like(self.out), np.zeros_like(self.base)
        grads_a, grads_b, loss = [], [], 0.0
        for t in range(steps):
            both = np.concatenate([states_a[t], states_b[t]])
            p = self.out @ both + self.base
            p = np.exp(p - p.max(axis=0))
            p /= p.sum(axis=0)
            loss -= float(np.log(p[answer, np.arange(lanes)] + 1e-9).mean()) / steps
            p[answer, np.arange(lanes)] -= 1
            p /= steps * lanes
            d_out += p @ both.T
            d_base += p.sum(axis=1, keepdims=True)
            g = self.out.T @ p
            grads_a.append(g[:u])
            grads_b.append(g[u:])
        return loss, [*self.ahead.backward(kept_a, grads_a), *self.behind.backward(kept_b, grads_b[::-1]), d_out, d_base]

    def train(self, codes: np.ndarray, answer: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> list[float]:
        """Adam over shuffled batches; at least 150 steps, so that a few documents are learned, too."""
        params = self.parameters()
        m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
        losses, step = [], 0
        total = max(150, epochs * -(-len(answer) // BATCH))
        while step < total:
            order = self.rng.permutation(len(answer))
            for lo in range(0, len(order), BATCH):
                if step == total:
                    break
                rows = order[lo : lo + BATCH]
                loss, grads = self.gradients(np.ascontiguousarray(codes[rows].T), answer[rows])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                speed = rate * (1 - 0.9 * step / total)
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= (speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                losses.append(loss)
        return losses

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean probabilities over all positions, positions, and positions labelled with the pooled language, per text."""
        n, size = len(offsets) - 1, np.diff(offsets)
        total = np.zeros((n, len(self.languages)))
        votes = np.zeros((n, len(self.languages)))
        owner, start, skip, fill = windows(offsets)
        padded = np.concatenate([data, np.full(WINDOW, FILL, np.uint8)])
        for lo in range(0, len(owner), LANES):
            part = slice(lo, lo + LANES)
            position = np.arange(WINDOW)[:, None]
            codes = padded[start[part] + position]
            codes[position >= fill[part]] = FILL
            counts = (position >= skip[part]) & (position < fill[part])
            sums = np.zeros((len(self.languages), codes.shape[1]), np.float32)
            wins = np.zeros_like(sums)
            for t, p in self.label(codes):
                p *= counts[t]
                sums += p
                wins += p > 0.5 * counts[t]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner[part], sums[k], n)
                votes[:, k] += np.bincount(owner[part], wins[k], n)
        mean = total / np.maximum(size, 1)[:, None]
        return mean, size, votes


def windows(offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows over whole texts: owner, first byte, positions already seen, positions in use.

    A text's last window ends with the text and repeats what it needs of the window before; only shorter texts are filled up.
    """
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(number * WINDOW, np.maximum(size[owner] - WINDOW, 0))
    return owner, offsets[:-1][owner] + at, number * WINDOW - at, np.minimum(size[owner], WINDOW)


#: Slices of ids that are ranked on their own.
SLICES = 64


def fit(docs: DataFrame, folds: int = 3, held: int = 1, documents: int = DOCUMENTS_PER_LANGUAGE) -> Network | None:
    """Train on documents outside the held-out fold with a language; None if there are none.

    Of each language the ``documents`` ids with the smallest hash take part, with a few passages each; the sample is bounded
    by these parameters and the number of languages.
    """
    # Ranked within slices of ids first: one task then ranks a language's firsts of SLICES slices, whatever the number of input parts.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sliced = Window.partitionBy("lang", F.pmod(F.hash("doc_id"), F.lit(SLICES))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    chosen = (
        docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"))
        .where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
        .withColumn("place", F.row_number().over(sliced)).where(F.col("place") <= documents)
        .withColumn("place", F.row_number().over(whole)).where(F.col("place") <= documents)
        .groupBy("doc_id", "lang").agg(F.min("place").alias("place"))
    )
    n = F.char_length("text")
    spots = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda k: F.substring(
        F.col("text"), (F.greatest(n - PASSAGE_CHARS, F.lit(0)) * k / max(PASSAGES - 1, 1)).cast("int") + 1, F.lit(PASSAGE_CHARS)))
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")
        .select("lang", "place", F.explode(F.array_distinct(spots)).alias("passage"))
        .where(F.col("passage").rlike("\\p{L}"))
    ).collect()
    rows.sort(key=lambda r: (r["lang"], r["place"], r["passage"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    codes = np.full((len(rows), TRAIN_BYTES), FILL, np.uint8)
    for i, r in enumerate(rows):
        raw = r["passage"].encode()[:TRAIN_BYTES]
        codes[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    answer = np.array([languages.index(r["lang"]) for r in rows])
    network = Network(languages)
    network.train(codes, answer)
    return network


def predict(docs: DataFrame, network: Network | None, prefix: str = "") -> DataFrame:
    """All columns and lang_pred, score, n_positions, n_agreeing (names with ``prefix``) from the whole text.

    ``n_agreeing`` counts the positions labelled with the predicted language.  A text that is null or has no letter gets
    ``und`` with score 0, as does every text if there was nothing to learn.
    """
    made = [prefix + c for c in ("lang_pred", "score", "n_positions", "n_agreeing")]
    letters = prefix + "has_letter"
    marked = docs.withColumn(letters, F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False)))
    schema = marked.selectExpr("*", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in zip(made, ("string", "double", "long", "long"), strict=True))).schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            names = np.full(n, UNKNOWN, object)
            scores, positions, agreeing = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for first, end, data, offsets in text_blocks(batch.column(place)) if network else ():
                mean, size, votes = network.pooled(data, offsets)
                best = mean.argmax(axis=1)
                rows = np.arange(end - first)
                names[first:end] = np.array(network.languages, object)[best]
                scores[first:end] = np.clip(mean[rows, best], 0, 1)
                positions[first:end], agreeing[first:end] = size, votes[rows, best]
            names[~known], scores[~known] = UNKNOWN, 0.0
            extra = [pa.array(names, pa.string()), pa.array(scores), pa.array(positions), pa.array(agreeing)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *made])

    return marked.mapInArrow(run, schema).drop(letters)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions, n_agreeing of every document.

    A null id counts as empty text for the fold; repeated rows get a row each; an empty table gives none; other columns are
    not read for a prediction.
    """
    network = fit(docs.select("doc_id", "lang", "text"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return predict(slim, network).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_positions", "n_agreeing")


def identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents, all columns unchanged, with a known language and at least the given score.

    Null texts and texts without a letter go; repeated rows and null ids stay or go with their text; an empty table stays empty;
    columns of any name may be there.
    """
    prefix = free_name(docs, "_language_")
    kept = predict(docs, fit(docs.select("doc_id", "lang", "text")), prefix)
    made = [c for c in kept.columns if c.startswith(prefix)]
    return kept.where((F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}score") >= least)).drop(*made)
