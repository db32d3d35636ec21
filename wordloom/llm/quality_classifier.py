"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label. Every passage of
the whole text is encoded: rates of hashed byte pairs and of kinds of characters, word lengths, repeats.
A layer embeds the passages, gated attention (Ilse, Tomczak, Welling 2018)

    a_k = softmax_k( w' (tanh(V h_k) * sigmoid(U h_k)) )

weighs them, and a logistic unit scores the weighted sum of the embeddings.

Learning takes a bounded sample of labelled documents, each with every passage of its text: at most
``max_rows``, in the order of a hash of their id, of which those are taken that keep the sample within ``max_passages``
passages. These go to the driver encoded, so what it holds is bounded however long the texts are, and a few thousand weights
are fitted there (Adam, fixed seed). Scoring reads all passages of all texts where they lie: no shuffle. Labels, language,
source and id take no part in a score.

Defined results: null and empty texts are a bag with one empty passage and get a score; labels
that are null or of unknown documents are not learned from; repeated labels of a document count once
(the smallest); an id with several rows is learned from once, by the row of fewest passages; with nothing to learn from every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import (
    BASE, BYTE_CODES, U64, mix, pieces, prefix_sums, stretch_hashes, utf8, word_spans,
)
from wordloom.llm.tables import shared, without

PASSAGE = 64
PAIRS = 48
#: Bounds of the sample that is learned from: documents, and passages of all of them (240 bytes each).
MAX_ROWS, MAX_PASSAGES = 6000, 300_000
HIDDEN, GATE = 24, 12
KINDS = 7  # lower, upper, digit, symbol, mark, stop, beyond ASCII
FEATURES = PAIRS + KINDS + 5


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS, np.int64)  # white space and the rest
    for k, of in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>@_=+^~\\/", b"!?", b".,;:'\"()-", range(128, 256))):
        kind[list(of)] = k
    return kind


_KIND = _kinds()
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the passages before each text; a text has one at least."""
    starts, ends, firsts = word_spans(~_WHITE[data], offsets)
    n_words = np.diff(firsts)
    bags = np.maximum(1, -(-n_words // PASSAGE))
    before = np.concatenate([[0], np.cumsum(bags)])
    total = int(before[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, before
    text = np.repeat(np.arange(len(n_words)), n_words)
    passage = before[text] + (np.arange(len(starts)) - firsts[text]) // PASSAGE
    lengths = ends - starts
    words = np.bincount(passage, minlength=total)
    letters = np.bincount(passage, lengths, minlength=total)
    size = np.maximum(letters, 1)
    # Passage of every byte of a word.
    of = np.repeat(passage, lengths)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(of))
    kind = np.bincount(of * (KINDS + 1) + _KIND[data[at]], minlength=total * (KINDS + 1))
    out[:, PAIRS : PAIRS + KINDS] = kind.reshape(total, -1)[:, :KINDS] / size[:, None]
    after = data[np.minimum(at + 1, len(data) - 1)]
    pair = mix((data[at].astype(U64) << U64(8) | after) * U64(BASE)) % U64(PAIRS)
    pairs = np.bincount(of * PAIRS + pair.astype(np.int64), minlength=total * PAIRS)
    out[:, :PAIRS] = pairs.reshape(total, -1) / size[:, None]
    hashes = stretch_hashes(prefix_sums(BYTE_CODES[data]), starts, ends)
    same = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    repeated = np.bincount(passage[1:][same], minlength=total)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (passage[order][1:] != passage[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=total)
    many = np.maximum(words, 1)
    firsts_of = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    longest = np.zeros(total)
    longest[passage[firsts_of]] = np.maximum.reduceat(lengths, firsts_of)
    extra = [letters / many / 10, repeated / many, distinct / many, words / PASSAGE, np.minimum(longest, 40) / 40]
    for k, x in enumerate(extra):
        out[:, PAIRS + KINDS + k] = x
    return out, before


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        """All intermediate values for bags of standardised passages."""
        w = self.weights
        x = ((features - self.mean) / self.spread).clip(-6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (t * s) @ w["w"]
        sizes = np.diff(before)
        a = np.exp(raw - np.repeat(np.maximum.reduceat(raw, before[:-1]), sizes))
        a /= np.repeat(np.add.reduceat(a, before[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, before[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ w["c"] + w["b"]}

    def gradients(self, run: dict[str, np.ndarray], before: np.ndarray, slope: np.ndarray) -> dict:
        """Of the mean loss; ``slope`` is its derivative by each logit."""
        w, h, a, t, s = self.weights, run["h"], run["a"], run["t"], run["s"]
        sizes = np.diff(before)
        dz = np.repeat(slope[:, None] * w["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        draw = a * (da - np.repeat(np.add.reduceat(a * da, before[:-1]), sizes))
        dgate = draw[:, None] * w["w"]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T
        dx = dh * (1 - h * h)
        return {
            "E": run["x"].T @ dx, "e": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
            "w": (t * s).T @ draw, "c": run["z"].T @ slope, "b": np.array(slope.sum()),
        }


def fit(
    features: np.ndarray, before: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128,
    rate: float = 0.005, decay: float = 1e-4, seed: int = 7,
) -> AttentionModel:
    """Weights by Adam on the log loss of the bags."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
        "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(()),
    }
    if not len(labels):
        zero = {k: np.zeros_like(v) for k, v in weights.items()}
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), zero)
    model = AttentionModel(features.mean(axis=0), features.std(axis=0) + 0.01, weights)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = before[own + 1] - before[own]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(before[own] - bounds[:-1], sizes) + np.arange(bounds[-1])
            run = model.forward(features[rows], bounds)
            grads = model.gradients(run, bounds, (_sigmoid(run["logit"]) - labels[own]) / len(own))
            step += 1
            for k, g in grads.items():
                g = g + decay * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                up = first[k] / (1 - 0.9**step)
                weights[k] -= rate * up / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def spread_over(start: int, end: int, most: int) -> np.ndarray:
    """At most ``most`` numbers from ``start`` up to ``end``, evenly spread."""
    n = min(end - start, most)
    return start + np.arange(n) * (end - start) // n


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES,
) -> AttentionModel:
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    marks = marks.groupBy(F.col(doc_id).alias("id__")).agg(F.min(label).cast("double").alias("label__"))
    some = marks.orderBy(F.xxhash64("id__"), "id__").limit(max_rows)  # so many numbers at most
    own = docs.select(F.col(doc_id).alias("id__"), F.col(text).alias("text__")).join(F.broadcast(some), "id__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(utf8(batch.column(1))):
                features, before = encode(data, offsets)
                bags = [features[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                some = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array(np.diff(before)), pa.array(bags, pa.binary())],
                    names=["id__", "label", "n", "bag"])

    schema = T.StructType([own.schema["id__"]]).add("label", "double").add("n", "long").add("bag", "binary")
    encoded = own.select("id__", "text__", "label__").mapInArrow(run, schema)
    bag = F.min(F.struct("n", "bag", "label")).alias("x")
    stored = shared(encoded.groupBy("id__").agg(bag).select("id__", "x.*"), "bags")
    order = F.xxhash64("id__")
    sizes = stored.select(order.alias("at"), "n").orderBy("at", "id__").collect()  # max_rows numbers at most
    left, taken = max_passages, []
    for row in sizes:
        if row["n"] <= left:
            left -= row["n"]
            taken.append(row["at"])
    sample = stored if len(taken) == len(sizes) else stored.where(order.isin(taken))
    found = sample.orderBy("id__").select("bag", "label").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["bag"].to_pylist()]
    before = np.concatenate([[0], np.cumsum([len(b) for b in bags], dtype=np.int64)]).astype(np.int64)
    features = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(features, before, found["label"].to_numpy())


def score(docs: DataFrame, model: AttentionModel, text: str = "text", into: str = "score") -> DataFrame:
    """All columns and the probability of label 1; a column named ``into`` is replaced."""
    own = without(docs, into)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores = np.zeros(len(batch))
            for rows, data, offsets in pieces(utf8(batch.column(batch.schema.get_field_index(text)))):
                features, before = encode(data, offsets)
                scores[rows] = _sigmoid(model.forward(features, before)["logit"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, into])

    return own.mapInArrow(run, T.StructType([*own.schema.fields]).add(into, "double"))
