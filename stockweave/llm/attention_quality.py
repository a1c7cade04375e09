"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
its words; a gated attention, learned from document labels alone, weighs the
passages; the weighted sum of the encodings is scored by a logistic unit. A
model is a few arrays, fitted on every passage of at most ``max_documents`` labelled texts with at most ``max_passages``
passages together, which is the only bounded part; scoring covers every passage of every text.

Inputs are the words of the text only: no label, language, source or id.

Cases: null text counts as empty; an empty text is one passage without words and
gets a score like any other; texts of any length are scored whole; several
labels of one doc_id are averaged; null labels teach nothing; without any label
all scores are 0.5; rows that repeat stay; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.batches import slices
from stockweave.llm.common import n_words, text_key

PASSAGE = 64
HASHED = 16
HIDDEN = 24
ATTENTION = 12
EPOCHS = 120
MAX_DOCUMENTS = 4000
MAX_PASSAGES = 1 << 16
PREDICT = 0.3
SLICE_CHARS = 2_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes whose share of a passage is a feature.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]()@^~_=+/\\", b".,;:?'\"-", b"!", b"|")
FEATURES = 10 + len(CLASSES) + HASHED


def _tables() -> np.ndarray:
    out = np.zeros((len(CLASSES), 256), np.int64)
    for row, chars in zip(out, CLASSES):
        row[list(chars)] = 1
    return out


TABLES = _tables()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages per text); a text without words is one passage that is only marked as such."""
    from xxhash import xxh3_64_intdigest

    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    per_text = np.maximum(1, -(-counts // PASSAGE))
    total = int(per_text.sum())
    out = np.zeros((total, FEATURES))
    n_words = int(counts.sum())
    if not n_words:
        out[:, 9] = 1
        return out, per_text
    words = [w for ws in split for w in ws]
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n_words)
    data = np.frombuffer(b"".join(words), np.uint8)
    del split, words
    starts = np.cumsum(lengths) - lengths
    place = np.arange(n_words) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = np.repeat(np.cumsum(per_text) - per_text, counts) + place // PASSAGE
    size = np.bincount(passage, minlength=total)
    some = np.maximum(size, 1)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(passage, x, minlength=total)

    def distinct(key: np.ndarray, where: np.ndarray) -> np.ndarray:
        mixed = (key ^ (where.astype(np.uint64) * GOLD)) * GOLD
        _, index = np.unique(mixed, return_index=True)
        return np.bincount(where[index], minlength=total)

    chars = np.maximum(summed(lengths), 1)
    mean = summed(lengths) / some
    last = data[starts + lengths - 1]
    same = np.zeros(n_words, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    pair = np.flatnonzero(passage[1:] == passage[:-1])
    n_pairs = np.bincount(passage[pair], minlength=total)
    out[:, 0] = mean / 10
    out[:, 1] = np.sqrt(np.maximum(summed(lengths.astype(float) ** 2) / some - mean**2, 0)) / 10
    out[:, 2] = np.log1p(size) / 4
    out[:, 3] = summed(same) / some
    out[:, 4] = distinct(hashes, passage) / some
    out[:, 5] = distinct(hashes[pair] * GOLD + hashes[pair + 1], passage[pair]) / np.maximum(n_pairs, 1)
    out[:, 6] = summed((last == 46) | (last == 33) | (last == 63)) / some
    out[:, 7] = summed(lengths <= 2) / some
    out[:, 8] = summed(lengths >= 16) / some
    out[:, 9] = size == 0
    for i, table in enumerate(TABLES):
        out[:, 10 + i] = summed(np.add.reduceat(table[data], starts)) / chars
    bucket = (hashes >> np.uint64(8)).astype(np.int64) % HASHED
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(passage * HASHED + bucket, sign, minlength=total * HASHED)
    out[:, -HASHED:] = hashed.reshape(total, HASHED) / some[:, None]
    return out, per_text


@dataclass
class Model:
    """Scaling of the features and the weights of encoder, gate and score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, per_text: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["w"]
        starts = np.cumsum(per_text) - per_text
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), per_text))
        a = e / np.repeat(np.add.reduceat(e, starts), per_text)
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -40, 40)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score, "starts": starts}

    def score(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return self.forward(x, per_text)["score"]


def train(x: np.ndarray, per_text: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the log loss of whole documents, with a small weight decay."""
    rng = np.random.default_rng(seed)

    def drawn(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    weights = {
        "W": drawn(x.shape[1], HIDDEN),
        "b": np.zeros(HIDDEN),
        "V": drawn(HIDDEN, ATTENTION),
        "U": drawn(HIDDEN, ATTENTION),
        "w": drawn(ATTENTION),
        "c": drawn(HIDDEN),
        "d": np.zeros(1),
    }
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, epochs + 1):
        f = model.forward(x, per_text)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        error = (f["score"] - label) / len(label)
        dz = error[:, None] * weights["c"]
        dz_rows = np.repeat(dz, per_text, axis=0)
        da = (dz_rows * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), per_text))
        dt, dg = de[:, None] * weights["w"] * g * (1 - t**2), de[:, None] * weights["w"] * t * g * (1 - g)
        dh = a[:, None] * dz_rows + dt @ weights["V"].T + dg @ weights["U"].T
        dx = dh * (1 - h**2)
        grads = {
            "W": f["x"].T @ dx,
            "b": dx.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "w": (t * g).T @ de,
            "c": f["z"].T @ error,
            "d": np.array([error.sum()]),
        }
        for k, grad in grads.items():
            grad = grad + 1e-5 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            weights[k] = weights[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return model


def constant_model(score: float) -> Model:
    """Gives every text the same score."""
    zeros = {
        "W": np.zeros((FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, ATTENTION)),
        "U": np.zeros((HIDDEN, ATTENTION)), "w": np.zeros(ATTENTION), "c": np.zeros(HIDDEN),
    }
    score = min(max(score, 1e-6), 1 - 1e-6)
    return Model(np.zeros(FEATURES), np.ones(FEATURES), zeros | {"d": np.array([np.log(score / (1 - score))])})


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such documents are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES) -> Model:
    """Learns from all passages of at most ``max_documents`` texts of labelled documents that are not held out, chosen by a
    hash of their ids; the texts end where theirs exceed ``max_passages`` passages, and a text beyond that alone is none."""
    usable = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
    )
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                x, per_text = passages([(t or "").encode() for t in part.column("text").to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_text) * FEATURES]).astype(np.int32))
                made = pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), made], names=["doc_id", "label", "features"]
                )

    # The sample has at most max_documents rows of two numbers, so it is small at any size of the corpus.
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows that repeat an id count once for each text, and an id's further texts come after the first ones of all ids.
    size = F.greatest(F.lit(1).cast("long"), F.ceil(n_words(F.col("text")) / PASSAGE))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = labelled.select("doc_id", "label", text_key(F.col("text")).alias("text_key"), size.alias("size")).distinct()
    first = texts.groupBy("doc_id").agg(F.min("text_key").alias("first"))
    place = [F.col("text_key") != F.col("first"), F.xxhash64("doc_id", "text_key"), "doc_id", "text_key"]
    ordered = texts.where(F.col("size") <= max_passages).join(first, "doc_id").orderBy(*place).limit(max_documents)
    # One window over at most max_documents rows of numbers.
    so_far = F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    chosen = ordered.withColumn("so_far", so_far).where(F.col("so_far") <= max_passages).select("doc_id", "text_key", "label")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    text = keyed.join(F.broadcast(chosen), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    text = text.select("doc_id", "label", "text")
    rows = text.mapInArrow(encoded, f"doc_id {kind}, label double, features array<float>").collect()
    if not rows:
        return constant_model(0.5)
    rows.sort(key=lambda r: (r.doc_id, r.label, r.features))
    sizes = np.array([len(r.features) // FEATURES for r in rows])
    label = np.array([r.label for r in rows])
    if label.min() == label.max():
        return constant_model(float(label[0]) * 0.9 + 0.05)
    x = np.concatenate([np.asarray(r.features, np.float64) for r in rows]).reshape(-1, FEATURES)
    return train(x, sizes, label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                x, per_text = passages([(t or "").encode() for t in part.column("text").to_pylist()])
                found = model.score(x, per_text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, predict: float = PREDICT, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model fitted on its labelled part."""
    scored = score(docs, fit(docs, labels, **bounds))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= predict).cast("int").alias("predicted"),
    )
