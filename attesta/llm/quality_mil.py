"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of a fixed number of words. Every passage is encoded as features, then
as a hidden vector; gated attention weighs the hidden vectors, and the weighted sum gives the score.
Only whole texts carry labels; which passages matter is learned from them.

Training reads a bounded sample of labelled rows (``max_rows``, picked by a hash of the id among those
that may be learned from). The sample of ids is broadcast (its size is that bound), their texts are
encoded where they lie and written to the shared folder, and as many of these rows as ``max_bytes``
holds, 16 bits a number, train the model in numpy with fixed seeds. Scoring is one pass over the texts, without a shuffle, in blocks of bounded size.

Defined results: a null or empty text is one passage of zeros and gets that score; a null ``doc_id`` is
scored but never learned from and is not held out; repeated rows give a row each; labels that are
null are ignored, repeated labels of an id count each; without labels of both kinds every score is the
share of good labels (0.5 without any), so it is the same for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut
from attesta.llm.passages import SHAPES, blocks, passage_features

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """``max_rows`` and ``max_bytes`` (of encoded passages) bound what training uses; the rest shapes the model."""

    max_rows: int = 6000
    max_bytes: int = 256_000_000
    passage_words: int = 64
    buckets: int = 256
    hidden: int = 32
    gate: int = 16
    epochs: int = 12
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 13


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over encoded passages; ``fixed`` is the score when nothing could be learned."""

    def __init__(self, settings: Settings, fixed: float | None = None):
        self.settings, self.fixed = settings, fixed
        rng = np.random.default_rng(settings.seed)
        size, hidden, gate = SHAPES + settings.buckets, settings.hidden, settings.gate
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean = np.zeros(size, np.float32)
        self.scale = np.ones(size, np.float32)
        self.weights = {
            "encode": draw(size, hidden), "encode_bias": np.zeros(hidden, np.float32),
            "value": draw(hidden, gate), "gate": draw(hidden, gate),
            "attend": draw(gate, 1)[:, 0], "out": draw(hidden, 1)[:, 0], "bias": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(counts) - counts
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, g = np.tanh(h @ w["value"]), sigmoid(h @ w["gate"])
        e = (v * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "v": v, "g": g, "a": a, "z": z, "score": sigmoid(z @ w["out"] + w["bias"][0]), "starts": starts}

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, counts)
        error = ((f["score"] - labels) / len(labels)).astype(np.float32)
        dz = np.repeat(error[:, None] * w["out"][None, :], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), counts))
        dvg = de[:, None] * w["attend"][None, :]
        dv, dg = dvg * f["g"] * (1 - f["v"] ** 2), dvg * f["v"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dv @ w["value"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ dh, "encode_bias": dh.sum(axis=0), "value": f["h"].T @ dv, "gate": f["h"].T @ dg,
            "attend": (f["v"] * f["g"]).T @ de, "out": f["z"].T @ error, "bias": error.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        s = self.settings
        stacked = np.concatenate(bags).astype(np.float32)
        self.mean = stacked.mean(axis=0)
        self.scale = 1 / (stacked.std(axis=0) + 1e-3)
        del stacked
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        rng, step = np.random.default_rng(s.seed), 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(bags))
            for start in range(0, len(order), s.batch):
                chosen = order[start : start + s.batch]
                x = np.concatenate([bags[i] for i in chosen]).astype(np.float32)
                counts = np.array([len(bags[i]) for i in chosen])
                step += 1
                rate = s.rate * (1 - epoch / s.epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, grad in self.gradients(x, counts, labels[chosen]).items():
                    grad = grad + s.decay * self.weights[name]
                    first, second = moments[name]
                    first += 0.1 * (grad - first)
                    second += 0.001 * (grad * grad - second)
                    self.weights[name] -= rate * first / (np.sqrt(second) + 1e-8)

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.fixed is not None:
            return [self.fixed] * len(texts)
        out: list[float] = []
        for block in blocks(texts):
            x, counts = passage_features(block, self.settings.passage_words, self.settings.buckets)
            out += self.forward(x, counts)["score"].astype(float).tolist()
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(
        ~held_out(F.col("doc_id"))
    ).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    total = usable.count()
    share = min(1.0, settings.max_rows / max(total, 1))
    chosen = usable.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")
    words, buckets = settings.passage_words, settings.buckets

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block in blocks(batch.column(2).to_pylist()):
                x, counts = passage_features(block, words, buckets)
                made += [p.astype(np.float16).tobytes() for p in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "_label", "bag"]
            )

    schema = rows.select("doc_id", "_label", F.lit(b"").alias("bag")).schema
    encoded = cut(rows.mapInArrow(encode, schema))
    size = encoded.agg(F.sum(F.octet_length("bag")).alias("n")).first()["n"] or 0
    fits = min(1.0, settings.max_bytes / max(size, 1))  # very long texts: fewer rows, each of them whole
    taken = encoded.filter(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1_000_000)) < int(fits * 1_000_000))
    found = sorted(taken.collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float16).reshape(-1, SHAPES + buckets) for r in found]
    return bags, np.array([r["_label"] for r in found], dtype=np.float32)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    bags, marks = training_bags(docs, labels, settings)
    if len(set(marks.tolist())) < 2:
        return Model(settings, fixed=float(marks.mean()) if len(marks) else 0.5)
    model = Model(settings)
    model.fit(bags, marks)
    return model


def score_column(frame: DataFrame, model: Model, text_col: str, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` and the score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores(batch.column(text_col).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], scores], names=[*keep, name])

    schema = frame.select(*keep, F.lit(0.0).alias(name)).schema
    names = keep if text_col in keep else [*keep, text_col]
    return frame.select(*names).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    scored = score_column(docs, train(docs, labels, settings), "text", ["doc_id"], "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # own names, whatever the input's are
    text = plain.columns[columns.index("text")]
    scored = score_column(plain, train(docs, labels, settings), text, plain.columns, "score")
    return scored.filter(F.col("score") >= THRESHOLD).select(*plain.columns).toDF(*columns)
