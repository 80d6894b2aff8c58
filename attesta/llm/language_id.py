"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes one space, and all byte runs of three and four
are hashed into buckets. The mean of the buckets' embeddings goes through a linear softmax. Embeddings
and softmax are trained by stochastic gradient descent in numpy, with fixed seeds, on a bounded sample:
``max_rows`` rows a language, picked by a hash of the id among the rows that may be learned from. Their
texts are turned into bucket counts where they lie; one short run of each text is a second example, so
short texts are learned as well. A fifth of the sample calibrates: a temperature makes the score a
probability, and the rejection bound is the lowest score above which ``precision`` of those are right.

Prediction multiplies embeddings and softmax out to one number a bucket and language, and is one pass
over whole texts without a shuffle.

Defined results: a null text or one without a letter is ``und`` with the score 0 and is rejected; a
null ``doc_id`` is predicted but never learned from and is not held out; repeated rows give a row each;
with no labelled row every prediction is ``und``; with one language all texts get it with the score 1;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
TO_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the training rows of one language."""

    max_rows: int = 1000
    buckets: int = 1 << 15
    size: int = 16
    epochs: int = 6
    rate: float = 4.0
    fragment: int = 80
    precision: float = 0.99
    seed: int = 5


def letters(text: str | None) -> bytes | None:
    """Words of the text in lower case with one space around each, None if it has no letter."""
    if not text or not LETTER.search(text):
        return None
    return b" " + b" ".join(text.lower().encode("utf-8").translate(TO_LETTERS).split()) + b" "


def subwords(data: bytes, buckets: int) -> np.ndarray:
    """Bucket of every run of three and of four bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.pad(b, (0, 3 - len(b)), constant_values=32)
    three = b[:-2] * PRIMES[0] + b[1:-1] * PRIMES[1] + b[2:] * PRIMES[2]
    four = three[:-1] + (b[3:] + np.uint32(1)) * PRIMES[3]
    runs = np.concatenate([three, four])
    return ((runs ^ (runs >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(7)) % np.uint32(buckets)


def bag(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(subwords(data, buckets), return_counts=True)
    return found, (counts / counts.sum()).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, settings: Settings, languages: list[str]):
        self.settings, self.languages = settings, languages
        self.temperature, self.bound = 1.0, 0.0
        self.table: np.ndarray | None = None
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, group: np.ndarray) -> None:
        """Rows whose ``group`` (one per text) is a multiple of five calibrate, the others train."""
        s, n = self.settings, len(self.languages)
        rng = np.random.default_rng(s.seed)
        embed = rng.uniform(-1 / s.size, 1 / s.size, (s.buckets, s.size)).astype(np.float32)
        weights = np.zeros((s.size, n), np.float32)
        aside = group % 5 == 0 if len(set(group.tolist())) >= 10 else np.zeros(len(group), bool)
        learn = np.flatnonzero(~aside)
        steps, done = max(1, s.epochs * len(learn)), 0
        for _ in range(s.epochs):
            for i in rng.permutation(learn):
                rate = s.rate * (1 - done / steps)
                done += 1
                found, share = bags[i]
                mean = share @ embed[found]
                error = softmax(mean @ weights + self.bias)
                error[marks[i]] -= 1
                back = weights @ error
                weights -= 0.1 * rate * np.outer(mean, error)
                self.bias -= 0.02 * rate * error
                embed[found] -= rate * share[:, None] * back[None, :]
        self.table = embed @ weights
        self.calibrate([bags[i] for i in np.flatnonzero(aside)], marks[aside])

    def calibrate(self, bags: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray) -> None:
        if not bags:
            return
        logits = np.stack([share @ self.table[found] for found, share in bags]) + self.bias
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(marks)), marks] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
        shares = softmax(logits / self.temperature)
        order = np.argsort(-shares.max(axis=1), kind="stable")
        right = np.cumsum(shares.argmax(axis=1)[order] == marks[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= self.settings.precision)
        self.bound = float(shares.max(axis=1)[order][good[-1]]) if len(good) else 1.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        data = letters(text)
        if data is None or not self.languages:
            return UNKNOWN, 0.0, True
        if self.table is None:
            return self.languages[0], 1.0, False
        total, runs = np.zeros(len(self.languages), dtype=np.float64), 0
        for start in range(0, len(data), 1 << 18):  # a block shares three bytes with the next one
            found = subwords(data[start : start + (1 << 18) + 3], self.settings.buckets)
            total += self.table[found].sum(axis=0, dtype=np.float64)
            runs += len(found)
        shares = softmax((total / runs + self.bias) / self.temperature)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best]), bool(shares[best] < self.bound)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    model = Model(settings, languages)
    if len(languages) < 2:
        return model
    limits = F.create_map(*[
        F.lit(x) for lang in languages for x in (lang, int(min(1.0, settings.max_rows / counts[lang]) * 1_000_000))
    ])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < limits[F.col("lang")])
    buckets, fragment = settings.buckets, settings.fragment

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, found, shares = [], [], [], []
            for doc_id, text, lang in zip(*[c.to_pylist() for c in batch.columns]):
                data = letters(text)
                if data is None:
                    continue
                at = (doc_id * 7919) % max(1, len(data) - fragment)
                for piece in {data, data[at : at + fragment]}:
                    which, share = bag(piece, buckets)
                    ids.append(doc_id)
                    names.append(lang)
                    found.append(which.astype(np.uint16).tobytes())
                    shares.append(share.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(shares, pa.binary())],
                names=["doc_id", "lang", "found", "shares"],
            )

    rows = chosen.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(
        encode, "doc_id long, lang string, found binary, shares binary"
    )
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["found"])))
    bags = [
        (np.frombuffer(bytes(r["found"]), np.uint16), np.frombuffer(bytes(r["shares"]), np.float16).astype(np.float32))
        for r in rows
    ]
    place = {lang: i for i, lang in enumerate(languages)}
    texts = {d: i for i, d in enumerate(dict.fromkeys(r["doc_id"] for r in rows))}
    model.fit(bags, np.array([place[r["lang"]] for r in rows]), np.array([texts[r["doc_id"]] for r in rows]))
    return model


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected); ``rejected`` marks predictions below the calibrated bound."""
    model = train(docs, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()))]],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    schema = docs.select(
        "doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    ).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    return identify(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
