"""SimHash near-duplicates with generalised pigeonhole search.

1. A task hashes all three-word shingles of a text and keeps the majority bits: 64 bits a document.
   Equal fingerprints are merged by partial aggregation, so copies never meet as pairs.
2. Dense neighbourhoods are linked through hubs: a fingerprint is written under itself and its 64
   one-bit variants. At most 65 fingerprints can meet under one variant, all of them within two
   bits of each other; chaining them links every pair at up to two bits without listing pairs.
3. Everything else is found by the generalised pigeonhole principle. The 64 bits are grouped into m
   parts, correlated bits together. For a bound of t bits, thresholds t_1..t_m of the parts with the
   sum t - m + 1 are enough: a pair within t bits is within t_i bits in some part i. Dynamic
   programming picks the thresholds for each probing fingerprint, from the candidate counts that
   histograms of the parts predict; -1 leaves a part out. A probe visits all values within t_i of
   its own; candidates are verified on the whole fingerprint.
   Only links between different groups of step 2 are still wanted, so the members of the smaller
   group probe, and a value that holds nothing but the probe's own group is not visited. A crowd
   of near copies thus costs its number of rows and not its square.
4. Components of the links give every document the smallest ``doc_id`` it reaches.

Nothing about single documents reaches the driver: only the 64 x 64 bit counts and 256-value
histograms do.

Defined results: a null, empty or blank text has the fingerprint zero and links like any other; a
row without ``doc_id`` links but gives no component its name (null if there is no other); repeated rows
give a row each; an empty table gives no rows.

The stage ``clean`` removes near copies by verified five-word shingles (``near_copies``). Its candidates come from
this search on five-word shingles first; three bits are far tighter than its similarity of 0.8, so MinHash bands
provide the rest. In it,
texts without words are copies of each other, rows without ``doc_id`` stay, and each group keeps one row;
rows that repeat a ``doc_id`` with different texts are judged by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, UPPER, cut
from attesta.llm.components import components
from attesta.llm.near_copies import near_copies

BITS = 64
SEED = 42
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bits of every byte value, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
BYTE_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit number."""
    parts = text.encode("utf-8").translate(TO_LOWER).split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda end, size: end + 1 + size))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_digest
    size = min(words, len(parts))
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    values = np.bincount((rows + BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
    counts = (values @ BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["doc_id", "fp"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def hub_links(marks: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within two bits of each other."""
    variants = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(BITS)])
    hubs = marks.select("fp", F.explode(variants).alias("hub"))
    last = F.lag("fp").over(Window.partitionBy("hub").orderBy("fp"))
    return hubs.select(F.col("fp").alias("a"), last.alias("b")).filter("b IS NOT NULL").distinct()


# Generalised pigeonhole -------------------------------------------------------------------------


def bits_of(marks: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, highest first."""
    return np.unpackbits(marks.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def summed(marks: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all rows of ``count(fingerprints)``, an array of fixed ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "n": pa.array(total, pa.int64())})

    rows = marks.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return out


def pair_counts(marks: np.ndarray) -> np.ndarray:
    bits = bits_of(marks).astype(np.float32)
    return np.rint(bits.T @ bits).astype(np.int64).ravel()


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size; each part takes the bits most correlated with it."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    corr = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left = list(range(BITS))
    groups = []
    for number in range(parts):
        size = -(-len(left) // (parts - number))
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


class Plan:
    """Parts of the bits, masks within a radius of a value, and predicted candidate counts."""

    def __init__(self, groups: list[list[int]], bound: int, total: int, slices: int = 8):
        self.groups, self.bound, self.total = groups, bound, total
        self.slices = [[g[i : i + slices] for i in range(0, len(g), slices)] for g in groups]
        self.histogram: list[np.ndarray] = []

    def values(self, bits: np.ndarray, places: list[int]) -> np.ndarray:
        return bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))

    def count(self, marks: np.ndarray) -> np.ndarray:
        bits = bits_of(marks)
        return np.concatenate([
            np.bincount(self.values(bits, s), minlength=256) for part in self.slices for s in part
        ])

    def learn(self, counts: np.ndarray) -> None:
        """Share of the fingerprints at distance 0, 1, .. of every value of a slice."""
        near = np.array([bin(v).count("1") for v in range(256)])
        distance = near[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        for row in counts.reshape(-1, 256):
            self.histogram.append(np.stack(
                [(distance == d) @ row / max(self.total, 1) for d in range(self.bound + 1)], axis=1
            ))

    def masks(self, part: int, radius: int) -> np.ndarray:
        width = len(self.groups[part])
        return np.array([
            sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)
        ], dtype=np.int64)

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """Threshold of every part for every row: least predicted work with the sum bound - parts + 1."""
        rows, parts, top = len(bits), len(self.groups), self.bound
        tables = iter(self.histogram)
        costs = []
        for part, slices in enumerate(self.slices):
            share = np.zeros((rows, top + 1))
            share[:, 0] = 1
            for s in slices:
                own = next(tables)[self.values(bits, s)]
                share = np.stack(
                    [sum(share[:, i] * own[:, d - i] for i in range(d + 1)) for d in range(top + 1)], axis=1
                )
            width = len(self.groups[part])
            visits = np.cumsum([comb(width, r) for r in range(top + 1)])
            work = np.cumsum(share, axis=1) * self.total + 2.0 * visits
            costs.append(np.concatenate([np.zeros((rows, 1)), work], axis=1))  # column t + 1
        # best[:, j]: least work of the parts so far whose thresholds plus one sum up to j
        goal = top + 1
        best = np.full((rows, goal + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for cost in costs:
            options = np.full((rows, goal + 1, goal + 1), np.inf)
            for j in range(goal + 1):
                for t in range(j + 1):
                    options[:, j, t] = best[:, j - t] + cost[:, t]
            chosen.append(options.argmin(axis=2))
            best = options.min(axis=2)
        out = np.zeros((rows, parts), dtype=np.int64)
        at = np.full(rows, goal)
        for part in range(parts - 1, -1, -1):
            out[:, part] = chosen[part][np.arange(rows), at]
            at -= out[:, part]
        return out - 1


def number_of_parts(total: int, bound: int) -> int:
    """Parts about as wide as the logarithm of the number of fingerprints, two at least."""
    return max(2, min(bound + 1, round(BITS / max(log2(max(total, 2)), 1))))


def plan_search(marks: DataFrame, bound: int) -> Plan:
    total = marks.count()
    parts = number_of_parts(total, bound)
    plan = Plan(group_bits(summed(marks, pair_counts, BITS * BITS).reshape(BITS, BITS), total, parts), bound, total)
    plan.learn(summed(marks, plan.count, 256 * sum(map(len, plan.slices))))
    return plan


ROWS = "part int, value long, fp long, root long, members long"


def _emit(part: int, values: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(values), part), pa.int32()), pa.array(values, pa.int64())]
    arrays += [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "value", "fp", "root", "members"])


def index_rows(marks: DataFrame, plan: Plan) -> DataFrame:
    """Every fingerprint under its value of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            bits = bits_of(columns[0])
            for part, places in enumerate(plan.groups):
                yield _emit(part, plan.values(bits, places), columns)

    return marks.select("fp", "root", "members").mapInArrow(run, ROWS)


def probe_rows(marks: DataFrame, plan: Plan, chunk: int = 1024) -> DataFrame:
    """Every fingerprint under all values within its threshold of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.slice(start, chunk).columns]
                bits = bits_of(columns[0])
                limits = plan.thresholds(bits)
                for part, places in enumerate(plan.groups):
                    own = plan.values(bits, places)
                    for radius in range(plan.bound + 1):
                        rows = np.flatnonzero(limits[:, part] == radius)
                        if not len(rows):
                            continue
                        if (part, radius) not in masks:
                            masks[part, radius] = plan.masks(part, radius)
                        near = masks[part, radius]
                        values = (own[rows][:, None] ^ near[None, :]).ravel()
                        yield _emit(part, values, [np.repeat(c[rows], len(near)) for c in columns])

    return marks.select("fp", "root", "members").mapInArrow(run, ROWS)


def cross_links(marks: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between roots of different groups with fingerprints within the bound."""
    index = cut(index_rows(marks, plan))
    held = index.groupBy("part", "value").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max("members").alias("largest")
    )
    # The largest group never probes: the other side of each of its links does.
    largest = marks.agg(F.max(F.struct("members", "root"))["root"].alias("r")).first()["r"]
    asking = marks.filter(F.col("root") != F.lit(largest)) if largest is not None else marks
    asked = probe_rows(asking, plan).join(held, ["part", "value"]).filter(
        ((F.col("low") != F.col("root")) | (F.col("high") != F.col("root")))
        & (F.col("largest") >= F.col("members"))
    ).select("part", "value", *[F.col(c).alias(f"q_{c}") for c in ("fp", "root", "members")])
    asked = cut(asked)
    pairs = asked.join(index, ["part", "value"]).filter(
        (F.struct("q_members", "q_root") < F.struct("members", "root"))
        & (F.bit_count(F.col("q_fp").bitwiseXOR(F.col("fp"))) <= plan.bound)
    )
    return pairs.select(F.col("q_root").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bound: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    rows = cut(fingerprints(docs, words))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    close = hub_links(firsts.select("fp")) if bound >= 2 else firsts.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    near = components(close).withColumnRenamed("node", "fp")
    rooted = cut(firsts.join(near, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    marks = cut(rooted.join(sizes, "root").select("fp", "root", "members"))
    merged = components(cross_links(marks, plan_search(marks, bound)))
    final = rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "fp", "first", F.coalesce("top", "root").alias("top")
    )
    named = final.groupBy("top").agg(F.min("first").alias("component_id"))
    names = cut(final.join(named, "top").select("fp", "component_id"))
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def clean(docs: DataFrame) -> DataFrame:
    """One document of every group of near copies, with all its columns."""
    found = near_copies(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"))
    stay = found.select(F.col("first.doc_id").alias("_id"), F.col("first.version").alias("_version")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    version = F.xxhash64("row.text")
    kept = rows.join(stay, (F.col("row.doc_id") == F.col("_id")) & (version == F.col("_version")), "left_semi")
    one = Window.partitionBy("row.doc_id", version).orderBy("row.text")
    numbered = kept.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")
    return numbered.unionByName(docs.filter("doc_id IS NULL"))
