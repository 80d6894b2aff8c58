"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash and MinHash, every link verified.

1. A task reduces a text to the set of its five-word shingles (64-bit hashes). Equal sets become one node, whose
   name is a 128-bit hash of the set, so exact copies never meet as pairs. A node has its number of shingles, a
   sketch (for each of 256 classes of hashes whether their number is odd) and 100 minima in 20 bands of five.
2. The SimHash operator (``simhash.near_duplicates``, on five-word shingles) groups the texts by its pigeonhole
   search; every node of a group is a candidate with the group's smallest. Similar texts may differ in more bits
   than any pigeonhole search reaches, so step 3 provides the rest.
3. Nodes with an equal band are candidates. Two texts of similarity s share a band with probability
   1 - (1 - s^5)^20: 99.96 % at 0.8 and more above. Only a pair that both steps miss is lost.
4. Two tests drop candidates without reading their sets, and never a pair that is similar enough: the smaller set
   must have 80 % of the larger one's shingles, and sketches that differ in more bits than similar sets can differ
   in shingles rule a pair out.
5. First every node of a bucket is compared with one centre of it, so a crowd of near copies is linked in as many
   comparisons as it has rows. Then only nodes of different groups are still compared, and those of the smaller
   group ask.
6. Each comparison counts the common shingles of both sets. Components of the links make the groups.

Sets are made again from the text for nodes that share a bucket or a SimHash group, and for no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, UPPER, cut
from attesta.llm.components import components

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORDS = 5
#: Least similarity, in hundredths.
PERCENT = 80
BANDS, DEPTH = 20, 5
SEEDS = np.random.default_rng(42)
FACTORS = SEEDS.integers(0, 2**64, (BANDS * DEPTH, 1), dtype=np.uint64) | np.uint64(1)
SHIFTS = SEEDS.integers(0, 2**64, (BANDS * DEPTH, 1), dtype=np.uint64)
SKETCH = ["s0", "s1", "s2", "s3"]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all different shingles, sorted; a text of fewer words is one shingle."""
    parts = text.encode("utf-8").translate(TO_LOWER).split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda end, size: end + 1 + size))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_digest
    size = min(words, len(parts))
    return np.unique(np.frombuffer(
        b"".join([digest(joined[s:e]) for s, e in zip(starts, ends[size - 1 :])]), dtype="<u8"
    ))


def name_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def sketch_of(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def bands_of(own: np.ndarray) -> list[int]:
    """A hash of the minima of every band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(own), 512):
        np.minimum(least, (own[start : start + 512] * FACTORS + SHIFTS).min(axis=1), out=least)
    data = least.tobytes()
    width = 8 * DEPTH
    return [
        int.from_bytes(xxhash.xxh64_digest(data[i : i + width]), "little", signed=True)
        for i in range(0, len(data), width)
    ]


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, size, sketch, bands), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                sketches = np.array([sketch_of(s) for s in sets], dtype=np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([name_of(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(sketches[:, i].copy()) for i in range(4)],
                        pa.array([bands_of(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "version", "node", "size", *SKETCH, "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = ", ".join(f"{c} long" for c in SKETCH)
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(
        run, f"doc_id {kind}, version long, node binary, size long, {sketch}, bands array<long>"
    )


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, own): the shingles of the given (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"]
                )

    return texts.select("node", "text").mapInArrow(run, "node binary, own array<long>")


def may_be_similar(other: str) -> Column:
    """Bounds that every similar pair keeps, from sizes and sketches only."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}{c}"))) for c in SKETCH), F.lit(0))
    sizes = (F.col("size"), F.col(f"{other}size"))
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * PERCENT) & (
        apart * (100 + PERCENT) <= (sizes[0] + sizes[1]) * (100 - PERCENT)
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of_a, of_b = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    common = F.size(F.array_intersect("own_a", "own_b"))
    whole = F.size("own_a") + F.size("own_b") - common
    return pairs.distinct().join(of_a, "a").join(of_b, "b").filter(common * 100 >= whole * PERCENT).select("a", "b")


def centre_pairs(entries: DataFrame) -> DataFrame:
    """Every node of a bucket with the bucket's smallest node."""
    names = ["node", "size", *SKETCH]
    centres = entries.groupBy("band", "value").agg(F.min(F.struct(*names)).alias("c")).select(
        "band", "value", *[F.col(f"c.{n}").alias(f"c_{n}") for n in names]
    )
    return entries.join(centres, ["band", "value"]).filter(
        (F.col("node") != F.col("c_node")) & may_be_similar("c_")
    ).select(F.col("node").alias("a"), F.col("c_node").alias("b"))


def simhash_pairs(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node of a SimHash group with the group's smallest node. Texts go by their ``version``."""
    from attesta.llm.simhash import near_duplicates

    names = ["node", "size", *SKETCH]
    found = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text").distinct(), WORDS)
    groups = found.select(F.col("doc_id").alias("version"), F.col("component_id").alias("group"))
    named = rows.select("node", "version").join(groups, "version").select("node", "group").distinct()
    entries = cut(named.join(nodes.select(*names), "node"))
    centres = entries.groupBy("group").agg(F.min(F.struct(*names)).alias("c")).select(
        "group", *[F.col(f"c.{n}").alias(f"c_{n}") for n in names]
    )
    return entries.join(centres, "group").filter(
        (F.col("node") != F.col("c_node")) & may_be_similar("c_")
    ).select(F.col("node").alias("a"), F.col("c_node").alias("b"))


def cross_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a bucket whose nodes have different roots; those of the smaller group ask."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    rooted = cut(
        entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes, "root", "left")
        .withColumn("members", F.coalesce("members", F.lit(1)))
    )
    rank = F.struct("members", "root")
    held = rooted.groupBy("band", "value").agg(F.max(rank).alias("largest"), F.min(rank).alias("least")).filter(
        "largest <> least"
    )
    asked = cut(rooted.join(held, ["band", "value"]).filter(rank < F.col("largest")).select(
        "band", "value", *[F.col(c).alias(f"q_{c}") for c in ("node", "size", *SKETCH, "root", "members")]
    ))
    return asked.join(rooted, ["band", "value"]).filter(
        (F.struct("q_members", "q_root") < rank) & may_be_similar("q_")
    ).select(F.col("q_node").alias("a"), F.col("node").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, version, first): every text of a ``doc_id`` with the first (doc_id, version) of its group."""
    rows = cut(marks(docs))
    nodes = cut(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "version")).alias("holder"), F.first("size").alias("size"),
        *[F.first(c).alias(c) for c in SKETCH], F.first("bands").alias("bands"),
    ))
    listed = nodes.select("node", "size", *SKETCH, F.posexplode("bands").alias("band", "value"))
    shared = listed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = cut(listed.join(shared.select("band", "value"), ["band", "value"], "left_semi"))
    alike = cut(simhash_pairs(docs, rows, nodes))
    paired = alike.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = nodes.join(entries.select("node").unionByName(paired).distinct(), "node", "left_semi").select(
        "node", F.col("holder.doc_id").alias("_id"), F.col("holder.version").alias("_version")
    )
    texts = docs.select("doc_id", "text").join(
        wanted, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    )
    sets = cut(sets_of(texts))
    links = cut(verified(alike.unionByName(centre_pairs(entries)), sets))
    roots = components(links)
    further = verified(cross_pairs(entries, roots), sets)
    groups = components(links.unionByName(further))
    named = nodes.join(groups, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "holder"
    )
    firsts = named.groupBy("root").agg(F.min("holder").alias("first"))
    return rows.select("doc_id", "version", "node").join(
        cut(named.join(firsts, "root").select("node", "first")), "node"
    ).select("doc_id", "version", "first")
