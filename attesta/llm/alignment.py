"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of ids meet in a corpus.

The first tokenizer is a byte-level one that reads a space before the text, the second one works on pieces and adds
that space itself, so both cover the same bytes.

1. Every text is tokenised whole by both. Token ends are running sums of byte lengths. An anchor is an end that both
   share, after which both go on with a space-marked token. Anchors cut the document into windows.
2. A window's alignment only depends on its ids. It is computed once by walking both rows of tokens and kept in a
   table of bounded size under the ids of both tokenizers; long windows are walked each time.
   Where neither tokenizer can reach across a single space between two words, and the second one reads the text
   unchanged, the text is cut there first: both shares of ids and their alignment then only depend on the stretch, and
   are kept under its letters, so a known stretch is not tokenised again; new ones are tokenised together.
3. Corpus counts: ``block_documents`` documents or ``block_links`` different links (a document at least) make a block,
   which carries its different id pairs and their document counts once. Documents refer to their block's pairs by
   position. Counts are summed per pair; the highest count per first id is a table of one row per id of the first
   vocabulary. A block then gets the totals of its own pairs back and adds them up per document. A pair that all
   documents hold is one row per block in every shuffle.

Blocks are written to the shared folder before they are counted, so a repeated task cannot deal them differently.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens and
zeros throughout; a null ``doc_id`` is kept; every row is a document of its own, also with a repeated id; texts of any
length are aligned whole; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import byte_bpe
from attesta.llm.common import cut

#: A pair of ids as one number: the first id times this, plus the second.
WIDTH = 1 << 32

#: Windows and stretches of more tokens than this are not kept.
LONGEST = 64

#: A single space between two characters that are no white space.
BORDER = re.compile(r" (?=\S)(?<=\S )")


def piece_bytes(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The piece tokenizer and the bytes of every id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.append(bytes([int(piece[3:5], 16)]))
        else:
            found.append(b"" if model.is_control(i) else piece.replace("▁", " ").encode())
    return model, found


class Vocabulary:
    """Byte lengths and bytes of a tokenizer's ids."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens])
        self.size_list = self.sizes.tolist()
        self.marked = np.array([t.startswith(b" ") for t in tokens])
        self.names = [str(i) for i in range(len(tokens))]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def gives_back(self, ids: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the bytes of ``ids``, which end at ``ends``, are those of ``whole``."""
        if not len(ids) or ends[-1] != len(whole):
            return False
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return bool((self.flat[np.arange(len(whole)) + shift] == whole).all())


def walk(a: list[int], b: list[int], first: Vocabulary, second: Vocabulary) -> tuple[str, list[int]]:
    """(groups, pairs) of two rows of ids that cover the same bytes.

    Groups read ``a1,a2|b1``, joined by semicolons; pairs are all whose byte ranges overlap, in order.
    """
    a_names, b_names = [*map(first.names.__getitem__, a)], [*map(second.names.__getitem__, b)]
    if len(a) == 1 or len(b) == 1:
        return ",".join(a_names) + "|" + ",".join(b_names), [x * WIDTH + y for x in a for y in b]
    a_size, b_size = first.size_list, second.size_list
    groups, pairs = "", []
    i = j = 0
    group_a, group_b = a_names[0], b_names[0]
    x, y = a[0], b[0]
    ahead = a_size[x] - b_size[y]
    while True:
        pairs.append(x * WIDTH + y)
        if ahead < 0:
            i += 1
            x = a[i]
            group_a += "," + a_names[i]
            ahead += a_size[x]
        elif ahead:
            j += 1
            y = b[j]
            group_b += "," + b_names[j]
            ahead -= b_size[y]
        else:
            groups += group_a + "|" + group_b
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, pairs
            groups += ";"
            x, y = a[i], b[j]
            group_a, group_b = a_names[i], b_names[j]
            ahead = a_size[x] - b_size[y]


def parts_at_spaces(byte_model: str, model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no token of either tokenizer reaches across a ``BORDER``.

    The pattern of plain byte-level files starts a token at such a space; a merge of pieces would need a piece with a
    space mark behind another letter.
    """
    with open(byte_model, encoding="utf-8") as file:
        plain = byte_bpe.plain_kind(json.load(file))
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return plain and not any(a != "▁" and b == "▁" for text in texts for a, b in zip(text, text[1:]))


#: The ids of a window of both tokenizers, each row as the bytes of its ids.
Window = tuple[bytes, bytes]


class Aligner:
    """Alignments of texts. Windows are kept in two tables of up to ``kept``: when the newer one is full it becomes the
    older one, and what is asked for again moves back. Stretches are kept in two further tables in the same way."""

    def __init__(self, byte_model: str, piece_model: str, kept: int = 400_000):
        self.encode_first = byte_bpe.encoder(byte_model, special=False)
        self.model, pieces = piece_bytes(piece_model)
        self.first, self.second = Vocabulary(byte_bpe.token_bytes(byte_model)), Vocabulary(pieces)
        self.kept = kept
        self.newer: dict[Window, tuple[str, bytes]] = {}
        self.older: dict[Window, tuple[str, bytes]] = {}
        self.parts = parts_at_spaces(byte_model, self.model)
        self.near: dict[str, tuple[int, int, str, bytes]] = {}
        self.far: dict[str, tuple[int, int, str, bytes]] = {}

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers and their ends, or None if one of them does not give the bytes back."""
        if not text:
            return None
        a = self.encode_first(" " + text)
        b = np.array(self.model.encode(text), dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.first.sizes[a]), np.cumsum(self.second.sizes[b])
        whole = np.frombuffer((" " + text).encode(), dtype=np.uint8)
        if self.first.gives_back(a, a_ends, whole) and self.second.gives_back(b, b_ends, whole):
            return a, b, a_ends, b_ends
        return None

    def window(self, key: Window, a: list[int], b: list[int]) -> tuple[str, bytes]:
        """Groups and pairs (as bytes) of a window that is not in the newer table."""
        made = self.older.get(key)
        if made is None:
            groups, pairs = walk(a, b, self.first, self.second)
            made = groups, array("q", pairs).tobytes()
        if len(a) + len(b) <= LONGEST:
            if len(self.newer) >= self.kept:
                self.older, self.newer = self.newer, {}
            self.newer[key] = made
        return made

    def align(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[str, np.ndarray]:
        """(groups, pairs) of a whole text; a pair occurs once per link."""
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_next, b_next = np.searchsorted(a_ends, shared) + 1, np.searchsorted(b_ends, shared) + 1
        inner = shared < a_ends[-1]
        anchor = ~inner
        anchor[inner] = self.first.marked[a[a_next[inner]]] & self.second.marked[b[b_next[inner]]]
        a_list, b_list = a.tolist(), b.tolist()
        a_ids, b_ids = array("I", a_list).tobytes(), array("I", b_list).tobytes()
        size = array("I").itemsize
        made = []
        known = self.newer.get
        i = j = 0
        for next_i, next_j in zip(a_next[anchor].tolist(), b_next[anchor].tolist()):
            key = a_ids[size * i : size * next_i], b_ids[size * j : size * next_j]
            found = known(key)
            if found is None:
                found = self.window(key, a_list[i:next_i], b_list[j:next_j])
                known = self.newer.get
            made.append(found)
            i, j = next_i, next_j
        groups, pairs = zip(*made)
        return ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)


    def stretches(self, texts: list[str]) -> dict[str, tuple[int, int, str, bytes]] | None:
        """Numbers of tokens, groups and pairs (as bytes) of different stretches, tokenised in one go, or None if a
        tokenizer does not give them back."""
        tokens = self.tokens(" ".join(texts))
        if tokens is None:
            return None
        a, b, a_ends, b_ends = tokens
        ends = np.cumsum([len(text.encode()) + 1 for text in texts])
        a_list, b_list = a.tolist(), b.tolist()
        a_next, b_next = (np.searchsorted(a_ends, ends) + 1).tolist(), (np.searchsorted(b_ends, ends) + 1).tolist()
        made = {}
        i = j = 0
        for text, next_i, next_j in zip(texts, a_next, b_next):
            groups, pairs = walk(a_list[i:next_i], b_list[j:next_j], self.first, self.second)
            made[text] = next_i - i, next_j - j, groups, array("q", pairs).tobytes()
            i, j = next_i, next_j
        return made

    def learned(self, texts: list[str]) -> dict[str, tuple[int, int, str, bytes]] | None:
        """As ``stretches``, for those that are not in the nearer table; they are kept in it."""
        made = {text: self.far[text] for text in texts if text in self.far}
        # white space at an edge would meet the space between two stretches
        edged = [text for text in texts if text not in made and (text[0].isspace() or text[-1].isspace())]
        inner = [text for text in texts if text not in made and text not in edged]
        for group in [inner, *([text] for text in edged)]:
            new = self.stretches(group) if group else {}
            if new is None:
                return None
            made |= new
        for text, found in made.items():
            if found[0] + found[1] <= LONGEST:
                if len(self.near) >= self.kept:
                    self.far, self.near = self.near, {}
                self.near[text] = found
        return made

    def by_stretches(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """As ``document``, or None where the text cannot be cut."""
        if not self.parts or self.model.normalize(text).replace("▁", " ") != " " + text:
            return None
        parts = BORDER.split(text)
        made = [*map(self.near.get, parts)]
        if None in made:
            learned = self.learned([*dict.fromkeys(part for part, known in zip(parts, made) if known is None)])
            if learned is None:
                return None
            made = [known or learned[part] for part, known in zip(parts, made)]
        n_a, n_b, groups, pairs = zip(*made)
        return sum(n_a), sum(n_b), ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)

    def document(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """(tokens of the first, of the second, groups, pairs) of a whole text, or None if it has no tokens."""
        if not text:
            return None
        cut_up = self.by_stretches(text)
        if cut_up is not None:
            return cut_up
        tokens = self.tokens(text)
        return None if tokens is None else (len(tokens[0]), len(tokens[1]), *self.align(*tokens))


@lru_cache(maxsize=2)
def aligner(byte_model: str, piece_model: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(byte_model, piece_model)


def align_documents(
    docs: DataFrame, byte_model: str, piece_model: str, block_documents: int = 4096, block_links: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Two kinds of rows. Documents: id, block, n_a, n_b, n_groups, n_links, groups, and their pairs as ``places`` in
    the block's ``pairs`` with ``times`` of occurrence. Blocks (``pairs`` is not null): the different pairs of their
    documents, and in how many ``documents`` each is.

    The models are files that all executors can read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "places array<int>, times array<int>, pairs array<long>, documents array<int>"
    )
    names = [id_col, "block", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times", "pairs", "documents"]
    kinds = [*[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32())]

    def packed(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_model, piece_model)
        block, in_block = TaskContext.get().partitionId() << 32, 0
        met: dict[int, int] = {}
        counts: list[int] = []
        no_key = None

        def closed() -> pa.RecordBatch:
            return packed(no_key, [(block, *[None] * 7, list(met), counts)])

        for batch in batches:
            no_key = pa.nulls(1, batch.column(0).type)
            rows: list[tuple] = []
            held = first = 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                aligned = own.document(text)
                if aligned is None:
                    rows.append((block, 0, 0, 0, 0, "", [], [], None, None))
                else:
                    n_a, n_b, groups, links = aligned
                    pairs, times = np.unique(links, return_counts=True)
                    places = [met.setdefault(pair, len(met)) for pair in pairs.tolist()]
                    counts += [0] * (len(met) - len(counts))
                    for place in places:
                        counts[place] += 1
                    sizes = n_a, n_b, groups.count(";") + 1, len(links)
                    rows.append((block, *sizes, groups, places, times.tolist(), None, None))
                in_block += 1
                held += len(text)
                if held >= 1 << 22 or row == batch.num_rows - 1:
                    yield packed(batch.column(0).slice(first, row + 1 - first), rows)
                    rows, held, first = [], 0, row + 1
                if in_block >= block_documents or len(met) >= block_links:
                    yield closed()
                    block, in_block, met, counts = block + 1, 0, {}, []
        if in_block:
            yield closed()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_totals(blocks: DataFrame) -> DataFrame:
    """(block, place, docs, best) of every pair of ``blocks`` (block, pairs, documents).

    ``docs`` is the number of documents corpus-wide, ``best`` whether no pair of the same first id has more.
    """
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "e")).select(
        "block", "place", F.col("e.pairs").alias("pair"), F.col("e.documents").alias("documents")
    )
    totals = cut(entries.groupBy("pair").agg(F.sum("documents").alias("docs")))
    first = F.shiftright("pair", 32).alias("first")
    highest = totals.groupBy(first).agg(F.max("docs").alias("most"))
    judged = totals.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("first"))
    judged = judged.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return entries.select("block", "place", "pair").join(judged, "pair").select("block", "place", "docs", "best")


def with_counts(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of ``aligned``, a written result of ``align_documents``, with n_best and count_sum."""
    rows = aligned.filter("pairs IS NULL").drop("pairs", "documents")
    totals = pair_totals(aligned.filter("pairs IS NOT NULL").select("block", "pairs", "documents"))
    kept = [c for c in rows.columns if c not in ("block", "places", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def counted(docs: pa.Table, known: pa.Table) -> pa.Table:
        place = known["place"].to_numpy()
        docs_of, best_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        docs_of[place], best_of[place] = known["docs"].to_numpy(), known["best"].to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(docs["places"], docs["times"]):
            at, occurred = places.values.to_numpy(), times.values.to_numpy()
            n_best.append(int(best_of[at] @ occurred))
            count_sum.append(int(docs_of[at] @ occurred))
        made = docs.select(kept).append_column("n_best", pa.array(n_best, pa.int64()))
        return made.append_column("count_sum", pa.array(count_sum, pa.int64()))

    known = totals.withColumnRenamed("block", "of_block")
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        counted, f"{schema}, n_best long, count_sum long"
    )


def report(docs: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Counts and a digest of the groups per document."""
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align_documents(docs, byte_model, piece_model)
    written = cut(aligned.select(*[c for c in aligned.columns if c != "groups"], digest))
    return with_counts(written).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
