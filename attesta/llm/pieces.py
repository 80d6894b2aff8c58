"""Encoding with a merge-type piece vocabulary through a table of each prefix's last token, and decoding.

A merge tokenizer joins the best-scored neighbouring symbols until none fit. Its result has a local form: a row of
tokens is the encoding of a text exactly if every two neighbours encode to themselves. So the encoding of a prefix ends
in one token only, and it follows from shorter prefixes: among the tokens that end at the place (found by an
automaton over the vocabulary), it is the one that is compatible with the last token of the prefix before it. Reading
the table backwards from the end gives the ids. No merge queue runs over the text; the work is linear in its length.

Compatibility of a pair is tested by merging its two texts and looking for a merge across their border; the answers
are kept, as are the ids of short stretches between spaces, both in tables of bounded size. Stretches are cut where no
piece can reach across: before a space mark after another letter, if the vocabulary holds no such piece.

Characters that occur in no piece become byte pieces, so the model has to hold these.

Defined results: null text and empty text have no ids and decode to the empty text; a null ``doc_id`` and repeated
rows are encoded like any others; texts of any length are encoded whole; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letter that stands for a space in pieces.
MARK = "▁"


class PieceEncoder:
    """Ids of texts; ``kept`` bounds the tables of answers."""

    def __init__(self, path: str, kept: int = 400_000):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        marked = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        self.bytes = [marked.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.bytes:
            raise ValueError("the model has no byte pieces")
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model has unused pieces")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.texts = {i: model.id_to_piece(i) for i in plain}
        #: Merges of the best score come first, equal ones from the left.
        self.rank = {text: -model.get_score(i) for i, text in self.texts.items()}
        letters = set().union(*self.texts.values())
        #: Letters that only occur inside pieces are tokens of their own here and bytes in the end.
        for number, letter in enumerate(sorted(letters - set(self.rank))):
            self.texts[size + number] = letter
        self.size = size
        self.width = size + len(letters)
        self.matches = ahocorasick.Automaton()
        for i, text in self.texts.items():
            self.matches.add_word(text, (i, len(text)))
        self.matches.make_automaton()
        self.known = letters
        self.foreign = re.compile("[^" + re.escape("".join(sorted(letters))) + "]")
        split = not any(a != MARK and b == MARK for text in self.texts.values() for a, b in zip(text, text[1:]))
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if split else "(?s).+").findall
        self.kept = kept
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}

    def _merged(self, text: str, border: int) -> int:
        """Symbols left after all merges of ``text``; 0 as soon as a merge crosses ``border``."""
        symbols, score = list(text), self.rank.get
        never = float("inf")
        scores = [score(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = min(scores)
            if best == never:
                break
            at = scores.index(best)
            if at == border - 1:
                return 0
            if at < border:
                border -= 1
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(symbols[at] + symbols[at + 1], never)
            if at:
                scores[at - 1] = score(symbols[at - 1] + symbols[at], never)
        return len(symbols)

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own text encodes to the token."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self._merged(self.texts[token], -1) == 1
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their texts meet; ``left`` stands alone."""
        key = left * self.width + right
        if len(self.pairs) >= self.kept:
            self.pairs.clear()
        border = len(self.texts[left])
        found = self.stands_alone(right) and self._merged(self.texts[left] + self.texts[right], border) > 0
        self.pairs[key] = found
        return found

    def _known_ids(self, text: str) -> list[int]:
        """Ids of a text of known letters: the table of last tokens, read backwards."""
        last: list[int | None] = [None] * (len(text) + 1)
        width, answers = self.width, self.pairs.get
        for end, (token, length) in self.matches.iter(text):
            end += 1
            if last[end] is None:
                start = end - length
                if start:
                    fits = answers(last[start] * width + token)
                    if fits is None:
                        fits = self.compatible(last[start], token)
                else:
                    fits = self.stands_alone(token)
                if fits:
                    last[end] = token
        ids = []
        at = len(text)
        while at:
            token = last[at]
            at -= len(self.texts[token])
            if token < self.size:
                ids.append(token)
            else:
                ids.extend(self.bytes[b] for b in reversed(self.texts[token].encode()))
        ids.reverse()
        return ids

    def _ids(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self._known_ids(text)
        ids, at = [], 0
        for strange in self.foreign.finditer(text):
            if strange.start() > at:
                ids += self._known_ids(text[at : strange.start()])
            ids += [self.bytes[b] for b in strange[0].encode()]
            at = strange.end()
        return ids + (self._known_ids(text[at:]) if at < len(text) else [])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for stretch in self.stretches(self.model.normalize(text)):
            found = memo.get(stretch)
            if found is None:
                found = self._ids(stretch)
                if len(stretch) <= 64:
                    if len(memo) >= self.kept:
                        memo.clear()
                    memo[stretch] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path)


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1 << 22,
) -> DataFrame:
    """(id, ids, decoded) per document. ``model`` is a file that all executors can read.

    About ``size`` characters of text are held in results at a time, one document at least.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            keys, first = batch.column(0), 0
            ids, decoded, held = [], [], 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                made = own.encode(text)
                ids.append(made)
                decoded.append(own.decode(made) if made else "")
                held += len(text)
                if held >= size or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, row + 1 - first), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                        names=[id_col, "ids", "decoded"],
                    )
                    ids, decoded, held, first = [], [], 0, row + 1

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def report(docs: DataFrame, model: str) -> DataFrame:
    """Counts and digests of ids and decoded texts per document."""
    return encode_documents(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
