"""Passages of texts and their features, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Byte classes of the shape features, in the order of the columns.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?",
    b"|", b"#*$%&<>", b"\"'()[]{}", b"@=+/\\_~^`", b"-", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
)
OTHER = len(CLASSES)
SHAPES = OTHER + 1 + 7
SPACE = np.zeros(256, dtype=bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
CLASS = np.full(256, OTHER, dtype=np.int64)
for _i, _members in enumerate(CLASSES):
    CLASS[list(_members)] = _i
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += np.uint64(32)
PLACE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def blocks(texts: list[str | None], size: int = 1 << 18) -> Iterator[list[bytes]]:
    """Encoded texts in blocks of about ``size`` bytes; a longer text is a block of its own."""
    block: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode("utf-8")
        if block and held + len(data) > size:
            yield block
            block, held = [], 0
        block.append(data)
        held += len(data)
    if block:
        yield block


def passage_features(block: list[bytes], words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages of each text): a row for every ``words`` words of every text.

    A text without words has one row of zeros. The columns are shares of the byte classes, seven
    figures about the words, and the square roots of the shares of hashed words.
    """
    data = np.frombuffer(b"\n".join(block) + b"\n", dtype=np.uint8)
    lengths = np.array([len(b) + 1 for b in block], dtype=np.int64)
    text_starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    word_text = np.searchsorted(text_starts, starts, side="right") - 1
    n_words = np.bincount(word_text, minlength=len(block))
    passages = np.maximum(1, -(-n_words // words))
    first_passage = np.cumsum(passages) - passages
    first_word = np.cumsum(n_words) - n_words
    word_passage = first_passage[word_text] + (np.arange(len(starts)) - first_word[word_text]) // words
    total = int(passages.sum())
    out = np.zeros((total, SHAPES + buckets), dtype=np.float32)
    if not len(starts):
        return out, passages
    places = np.flatnonzero(~space)
    letters = data[places]
    word_of = np.cumsum(begins)[places] - 1
    counts = np.bincount(
        word_passage[word_of] * (OTHER + 1) + CLASS[letters], minlength=total * (OTHER + 1)
    ).reshape(total, -1)
    size = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out[:, : OTHER + 1] = counts / size
    terms = (LOWERED[letters] + np.uint64(1)) * PLACE[(places - starts[word_of]) & 63]
    bounds = np.searchsorted(places, starts)
    marks = np.add.reduceat(terms, bounds)
    marks = (marks ^ (marks >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    per = np.maximum(np.bincount(word_passage, minlength=total), 1)
    length = np.diff(np.append(bounds, len(places)))
    same = np.zeros(len(marks))
    same[1:] = (marks[1:] == marks[:-1]) & (word_text[1:] == word_text[:-1])
    distinct = np.unique(marks ^ (word_passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    figures = (
        np.bincount(word_passage, length, total) / per / 10,
        np.bincount(word_passage, length == 1, total) / per,
        np.bincount(word_passage, same, total) / per,
        np.bincount(word_passage[distinct], minlength=total) / per,
        np.bincount(word_passage, CLASS[letters[bounds]] == 1, total) / per,
        np.log1p(np.bincount(word_passage, minlength=total)) / 5,
        np.log1p(np.repeat(n_words, passages)) / 10,
    )
    out[:, OTHER + 1 : SHAPES] = np.stack(figures, axis=1)
    bucket = (marks >> np.uint64(40)).astype(np.int64) % buckets
    bag = np.bincount(word_passage * buckets + bucket, minlength=total * buckets).reshape(total, buckets)
    out[:, SHAPES:] = np.sqrt(bag / per[:, None])
    return out, passages
