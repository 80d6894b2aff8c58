"""Ids of byte-level merge tokenizers, as the tokenizers library makes them.

Where the file is of the plain kind (the usual pattern, merges in the order of their ids), tiktoken makes the same ids
several times faster. Any other file, and any text with a very long run of white space, for which tiktoken's pattern
needs a stack that grows with the run, goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs from this length on are left to the tokenizers library.
LONGEST_RUN = 50_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONGEST_RUN}}}")


def byte_letters() -> dict[str, int]:
    """Byte of every letter that byte-level vocabularies write for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def plain_kind(spec: dict) -> bool:
    """Whether tiktoken makes the same ids from the vocabulary of this file."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or spec.get("normalizer"):
        return False
    if cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    return -1 not in made and made == sorted(made) and all(letter in model["vocab"] for letter in byte_letters())


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; tokens that are no byte-level text are taken as they are."""
    letters = byte_letters()
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    found = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        known = all(c in letters for c in token)
        found[number] = bytes(letters[c] for c in token) if known else token.encode()
    return found


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Function text -> array of ids without added ones, from the file of a byte-level tokenizer.

    With ``special``, strings of special tokens in a text become their ids; else they are plain text.
    """
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not plain_kind(spec):
        return slow
    import tiktoken

    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    ranks = {
        bytes(letters[c] for c in token): number
        for token, number in spec["model"]["vocab"].items()
        if token not in added
    }
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    allowed = {"allowed_special": "all"} if special else {"allowed_special": set(), "disallowed_special": ()}

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONGEST_RUN and LONG_RUN.search(text):
            return slow(text)
        return fast.encode_to_numpy(text, **allowed)

    return encode
