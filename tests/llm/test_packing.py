import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attesta.llm import byte_bpe
from attesta.llm import packing as P
from tests.llm import helpers as H

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizer():
    rng = random.Random(5)
    letters = ["a", "É", "the ", "ß", " ", "\n", "\t", "12", "!?", "日本", "<|endoftext|>", "'s", " ", "\x00", "🙂"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["x" * 5000, " " * 5000]
    whole = Tokenizer.from_file(PATH)
    encode = P.encoder(PATH)
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \t" * 30_000 + "b", "x" * 100_000])
def test_very_long_runs(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    assert P.encoder(PATH)(text).tolist() == whole.ids


def test_other_tokenizer_files(tmp_path):
    """Files of another kind go to the tokenizers library itself."""
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    assert byte_bpe.plain_kind(spec)
    spaced = json.loads(json.dumps(spec))
    spaced["pre_tokenizer"]["add_prefix_space"] = True
    swapped = json.loads(json.dumps(spec))
    swapped["model"]["merges"][:2] = swapped["model"]["merges"][1::-1]
    lower = json.loads(json.dumps(spec))
    lower["normalizer"] = {"type": "Lowercase"}
    text = "The Whole <|endoftext|> thing's  12 th"
    for n, other in enumerate((spaced, swapped, lower)):
        path = str(tmp_path / f"{n}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(other, file)
        assert not byte_bpe.plain_kind(other)
        assert P.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    words = public_tokenizers.path("word_bpe_49k.json")
    assert P.encoder(words)(text).tolist() == Tokenizer.from_file(words).encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "élan", "rho.", "x"]) for _ in range(rng.choice([3, 40, 300, 900, 4000]))) for _ in range(120)]
    pairs = list(enumerate(texts)) + [(500, None), (501, ""), (501, ""), (None, "no id")]
    rows = P.pack_documents(H.documents(spark, pairs).repartition(3).selectExpr("*", "1 AS piece", "2 AS start"), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    for doc_id, text in pairs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        if doc_id == 501:
            assert [r["length"] for r in own] == [1, 1]
            continue
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) * 1.1 + 3
    assert P.pack_documents(H.documents(spark, []), PATH).collect() == []


def test_bins_are_bounded_and_fullest_closes():
    bins = P.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, the fuller one, closed
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)
    assert bins.place(1) == (0, 9) and bins.open == 0
    rng = random.Random(7)
    bins = P.OpenBins(100, 8)
    for _ in range(1000):
        bins.place(rng.randint(1, 100))
        assert bins.open <= 8 and bins.open == sum(map(len, bins.by_free))
