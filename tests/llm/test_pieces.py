import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from attesta.llm import pieces as P
from tests.llm import helpers as H

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [
    "a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "🙂", "<s>", "<0x0A>", "▁", "▁▁", "\x00", "한", "\xa0", "ǅ", "th", "er",
    "==", "----", "//", "12", "0", "́", "​", "�",
]


@pytest.fixture(scope="module")
def own():
    return P.encoder(PATH)


def test_ids_and_texts_equal_the_library(own):
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    known = sorted(own.known)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(known[:150]) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == whole.encode(text)
        assert own.decode(ids) == whole.decode(ids)


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 50_000, "ab" * 100_000, "\n" * 100_000, "日" * 30_000, "\U000e0001" * 5000])
def test_long_runs(own, text):
    assert own.encode(text) == own.model.encode(text)


def test_tables_are_bounded():
    small = P.PieceEncoder(PATH, kept=20)
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(5))
        assert small.encode(text) == small.model.encode(text)
        assert len(small.memo) <= 20 and len(small.pairs) <= 20


def test_every_prefix_ends_in_one_token(own):
    """The table's claim: the last id of each prefix is the one compatible token among all that end there."""
    rng = random.Random(3)
    for _ in range(60):
        text = "▁" + "".join(rng.choice("theiran") for _ in range(12))
        for end in range(2, len(text) + 1):
            last = own._known_ids(text[:end])[-1]
            fitting = []
            for token, piece in own.texts.items():
                if text[:end].endswith(piece):
                    before = own._known_ids(text[: end - len(piece)])
                    if own.compatible(before[-1], token) if before else own.stands_alone(token):
                        fitting.append(token)
            assert fitting == [last]


def test_report(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [(0, "a b"), (1, None), (2, ""), (3, "  two  "), (3, "  two  "), (None, "▁ no id"), (4, "日本 \x00 x\n")]
    rows = P.report(H.documents(spark, texts).selectExpr("*", "1 AS ids", "2 AS decoded").repartition(2), PATH).collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = []
    for doc_id, text in texts:
        ids = whole.encode(text or "")
        expected.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(whole.decode(ids) if ids else "")))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert P.report(H.documents(spark, []), PATH).collect() == []
