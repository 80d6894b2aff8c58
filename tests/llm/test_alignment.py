import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attesta.llm import alignment as A
from attesta.llm import byte_bpe
from tests.llm import helpers as H

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "É", "the ", " of", "ß", " ", "   ", "\n", "\t", "12", "!?", "日本", "<|endoftext|>", "</s>", "🙂", "\x00", "ﬁ", "naïve ", "\xa0"]


def spans(tokens):
    ends, at = [], 0
    for t in tokens:
        ends.append((at, at + len(t)))
        at += len(t)
    return ends


def expected(texts):
    """Every field by comparing all tokens' byte ranges, straight from the two libraries."""
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    a_bytes = byte_bpe.token_bytes(BYTES)
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    rows, docs_of = [], defaultdict(set)
    for n, text in enumerate(texts):
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x) != whole for x in ([a_bytes[i] for i in a], [piece(i) for i in b])):
            rows.append(([], [], [], ""))
            continue
        a_spans, b_spans = spans([a_bytes[i] for i in a]), spans([piece(i) for i in b])
        links = [(x, y) for x, (s, e) in zip(a, a_spans) for y, (u, v) in zip(b, b_spans) if s < v and u < e]
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(
                ",".join(str(x) for x, (s, _) in zip(ids, marks) if low <= s < high) for ids, marks in ((a, a_spans), (b, b_spans))
            ))
            low = high
        for pair in links:
            docs_of[pair].add(n)
        rows.append((a, b, links, ";".join(groups)))
    most = defaultdict(int)
    for (x, _), docs in docs_of.items():
        most[x] = max(most[x], len(docs))
    return [
        (
            len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
            sum(len(docs_of[p]) == most[p[0]] for p in links), sum(len(docs_of[p]) for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for a, b, links, groups in rows
    ]


def table(spark, texts):
    return H.documents(spark, texts).selectExpr("*", "1 AS block", "'x' AS groups", "2 AS pairs")


def test_all_fields_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "a▁b", "the of", "the of", "x" * 300, " " * 200, "\n" * 50]
    rows = A.report(table(spark, texts).repartition(3), BYTES, PIECES).collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert [found[i] for i in range(len(texts))] == expected(texts) and len(rows) == len(texts)
    assert found[texts.index("a▁b")] == (0, 0, 0, 0, 0, 0, "")
    assert A.report(table(spark, []), BYTES, PIECES).collect() == []


def test_counts_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    pairs = [(i % 7 or None, "".join(rng.choice(LETTERS[:12]) for _ in range(rng.randint(1, 20)))) for i in range(60)]
    whole = A.cut(A.align_documents(table(spark, pairs).coalesce(1), BYTES, PIECES))
    small = A.cut(A.align_documents(table(spark, pairs).coalesce(1), BYTES, PIECES, block_documents=4, block_links=50))
    assert small.filter("pairs IS NOT NULL").count() >= 15 and whole.filter("pairs IS NOT NULL").count() == 1
    fields = ["doc_id", "groups", "n_links", "n_best", "count_sum"]
    read = [sorted(map(str, A.with_counts(t).select(fields).collect())) for t in (whole, small)]
    assert read[0] == read[1] and len(read[0]) == 60


def test_windows_are_kept_within_bounds():
    own = A.Aligner(BYTES, PIECES, kept=5)
    text = "one two three four five six seven eight nine ten one two"
    first = [x if isinstance(x, str) else x.tolist() for x in own.align(*own.tokens(text))]
    assert len(own.newer) <= 5 and len(own.older) <= 5
    assert [x if isinstance(x, str) else x.tolist() for x in own.align(*own.tokens(text))] == first
    long = "y" * 500
    own.align(*own.tokens(long))
    assert not any(len(a) + len(b) > 4 * A.LONGEST for a, b in [*own.newer, *own.older])


@pytest.mark.parametrize("text", [" " * 1_500_000, "\n" * 1_500_000, "a b " * 50_000, "q" * 200_000])
def test_very_long_texts(text):
    own = A.Aligner(BYTES, PIECES)
    a, b, *ends = own.tokens(text)
    groups, links = own.align(a, b, *ends)
    assert len(links) == len(a) + len(b) - groups.count("|") and groups.count("|") == groups.count(";") + 1


def whole(own, text):
    """The alignment of a text that is tokenised whole."""
    tokens = own.tokens(text)
    return None if tokens is None else (len(tokens[0]), len(tokens[1]), *own.align(*tokens))


def test_stretches_equal_whole_texts():
    own = A.Aligner(BYTES, PIECES, kept=50)
    rng = random.Random(5)
    texts = ["".join(rng.choice([*LETTERS, " the", " Of", " it's", " é́", " ́x", "\x1c", "\u2003", " 1.5", "don't "]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    cut_up = 0
    for text in texts:
        found, want = own.document(text), whole(own, text)
        cut_up += own.by_stretches(text) is not None
        assert (found is None) == (want is None)
        assert found is None or (found[:3] == want[:3] and (found[3] == want[3]).all())
    assert cut_up > 100 and len(own.near) <= 50 and len(own.far) <= 50


def test_known_stretches_are_not_tokenised_again():
    own, asked = A.Aligner(BYTES, PIECES), []
    plain = own.encode_first
    own.encode_first = lambda text: asked.append(text) or plain(text)
    first = own.document("one two three one two")
    second = own.document("three two one two one")
    assert asked == [" one two three"] and first[:2] == second[:2] == whole(own, "one two three one two")[:2]
