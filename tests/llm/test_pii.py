import hashlib
import re

from attesta.llm import pii as P
from tests.llm import helpers as H


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    """Base spans from the patterns as stated."""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        if 14 <= len(only(m)) <= 19 and luhn(only(m)):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 10 <= len(only(m)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)


TEXTS = [
    "écrire à ana.b@mail.example.com. Or x@y.z._w@q.example, a@b, @c.d, a@b.c@d.e.f",
    "ip 10.0.0.1 and 300.1.1.1.5.6.7.8 then 1.2.3.4.5.6.7.8 and 000010.2.3.4, 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1111, 4111111111111112; 5500000000000004 4111111111111111",
    "call +1 (555) 010-0123 or +49 30 1234567 89, +1 23, +1  2 , ++44 20 7946 0958-",
    "ünï 4111111111111111 ünï +1 555 010 0199 x@ü.de x@example.org", None, "", "nothing here",
    "a." * 20000 + "@" + "b" * 20000, "1 " * 30000, "9" * 50000, "+1" + " " * 50000 + "2",
    " ".join(f"u{i}@mail.example.com 4111111111111111" for i in range(700)),
]


def test_base_spans(spark):
    found = {r["doc_id"]: r for r in P.report(H.documents(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = base(text)
        assert found[i]["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest(), i
        assert [found[i][f"n_{k}"] for k in P.KINDS] == [sum(s[1] == n for s in want) for n in range(4)]
        assert set(text_of(want).split(",")) - {""} <= set(found[i]["spans"].split(","))


def test_method_adds_spans(spark):
    """Numbers side by side and mail names in other scripts are found; plain numbers are not."""
    good = [f"write to ana{i}@mail.example.com or call +1 (555) 010-01{i:02d}" for i in range(30)]
    added = ["mail josé.lé@mail.example.com now", "two 4111111111111111 5500000000000004 cards"]
    clean = ["ordered 1234567812345678 pieces", "on 2024-01-15 at 10:20:30, v 1.2.3", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""]
    texts = good + added + clean
    found = {r["doc_id"]: r["spans"] for r in P.report(H.documents(spark, texts)).collect()}
    assert "email:5:29" in found[30]
    assert found[31] == "card:4:20,card:21:37"
    assert [found[i] for i in (32, 33, 34)] == ["", "", ""]


def test_shapes(spark):
    assert P.report(H.documents(spark, [])).collect() == []
    docs = H.documents(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")]).selectExpr("*", "1 AS spans", "2 AS base", "3 AS candidates")
    rows = P.report(docs).collect()
    assert len(rows) == 3 and {r["spans"] for r in rows} == {"email:0:6"}
