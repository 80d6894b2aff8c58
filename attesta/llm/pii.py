"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns find the base spans (email, ip, card, phone). Wider patterns propose candidate spans: letters of any
script in mail names, written-out "at" and "dot", numbers with other separators, the longer form of addresses. Labelers of
three sorts vote on every candidate: patterns (form, checksum, ranges), gazetteers (mail endings, calling codes,
issuer digits) and context (words before it, characters at its ends). Expectation maximisation estimates how reliable
the labelers are, and its posteriors train the final span classifier, a logistic regression over kind, form and votes.
Candidates it accepts are added; base spans always stay.

Texts are read once: spans and candidates of a document are written as one narrow row to the shared folder, so
learning and the answer need no second scan, no join and no shuffle of texts. What the driver sees are counts of vote
and form patterns, whose number does not grow with the data.

Positions come from cutting the text at a pattern: lengths of pieces and matches add up to them. Sums are made by
blocks of 256 matches, so many matches in a long text do not cost their square. Patterns start only at the edge of a run
of their characters and never go back into one, so each takes one pass.

Defined results: a null or empty text has no spans; a null ``doc_id`` is passed on; repeated rows give a row each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import votes as V
from attesta.llm.common import cut, text_or_empty
from attesta.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that no run of characters is entered twice.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9]++(?:[ -][0-9]++)*+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++(?:@| ?[\\[(]at[\\])] ?| at )[\\p{L}\\p{N}-]++"
    "(?:(?:\\.| ?[\\[(]dot[\\])] ?| dot )[\\p{L}\\p{N}-]++)++",
    "ip": "(?<![\\p{L}\\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    "|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\\.[0-9]{1,3}){3})(?![\\p{L}\\p{N}:])",
    "card": "(?<![\\p{L}\\p{N}])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![\\p{L}\\p{N}])",
    "phone": "(?<![\\p{L}\\p{N}+.])(?![0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9.]))(?:\\+|00)?\\(?[0-9]{1,4}\\)?(?:[ ()./-]{1,3}[0-9]{2,5}){2,5}(?![\\p{L}\\p{N}])",
}
#: An address part of at most 255, with zeros before it.
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Gazetteers.
MAIL_ENDINGS = "com org net edu gov int mil info biz io co de fr es it nl be at ch uk us ca au eu ru jp cn in br mx pt pl se no dk fi ie".split()
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": "e-?mail|mailto|contact|write|reach|courriel|correo|kontakt",
    "ip": "\\bip\\b|address|server|host|login|client|adresse|direcci",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel\\b|tel\\.|call|mobile|fax|cell|whatsapp|telefon|anruf|appel|llam",
}
AGAINST = "version|\\bv\\.?$|order|invoice|isbn|issn|\\bid\\b|\\bno\\.|\\bref|page|token|hash|sha|serial|price"
VOTERS = ["form", "check", "gazetteer", "context", "edges", "variety"]
FEATURES = ["kind", "digits", "gaps", "size"]


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: text ``m``, ``start`` in code points, and what stands before and after."""
    length = lambda c: F.char_length(c).cast("long")
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

    def placed(pieces: Column, found: Column, sizes: Column, sums: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / 256).cast("int")
            before = F.get(sums, block) + total(F.slice(sizes, block * 256 + 1, i % 256))
            return F.struct(
                m.alias("m"), (before + length(F.get(pieces, i))).alias("start"),
                F.right(F.get(pieces, i), F.lit(40)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(2)).alias("right"),
            )

        return F.transform(found, one)

    def sized(pieces: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: length(m) + length(F.get(pieces, i)))
        blocks = lambda s: F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s) / 256).cast("int")), lambda b: total(F.slice(s, 1, b * 256))
        )
        return let(sizes, lambda s: let(blocks(s), lambda sums: placed(pieces, found, s, sums)))

    return let(
        F.split(text, pattern, -1),
        lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: sized(pieces, found)),
    )


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern counts."""
    size = F.char_length(digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(f"^{PART}(?:\\.{PART}){{3}}$"),
        "card": lambda: size.between(14, 19) & F.call_function("luhn_check", digits(m)),
        "phone": lambda: size.between(10, 15),
    }[kind]()


def base_spans(text: Column, kind: str) -> Column:
    counted = F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["m"]))
    return F.transform(counted, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.char_length(x["m"])).alias("end"),
    ))


def vote(good: Column, bad: Column | None = None) -> Column:
    chosen = F.when(good, 1)
    return (chosen if bad is None else chosen.when(bad, -1)).otherwise(0)


def candidates(text: Column, kind: str) -> Column:
    """Proposed spans with their votes and form features."""

    def labelled(x: Column) -> Column:
        m, number = x["m"], digits(x["m"])
        size = F.char_length(number)
        ending = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1))
        form, check, gazetteer = {
            "email": lambda: (
                vote(m.rlike("^[^@ ]+@[^@ ]+\\.[\\p{L}]{2,}$"), m.rlike(" at | dot ") & ~m.rlike(" at .* dot ")),
                vote(m.rlike("^[^@ ]{1,64}(@|.?[\\[( ]at)"), m.rlike("^[.]|[.]{2}")),
                vote(ending.isin(MAIL_ENDINGS), F.lit(True)),
            ),
            "ip": lambda: (
                vote(m.rlike(f"^{PART}(?:\\.{PART}){{3}}$") | m.contains(":"), F.lit(True)),
                vote(m.rlike("^(?!0)[0-9.]+$|::|(?:[^:]+:){7}"), m.rlike("^0|^[0-9](?:\\.[0-9]){3}$")),
                vote(m.rlike("^(?:10|172|192|127|8|1)\\.|^(?:2|fe|fd)[0-9A-Fa-f]*:")),
            ),
            "card": lambda: (
                vote(m.rlike("^[0-9]{13,19}$|^[0-9]{4}([ .-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$"), F.lit(True)),
                vote(F.call_function("luhn_check", number), F.lit(True)),
                vote(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), number.rlike("^[01789]")),
            ),
            "phone": lambda: (
                vote(m.rlike("^(?:\\+|00)|^\\([0-9]{2,4}\\)"), m.rlike("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}")),
                vote(size.between(10, 13), ~size.between(10, 15)),
                vote(m.rlike(f"^(?:\\+|00)(?:{CALLING_CODES})") | m.rlike("^\\(?[2-9][0-9]{2}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
            ),
        }[kind]()
        near = F.lower(x["left"])
        clear = ~x["left"].rlike("[\\p{L}\\p{N}=\"'/_#-]$") & ~x["right"].rlike("^[\\p{L}\\p{N}=\"'/_-]")
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.char_length(m)).alias("end"),
            form.alias("form"), check.alias("check"), gazetteer.alias("gazetteer"),
            vote(near.rlike(CONTEXT[kind]), near.rlike(AGAINST)).alias("context"), vote(clear, ~clear).alias("edges"),
            vote(F.lit(False), (size >= 7) & number.rlike("^(.)\\1+$|^0?123456789")).alias("variety"),
            F.least(F.floor(size / 4), F.lit(5)).cast("int").alias("digits"),
            F.least(F.regexp_count(m, F.lit("[ ().-]")), F.lit(3)).cast("int").alias("gaps"),
            F.least(F.floor(F.char_length(m) / 10), F.lit(3)).cast("int").alias("size"),
        )

    possible = matches(text, WIDE[kind])
    if kind in ("card", "phone"):  # the numbers of digits that exist
        low, high = (13, 19) if kind == "card" else (10, 15)
        possible = F.filter(possible, lambda x: F.char_length(digits(x["m"])).between(low, high))
    if kind == "card":  # a number that fails the checksum needs a word for it before it
        possible = F.filter(
            possible, lambda x: F.call_function("luhn_check", digits(x["m"])) | F.lower(x["left"]).rlike(CONTEXT["card"])
        )
    return F.transform(possible, labelled)


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): one narrow row per document."""
    text = text_or_empty()
    some = {
        "email": text.contains("@") | text.rlike("[\\[(]at[\\])]| dot "), "ip": text.rlike("[0-9A-Fa-f]:|[0-9]\\.[0-9]"),
        "card": text.rlike("[0-9][ .-]?[0-9][ .-]?[0-9]"), "phone": text.rlike("[0-9][ ().0-9/-]{7}"),
    }

    def guarded(kind: str, made: Column, empty: str) -> Column:
        return F.when(some[kind], made).otherwise(F.array().cast(empty))

    base = "array<struct<start:bigint,kind:int,end:bigint>>"
    wide = f"array<struct<start:bigint,kind:int,end:bigint,{','.join(f'{n}:int' for n in [*VOTERS, *FEATURES[1:]])}>>"
    return docs.select(
        "doc_id",
        joined([guarded(k, base_spans(text, k), base) for k in KINDS]).cast(base).alias("base"),
        joined([guarded(k, candidates(text, k), wide) for k in KINDS]).cast(wide).alias("candidates"),
    )


# Span classifier ----------------------------------------------------------------------------------


def inputs(row: dict) -> list[str]:
    """Names of the indicators that are set for a candidate."""
    kind = KINDS[row["kind"]]
    own = [f"{kind}:{n}={row[n]}" for n in [*VOTERS, *FEATURES[1:]]]
    return [kind, *[f"{n}={row[n]}" for n in VOTERS], *own]


def train_classifier(rows: list[tuple[dict, float, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on soft labels: weight of every indicator. Rows are (pattern, label, count)."""
    names = {n for row, _, _ in rows for n in inputs(row)}
    weights = dict.fromkeys(sorted(names), 0.0)
    total = sum(n for _, _, n in rows) or 1.0
    sets = [(inputs(row), label, n / total) for row, label, n in rows]
    slow = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {n: decay * w for n, w in weights.items()}
        for names_set, label, share in sets:
            error = (V.logistic(sum(weights[n] for n in names_set)) - label) * share
            for n in names_set:
                slope[n] += error
        for n, g in slope.items():
            slow[n] += g * g
            weights[n] -= rate * g / slow[n] ** 0.5
    return weights


def learn(found: DataFrame, prior: float = 0.7) -> dict[str, float]:
    """Reliabilities of the labelers by EM, then the classifier trained on the posteriors."""
    names = [*VOTERS, *FEATURES]
    rows = found.select(F.explode("candidates").alias("c")).select("c.*").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted(([r[n] for n in names], float(r["n"])) for r in rows)
    if not patterns:
        return {}
    votes = [(p[: len(VOTERS)], n) for p, n in patterns]
    reliability = V.fit(votes, len(VOTERS), prior=prior)
    return train_classifier([
        (dict(zip(names, p)), reliability.posterior(p[: len(VOTERS)]), n) for p, n in patterns
    ])


def logit(c: Column, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k, kind in enumerate(KINDS):
        total = total + F.when(c["kind"] == k, weights.get(kind, 0.0)).otherwise(0.0)
    for name, weight in weights.items():
        owner, _, test = name.rpartition(":")
        if "=" in test:
            field, value = test.split("=")
            hit = c[field] == int(value)
            total = total + F.when(hit & (c["kind"] == KINDS.index(owner)) if owner else hit, weight).otherwise(0.0)
    return total


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_personal_data(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans with those the classifier accepts."""
    found = cut(find(docs))
    weights = learn(found)
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    accepted = F.filter("candidates", lambda c: logit(c, weights) >= log(accept / (1 - accept)))
    added = F.transform(accepted, plain) if weights else F.slice(F.transform("candidates", plain), 1, 0)
    return found.select("doc_id", "base", F.array_distinct(F.concat("base", added)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
