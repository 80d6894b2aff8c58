"""Job-post fields as Column expressions over the text and the paragraphs of a post."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.registry import post_values as V

ANY = "(?iuU)"
KEY_CHARS = 1600
VERBATIM = 8
PLACES_SHOWN = 3
MAX_LENGTH = 2**31 - 1


def branches(pattern: str) -> list[str]:
    """Parts of a pattern between the bars that are in no group."""
    depth, parts = 0, [""]
    for token in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def literal_first(pattern: str) -> str:
    r"""The same pattern with the plain text after a leading ``\b`` put before it, in every branch.

    A word border costs a look at two Unicode classes wherever the search stops. Compared first, the plain text turns
    most places down, and the border is looked up behind it. Where a group or a number follows the border, a look at
    its first letters does the same. Matches begin and end where they did.
    """

    def turned(part: str) -> str:
        hit = re.match(r"\\b([a-z][a-z ]*)(.*)\Z", part)
        if not hit:
            return _first_letters(part) + part
        plain, rest = hit.groups()
        if rest[:1] in ("?", "*", "+", "{") and rest:
            plain, rest = plain[:-1], plain[-1] + rest
        return f"{plain}(?<=\\b{plain}){rest}" if plain else part

    return "|".join(map(turned, branches(pattern)))


def _first_letters(part: str) -> str:
    r"""Look-ahead for what comes after a leading ``\b``: a number, or one of several words in a group."""
    if re.match(r"\\b\(\\d", part):
        return r"(?=\d)"
    group = re.match(r"\\b\(\?:([^()]*)\)(?![?*{])", part)
    words = group.group(1).split("|") if group else []
    if not words or not all(re.match(r"[a-z](?![?*{])", w) for w in words):
        return ""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])"


#: What is left in a folded text of letters that a pattern that ignores case reads as i or s.
ODD_FOLDED = ("i\u0307", "ı", "ſ")


def found(text: Column, pattern: str, folded: Column | None = None) -> Column:
    """True when the pattern occurs. With the folded text it only runs where the plain text of a branch occurs."""
    hit = text.rlike(ANY + literal_first(pattern))
    plain = [required_text(part) for part in branches(pattern)]
    return hit if folded is None or not all(plain) else holds_any(folded, *plain, *ODD_FOLDED) & hit


def leading_text(pattern: str) -> str:
    """Plain text that every match of a pattern begins with, empty when there is none."""
    if len(branches(pattern)) > 1:
        return ""
    hit = re.match(r"(?:\\b|\(\?<!\\w\))?((?:[a-z0-9 #]|\\\.)*)(.?)", pattern)
    plain, after = hit.groups()
    if after in ("?", "*", "+", "{") and after:
        plain = plain.removesuffix(r"\.") if plain.endswith(r"\.") else plain[:-1]
    return plain.replace("\\", "")


def aligned(text: Column, folded: Column) -> Column:
    """True when every letter of the text is one letter of the folded text and one unit of Java's, and none is odd."""
    units = F.octet_length(F.encode(text, "UTF-16LE"))
    return (F.length(text) == F.length(folded)) & (units == 2 * F.length(text)) & ~holds_any(folded, *ODD_FOLDED)


def from_lead(text: Column, folded: Column, even: Column, pattern: str, use) -> Column:
    """``use(tail, before)``: the text from shortly before the first place where a match may begin, and what is cut off.

    ``even`` is :func:`aligned`; other texts are searched as a whole. Two letters before that place are left, so a
    border is judged as in the whole text, and no match can begin in them.
    """
    lead = leading_text(pattern)
    if len(lead) < 2:
        return use(text, F.lit(0))
    before = F.when(even, F.greatest(F.locate(lead, folded) - 3, F.lit(0))).otherwise(0)
    return T.bind(before, lambda n: use(F.substring(text, n + 1, F.lit(MAX_LENGTH)), n))


def pattern_flags(pattern: str) -> str:
    """All patterns ignore case, but for the single letter R."""
    return "(?U)" if ")R(" in pattern else ANY


def required_text(pattern: str) -> str | None:
    """Longest plain text that every match of a pattern holds, null when there is none.

    Searching plain text is far cheaper than running a Unicode-aware pattern, and most labels
    occur in few posts.
    """
    plain = pattern.lower()
    while re.search(r"\([^()]*\)\??", plain):
        plain = re.sub(r"\([^()]*\)\??", "\0", plain)
    plain = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[?*+])?", "\0", plain)
    plain = re.sub(r"\\([.#])", r"\1", plain)
    plain = re.sub(r"\\[a-z][*+?]?", "\0", plain)
    plain = re.sub(r"[a-z0-9.#][?*]", "\0", plain)
    if "|" in plain:
        return None
    parts = re.findall(r"[a-z0-9 .#'-]+", plain)
    longest = max(parts, key=len, default="")
    return longest if len(longest) > 1 else None


def guarded(folded: Column, pattern: str, value: Column) -> Column:
    """The value where the plain text of the pattern occurs, else null."""
    plain = required_text(pattern)
    return value if plain is None else F.when(folded.contains(plain), value)


def holds_any(folded: Column, *plain: str) -> Column:
    test = folded.contains(plain[0])
    for other in plain[1:]:
        test = test | folded.contains(other)
    return test


def first_position(text: Column, patterns, folded: Column | None = None, even: Column | None = None) -> Column:
    """Earliest start over all patterns, null when none occurs."""
    low = folded if folded is not None else T.fold_case(text)
    straight = even if even is not None else aligned(text, low)

    def spot(p):
        at = lambda tail, cut: F.nullif(F.regexp_instr(tail, F.lit(pattern_flags(p) + literal_first(p))), F.lit(0)) + cut
        return guarded(low, p, from_lead(text, low, straight, p, at))

    spots = [spot(p) for p in patterns]
    return F.least(*spots) if len(spots) > 1 else spots[0]


def vocabulary_labels(text: Column, name: str, folded: Column | None = None, even: Column | None = None) -> Column:
    """Labels of a vocabulary that occur, ordered by first position."""
    hits = [
        F.struct(
            first_position(text, patterns, folded, even).alias("pos"), F.lit(i).alias("ord"),
            F.lit(label).alias("label"),
        )
        for i, (label, patterns) in enumerate(V.VOCABULARIES[name].items())
    ]
    found_ones = F.filter(F.array(*hits), lambda h: h.pos.isNotNull())
    return F.transform(F.array_sort(found_ones), lambda h: h.label)


def verbatim(text: Column, patterns, folded: Column | None = None, even: Column | None = None) -> Column:
    """First quote of each phrase, ordered by position, at most eight: a limit of the record."""
    low = folded if folded is not None else T.fold_case(text)
    straight = even if even is not None else aligned(text, low)

    def hit(p):
        def told(tail, cut):
            quote = F.regexp_extract(tail, f"{ANY}({literal_first(p)})", 1)
            clean = F.regexp_replace(T.collapse_spaces(quote), r"^[ ,.;:]+|[ ,.;:]+$", "")
            return T.bind(clean, _placed(F.regexp_instr(tail, F.lit(ANY + literal_first(p))) + cut))

        return guarded(low, p, from_lead(text, low, straight, p, told))

    told = F.array_compact(F.array(*map(hit, patterns)))
    return F.transform(F.slice(F.array_sort(told), 1, VERBATIM), lambda h: h.value)


def _placed(at: Column):
    return lambda value: F.when(value != "", F.struct(at.alias("pos"), value.alias("value")))


def _years(text: Column, index: int) -> Column:
    """First hit of one years pattern. Numbers are read from the hit, not from the text again."""
    pattern, kind = V.YEARS[index]

    def told(whole):
        numbers = F.transform(F.regexp_extract_all(whole, F.lit(r"(?U)(\d+)"), F.lit(1)), lambda n: n.try_cast("int"))
        first, top = F.get(numbers, F.lit(0)), F.array_max(numbers)
        plus = F.concat(first, F.lit("+"))
        shown = {
            "range": F.array_join(F.transform(numbers, lambda n: n.cast("string")), "-"),
            "minimum": F.when(whole.contains("+") | found(whole, "minimum|at least"), plus).otherwise(first.cast("string")),
            "open": plus,
            "limit": F.concat(F.lit("0-"), first),
            "plain": first.cast("string"),
        }[kind]
        return F.when(
            whole != "",
            F.struct(
                (F.regexp_instr(text, F.lit(ANY + literal_first(pattern))) - 1 + index).alias("key"),
                F.lit(index).alias("ord"), shown.alias("shown"), top.alias("top"),
            ),
        )

    return T.bind(F.regexp_extract(text, f"{ANY}({literal_first(pattern)})", 1), told)


#: One of these is in every hit of a years pattern that begins with words.
YEARS_WORDS = {"minimum": ("min", "at least"), "limit": ("up to", "max")}


def experience(text: Column, folded: Column | None = None) -> Column:
    """Struct of shown years and their maximum.

    The key of a hit is its position plus the number of its pattern, as published.
    """
    low = folded if folded is not None else T.fold_case(text)
    words = lambda kind: holds_any(low, *YEARS_WORDS[kind], *ODD_FOLDED) if kind in YEARS_WORDS else F.lit(True)
    hits = F.array(*[
        F.when(holds_any(low, "year", "yr") & words(kind), _years(text, i)) for i, (_, kind) in enumerate(V.YEARS)
    ])
    none = F.when(
        found(text, V.NO_EXPERIENCE, low), F.struct(F.lit("0").alias("shown"), F.lit(0).alias("top"))
    ).otherwise(F.struct(F.lit("Not specified").alias("shown"), F.lit(None).cast("int").alias("top")))
    best = F.transform(
        F.slice(F.array_sort(F.array_compact(hits)), 1, 1),
        lambda h: F.struct(h.shown.alias("shown"), h.top.alias("top")),
    )
    return T.bind(best, lambda b: F.when(F.size(b) > 0, F.get(b, F.lit(0))).otherwise(none))


def qualification(text: Column, folded: Column | None = None) -> Column:
    """Degree wish by the words around each degree word, the first telling one decides."""
    low = folded if folded is not None else T.fold_case(text)
    degree = holds_any(low, "bachelor", "degree", "bsc", "bcom", "diploma", "tertiary")

    def step(acc, item):
        start = acc.pos + F.length(item.piece)
        end = start + F.length(item.word)

        def judge(context):
            return F.when(found(context, V.DEGREE_PREFERRED), "Degree preferred").when(
                found(context, V.DEGREE_REQUIRED), "Degree required"
            )

        from_ = F.greatest(start - 100, F.lit(0))
        told = T.bind(F.substring(text, from_ + 1, end + 100 - from_), judge)
        return F.struct(end.alias("pos"), F.when(acc.told.isNotNull(), acc.told).otherwise(told).alias("told"))

    def walk(hit):
        between = F.arrays_zip(F.slice(hit.pieces, 1, F.size(hit.words)).alias("piece"), hit.words.alias("word"))
        start = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("told"))
        told = F.aggregate(between, start, step, lambda acc: acc.told)
        return F.when(F.size(hit.words) > 0, F.coalesce(told, F.lit("Degree required")))

    hit = F.struct(
        F.split(text, ANY + literal_first(V.DEGREE), -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(f"{ANY}({literal_first(V.DEGREE)})"), F.lit(1)).alias("words"),
    )
    other = F.when(
        holds_any(low, "certificat", "bootcamp") & found(text, V.CERTIFICATE), "Certificate/bootcamp mentioned"
    ).otherwise("No qualification specified")
    return F.coalesce(F.when(degree, T.bind(hit, walk)), other)


def portfolio(text: Column, folded: Column | None = None) -> Column:
    """Struct of the request flag and its level, from the sentence around the request."""
    low = folded if folded is not None else T.fold_case(text)

    def asked(pattern):
        def told(hit):
            start = F.regexp_instr(text, F.lit(ANY + literal_first(pattern)))

            def judge(span):
                # cut at the last and the next full stop or line end
                before = F.translate(F.substring(text, F.lit(1), span.start - 1), "\n", ".")
                after = F.translate(
                    F.substring(text, span.start + F.length(hit), F.length(text)), "\n", "."
                )
                left = F.substring_index(before, ".", -1)
                right = F.when(after.contains("."), F.substring_index(after, ".", 1)).otherwise(
                    F.substring(after, 1, 100)
                )
                optional = found(F.concat(left, hit, right), V.PORTFOLIO_OPTIONAL)
                return F.when(optional, "Preferred").otherwise("Required")

            return F.when(hit != "", T.bind(F.struct(start.alias("start")), judge))

        return T.bind(F.regexp_extract(text, f"{ANY}({literal_first(pattern)})", 1), told)

    may = holds_any(low, "portfolio", "github", "code sample")
    level = F.coalesce(*[F.when(may, asked(p)) for p in V.PORTFOLIO])
    return T.bind(
        F.coalesce(level, F.lit("Not Mentioned")),
        lambda x: F.struct(
            F.when(x == "Not Mentioned", "N").otherwise("Y").alias("requested"), x.alias("level")
        ),
    )


def labelled_value(paragraphs: Column, label: str) -> Column:
    """Value of the first ``Label: value`` among the first twelve paragraphs."""
    pattern = rf"{ANY}\A\s*{T.java_quote(label)}\s*[:\-]\s*(.+)\z"
    values = F.transform(F.slice(paragraphs, 1, 12), lambda p: F.regexp_extract(p, pattern, 1))
    return T.strip(F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit("")))


def fallback_title(paragraphs: Column) -> Column:
    titled = F.filter(
        F.slice(paragraphs, 1, 8),
        lambda p: (F.length(p) <= 120) & found(p, V.ROLE_WORDS) & ~p.endswith("."),
    )
    return F.coalesce(
        F.nullif(labelled_value(paragraphs, "job title"), F.lit("")),
        F.nullif(labelled_value(paragraphs, "position"), F.lit("")),
        F.get(titled, F.lit(0)), F.lit(""),
    )


def places(text: Column, folded: Column | None = None) -> Column:
    """Up to three place names by position. ``folded`` holds the folded text, and may hold more."""
    low = folded if folded is not None else T.fold_case(text)

    def hit(name, odd):
        quoted = T.java_quote(name)
        pattern = rf"{ANY}{quoted}(?<=\b{quoted})\b"
        at = F.regexp_instr(text, F.lit(pattern))
        return F.when(
            (odd | low.contains(name.lower())) & (at > 0),
            F.struct(at.alias("pos"), F.regexp_extract(text, f"({pattern})", 1).alias("value")),
        )

    # letters that the pattern reads as i or s, and that folding may leave or take apart; looked for once a text
    odd_letters = holds_any(low, *ODD_FOLDED)
    hits = T.bind(odd_letters, lambda odd: F.array(*[hit(name, odd) for name in V.PLACES]))
    ordered = F.array_sort(F.array_compact(hits))
    return F.array_join(F.transform(F.slice(ordered, 1, PLACES_SHOWN), lambda h: h.value), ", ")


def fallback_location(paragraphs: Column, text: Column, folded: Column | None = None) -> Column:
    return F.coalesce(F.nullif(labelled_value(paragraphs, "location"), F.lit("")), places(text, folded))


def work_type(text: Column, location_type: Column, folded: Column | None = None) -> Column:
    remote = F.lower(F.coalesce(location_type, F.lit(""))).contains("telecommute")
    chain = F.when(remote, "Remote")
    for name, pattern in V.WORK_TYPES:
        chain = chain.when(found(text, pattern, folded), name)
    return chain.otherwise("")


def label_keys(labels: Column) -> Column:
    """Labels as they are looked for in a paragraph."""
    return F.transform(labels, lambda x: F.split_part(F.lower(x), F.lit(" ("), F.lit(1)))


def requirement_score(paragraph: Column, low: Column, keys: Column) -> Column:
    """How much a paragraph speaks of requirements. ``low`` is its lower-case form."""
    # lower case leaves letters that the patterns read as s, i or k
    odd = holds_any(low, *ODD_FOLDED)
    fits = lambda pattern: holds_any(low, *map(required_text, branches(pattern))) | odd
    named = F.size(F.filter(keys, lambda key: low.contains(key)))
    talk = F.when(fits(V.PAGE_TALK) & found(paragraph, V.PAGE_TALK), 5).otherwise(0)
    length = F.least(F.floor(F.length(paragraph) / 120), F.lit(4)).cast("int")
    asked = F.regexp_count(paragraph, F.lit(ANY + literal_first(V.REQUIREMENT_WORDS)))
    return F.when(fits(V.REQUIREMENT_WORDS), asked).otherwise(0) * 4 + named * 2 + length - talk


def key_requirements(paragraphs: Column, keys: Column) -> Column:
    """The paragraph with the best score, the first one on a tie."""
    long_ones = F.transform(
        F.filter(paragraphs, lambda p: F.length(p) >= 40),
        lambda p, i: F.struct(p.alias("text"), F.lower(p).alias("low"), (-i).alias("place")),
    )
    scored = F.transform(
        long_ones,
        lambda x: F.struct(
            requirement_score(x.text, x.low, keys).alias("score"), x.place.alias("place"), x.text.alias("text")
        ),
    )
    best = F.array_max(F.filter(scored, lambda x: x.score > -1))
    return F.coalesce(F.substring(best.text, 1, KEY_CHARS), F.lit(""))


def location_warning(location: Column, country: Column, text: Column) -> Column:
    combined = F.lower(F.concat_ws(" ", location, country))
    names = [place.lower() for place in V.PLACES]
    # the text is put in lower case once, and only where the location alone does not tell
    known = holds_any(combined, *names) | T.bind(F.lower(text), lambda low: holds_any(low, *names))
    return (
        F.when(combined.rlike("(?U)" + V.COUNTRY) | known, F.lit(None).cast("string"))
        .when(
            country != "",
            F.format_string("Location appears to be outside South Africa (%s).", country),
        )
        .otherwise("South African location could not be confirmed.")
    )


def name_from_json(value: Column) -> Column:
    """Name of a JSON object (``name``, then ``legalName``), or the JSON text itself. Fields are plain text."""
    named = F.coalesce(
        F.nullif(F.get_json_object(value, "$.name"), F.lit("")), F.get_json_object(value, "$.legalName")
    )
    return T.collapse_spaces(F.coalesce(F.when(value.startswith("{"), named).otherwise(value), F.lit("")))


ADDRESS = "struct<addressLocality:string,addressRegion:string,addressCountry:string>"


def location_from_json(value: Column) -> Column:
    """Struct of location and country from a JSON location, or a list of them."""
    listed = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
    places_ = F.from_json(listed, f"array<struct<address:{ADDRESS}>>")
    country = lambda a: F.when(
        a.addressCountry.startswith("{"), F.coalesce(F.get_json_object(a.addressCountry, "$.name"), F.lit(""))
    ).otherwise(F.coalesce(a.addressCountry, F.lit("")))
    shown = F.transform(
        places_,
        lambda p: F.array_join(
            F.filter(
                F.array(
                    T.collapse_spaces(F.coalesce(p.address.addressLocality, F.lit(""))),
                    T.collapse_spaces(F.coalesce(p.address.addressRegion, F.lit(""))),
                    T.collapse_spaces(country(p.address)),
                ),
                lambda x: x != "",
            ),
            ", ",
        ),
    )
    return F.struct(
        F.array_join(F.filter(shown, lambda x: x != ""), "; ").alias("location"),
        F.array_join(F.filter(F.transform(places_, lambda p: country(p.address)), lambda x: x != ""), ", ").alias("country"),
    )


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def combined_text(title: Column, body: Column) -> Column:
    return F.array_join(
        F.filter(F.array(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), lambda v: v != ""), "\n"
    )
