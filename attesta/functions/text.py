"""Text functions as Column expressions: normalising, sentences, tokens and cue phrases."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware engine sees it; Java's plain \s is ASCII only.
SPACE = r"[\s\x1c-\x1f]"
STRIP = rf"(?U)\A{SPACE}+|{SPACE}+\z"
BEFORE = "(?<![A-Za-z0-9])"
AFTER = "(?![A-Za-z0-9])"
FROM_TO = rf"(?iuU){BEFORE}from\s+\S.{{0,80}}?\s+to{AFTER}"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
# Named-only evidence quotes the block up to this length, fixed value.
QUOTE_CHARS = 240


def java_quote(text: str) -> str:
    """Escape a phrase for a Java pattern."""
    return re.sub(r"([^A-Za-z0-9\s])", r"\\\1", text)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Cut Unicode whitespace at both ends. Texts without any there are not searched."""
    edge = lambda t, at: F.substring(t, at, 1).rlike(rf"(?U){SPACE}")
    return bind(col, lambda t: F.when(edge(t, 1) | edge(t, -1), F.regexp_replace(t, STRIP, "")).otherwise(t))


def collapse_spaces(col: Column) -> Column:
    """One blank for every whitespace run, none at the ends. Plain texts with single blanks only are not searched."""
    odd = lambda t: t.contains("  ") | t.rlike("[^ -~]")
    return bind(
        col,
        lambda t: F.trim(F.when(odd(t), F.regexp_replace(t, rf"(?U){SPACE}+", " ")).otherwise(t)),
    )


def fold_case(col: Column) -> Column:
    """Case-insensitive key. Upper before lower also folds letters such as the long s."""
    return F.lower(F.upper(col))


def _where(col: Column, held: Iterable[str], use) -> Column:
    """``use(text)`` for texts that hold one of the plain texts; all others stay as they are."""
    wanted = lambda t: reduce(or_, (t.contains(plain) for plain in held))
    return bind(col, lambda t: F.when(wanted(t), use(t)).otherwise(t))


def _single_blanks(col: Column) -> Column:
    """Plain line ends and single blanks."""
    lines = _where(col, ["\r"], lambda t: F.regexp_replace(t, "\r\n?", "\n"))
    # a single plain blank stays as it is
    odd = ["  ", "\t", "\f", "\x0b", "\xa0"]
    return _where(lines, odd, lambda t: F.regexp_replace(t, "[ \\t\\f\\x0b\\xa0]+", " "))


def _lines(col: Column) -> Column:
    """Array of the trimmed non-empty lines."""
    return F.filter(F.transform(F.split(col, "\n"), strip), lambda line: line != "")


def normalize_text(col: Column) -> Column:
    """Plain line ends, single blanks, trimmed lines and no empty lines."""
    return strip(_where(_single_blanks(col), ["\n"], lambda t: F.array_join(_lines(t), "\n")))


def split_lines(col: Column) -> Column:
    """Array of the non-empty normalised lines."""
    return _lines(_single_blanks(col))


def split_sentences(col: Column) -> Column:
    """Array of sentences: cut after ``.``, ``!`` or ``?`` and at line ends."""
    parts = F.split(col, rf"(?U)(?<=[.!?]){SPACE}+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def word_count(col: Column) -> Column:
    """Number of whitespace-separated tokens."""
    text = collapse_spaces(col)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("int")


def has_words(col: Column, least: int) -> Column:
    """True when ``word_count`` is ``least`` or more; no more of the text is read than it takes."""
    return col.rlike(rf"(?U)\A(?:{SPACE}*+[^\s\x1c-\x1f]++){{{least}}}")


def quote_text(col: Column) -> Column:
    """Normalised text, cut at the quote length."""
    return F.regexp_replace(
        F.substring(normalize_text(col), 1, QUOTE_CHARS), rf"(?U){SPACE}+\z", ""
    )


def named_only_text(block: Column, matched: Column) -> Column:
    """The whole block when it is short, else the matched words."""
    text = normalize_text(block)
    return F.when(F.length(text) <= QUOTE_CHARS, text).otherwise(matched)


def _longest_first(phrases: Iterable[str]) -> str:
    """Alternation that reads the longest phrase, factored letter by letter so that most starts fail fast."""
    groups: dict[str, list[str]] = {}
    for phrase in sorted(phrases):
        groups.setdefault(phrase[:1].lower(), []).append(phrase[1:])
    ends = groups.pop("", None) is not None
    parts = [java_quote(first) + _longest_first(rest) for first, rest in groups.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if ends else "")


# Letters beyond ASCII that a Unicode-aware engine takes for s, k and i when it ignores case.
ODD_LETTERS = ("\u017f", "\u212a", "\u0131", "\u0130")


def any_case(col: Column, phrases: Iterable[str], search) -> Column:
    """``search(flags)`` with the flags that ignore case: the Unicode-aware ones, which are slow, only where they matter."""
    if not all(p.isascii() for p in phrases):
        return search("iu")
    odd = reduce(or_, (col.contains(letter) for letter in ODD_LETTERS))
    return F.when(odd, search("iu")).otherwise(search("i"))


def token_pattern(phrases: Iterable[str], prefix_only: bool = False, flags: str = "iu") -> str:
    """Java pattern of phrases between token ends, ignoring case."""
    unique = list(dict.fromkeys(p for p in phrases if p))
    return f"(?{flags}){BEFORE}{_longest_first(unique)}" + ("" if prefix_only else AFTER)


def has_cue(col: Column, phrases: Iterable[str], prefix_only: bool = False) -> Column:
    """True when one of the phrases occurs as whole tokens."""
    return col.rlike(token_pattern(phrases, prefix_only))


def alias_pattern(aliases: Iterable[str], case_sensitive: Iterable[str], flags: str = "iu") -> str:
    """One alternation for all aliases, longest first.

    Scanning with it yields the leftmost-longest, non-overlapping hits, so no regex join against
    the alias table is needed. Group 1 is the hit.
    """
    exact = sorted(set(case_sensitive), key=lambda a: (-len(a), a))
    loose = [a for a in aliases if a not in exact]
    nested = any(e.lower().startswith(a.lower()) and len(a) < len(e) for e in exact for a in loose)
    if nested:
        ordered = sorted([*exact, *loose], key=lambda a: (-len(a), a))
        parts = [java_quote(a) if a in exact else f"(?{flags}:{java_quote(a)})" for a in ordered]
    else:
        parts = [f"(?{flags}:{_longest_first(loose)})", *map(java_quote, exact)]
    return f"{BEFORE}({'|'.join(parts)}){AFTER}"


def alias_hits(col: Column, aliases: Iterable[str], case_sensitive: Iterable[str]) -> Column:
    """Array of the alias texts that occur, in order."""
    return any_case(
        col, aliases,
        lambda flags: F.regexp_extract_all(col, F.lit(alias_pattern(aliases, case_sensitive, flags)), F.lit(1)),
    )


class CueScanner:
    """Finds the cue groups of a text in one pass over it.

    A zero-width scan reads the longest phrase at every token start, so overlapping phrases of
    different groups are all seen. A phrase that another one starts with is added by a lookup.
    """

    def __init__(self, groups: Mapping[str, Iterable[str]], prefixes: Iterable[str] = ()):
        self.members: dict[str, set[str]] = {}
        owners: dict[str, set[str]] = {}
        for group, phrases in groups.items():
            for phrase in phrases:
                owners.setdefault(phrase.lower(), set()).add(group)
        for phrase in owners:
            found: set[str] = set()
            for other, names in owners.items():
                rest = phrase[len(other):]
                if phrase.startswith(other) and not re.match("[a-z0-9]", rest):
                    found |= names
            self.members[phrase] = found
        self.open_ended = [p.lower() for p in prefixes]
        self.closed = [p for p in self.members if p not in self.open_ended]

    def pattern(self, flags: str) -> str:
        body = _longest_first(self.closed) + AFTER
        if self.open_ended:
            body += "|" + "|".join(java_quote(p) for p in self.open_ended)
        return f"(?{flags}){BEFORE}(?=({body}))"

    def groups(self, col: Column) -> Column:
        """Array of the cue groups found in the text."""
        hits = any_case(
            col, self.members, lambda flags: F.regexp_extract_all(col, F.lit(self.pattern(flags)), F.lit(1))
        )
        names = F.create_map(
            *[
                part
                for phrase, found in self.members.items()
                for part in (F.lit(phrase), F.array(*[F.lit(g) for g in sorted(found)]))
            ]
        )
        return F.array_distinct(F.flatten(F.transform(hits, lambda h: names[fold_case(h)])))

    def may_hold(self, texts: Column, others: Iterable[str] = ()) -> Column:
        """Array of booleans, false for texts of an array that hold none of these phrases nor of the ``others``."""
        return _may_hold([*self.closed, *(o for o in others if o)], self.open_ended)(texts)


def _may_hold(closed: Iterable[str], open_ended: Iterable[str]):
    """Arrow function: which texts of an array the patterns need to be tried on.

    Arrow searches without backtracking, which takes a fraction of the time of Java's patterns. It may say yes too often:
    texts with one of ``ODD_LETTERS`` always pass, and a letter beyond ASCII in a phrase stands for any.
    """
    any_letter = lambda phrase: re.sub(r"\\?[^\x00-\x7f]", ".", java_quote(phrase))
    whole = "|".join(map(any_letter, sorted(set(closed))))
    parts = [f"(?:{whole})(?:$|[^A-Za-z0-9])", *map(any_letter, open_ended)]
    # the odd letters stand outside of the group that ignores case, where they would match s, k and i
    pattern = f"(?is:(?:^|[^A-Za-z0-9])(?:{'|'.join(parts)}))|[{''.join(ODD_LETTERS)}]"

    def search(lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.match_substring_regex(lists.flatten(), pattern)
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, found, mask=lists.is_null())

    return F.arrow_udf(search, "array<boolean>")
