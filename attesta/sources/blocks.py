"""Text blocks with locators from plain text, document lines and pasted posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.sources.html import html_blocks

# a paragraph ends at an empty line; pasted text also at a line that starts with a bullet
BULLET = r"(?mU)\n\s*\n|^\s*[•●▪*-]\s+"


def plain_paragraphs(body: Column) -> Column:
    """Array of paragraphs, parted by blank lines, each on one line."""
    lines = F.replace(F.regexp_replace(body, "\r\n?", "\n"), F.lit(" "), F.lit(" "))
    parts = F.split(lines, rf"(?U)\n(?:{T.SPACE}*\n)+")
    flat = F.transform(parts, lambda p: F.replace(T.normalize_text(p), F.lit("\n"), F.lit(" ")))
    return F.filter(flat, lambda p: p != "")


def plain_blocks(df: DataFrame, key: str, body: str) -> DataFrame:
    """Paragraph blocks ``text:p:n``."""
    rows = df.select(key, F.posexplode(plain_paragraphs(F.col(body))).alias("block_ord", "text"))
    return rows.select(
        key, "block_ord", F.format_string("blk-text-%04d", F.col("block_ord") + 1).alias("block_id"),
        F.concat(F.lit("text:p:"), F.col("block_ord") + 1).alias("locator"), "text",
    )


def line_blocks(df: DataFrame, key: str, body: str, page: Column | None = None) -> DataFrame:
    """One block per line ``page p, block n``."""
    number = page if page is not None else F.lit(1)
    rows = df.select(
        key, number.alias("page"), F.posexplode(T.split_lines(F.col(body))).alias("block_ord", "text")
    )
    n = F.col("block_ord") + 1
    return rows.select(
        key, "block_ord", F.format_string("blk-p%04d-%04d", F.col("page"), n).alias("block_id"),
        F.concat(F.lit("page "), F.col("page"), F.lit(", block "), n).alias("locator"), "text",
    )


def visible_blocks(bodies: DataFrame) -> DataFrame:
    """Blocks of fetched bodies by media type. ``bodies``: page_id, media_type, body."""
    is_html = F.col("media_type").isin("text/html", "application/xhtml+xml")
    marked = html_blocks(bodies.filter(is_html).select("page_id", F.col("body").alias("html")))
    return marked.unionByName(plain_blocks(bodies.filter(~is_html), "page_id", "body"))


def manual_paragraphs(text: Column) -> Column:
    """Paragraphs of pasted text, split at blank lines and bullets."""
    parts = F.filter(F.transform(F.split(text, BULLET), T.collapse_spaces), lambda p: p != "")
    return T.bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(T.collapse_spaces(text))))


def with_distinct_paragraphs(df: DataFrame, paragraphs: Column, name: str) -> DataFrame:
    """Paragraphs in order, later copies (ignoring case) left out.

    The cleaned and the folded array become columns first: inside a lambda they would be computed
    anew for every element.
    """
    cleaned = df.withColumn(
        "_clean", F.filter(F.transform(paragraphs, T.collapse_spaces), lambda p: p != "")
    ).withColumn("_folded", F.transform("_clean", T.fold_case))
    first = F.filter(
        "_clean",
        lambda p, i: F.array_position("_folded", F.get("_folded", i)) == i + 1,
    )
    return cleaned.withColumn(name, first).drop("_clean", "_folded")


def without_repeats(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Drop a row whose text equals that of the row before it."""
    from pyspark.sql import Window

    before = F.lag(text).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col(text))
    ).drop("_before")


def is_page_frame(paragraph: Column) -> Column:
    from attesta.registry.post_values import PAGE_FRAME

    low = T.strip(F.lower(paragraph))
    return low.isin(*PAGE_FRAME) | ((F.length(low) < 40) & low.startswith("cookie settings"))
