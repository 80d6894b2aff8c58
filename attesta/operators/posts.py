"""Job posts: records, warnings, validation, duplicates, IDs and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import posts as P
from attesta.functions import text as T
from attesta.functions import urls as U
from attesta.operators.ordering import first_of_both, number_in_ranges
from attesta.registry import post_values as V
from attesta.sources.blocks import with_distinct_paragraphs

MIN_PAGE_WORDS = 60
MIN_POST_WORDS = 100
SENIOR_YEARS = 5
LEVELS = ("Required", "Preferred", "Not Mentioned")


def too_little_content(text: Column, json_ld: Column) -> Column:
    """A page with few words and no JSON-LD cannot be used."""
    return (T.word_count(text) < MIN_PAGE_WORDS) & (F.size(json_ld) == 0)


def with_text(pages: DataFrame) -> DataFrame:
    """Paragraphs, body and combined text of parsed pages or pasted posts.

    ``pages``: page_id, url, track, text, paragraphs, metadata, job (JSON), job_paragraphs.
    """
    job = lambda path: F.coalesce(F.get_json_object("job", path), F.lit(""))
    listed = F.concat(F.coalesce("job_paragraphs", F.array().cast("array<string>")), "paragraphs")
    return (
        with_distinct_paragraphs(pages, listed, "paragraphs")
        .withColumn("body", P.first_non_empty(F.array_join("paragraphs", "\n"), F.col("text")))
        .withColumn("job_title", T.collapse_spaces(job("$.title")))
        .withColumn("combined", P.combined_text(F.col("job_title"), F.col("body")))
        .withColumn("folded", T.fold_case(F.col("combined")))
        .withColumn("place", P.location_from_json(F.get_json_object("job", "$.jobLocation")))
        .withColumn("employer", P.name_from_json(F.get_json_object("job", "$.hiringOrganization")))
    )


def vocabulary_columns(text: Column, folded: Column, even: Column | None = None) -> dict[str, Column]:
    return {name: P.vocabulary_labels(text, name, folded, even) for name in V.VOCABULARIES}


def fields(rows: DataFrame) -> DataFrame:
    """The record fields that depend on text only."""
    text = F.col("combined")
    meta = lambda key: F.coalesce(F.col("metadata")[key], F.lit(""))
    se = F.col("track") == "SE Track"
    low = F.col("folded")
    even = F.col("aligned")
    picks = vocabulary_columns(text, low, even)
    both = lambda a, b: F.when(se, picks[a]).otherwise(picks[b])
    return rows.withColumn("aligned", P.aligned(text, low)).select(
        "page_id", "url", "track", "combined", "paragraphs",
        P.first_non_empty(
            F.col("job_title"), meta("h1"), meta("og:title"), P.fallback_title(F.col("paragraphs"))
        ).alias("title"),
        P.first_non_empty(
            F.col("employer"), meta("og:site_name"), P.labelled_value(F.col("paragraphs"), "company")
        ).alias("company"),
        P.first_non_empty(
            F.col("place.location"), P.fallback_location(F.col("paragraphs"), F.col("body"), low)
        ).alias("location"),
        F.coalesce("place.country", F.lit("")).alias("country"),
        P.work_type(text, F.get_json_object("job", "$.jobLocationType"), low).alias("work_type"),
        U.source_name(F.col("url")).alias("source"),
        F.substring(T.collapse_spaces(F.coalesce(F.get_json_object("job", "$.datePosted"), F.lit(""))), 1, 10).alias("date_posted"),
        P.experience(text, low).alias("years"),
        P.qualification(text, low).alias("qualification"),
        both("languages", "core").alias("primary_skills"),
        both("frameworks", "reporting").alias("secondary_skills"),
        both("se_tools", "da_tools").alias("tools"),
        F.when(F.when(se, P.found(text, V.SE_FLAG, low)).otherwise(P.found(text, V.DA_FLAG, low)), "Y")
        .otherwise("N")
        .alias("named_flag"),
        P.portfolio(text, low).alias("portfolio"),
        F.array_join(P.verbatim(text, V.SOFT_SKILLS, low, even), ", ").alias("soft_skills"),
        F.array_join(P.verbatim(text, V.READINESS, low, even), ", ").alias("readiness_signals"),
    )


def warnings() -> Column:
    """Warnings of a record in their fixed order."""
    se = F.col("track") == "SE Track"
    has = lambda c: F.size(c) > 0
    libraries = F.arrays_overlap("tools", F.array(*[F.lit(x) for x in V.LIBRARIES]))
    parts = [
        F.when(
            se & has("secondary_skills") & ~has("primary_skills"),
            "Frameworks were found but no programming language was explicitly named.",
        ),
        F.when(
            ~se & libraries & ~F.array_contains("primary_skills", "Python"),
            "Python libraries were found but Python was not explicitly named.",
        ),
        P.location_warning(F.col("location"), F.col("country"), F.col("combined")),
        F.when(
            F.col("years.top") >= SENIOR_YEARS,
            F.format_string(
                "Experience requirement appears to be %s; the collection excludes 5+ year roles.",
                F.col("years.shown"),
            ),
        ),
        F.when(
            P.found(F.col("title"), V.SENIOR),
            "The title appears senior and may fall outside the collection rules.",
        ),
        F.when(
            ~T.has_words(F.col("combined"), MIN_POST_WORDS),
            "Very little requirement text was extracted; check the page or use the paste fallback.",
        ),
    ]
    for label, column in (
        ("job title", "title"), ("company", "company"), ("location", "location"),
        ("work type", "work_type"), ("date posted", "date_posted"),
        ("key requirements paragraph", "key_requirements"),
    ):
        parts.append(
            F.when(F.col(column) == "", f"Could not determine {label}; fill it in manually.")
        )
    return F.array_compact(F.array(*parts))


def extract_posts(pages: DataFrame, date_collected: Column) -> DataFrame:
    """One record of 21 columns per page, plus its list of warnings. No shuffle."""
    rows = fields(with_text(pages))
    keys = P.label_keys(F.concat("primary_skills", "secondary_skills", "tools"))
    keyed = rows.withColumn("_keys", keys).withColumn(
        "key_requirements", P.key_requirements(F.col("paragraphs"), F.col("_keys"))
    )
    noted = keyed.withColumn("warnings", warnings())
    listed = lambda c: F.array_join(c, ", ")
    return noted.select(
        "page_id", "track", F.lit("Generated when saved").alias("post_id"), "title", "company",
        "location", "work_type", "source", "url", "date_posted",
        date_collected.alias("date_collected"), F.col("years.shown").alias("experience_years"),
        "qualification", listed("primary_skills").alias("primary_skills"),
        listed("secondary_skills").alias("secondary_skills"), "named_flag",
        listed("tools").alias("tools"), F.col("portfolio.requested").alias("portfolio_requested"),
        F.col("portfolio.level").alias("requirement_level"), "soft_skills", "readiness_signals",
        "key_requirements", F.array_join("warnings", " | ").alias("notes"), "warnings",
    )


def post_error() -> Column:
    """Why a record may not be saved, null when it may."""
    flag = lambda c: F.upper(T.strip(F.coalesce(F.col(c), F.lit(""))))
    return (
        F.when(~F.col("track").isin(*V.TRACK_CODES), "UNKNOWN_TRACK")
        .when(~F.col("url").rlike(r"\A\s*https?://"), "INVALID_URL")
        .when(~flag("named_flag").isin("Y", "N"), "INVALID_NAMED_FLAG")
        .when(~flag("portfolio_requested").isin("Y", "N"), "INVALID_PORTFOLIO_FLAG")
        .when(~T.strip(F.col("requirement_level")).isin(*LEVELS), "INVALID_REQUIREMENT_LEVEL")
    )


def validated_level() -> Column:
    """A post without a portfolio request has no requirement level."""
    return F.when(F.upper("portfolio_requested") == "N", "Not Mentioned").otherwise(F.col("requirement_level"))


def signature(*cols: str) -> Column:
    """Key of title, company and location; null when one of them is empty."""
    parts = [T.fold_case(T.strip(F.coalesce(F.col(c), F.lit("")))) for c in cols]
    complete = parts[0] != ""
    for part in parts[1:]:
        complete = complete & (part != "")
    return F.when(complete, F.to_json(F.struct(*[p.alias(c) for c, p in zip(cols, parts)])))


def post_keys(posts: DataFrame) -> DataFrame:
    return posts.withColumn("url_key", U.url_key(F.col("url"))).withColumn(
        "signature", signature("title", "company", "location")
    )


def new_posts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming posts that repeat no saved post of their track, by URL or by signature.

    Two anti joins on single keys. Both sides carry each key once, so copies do not multiply.
    """
    fresh = post_keys(incoming)
    saved = post_keys(existing)
    for key in ("url_key", "signature"):
        known = saved.filter(F.col(key).isNotNull()).select("track", key).distinct()
        fresh = fresh.join(known, ["track", key], "left_anti")
    return fresh


def key_texts(keyed: DataFrame) -> DataFrame:
    """Both keys of ``post_keys`` as one text each with the track; null where the post has none."""
    text = lambda key: F.when(F.col(key).isNotNull(), F.concat_ws(" ", "track", key))
    return keyed.withColumn("url_text", text("url_key")).withColumn("signature_text", text("signature"))


def first_of_each(posts: DataFrame, order: str = "page_id") -> DataFrame:
    """Posts of one batch that repeat no earlier kept post of their track."""
    keyed = post_keys(posts)
    by_track = keyed.select(
        F.col(order),
        F.concat_ws(" ", "track", "url_key").alias("_url"),
        F.when(F.col("signature").isNotNull(), F.concat_ws(" ", "track", "signature")).alias("_sign"),
    )
    kept = first_of_both(by_track, order, "_url", "_sign").select(order)
    return keyed.join(kept, order, "left_semi")


def id_number(post_id: Column) -> Column:
    """Number at the end of a post ID, 0 when there is none."""
    return F.coalesce(F.regexp_extract(post_id, r"(\d+)$", 1).try_cast("int"), F.lit(0))


def highest_ids(existing: DataFrame) -> DataFrame:
    """Highest number in use per track code."""
    match = F.regexp_extract(F.col("post_id"), r"(?i)^([A-Z]+)-(\d+)$", 2).try_cast("int")
    code = F.upper(F.regexp_extract(F.col("post_id"), r"(?i)^([A-Z]+)-(\d+)$", 1))
    return (
        existing.select(code.alias("code"), match.alias("n"))
        .filter(F.col("n").isNotNull())
        .groupBy("code")
        .agg(F.max("n").alias("highest"))
    )


def track_code(track: Column) -> Column:
    chain = F
    for name, code in V.TRACK_CODES.items():
        chain = chain.when(track == name, code)
    return chain


def allocate_ids(posts: DataFrame, existing: DataFrame, order: str = "page_id") -> DataFrame:
    """Next IDs such as ``SE-001`` for new posts. Two tracks hold all rows, so numbering is split."""
    coded = posts.withColumn("code", track_code(F.col("track")))
    numbered = number_in_ranges(coded, ["code"], [order], "n")
    codes = highest_ids(existing).filter(F.col("code").isin(*V.TRACK_CODES.values()))  # one row a track at most
    joined = numbered.join(F.broadcast(codes), "code", "left")
    number = F.col("n") + F.coalesce("highest", F.lit(0))
    return joined.withColumn("post_id", F.concat(F.col("code"), F.lit("-"), F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0")))).drop("n", "highest", "code")


def guard_formula(col: Column) -> Column:
    """Cell text that a spreadsheet will not run as a formula."""
    return F.when(col.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def append_posts(posts: DataFrame, path: str) -> None:
    """Append records to the collection, one folder per track."""
    texts = {f.name for f in posts.schema.fields if f.dataType.simpleString() == "string"} - {"track"}
    guarded = posts.select(*[guard_formula(F.col(c)).alias(c) if c in texts else F.col(c) for c in posts.columns])
    guarded.write.mode("append").partitionBy("track").parquet(path)


def export_collection(posts: DataFrame, path: str) -> None:
    """The collection as CSV files in one folder; Spark keeps it in parts."""
    posts.write.mode("overwrite").option("header", True).csv(path)


def real_posts(posts: DataFrame) -> DataFrame:
    """Posts without the example rows."""
    return posts.filter(F.col("post_id").isNotNull() & (F.col("post_id") != "") & ~F.col("post_id").startswith("EXAMPLE"))


def track_counts(posts: DataFrame) -> DataFrame:
    return real_posts(posts).groupBy("track").agg(F.count(F.lit(1)).alias("n"))


def recent_posts(posts: DataFrame, order: str = "page_id") -> DataFrame:
    """The last three posts of each track, together six, by descending number.

    ``row_number`` with a small bound is cut per task before the shuffle.
    """
    last = Window.partitionBy("track").orderBy(F.col(order).desc())
    return (
        real_posts(posts)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= 3)
        .drop("_rn")
        .orderBy(id_number(F.col("post_id")).desc(), F.col("track").desc())
        .limit(6)
    )
