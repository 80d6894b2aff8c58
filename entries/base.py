"""Inputs of the registered queries, in Spark and in SQL.

The text tables hold invented words, so rule words are added: every line of a document is followed
by one phrase, chosen by document and line number. The SQL side builds the same tables.

* ``documents``: CVs. Lines and phrases are blocks, even documents are on the first track.
* ``conversations``: submitted links. Turns are paragraphs, each led by one phrase.
* ``labels``: ownership of a link, and whether it could be read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.registry.tables import DA, SE
from attesta.session import read_table
from entries.phrases import PHRASES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: a query under its name, with the SQL it has to equal."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def sql_values(name: str, columns: str, rows) -> str:
    """A CTE that holds literal rows."""

    def literal(value):
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (list, tuple)):
            return sql_list(value)
        return str(value) if isinstance(value, (int, float)) else q(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_ctes(*parts: str) -> str:
    """Join CTE texts and a final SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# Spark inputs ---------------------------------------------------------------------------------


def phrase(seed: Column) -> Column:
    # without a seed it is the last phrase: generated code took that one, evaluated code none
    place = F.coalesce((F.pmod(seed, F.lit(len(PHRASES))) + 1).cast("int"), F.lit(len(PHRASES)))
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), place)


def track_of(key: Column) -> Column:
    return F.when(F.pmod(key, F.lit(2)) == 0, SE).otherwise(DA)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return documents.select(
        F.col("doc_id").alias("run_id"), track_of(F.col("doc_id")).alias("track"),
        F.sha2("text", 256).alias("cv_hash"), F.lit(True).alias("links_ok"),
    )


def cv_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the CVs: line, phrase, line, phrase and so on."""
    documents = read_table(spark, folder, "documents")
    lines = documents.select(
        F.col("doc_id").alias("run_id"), F.posexplode(T.split_lines(F.col("text"))).alias("i", "line")
    )
    seed = F.col("run_id") * 7 + F.col("i") * 13
    pairs = F.array(F.col("line"), phrase(seed))
    blocks = lines.select("run_id", "i", F.posexplode(pairs).alias("j", "text"))
    ord_ = (F.col("i") * 2 + F.col("j")).cast("int")
    return blocks.select(
        "run_id", track_of(F.col("run_id")).alias("track"),
        F.concat(F.lit("doc-"), F.col("run_id")).alias("source_id"), F.lit(0).alias("source_ord"),
        F.lit("cv").alias("source_type"), F.lit("attributed").alias("ownership_status"),
        F.lit(True).alias("accessible"), ord_.alias("block_ord"),
        F.format_string("blk-p0001-%04d", ord_ + 1).alias("block_id"),
        F.concat(F.lit("page 1, block "), ord_ + 1).alias("locator"), "text",
    )


LINK_TYPES = (
    "repository", "portfolio", "project", "deployed_project", "kaggle", "dashboard",
    "other_professional",
)


def link_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One link per conversation that belongs to a document."""
    talks = read_table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns")
    )
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("conv_id"))
    labels = read_table(spark, folder, "labels").withColumnRenamed("doc_id", "conv_id")
    kind = F.element_at(
        F.array(*[F.lit(t) for t in LINK_TYPES]), (F.pmod(F.col("conv_id"), F.lit(7)) + 1).cast("int")
    )
    return (
        talks.join(documents, "conv_id", "left_semi")
        .join(labels, "conv_id", "left")
        .select(
            F.col("conv_id").alias("run_id"), F.lit("link-001").alias("link_id"),
            F.concat(F.lit("https://work.example.com/"), "conv_id").alias("submitted_url"),
            kind.alias("declared_type"),
            F.when(F.col("toxic") == 1, "conflicting").when(F.col("quality") == 1, "attributed")
            .otherwise("unclear").alias("ownership_status"),
            (F.coalesce(F.col("quality"), F.col("turns").cast("int")) != 0).alias("accessible"),
        )
    )


def link_blocks(spark: SparkSession, folder: str) -> DataFrame:
    talks = read_table(spark, folder, "conversations")
    seed = F.col("conv_id") * 7 + F.col("turn") * 13 + 5
    texts = talks.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").cast("int").alias("block_ord"),
        F.concat(phrase(seed), F.lit(". "), F.regexp_replace(T.normalize_text(F.col("text")), "\n", " ")).alias("text"),
    )
    return texts.join(link_rows(spark, folder), "run_id").select(
        "run_id", track_of(F.col("run_id")).alias("track"),
        F.concat(F.lit("src-"), "link_id").alias("source_id"), F.lit(1).alias("source_ord"),
        F.col("declared_type").alias("source_type"), "ownership_status", "accessible", "block_ord",
        F.format_string("blk-text-%04d", F.col("block_ord") + 1).alias("block_id"),
        F.concat(F.lit("text:p:"), F.col("block_ord") + 1).alias("locator"), "text",
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return cv_blocks(spark, folder).unionByName(link_blocks(spark, folder))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    cv = runs(spark, folder).select(
        "run_id", F.concat(F.lit("doc-"), "run_id").alias("source_id"), F.lit(0).alias("source_ord"),
        F.lit("cv").alias("source_type"), F.lit(True).alias("submitted_by_candidate"),
        F.lit("accessible").alias("access_status"), F.lit("attributed").alias("ownership_status"),
        F.col("cv_hash").alias("content_hash"), F.lit("page 1").alias("locator"),
    )
    links = link_rows(spark, folder).select(
        "run_id", F.concat(F.lit("src-"), "link_id").alias("source_id"), F.lit(1).alias("source_ord"),
        F.col("declared_type").alias("source_type"), F.lit(True).alias("submitted_by_candidate"),
        F.when(F.col("accessible"), "accessible").otherwise("inaccessible").alias("access_status"),
        "ownership_status",
        F.when(F.col("accessible"), F.sha2("submitted_url", 256)).alias("content_hash"),
        F.col("submitted_url").alias("locator"),
    )
    return cv.unionByName(links)


# The same inputs in SQL -------------------------------------------------------------------------

SPACES = "[ \\t\\f\\x0b\\x{00A0}]+"


def sql_normalize(col: str) -> str:
    """Normalised text, as SQL."""
    step = f"regexp_replace({col}, '\\r\\n?', chr(10), 'g')"
    step = f"regexp_replace({step}, '{SPACES}', ' ', 'g')"
    step = f"regexp_replace({step}, '\\s*\\n\\s*', chr(10), 'g')"
    return f"regexp_replace({step}, '^\\s+|\\s+$', '', 'g')"


def sql_sentences(col: str) -> str:
    """List of sentences, as SQL."""
    parts = f"string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({parts}, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def sql_phrase(seed: str) -> str:
    return f"({sql_list(PHRASES)})[(({seed}) % {len(PHRASES)}) + 1]"


def sql_track(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN {q(SE)} ELSE {q(DA)} END"


SQL_RUNS = f"runs AS (SELECT doc_id AS run_id, {sql_track('doc_id')} AS track, sha256(text) AS cv_hash FROM documents)"

SQL_CV_BLOCKS = f"""cv_lines AS (
  SELECT doc_id AS run_id, i - 1 AS i, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, list_filter(string_split({sql_normalize('text')}, chr(10)), lambda s: s <> '') AS l
      FROM documents))),
cv_blocks AS (
  SELECT run_id, {sql_track('run_id')} AS track, 'doc-' || run_id AS source_id, 0 AS source_ord,
    'cv' AS source_type, 'attributed' AS ownership_status, TRUE AS accessible,
    (i * 2 + j)::INT AS block_ord, printf('blk-p0001-%04d', i * 2 + j + 1) AS block_id,
    'page 1, block ' || (i * 2 + j + 1) AS locator,
    CASE j WHEN 0 THEN line ELSE {sql_phrase('run_id * 7 + i * 13')} END AS text
  FROM cv_lines, (VALUES (0), (1)) AS v(j))"""

SQL_LINKS = f"""link_rows AS (
  SELECT c.conv_id AS run_id, 'link-001' AS link_id,
    'https://work.example.com/' || c.conv_id AS submitted_url,
    ({sql_list(LINK_TYPES)})[c.conv_id % 7 + 1] AS declared_type,
    CASE WHEN toxic = 1 THEN 'conflicting' WHEN quality = 1 THEN 'attributed' ELSE 'unclear' END
      AS ownership_status,
    coalesce(quality, turns) <> 0 AS accessible
  FROM (SELECT conv_id, count(*) AS turns FROM conversations
        WHERE conv_id IN (SELECT doc_id FROM documents) GROUP BY 1) c
  LEFT JOIN labels ON labels.doc_id = c.conv_id),
link_blocks AS (
  SELECT r.run_id, {sql_track('r.run_id')} AS track, 'src-' || link_id AS source_id,
    1 AS source_ord, declared_type AS source_type, ownership_status, accessible,
    turn::INT AS block_ord, printf('blk-text-%04d', turn + 1) AS block_id,
    'text:p:' || (turn + 1) AS locator,
    {sql_phrase('c.conv_id * 7 + turn * 13 + 5')} || '. '
      || replace({sql_normalize('text')}, chr(10), ' ') AS text
  FROM conversations c JOIN link_rows r ON r.run_id = c.conv_id)"""

SQL_BLOCKS = f"""{SQL_RUNS},
{SQL_CV_BLOCKS},
{SQL_LINKS},
blocks AS (SELECT * FROM cv_blocks UNION ALL SELECT * FROM link_blocks)"""

SQL_SOURCES = """sources AS (
  SELECT run_id, 'doc-' || run_id AS source_id, 0 AS source_ord, 'cv' AS source_type,
    TRUE AS submitted_by_candidate, 'accessible' AS access_status,
    'attributed' AS ownership_status, cv_hash AS content_hash, 'page 1' AS locator FROM runs
  UNION ALL
  SELECT run_id, 'src-' || link_id, 1, declared_type, TRUE,
    CASE WHEN accessible THEN 'accessible' ELSE 'inaccessible' END, ownership_status,
    CASE WHEN accessible THEN sha256(submitted_url) END, submitted_url FROM link_rows)"""
