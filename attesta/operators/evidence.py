"""Evidence facts from text blocks: alias hits, levels, duplicates, limit and numbering.

A blocks table has one row per text block with ``run_id, track, source_id, source_ord,
source_type, ownership_status, accessible, block_ord, block_id, locator, text``. Source columns
travel with the blocks, so scanning the text needs no join and no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.ordering import cut, earliest, rank_struct
from attesta.registry import Registry, default_registry

ORDER = ("source_ord", "block_ord", "sent_ord", "emit_ord")
FACT_COLUMNS = (
    "source_id", "locator", "fact_type", "subject", "explicit_text", "evidence_level",
    "attribution_status", "rule_id",
)
# Fixed value: a run with more raw facts than this fails as a whole.
FACT_LIMIT = 5000
LEVEL_RANK = {"demonstrated": 3, "documented": 2, "named_only": 1, "missing_unverifiable": 0}
ATTRIBUTION_RANK = {"attributed": 3, "unclear": 2, "conflicting": 1}
APPLICATION_TYPES = ("skill_application", "tool_application")
NAME_TYPES = ("skill_name", "tool_name")
# Groups whose cues are read in the one scan over a sentence.
SCANNED_GROUPS = (
    "artifact_markers", "url_prefixes", "repository_markers", "context_markers",
    "architecture_cues", "integration_cues", "documentation_cues", "outcome_markers",
    "findings_cues", "visual_cues", "forbidden_labels", "collaboration_cues",
    "communication_cues", "professional_context_markers", "initiative_cues",
    "self_management_cues", "problem_solving_cues", "attention_cues", "se_target_phrases",
    "da_target_phrases", "target_cues",
)


def lookup(ranks: dict[str, int], col: Column) -> Column:
    """Ordinal of a name, as a chain of conditions."""
    chain = F
    for name, value in ranks.items():
        chain = chain.when(col == name, value)
    return chain


def level_rank(col: Column) -> Column:
    return lookup(LEVEL_RANK, col)


def attribution_rank(col: Column) -> Column:
    return lookup(ATTRIBUTION_RANK, col)


@lru_cache(maxsize=4)
def _scanner(cues: tuple, action: tuple) -> T.CueScanner:
    groups = {g: phrases for g, phrases in cues}
    return T.CueScanner(groups | {"action": action}, prefixes=groups.get("url_prefixes", ()))


def cue_scanner(registry: Registry) -> T.CueScanner:
    wanted = tuple((g, tuple(registry.cues.get(g, ()))) for g in SCANNED_GROUPS)
    return _scanner(wanted, tuple(registry.action_cues))


def cue_groups(col: Column, registry: Registry) -> Column:
    """Array of all cue groups of a sentence, read in one pass."""
    return cue_scanner(registry).groups(col)


def attribution(source_type: Column, ownership: Column) -> Column:
    return F.when(source_type == "cv", "attributed").otherwise(ownership)


def technical_level(source_type: Column, ownership: Column, applied: Column) -> Column:
    """Level of a skill or tool fact."""
    return (
        F.when(~applied, "named_only")
        .when((source_type != "cv") & (ownership == "attributed"), "demonstrated")
        .otherwise("documented")
    )


def technical_fact_type(kind: Column, applied: Column) -> Column:
    suffix = F.when(applied, "application").otherwise("name")
    return F.when(kind == "qualification", kind).otherwise(F.concat_ws("_", kind, suffix))


def emitting_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that may yield facts: the CV, and links that were read."""
    return blocks.filter((F.col("source_type") == "cv") | F.col("accessible"))


def scan_sentences(blocks: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Sentences with an alias hit or a cue, with ``hits`` and ``cues`` arrays.

    A quick search tells which sentences may hold a phrase. The patterns run on these inside the exploded array, so
    each is scanned once per pattern, and sentences without any finding are dropped in the same task.
    """
    rules = registry or default_registry()
    aliases = [row[3] for row in rules.alias_rows()]
    place = (
        "run_id", "track", "source_id", "source_ord", "source_type", "ownership_status",
        "block_ord", "locator",
    )
    cut_up = emitting_blocks(blocks).select(
        *place, "text", T.split_sentences(F.col("text")).alias("sentences")
    )
    told = cut_up.withColumn("worth", cue_scanner(rules).may_hold(F.col("sentences"), aliases))
    numbered = F.transform(
        "sentences",
        lambda s, i: F.struct(i.alias("sent_ord"), s.alias("sentence"), F.get("worth", i).alias("worth")),
    )
    found = F.transform(
        F.filter(numbered, lambda n: n.worth),
        lambda n: F.struct(
            n.sent_ord.alias("sent_ord"), n.sentence.alias("sentence"),
            T.alias_hits(n.sentence, aliases, rules.case_sensitive).alias("hits"),
            cue_groups(n.sentence, rules).alias("cues"),
        ),
    )
    # the quote is made once a block: behind the explode the whole text would go along with each sentence
    quote = T.bind(T.normalize_text(F.col("text")), lambda t: F.when(F.length(t) <= T.QUOTE_CHARS, t))
    quoted = told.filter(F.array_contains("worth", True)).withColumn("block_quote", quote)
    exploded = quoted.select(*place, "block_quote", F.explode(found).alias("found")).select(
        *place, "block_quote", F.col("found.sent_ord").alias("sent_ord"), "found"
    )
    qualifying = [a.lower() for a in _qualification_aliases(rules)]
    return (
        exploded.filter((F.size("found.hits") > 0) | (F.size("found.cues") > 0))
        .select("*", "found.sentence", "found.hits", "found.cues")
        .drop("found")
        .withColumn("sentence_text", T.normalize_text(F.col("sentence")))
        .withColumn("applied", F.array_contains("cues", "action"))
        .withColumn(
            "qualified", F.exists("hits", lambda h: T.fold_case(h).isin(*qualifying))
        )
    )


def _qualification_aliases(rules: Registry) -> list[str]:
    return [alias for _, kind, _, alias, _ in rules.alias_rows() if kind == "qualification"]


def raw_technical_facts(sentences: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One fact per alias hit; a sentence with a qualification yields nothing else."""
    rules = registry or default_registry()
    aliases = rules.table(sentences.sparkSession, "alias").select(
        F.lower("alias").alias("alias_key"), "subject", "kind", "rule_id"
    )
    hits = (
        sentences.filter(F.size("hits") > 0)
        .select(
            "run_id", "source_id", "source_ord", "source_type", "ownership_status", "block_ord",
            "locator", "block_quote", "sent_ord", "sentence_text", "applied", "qualified",
            F.posexplode("hits").alias("emit_ord", "hit"),
        )
        .withColumn("alias_key", T.fold_case(F.col("hit")))
        .join(F.broadcast(aliases), "alias_key")
    )
    is_qualification = F.col("kind") == "qualification"
    is_cv = F.col("source_type") == "cv"
    kept = hits.filter(F.when(F.col("qualified"), is_qualification & is_cv).otherwise(True))
    return kept.select(
        "run_id", *ORDER, "source_id", "locator",
        technical_fact_type(F.col("kind"), F.col("applied")).alias("fact_type"),
        "subject",
        F.when(is_qualification | F.col("applied"), F.col("sentence_text"))
        .otherwise(F.coalesce("block_quote", "hit"))
        .alias("explicit_text"),
        F.when(is_qualification, "documented")
        .otherwise(
            technical_level(F.col("source_type"), F.col("ownership_status"), F.col("applied"))
        )
        .alias("evidence_level"),
        attribution(F.col("source_type"), F.col("ownership_status")).alias("attribution_status"),
        "rule_id",
    )


def dedup_facts(raw: DataFrame, by_locator: bool = False) -> DataFrame:
    """Merge facts with the same subject, type and text.

    The strongest fact (level, then attribution, then the earlier one) gives the content, the
    earliest one the place. Partial aggregation merges copies before the shuffle.
    """
    keys = ["run_id", "subject", "fact_type", "text_key"] + (["locator"] if by_locator else [])
    body = [c for c in FACT_COLUMNS if c not in keys]
    rank = rank_struct(
        level_rank(F.col("evidence_level")),
        attribution_rank(F.col("attribution_status")),
        *earliest(ORDER),
    )
    merged = (
        raw.withColumn("text_key", T.fold_case(T.normalize_text(F.col("explicit_text"))))
        .groupBy(*keys)
        .agg(
            F.min(F.struct(*ORDER)).alias("place"),
            F.max_by(F.struct(*body), rank).alias("best"),
            F.count(F.lit(1)).alias("raw_facts"),
        )
    )
    carried = [c for c in ("subject", "fact_type", "locator") if c in keys]
    return merged.select("run_id", "place.*", *carried, "best.*", "raw_facts").select(
        "run_id", *ORDER, *FACT_COLUMNS, "raw_facts"
    )


def runs_over_limit(sentences: DataFrame, limit: int = FACT_LIMIT) -> DataFrame:
    """Runs with more raw facts than the limit, counted without building the facts.

    Such a run fails as a whole: it has no facts and the error code of ``failed_runs``.
    """
    usable = F.when(~F.col("qualified"), F.size("hits")).when(
        F.col("source_type") == "cv",
        # only the qualification hits of such a sentence become facts
        F.col("qualification_hits"),
    )
    return (
        sentences.groupBy("run_id")
        .agg(F.sum(F.coalesce(usable, F.lit(0))).alias("raw_facts"))
        .filter(F.col("raw_facts") > limit)
        .select("run_id")
    )


def failed_runs(sentences: DataFrame, limit: int = FACT_LIMIT) -> DataFrame:
    """(run_id, error_code) of the runs that ``normalize_evidence`` gives no facts for."""
    return runs_over_limit(sentences, limit).withColumn("error_code", F.lit("FACT_LIMIT_EXCEEDED"))


def with_qualification_hits(
    sentences: DataFrame, registry: Registry | None = None
) -> DataFrame:
    qualifying = [a.lower() for a in _qualification_aliases(registry or default_registry())]
    return sentences.withColumn(
        "qualification_hits",
        F.size(F.filter("hits", lambda h: T.fold_case(h).isin(*qualifying))),
    )


def evidence_id(number: Column) -> Column:
    return F.format_string("ev-%04d", number)


def number_facts(facts: DataFrame) -> DataFrame:
    """Evidence IDs in reading order. At most ``FACT_LIMIT`` facts per run are left here."""
    order = Window.partitionBy("run_id").orderBy(*ORDER)
    return facts.withColumn("fact_no", F.row_number().over(order)).withColumn(
        "evidence_id", evidence_id(F.col("fact_no"))
    )


def normalize_evidence(
    blocks: DataFrame,
    registry: Registry | None = None,
    sentences: DataFrame | None = None,
    limit: int = FACT_LIMIT,
    over: DataFrame | None = None,
) -> DataFrame:
    """Deduplicated, numbered skill, tool and qualification facts of every run within the limit.

    The runs beyond it are in ``failed_runs``; ``over`` gives them when they are known.
    """
    # the scan is read twice, for the limit and for the facts, so it is written once
    if sentences is None:
        sentences = cut(with_qualification_hits(scan_sentences(blocks, registry), registry))
    if over is None:
        over = runs_over_limit(sentences, limit)
    facts = dedup_facts(raw_technical_facts(sentences, registry))
    return number_facts(facts.join(over, "run_id", "left_anti"))
