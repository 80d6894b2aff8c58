"""Reading rule documents with Spark, so that a rule set can come from JSON files.

Rule documents are configuration: a few hundred rows each, read once and broadcast in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document as one row."""
    return spark.read.json(path, multiLine=True)


def alias_table(document: DataFrame) -> DataFrame:
    """Aliases of an evidence rule document."""
    entries = document.select(F.explode(F.concat("subjects", "qualifications")).alias("e"))
    return entries.select("e.subject", "e.kind", "e.rule_id", F.explode("e.aliases").alias("a")).select(
        "subject", "kind", "rule_id", F.col("a.text").alias("alias"), F.col("a.case_sensitive").alias("case_sensitive")
    )


def cue_table(document: DataFrame) -> DataFrame:
    """Phrases of every list-valued entry of a cue document."""
    groups = [f.name for f in document.schema.fields if f.dataType.simpleString() == "array<string>"]
    pairs = F.array(*[F.struct(F.lit(g).alias("cue_group"), F.col(g).alias("phrases")) for g in groups])
    return document.select(F.inline(pairs)).select("cue_group", F.explode("phrases").alias("phrase"))


def criterion_tables(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Criteria and their anchor points of a rubric document."""
    tracks = document.schema["tracks"].dataType.names
    criteria = None
    for track in tracks:
        part = document.select(F.lit(track).alias("track"), F.posexplode(f"tracks.{track}.criteria").alias("criterion_ord", "c"))
        part = part.select(
            "track", "criterion_ord", F.col("c.id").alias("criterion_id"), "c.category_id",
            F.col("c.display_name").alias("label"), "c.max_points", "c.scoring", "c.rule_id",
            F.to_json("c.evidence_anchors").alias("anchors"),
        )
        criteria = part if criteria is None else criteria.unionByName(part)
    anchors = criteria.select(
        "criterion_id", F.explode(F.from_json("anchors", "map<string,int>")).alias("anchor", "points")
    )
    return criteria.drop("anchors"), anchors


def project_table(document: DataFrame) -> DataFrame:
    """What a project catalogue document tells about each project besides its criteria."""
    lists = ("required_foundations", "required_outputs", "completion_checks", "optional_criterion_ids")
    return document.select(F.explode("projects").alias("p")).select(
        "p.project_id", "p.scenario", *[F.col(f"p.{name}").alias(name) for name in lists]
    )


def label_table(document: DataFrame, kinds: list[str]) -> DataFrame:
    """Labels of a label document: for each kind an object from ID to label."""
    parts = [
        document.select(F.lit(kind).alias("label_kind"), F.explode(F.from_json(F.to_json(kind), "map<string,string>")).alias("id", "label"))
        for kind in kinds
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
