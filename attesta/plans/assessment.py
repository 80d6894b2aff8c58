"""The whole assessment of many candidates as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import binding, classify, evidence, qa, scoring
from attesta.operators.ordering import cut
from attesta.operators.sources import with_retrievals
from attesta.registry import Registry, default_registry

COMPLETED, REVIEW, FAILED = "COMPLETED", "REVIEW_REQUIRED", "ASSESSMENT_PIPELINE_FAILED"


@dataclass(frozen=True)
class Assessment:
    """Tables of one assessment batch; each is a DataFrame and none is collected.

    A table is made when it is first asked for, together with the ones it is made from, and kept. ``stage`` writes what
    several branches read to the shared folder.
    """

    runs: DataFrame
    sources: DataFrame
    blocks: DataFrame
    rules: Registry
    stage: Callable[[DataFrame], DataFrame]

    @cached_property
    def sentences(self) -> DataFrame:
        scanned = evidence.scan_sentences(self.blocks, self.rules)
        return self.stage(evidence.with_qualification_hits(scanned, self.rules))

    @cached_property
    def over(self) -> DataFrame:
        """Runs beyond the fact limit, which fail as a whole."""
        return self.stage(evidence.runs_over_limit(self.sentences))

    @cached_property
    def technical(self) -> DataFrame:
        return self.stage(evidence.normalize_evidence(self.blocks, self.rules, self.sentences, over=self.over))

    @cached_property
    def facts(self) -> DataFrame:
        allowed = self.sentences.join(self.over, "run_id", "left_anti")
        # one row a source: the limit is applied to these rows and never to texts
        summary = self.stage(classify.source_summary(self.blocks, self.rules)).join(self.over, "run_id", "left_anti")
        derived = classify.derived_facts(summary, allowed, self.technical, self.rules, self.stage)
        return self.stage(self.technical.unionByName(derived))

    @cached_property
    def _named(self) -> DataFrame:
        """The runs, without the text that their hash is made from."""
        return self.stage(self.runs.select("run_id", "track", "cv_hash", "links_ok"))

    @cached_property
    def _origins(self) -> DataFrame:
        """What scoring needs to know of the sources, without their texts."""
        return self.stage(
            self.sources.select("run_id", "source_id", "source_type", "submitted_by_candidate", "access_status")
        )

    @cached_property
    def _bound(self) -> tuple[DataFrame, DataFrame]:
        live = self._named.join(self.over, "run_id", "left_anti")
        mismatched = classify.track_mismatch(self.facts, live)
        bindings, context = binding.bind(self.facts, self._origins, live, mismatched, self.rules, self.stage)
        return bindings, self.stage(context.join(live.select("run_id", "cv_hash", "links_ok"), "run_id"))

    @cached_property
    def bindings(self) -> DataFrame:
        return self._bound[0]

    @cached_property
    def context(self) -> DataFrame:
        return self._bound[1]

    @cached_property
    def scored(self) -> DataFrame:
        scored = scoring.score_runs(self.bindings, self.context, self._origins, self.rules)
        return self.stage(qa.run_checks(scored, self.rules))

    @cached_property
    def outcomes(self) -> DataFrame:
        return outcomes(self._named, self.over, self.context, self.scored)


def assess(
    runs: DataFrame,
    sources: DataFrame,
    blocks: DataFrame,
    registry: Registry | None = None,
    materialize: bool = True,
    link_retrievals: DataFrame | None = None,
) -> Assessment:
    """Facts, bindings, scores and outcome of every run.

    With ``link_retrievals`` (locator, retrieved_at, access_status, content_hash) links are read as they were at
    ``runs.assessed_at``; see ``sources.with_retrievals``.

    ``runs``: run_id, track, cv_hash, links_ok. ``sources``: see ``binding.scoreable_source``.
    ``blocks``: see ``attesta.operators.evidence``. With ``materialize`` the scanned sentences, the
    facts and other tables that several branches read are written once to the shared folder.
    """
    rules = registry or default_registry()
    stage = cut if materialize else (lambda df: df)
    if link_retrievals is not None:
        sources, blocks = with_retrievals(sources, blocks, runs, link_retrievals)
        sources = stage(sources)
    return Assessment(runs, sources, blocks, rules, stage)


def outcomes(
    runs: DataFrame, over: DataFrame, context: DataFrame, scored: DataFrame
) -> DataFrame:
    """State and error code of every run; failed and blocked runs are kept, never dropped."""
    done = scored.select(
        "run_id",
        F.when(F.col("qa_status") == "PASS", COMPLETED).otherwise(FAILED).alias("state"),
        F.when(F.col("qa_status") != "PASS", "QA_FAILED").alias("error_code"),
        F.when(F.col("qa_status") == "PASS", F.col("final_score")).alias("final_score"),
        F.when(F.col("qa_status") == "PASS", F.col("band")).alias("band"),
    )
    empty = [F.lit(None).cast("int").alias("final_score"), F.lit(None).cast("string").alias("band")]
    blocked = context.filter(F.size("review_flags") > 0).select(
        "run_id", F.lit(REVIEW).alias("state"), F.lit(REVIEW).alias("error_code"), *empty
    )
    failed = runs.join(over, "run_id", "left_semi").select(
        "run_id", F.lit(FAILED).alias("state"),
        F.lit("EVIDENCE_NORMALIZATION_FAILED").alias("error_code"), *empty,
    )
    return done.unionByName(blocked).unionByName(failed)
