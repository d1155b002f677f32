"""The whole scan as one plan: files to findings, summary, gate and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.functions.languages import BUILT_IN, Languages
from coderake.functions.vocabulary import DEFAULT_POLICY
from coderake.operators import findings as fnd
from coderake.operators.rules import RULES, Facts, raw_findings
from coderake.plans import policy as pol
from coderake.plans.tables import written
from coderake.sources.files import decoded, enabled_languages, not_ignored, with_language


@dataclass
class Scan:
    """found: all findings with ``suppressed``; findings: what is kept; summary and gate: one row each; left_out: files
    over the size limit, which are reported and not scanned."""

    files: DataFrame
    found: DataFrame
    summary: DataFrame
    gate: DataFrame
    left_out: DataFrame
    patched: DataFrame | None

    @property
    def findings(self) -> DataFrame:
        return fnd.kept(self.found)


def source_texts(files: DataFrame, languages: list[str] | None = None, max_file_bytes: int | None = None, known: Languages = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """Scannable (path, language, text) and left out (path, size) of (path, content or text)."""
    chosen = enabled_languages(with_language(not_ignored(files), known.extensions(files.sparkSession)), languages or DEFAULT_POLICY["languages.enabled"].split(","))
    text = F.col("text") if "text" in files.columns else decoded(F.col("content"))
    size = F.octet_length(F.col("text")) if "text" in files.columns else (F.col("size") if "size" in files.columns else F.octet_length("content"))
    large = F.lit(False) if max_file_bytes is None else size > max_file_bytes
    return chosen.where(~large).select("path", "language", text.alias("text")).where("text IS NOT NULL"), chosen.where(large).select("path", size.cast("long").alias("size"))


def scan(files: DataFrame, overrides: DataFrame | None = None, apply_fixes: bool = False, dry_run: bool = True, max_file_bytes: int | None = None, persisted: bool = True, rules=RULES, languages: DataFrame | None = None, **options) -> Scan:
    """Scans (path, content or text); with persisted, tokens, facts and findings are written to the shared folder as they
    are made, else everything stays one lazy plan. languages: rows as in functions/languages.py instead of the built-in ones;
    languages besides these are enabled with those of the policy. Policy and languages are read on the driver: a few
    dozen leaves, and a vocabulary."""
    spark = files.sparkSession
    policy = pol.loaded(spark, overrides)
    leaf = {r["key_path"]: r["value"] for r in policy.collect()}
    known = BUILT_IN if languages is None else Languages.of(languages)
    enabled = leaf.get("languages.enabled", "").split(",") + [k for k in known.names if k not in BUILT_IN.names]
    texts, left_out = source_texts(files, enabled, max_file_bytes, known)
    limit = tuple(pol.number(leaf, f"thresholds.complexity.{k}", d) for k, d in (("max_cyclomatic", 15), ("max_nesting", 4), ("max_function_lines", 80)))
    facts = Facts(texts, thresholds=limit, persisted=persisted, languages=known, **options)
    raw = raw_findings(facts, leaf.get("rules.enabled", "").split(","), rules)
    rated = pol.with_rating(raw, F.broadcast(pol.rules(policy)))
    found = fnd.with_suppression(rated, facts.files, leaf.get("suppression.inline_comment", "scan:ignore"))
    found = written(found, "found") if persisted else found
    patched = fnd.apply_fixes(fnd.kept(found), facts.files, dry_run) if apply_fixes else None
    counts = fnd.fix_counts(patched, spark)
    return Scan(facts.files, found, fnd.summary(found, counts), fnd.gate(fnd.kept(found), leaf.get("reporting.fail_on_severity", "High")), left_out, patched)
