"""Findings: suppression, order, fixes, counts and the severity gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderake.functions.vocabulary import SEVERITY_RANK
from coderake.sources.files import code_lines


def marked_lines(files: DataFrame, marker: str) -> DataFrame:
    """(path, line): lines whose findings are suppressed: the marker is on them or on the line above."""
    by_line = Window.partitionBy("path").orderBy("line_no")
    here = F.contains("line", F.lit(marker))
    lines = code_lines(files.where(F.contains("text", F.lit(marker))), "path")
    return lines.withColumn("marked", here | F.coalesce(F.lag(here).over(by_line), F.lit(False))).where("marked").select("path", F.col("line_no").alias("line"))


def with_suppression(found: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """Adds ``suppressed``."""
    marks = marked_lines(files, marker).withColumn("suppressed", F.lit(True))
    keyed = found.withColumn("path", F.col("location.path")).withColumn("line", F.col("location.line"))
    return keyed.join(marks, ["path", "line"], "left").select(*found.columns, F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def kept(found: DataFrame) -> DataFrame:
    return found.where("NOT suppressed").drop("suppressed")


def ordered(found: DataFrame) -> DataFrame:
    """By path, line and rule; ties in the order of emission."""
    return found.orderBy("location.path", "location.line", "rule_id", "rule_no", "ord")


def apply_fixes(found: DataFrame, files: DataFrame, dry_run: bool = False) -> DataFrame:
    """(path, text, applied, skipped) of each file with findings: its fixes in emission order, each replacing the first
    occurrence of ``before``. Input files are never rewritten; the patched text is a column."""
    fixes = found.groupBy(F.col("location.path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("rule_no", "ord", "fix"))).alias("fixes"))
    rows = fixes.join(files.select("path", "text"), "path")

    def step(s, f):
        fix = f["fix"]
        at = F.instr(s["text"], fix["before"])
        fits = F.coalesce(fix["auto_applicable"] & (at > 0), F.lit(False)) & F.lit(not dry_run)
        new = F.concat(F.substring(s["text"], F.lit(1), at - 1), fix["after"], F.substring(s["text"], at + F.length(fix["before"]), F.length(s["text"])))
        return F.struct(F.when(fits, new).otherwise(s["text"]).alias("text"), (s["applied"] + fits.cast("long")).alias("applied"), (s["skipped"] + (~fits).cast("long")).alias("skipped"))

    zero = F.struct(F.col("text"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("skipped"))
    return rows.select("path", F.aggregate("fixes", zero, step).alias("r")).select("path", "r.*")


def fix_counts(patched: DataFrame | None, spark=None) -> DataFrame:
    """One row: auto_fixes_applied, auto_fixes_skipped; zeros if no fixes were asked for."""
    if patched is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("auto_fixes_applied"), F.lit(0).cast("long").alias("auto_fixes_skipped"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return patched.agg(total("applied").alias("auto_fixes_applied"), total("skipped").alias("auto_fixes_skipped"))


def summary(found: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: count (of findings that are kept), suppressed, auto_fixes_applied, auto_fixes_skipped."""
    own = found.agg(F.count_if(~F.col("suppressed")).alias("count"), F.count_if("suppressed").alias("suppressed"))
    return own.withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one")


def gate(found: DataFrame, threshold: str = "High") -> DataFrame:
    """One row: failed, exit_code (2 or 0). An unknown threshold is as High, an unknown severity below all."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    worst = F.coalesce(F.max(F.coalesce(rank[F.col("severity")], F.lit(0))), F.lit(0))
    least = SEVERITY_RANK.get(threshold, 3)
    return found.agg((worst >= least).alias("failed"), F.when(worst >= least, 2).otherwise(0).alias("exit_code")) if least > 0 else found.agg((F.count("*") > 0).alias("failed"), F.when(F.count("*") > 0, 2).otherwise(0).alias("exit_code"))
