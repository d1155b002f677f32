"""Reports: text, JSON and SARIF, as columns of text; and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderake.plans.tables import written

TOOL = "coderake"
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def text_block(_: None = None) -> Column:
    """A finding as lines of text."""
    loc = lambda f: F.col(f"location.{f}")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    indented = lambda text: F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("      "), x)), "\n")
    refs = F.when(F.size("references") > 0, F.concat(F.lit("  References:\n"), F.array_join(F.transform("references", lambda r: F.concat(F.lit("    - "), r)), "\n")))
    fix = F.when(F.col("fix").isNotNull(), F.concat_ws("\n", F.lit("  Suggested Fix:"), line("    ", F.col("fix.description")), F.when(F.col("fix.diff") != "", F.concat(F.lit("    Diff:\n"), indented(F.col("fix.diff"))))))
    return F.concat_ws("\n", line("[", F.col("severity"), "/", F.col("confidence"), "] ", F.col("rule_id"), ": ", F.col("title")), line("  Location: ", loc("path"), ":", loc("line").cast("string"), ":", loc("column").cast("string")), line("  Snippet: ", loc("snippet")), line("  Message: ", F.col("message")), line("  Remediation: ", F.col("remediation")), refs, fix)


def _text_tail() -> Column:
    return F.concat(F.lit("Suppressed findings: "), F.col("suppressed").cast("string"), F.lit("\nAuto-fixes applied: "), F.col("auto_fixes_applied").cast("string"), F.lit("\nAuto-fixes skipped: "), F.col("auto_fixes_skipped").cast("string"))


def finding_struct() -> Column:
    return F.struct("rule_id", "title", "severity", "confidence", "message", "location", "remediation", "references", "fix")


def sarif_level(severity: Column) -> Column:
    return F.when(F.lower(severity).isin("critical", "high"), "error").when(F.lower(severity) == "medium", "warning").otherwise("note")


def sarif_result() -> Column:
    region = F.struct(F.col("location.line").alias("startLine"), F.col("location.column").alias("startColumn"), F.struct(F.col("location.snippet").alias("text")).alias("snippet"))
    physical = F.struct(F.struct(F.col("location.path").alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(physical.alias("physicalLocation"))).alias("locations"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """One row for each rule in the order of first findings, with what its last finding says."""
    place = F.struct("location.path", "location.line", "rule_id", "rule_no", "ord")
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"), text("title").alias("shortDescription"), text("message").alias("fullDescription"), text("remediation").alias("help"), F.struct("severity", "confidence").alias("properties"))
    return found.groupBy("rule_id").agg(F.min(place).alias("first"), F.max_by(rule, place).alias("rule"))


def _rules_listed(found: DataFrame) -> DataFrame:
    """One row with the rules, of which there are few, in the order of first findings."""
    return sarif_rules(found).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rule"))), lambda x: x["rule"]).alias("rules"))


def _sarif_tool() -> Column:
    return F.struct(F.struct(F.lit(TOOL).alias("name"), F.lit(f"https://example.com/{TOOL}").alias("informationUri"), F.col("rules")).alias("driver"))


#: What puts the rows of report_rows in order.
PLACE = ("part", "path", "line", "rule_id", "rule_no", "ord", "nth")


def report_rows(found: DataFrame, counts: DataFrame | None, how: str) -> DataFrame:
    """PLACE, value: a report as rows that, in the order of PLACE and a line break after each, are the document; part 0 is
    the header, part 1 has a row for each finding, part 2 is the footer. No task holds more than rows."""
    plain = {"ignoreNullFields": "false"}
    if how == "text":
        item, head, foot = F.concat(text_block(), F.lit("\n")), None, counts.select(_text_tail().alias("value"))
    elif how == "json":
        item, foot = F.to_json(finding_struct(), plain), counts.select(F.lit("]}").alias("value"))
        summary = F.to_json(F.struct("count", "suppressed", "auto_fixes_applied", "auto_fixes_skipped"), plain)
        head = counts.select(F.concat(F.lit('{"summary":'), summary, F.lit(',"findings":[')).alias("value"))
    else:
        rules = _rules_listed(found)
        item, foot = F.to_json(sarif_result()), rules.select(F.lit("]}]}").alias("value"))
        head = rules.select(F.concat(F.lit(f'{{"version":"2.1.0","$schema":"{SCHEMA}","runs":[{{"tool":'), F.to_json(_sarif_tool()), F.lit(',"results":[')).alias("value"))
    key = PLACE[1:-1]
    rows = found.select("location.path", "location.line", "rule_id", "rule_no", "ord", item.alias("value"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("value")))
    if how != "text":  # a comma before each item but the first
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(F.struct(*key, "nth")).alias("least"))))
        rows = rows.withColumn("value", F.when(F.struct(*key, "nth") == F.col("least"), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))))
    out = rows.select(F.lit(1).alias("part"), *PLACE[1:], "value")
    for part, edge in ((0, head), (2, foot)):
        if edge is not None:
            out = out.unionByName(edge.withColumn("part", F.lit(part)), allowMissingColumns=True)
    return out


def with_offsets(rows: DataFrame) -> DataFrame:
    """Rows of report_rows with ``at``, the byte at which each begins in the document. Rows are sorted in ranges; a range
    begins where those before it end, and its rows are added up inside it: no task sees more than a range, and only the
    ranges' sizes come to the driver."""
    ranges = written(rows.orderBy(*PLACE).select("*", F.monotonically_increasing_id().alias("id")), "report").withColumn("range_no", F.shiftright("id", 33))
    size = F.octet_length("value").cast("long") + 1
    start, starts = 0, {}
    for row in sorted(ranges.groupBy("range_no").agg(F.sum(size).alias("size")).collect()):
        starts[row["range_no"]], start = start, start + row["size"]
    begin = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), F.col("range_no")) if starts else F.lit(0).cast("long")
    inside = Window.partitionBy("range_no").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("at", begin + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("range_no", "id")


def report_digest(rows: DataFrame) -> DataFrame:
    """One row (n_rows, n_bytes, digest) for the whole document: each row is digested together with its place in bytes, and
    the digests are added up, so parts of a document can be digested anywhere and in any order; a row that is missing,
    changed or moved changes the sum."""
    own = F.conv(F.substring(F.md5(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("value")).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return with_offsets(rows).agg(F.count("*").alias("n_rows"), total(F.octet_length("value").cast("long") + 1).alias("n_bytes"), total(own).cast("string").alias("digest"))


def write_report(found: DataFrame, counts: DataFrame, path: str, how: str = "text", mode: str = "error") -> None:
    """Writes findings under path: text, json or sarif as part files whose texts in the order of their names
    are one document, jsonl and parquet as rows by rule."""
    if how in ("jsonl", "parquet"):
        rows = found.drop("rule_no", "ord")
        (rows.write.mode(mode).partitionBy("rule_id").json(path) if how == "jsonl" else rows.write.mode(mode).partitionBy("rule_id").parquet(path))
        return
    report_rows(found, counts, how if how in ("json", "sarif") else "text").orderBy(*PLACE).select("value").write.mode(mode).text(path)
