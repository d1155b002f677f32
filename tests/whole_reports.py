"""Plain versions of the reports: one row that holds a whole document, for few findings."""

from pyspark.sql import functions as F

from coderake.operators import reports as rep


def _listed(found, item):
    keyed = F.struct("location.path", "location.line", "rule_id", "rule_no", "ord", item.alias("item"))
    return found.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["item"]).alias("items")).withColumn("one", F.lit(1))


def text_report(found, counts):
    rows = _listed(found, rep.text_block()).join(counts.withColumn("one", F.lit(1)), "one")
    return rows.select(F.concat(F.array_join(F.transform("items", lambda b: F.concat(b, F.lit("\n\n"))), ""), rep._text_tail(), F.lit("\n")).alias("report"))


def json_report(found, counts):
    rows = _listed(found, rep.finding_struct()).join(counts.withColumn("one", F.lit(1)), "one")
    own = F.struct(F.struct("count", "suppressed", "auto_fixes_applied", "auto_fixes_skipped").alias("summary"), F.col("items").alias("findings"))
    return rows.select(F.to_json(own, {"ignoreNullFields": "false"}).alias("report"))


def sarif_report(found):
    rows = _listed(found, rep.sarif_result()).join(rep._rules_listed(found).withColumn("one", F.lit(1)), "one")
    run = F.struct(rep._sarif_tool().alias("tool"), F.col("items").alias("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(rep.SCHEMA).alias("$schema"), F.array(run).alias("runs"))).alias("report"))
