"""Policies as rows: overlaying overrides on defaults, and lookups with a default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.functions.vocabulary import default_policy
from coderake.plans.tables import written


def overlay(defaults: DataFrame, overrides: DataFrame, *scope: str) -> DataFrame:
    """(scope.., key_path, value): leaves of a deep merge. An override replaces the default of its path, also by null, and a
    scalar put over a branch removes the defaults below it; a leaf under a scalar default replaces that scalar. Overrides
    with a column ``hollow`` may say that a path holds a branch without leaves: it stays a branch, or replaces a scalar."""
    base = defaults
    if scope:
        # Every scope starts from all defaults: the leaves of one policy, few by nature.
        leaves = F.array(*[F.struct(F.lit(r["key_path"]).alias("key_path"), F.lit(r["value"]).alias("value")) for r in defaults.collect()])
        base = overrides.select(*scope).distinct().select(*scope, F.explode(leaves).alias("leaf")).select(*scope, "leaf.*")
    base = base.withColumnRenamed("value", "base_value")
    ancestors = lambda df: df.select(*scope, "key_path", F.explode(_above(F.col("key_path"))).alias("above"))
    keys = [*scope, "key_path"]
    named = overrides.select(*keys, F.col("value").alias("over_value"), (F.col("hollow") if "hollow" in overrides.columns else F.lit(False)).alias("hollow"))
    over, hollow = named.where("NOT hollow").select(*keys, "over_value", F.lit(True).alias("over")), named.where("hollow").select(*keys)
    # Defaults below an overriding scalar, and default scalars above an overriding leaf.
    below = ancestors(base).join(over.select(*scope, F.col("key_path").alias("above")), [*scope, "above"], "left_semi").select(*keys)
    above = ancestors(over.unionByName(hollow, allowMissingColumns=True)).select(*scope, F.col("above").alias("key_path")).unionByName(hollow)
    base = base.join(below, keys, "left_anti").join(above, keys, "left_anti")
    return base.join(over, keys, "full_outer").select(*keys, F.when(F.col("over"), F.col("over_value")).otherwise(F.col("base_value")).alias("value"))


def leaves(documents: DataFrame, *scope: str, column: str = "document") -> DataFrame:
    """(scope.., key_path, value, hollow): the leaves of nested JSON documents (text), one level of nesting after the other;
    a level is written before the next one is made of it, so documents may be as many and as deep as they like. A list is
    one leaf, its items joined by commas; null is a leaf without a value; an object without members is hollow; a dot in a
    key is escaped by a backslash. What is no JSON object gives nothing: see ``malformed``."""
    spark = documents.sparkSession
    rows = documents.select(*scope, F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(column)).alias("node")).where(_is_object())
    done = None
    while True:
        rows = rows.select("*", _is_object().alias("is_object"), F.to_json("node").alias("text"))
        rows = written(rows, "policy-level")
        ends = rows.where((~F.col("is_object")) | (F.col("text") == "{}")).where(F.size("path") > 0)
        items = F.expr("try_variant_get(node, '$', 'array<string>')")
        value = F.when(~F.col("is_object"), F.coalesce(F.array_join(items, ","), F.expr("try_variant_get(node, '$', 'string')")))
        key = F.array_join(F.transform("path", lambda p: F.replace(p, F.lit("."), F.lit("\\."))), ".")
        own = ends.select(*scope, key.alias("key_path"), value.alias("value"), F.col("is_object").alias("hollow"))
        done = own if done is None else done.unionByName(own)
        inner = rows.where("is_object AND text <> '{}'")
        if inner.isEmpty():
            return done
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).select(F.col("key").alias("member"), F.col("value").alias("below")))
        rows = below.select(*scope, F.concat("path", F.array("member")).alias("path"), F.col("below").alias("node"))


def _is_object():
    return F.coalesce(F.schema_of_variant("node").startswith("OBJECT"), F.lit(False))


def malformed(documents: DataFrame, *scope: str, column: str = "document") -> DataFrame:
    """Documents that are no JSON objects, and so override nothing."""
    node = F.try_parse_json(F.col(column)).alias("node")
    return documents.select(*scope, column, node).where(~_is_object()).drop("node")


def merged(documents: DataFrame, *scope: str, column: str = "document", defaults: DataFrame | None = None) -> DataFrame:
    """(scope.., key_path, value): each scope's policy, the defaults under the document it has."""
    spark = documents.sparkSession
    found = overlay(defaults if defaults is not None else default_policy(spark), written(leaves(documents, *scope, column=column), "policy-leaves"), *scope)
    return found


def _above(key_path):
    """Proper ancestors of a dotted path; escaped dots are none."""
    parts = F.split(key_path, r"(?<!\\)\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def loaded(spark, overrides: DataFrame | None = None) -> DataFrame:
    """(key_path, value) of the built-in policy, with overrides on top if there are any."""
    return default_policy(spark) if overrides is None else overlay(default_policy(spark), overrides)


def rules(policy: DataFrame) -> DataFrame:
    """(rule_id, enabled, severity, confidence) of a policy; the list of enabled rules is one leaf."""
    leaf = lambda prefix, name: policy.where(F.col("key_path").startswith(prefix)).select(F.substring_index("key_path", ".", -1).alias("rule_id"), F.col("value").alias(name))
    enabled = policy.where("key_path = 'rules.enabled'").select(F.explode(F.split("value", ",")).alias("rule_id")).withColumn("enabled", F.lit(True))
    named = enabled.join(leaf("rules.severities.", "severity"), "rule_id", "full_outer").join(leaf("rules.confidence.", "confidence"), "rule_id", "full_outer")
    return named.select("rule_id", F.coalesce("enabled", F.lit(False)).alias("enabled"), "severity", "confidence")


def with_rating(findings: DataFrame, rated: DataFrame) -> DataFrame:
    """Adds severity and confidence of each finding's rule; Medium where the policy has none."""
    found = findings.join(rated.select("rule_id", "severity", "confidence"), "rule_id", "left")
    medium = lambda c: F.coalesce(c, F.lit("Medium")).alias(c)
    return found.select(*[c for c in findings.columns], medium("severity"), medium("confidence"))


def number(policy: dict[str, str], key: str, default: int) -> int:
    return int(policy.get(key, default))
