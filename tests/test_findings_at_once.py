"""Findings of all rules come from one pass over tokens, one over names and one over texts, and facts are written in as many files as parts."""

import random
import re

from pyspark.sql import functions as F

from coderake.operators import rules as rul
from coderake.operators.elements import enclosing, holding_any
from tests.test_scan import texts

CODE = "x = request\ndb.execute(x)\nel.innerHTML = x\npassword = 'abc'\ndef f():\n    db.query(x, 1)\n"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def facts_of(spark, n=1, **more):
    return rul.Facts(texts(spark, *[(f"a{i}.py", "python", CODE) for i in range(n)]), persisted=True, **more)


def test_rules_are_located_together(spark):
    own = facts_of(spark, thresholds=(0, 0, 0))
    rows = rul.raw_findings(own)
    table = lambda df: re.search(r"coderake_facts_\w+", plan(df))[0]
    for read, times in ((own.code, 1), (own.files, 2)):  # texts also for secrets
        assert len(re.findall(rf"Scan parquet \S*{table(read)}\b", plan(rows))) == times
    got = sorted((r["rule_id"], r["rule_no"], r["location"]["line"], r["location"]["snippet"], r["message"].split(":")[0]) for r in rows.collect())
    said = {k: v[1].split(":")[0] for k, v in rul.RULE_TEXT.items()}
    assert got == [
        ("COMPLEXITY", 3, 5, "def f():\n    db.query(x, 1)", "Function 'f' is over its limits"), ("HARDCODED_SECRET", 2, 4, "password = 'abc'", said["HARDCODED_SECRET"]),
        ("SQLI", 0, 2, "db.execute(x)", said["SQLI"]), ("SQLI", 0, 6, "db.query(x, 1)", said["SQLI"]), ("XSS", 1, 3, "el.innerHTML = x", said["XSS"]),
    ]


def test_sinks_of_all_rules_are_told_at_once(spark):
    own = facts_of(spark, sinks=[("XSS", "call", "execute"), ("OWN", "property", "innerHTML")])
    assert len({id(own.sinks) for _ in range(2)}) == 1
    assert sorted((r["kind"], r["rule_id"]) for r in own.sinks.collect()) == [("call", "SQLI"), ("call", "SQLI"), ("call", "XSS"), ("property", "XSS")]
    assert rul.sink_calls(own, "XSS").count() == 1 and rul.sink_calls(own, "none").count() == 0


def test_facts_are_written_in_one_file_a_part(spark, monkeypatch):
    """Not in one for each part and each task of a shuffle."""
    monkeypatch.setattr(rul, "PART_BYTES", 130)
    own = facts_of(spark, 12)
    assert own.parts == 9
    for rows in (own.files, own.code, own.arguments, own.tainted, own.sinks, own.elements):
        assert len(rows.inputFiles()) <= own.parts


def test_filters_on_texts_work_where_texts_were_dealt_out(spark):
    own = facts_of(spark)
    assert "Exchange" not in plan(rul.secret_lines(own.files, "path")) and rul.secret_lines(own.files, "path").count() == 1


def test_equal_extents_each_count(spark):
    own = facts_of(spark)
    extents = spark.createDataFrame([("a0.py", 0, 0, ["k"]), ("a0.py", 0, 0, ["k"]), ("a0.py", 0, 4, None), ("a0.py", 0, 999, None)], "path string, first_tok int, last_tok int, more array<string>")
    assert sorted((r["location"]["snippet"], r["more"]) for r in own.located(extents).collect()) == [("x", ["k"]), ("x", ["k"]), ("x = request", None)]


def test_holding_any_is_all_pairs(spark):
    r = random.Random(3)
    span = lambda n: [(f"f{r.randrange(4)}", *sorted((r.randrange(40), r.randrange(40)))) for _ in range(n)]
    extents = spark.createDataFrame([(p, i % 50, a, b) for i, (p, a, b) in enumerate(span(70))], "path string, key int, first_tok int, last_tok int")
    points = spark.createDataFrame([(f"f{i % 5}", i // 5, [r.choice("abcdefgh") for _ in range(i % 3)] if i % 7 else None, r.random() < 0.1) for i in range(200)], "path string, t int, parts array<string>, is_source boolean")
    bars = spark.createDataFrame(span(12), "path string, first_tok int, last_tok int")
    words = spark.createDataFrame([("f0", ["a"]), ("f1", []), ("f2", ["b", "zz"]), ("f4", ["a"])], "path string, names array<string>")
    for barriers in (None, bars):
        got = holding_any(extents, points, barriers, words)
        met = enclosing(extents, points, barriers).join(words, "path", "left").where("is_source OR arrays_overlap(parts, names)").select("path", "key").distinct()
        assert got.count() > 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect()))
    assert holding_any(extents, points.where("false"), None, words).count() == 0


def test_elements_of_several_files_in_a_batch_are_those_of_each(spark):
    """Extents that cross, too: none of one file lies in one of another."""
    code = ["f(a, {b = [c\nx = y;", ")]}} f(x)", "g(h(1), k)", "a = b"]
    one = lambda files: {tuple(r) for r in rul.Facts(texts(spark, *files).coalesce(1)).elements.drop("path").withColumn("n", F.lit(files[0][0]) if len(files) == 1 else F.lit("")).collect()}
    files = [(f"{i}.js", "javascript", c) for i, c in enumerate(code)]
    each = {tuple(x[:-1]) for f in files for x in one([f])}
    assert {tuple(x[:-1]) for x in one(files)} == each
