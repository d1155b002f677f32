"""Extents and what lies in them, against all pairs; elements of small files by hand; deep and long files in time."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coderake.operators import rules as rul
from coderake.operators.elements import enclosing
from tests.test_scan import facts, texts

EXTENTS = "path string, key struct<a:int,b:string>, first_tok int, last_tok int, text string"
POINTS = "path string, t int, key string, parts array<string>"
BARRIERS = "path string, first_tok int, last_tok int"


def test_enclosing_is_all_pairs(spark):
    """Nested, crossing, equal, repeated, empty and null extents; a file without points, one without extents."""
    r = random.Random(5)
    span = lambda n, a: [(f"f{r.randrange(4)}", *sorted((r.randrange(40), r.randrange(40)))) for _ in range(n)] + a
    spans = span(60, [("f0", 3, 3), ("f0", 3, 3), ("f1", 9, 8), ("f1", None, 5), ("f1", 5, None), ("only extents", 0, 9), (None, 0, 5)])
    extents = [(p, (i, "k"), a, b, "own") for i, (p, a, b) in enumerate(spans)] + [("f0", None, 0, 39, None)]
    points = [(f"f{i % 4}", i // 4, None if i % 7 else "k", ["x"] * (i % 3) if i % 5 else None) for i in range(160)] + [("f0", 3, "twice", [])] * 2 + [("f0", None, "n", []), ("only points", 1, "p", [])]
    barriers = span(12, [("f0", 3, 3), ("f1", 9, 8)])
    for bars in ([], barriers):
        got = enclosing(spark.createDataFrame(extents, EXTENTS), spark.createDataFrame(points, POINTS).withColumnRenamed("key", "own"), spark.createDataFrame(bars, BARRIERS)).collect()
        inside = lambda t, a, b: None not in (t, a, b) and a <= t <= b
        want = [(p, k, t, own, parts) for p, k, a, b, _ in extents for q, t, own, parts in points if p == q and inside(t, a, b) and not any(p == s and inside(t, c, d) and a <= c and d <= b for s, c, d in bars)]
        text = lambda rows: sorted(map(str, rows))
        assert text((x["path"], tuple(x["key"]) if x["key"] else None, x["t"], x["own"], x["parts"]) for x in got) == text(want)


def test_elements_by_hand(spark):
    own = facts(texts(spark, ("a.py", "python", "x = f(y, g(1))\n"), ("b.js", "javascript", "run(() => { k = a.b().c(d); });\n"), ("none.py", "python", "# nothing\n")))
    rows = {}
    for r in own.elements.orderBy("path", "place").collect():
        rows.setdefault(r["path"], []).append((r["place"], r["kind"], r["parent"], r["depth"], r["last_place"]))
    assert rows == {
        "a.py": [(0, "assignment", None, 0, 10), (1, "name", 0, 1, 1), (2, "value", 0, 1, 10), (3, "call", 2, 2, 10), (4, "name", 3, 3, 4), (5, "argument", 3, 3, 6), (6, "name", 5, 4, 6), (7, "argument", 3, 3, 10), (8, "call", 7, 4, 10), (9, "name", 8, 5, 9), (10, "argument", 8, 5, 10)],
        "b.js": rows["b.js"],
    }
    tree = [(kind, depth) for _, kind, _, depth, _ in rows["b.js"]]
    assert tree == [("call", 0), ("name", 1), ("argument", 1), ("function", 2), ("assignment", 3), ("name", 4), ("value", 4), ("call", 5), ("call", 6), ("name", 7), ("name", 6), ("argument", 6), ("name", 7)]


@pytest.mark.parametrize("text", ["f(" * 3000 + "x" + ")" * 3000 + "\n", "a = " + "f(x, y) + " * 20_000 + "1\n"], ids=["deep", "long"])
def test_deep_and_long_statements_in_time(spark, text):
    own = facts(texts(spark, ("a.js", "javascript", text)))
    began = time.time()
    found = own.elements.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    assert time.time() - began < 60
    assert (found["depth"], found["n"]) == ((6000, 9001) if text.startswith("f") else (4, 120_003))


ENDS = "def one(a):\n    return g(a,\n             b)\n\n\ndef two():\n    '''doc\n    more\n    '''\n# outside\nclass C:\n    def three(self):\n        def four(): pass\n        x = [\n1]\n    y = 2\ndef five(): return {\n}\ndef six():\n    if a:\n        return {\n            1: [\n                2,\n            ],\n}\n"


def test_functions_end_with_their_last_statement(spark):
    own = facts(texts(spark, ("a.py", "python", ENDS)))
    got = {r["name"]: (r["start_line"], r["end_line"], r["top_level"]) for r in own.functions.collect()}
    assert got == {"one": (1, 3, True), "two": (6, 9, True), "three": (12, 15, False), "four": (13, 13, False), "five": (17, 18, True), "six": (19, 25, True)}
    by_name = {r["name"]: (r["line_count"], r["max_nesting"]) for r in own.metrics.collect()}
    assert by_name == {"one": (3, 1), "two": (4, 1), "three": (4, 1), "four": (1, 0), "five": (2, 0), "six": (7, 2)}


def test_code_stays_dealt_out_by_path(spark):
    """Windows by path over the written code shuffle nothing, and its entry in the catalog can be dropped."""
    from coderake.plans.tables import PREFIX, release

    own = rul.Facts(texts(spark, ("a.py", "python", "x = f(y)\n"), ("b.py", "python", "z\n")), persisted=True)
    rows = own.code.withColumn("n", F.count("*").over(Window.partitionBy("path", "brace_depth").orderBy("tok_no")))
    assert {(r["path"], r["n"]) for r in rows.collect()} == {("a.py", n) for n in range(1, 7)} | {("b.py", 1)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    before = spark.catalog.listTables(pattern=f"{PREFIX}*")
    assert before
    own_tables = rows.inputFiles()
    release(spark)
    assert not spark.catalog.listTables(pattern=f"{PREFIX}*")
    assert spark.read.parquet(*own_tables).count() == 7
