"""Facts are told where the tokens are: no sort and no second pass of all tokens for what one of them can tell."""

from coderake.operators import facts as fact
from coderake.operators import rules as rul
from coderake.operators import taint
from coderake.operators.elements import holding
from tests.test_scan import facts, texts


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_assignments_and_sources_come_with_the_tokens(spark):
    own = rul.Facts(texts(spark, ("a.js", "javascript", "let a: T = req.body, b = c = f(1); for (let i = a; i; i++) { x.y = i }\ncase z: k = 2;\n"), ("b.py", "python", "if a: b = c, d = request\nf(k=1)\nx = input(\n")))
    for rows in (own.assignments, taint.sources(own.code)):
        assert plan(rows).count("MapInArrow") == 1 and "Window" not in plan(rows) and "arrays_overlap" not in plan(rows)
    got = {(r["path"], r["line_no"], ",".join(r["targets"]), ".".join(r["target_chain"])) for r in own.assignments.collect()}
    assert got == {("a.js", 1, "a", "a"), ("a.js", 1, "b", "b"), ("a.js", 1, "c", "c"), ("a.js", 1, "i", "i"), ("a.js", 1, "x,y", "x.y"), ("a.js", 2, "k", "k"), ("b.py", 1, "b", "b"), ("b.py", 1, "c,d", "d"), ("b.py", 3, "x", "x")}
    assert {(r["path"], r["source"]) for r in taint.sources(own.code).collect()} == {("a.js", "member"), ("b.py", "identifier")}
    # A call without an end is no call among the sources; a name in it is live all the same.
    assert [r["parts"] for r in taint._inner_names(own.code).where("path = 'b.py' AND is_source").orderBy("t").collect()] == [["request"], ["input"]]


def test_live_names_are_not_sorted(spark):
    own = rul.Facts(texts(spark, ("a.py", "python", "a = request\nb = a\nc = d\nx = escape(a)\n")), persisted=True)
    hit = taint.tainted_extents(own.code, own.calls, taint._value_extents(own.assignments), own.tainted)
    assert "ShuffledHashJoin" in plan(hit) and "array_sort" not in plan(taint.live_names(own.code, own.calls, taint._value_extents(own.assignments)))
    assert hit.join(own.assignments, [hit["path"] == own.assignments["path"], hit["key"] == own.assignments["tok_no"]]).select("line_no").orderBy("line_no").collect() == [(1,), (2,)]


def test_points_come_in_order_and_barriers_nest(spark):
    extents = spark.createDataFrame([("f", 1, 0, 9), ("f", 2, 3, 6), ("g", 3, 0, 9)], "path string, key int, first_tok int, last_tok int")
    points = spark.createDataFrame([(p, t) for t in (8, 5, 4, 0, 9) for p in "fg"], "path string, t int").coalesce(1)
    barriers = spark.createDataFrame([("f", 3, 6), ("f", 4, 4), ("f", 5, 12)], "path string, first_tok int, last_tok int")
    got = {r["key"]: [x["t"] for x in r["points"]] for r in holding(extents, points, barriers).collect()}
    assert got == {1: [0, 8, 9], 3: [0, 4, 5, 8, 9]}


def test_ends_of_files_take_no_sort(spark):
    own = facts(texts(spark, ("a.py", "python", "def f():\n    x = 1\n    s = '''a\nb\n'''\n")))
    rows = fact.functions(own.code)
    assert "SortAggregate" not in plan(rows)
    assert [(r["end_line"], r["end_tok"]) for r in rows.collect()] == [(5, own.code.agg({"tok_no": "max"}).first()[0])]
