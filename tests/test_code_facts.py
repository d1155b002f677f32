"""Assignments and calls wherever they stand, whole calls as locations, and work in proportion to a file's size."""

import time

import pytest
from pyspark.sql import functions as F

from coderake.operators import facts as fact
from coderake.operators import rules as rul
from coderake.operators.tokens import code_tokens, tokens
from tests.test_scan import facts, texts

HANDLER = "app.get('/u', (req, res) => {\n  const id = req.query.id;\n  const sql = 'SELECT ' + id;\n  db.execute(sql);\n});\n"
ROUTE = "def user(name):\n    con = connect('a.db')\n    query = f\"select * from users where name = '{name}'\"\n    return con.execute(query).fetchall()\n\ndef hello():\n    name = request.args.get('name')\n    return render_text('<h1>{{ name }}</h1>', name=name)\n"
DEEP = "def deep(a, b, c, d):\n" + "".join("    " * (i + 1) + f"if {x}:\n" for i, x in enumerate(["a", "b", "c", "d", "a and b and c and d"])) + "    " * 6 + "return 1\n    return 2\n"
DEEP_CS = "class T\n{\n    string Deep(bool a, bool b)\n    {\n" + "".join("    " * (i + 2) + "if (a && b)\n" + "    " * (i + 2) + "{\n" for i in range(5)) + "    " * 7 + 'return "x";\n' + "".join("    " * (6 - i) + "}\n" for i in range(5)) + '        return "y";\n    }\n}\n'

#: Code, and (rule, line, column, snippet) of its findings.
FOUND = {
    "handler.js": (HANDLER, [("SQLI", 4, 3, "db.execute(sql)")]),
    "chained.js": ("b = c = req;\ndb.execute(b); db.execute(c);\n", [("SQLI", 2, 1, "db.execute(b)"), ("SQLI", 2, 16, "db.execute(c)")]),
    "chained.py": ("b = c = request\ndb.execute(b)\n", [("SQLI", 2, 1, "db.execute(b)")]),
    "declared.js": ("let a = 1, b = req.query.q, c;\ndb.execute(a); db.execute(b);\n", [("SQLI", 2, 16, "db.execute(b)")]),
    "one_line.py": ("if c: x = request\ndb.execute(x)\n", [("SQLI", 2, 1, "db.execute(x)")]),
    "literal.js": ("const o = {text: 'S' + req.body};\ndb.execute({sql: o});\n", [("SQLI", 2, 1, "db.execute({sql: o})")]),
    "loop.js": ("for (let i = req.body; i; i--) { el.innerHTML = i; }\n", [("XSS", 1, 34, "el.innerHTML = i")]),
    "nested.js": ("run(function () { go(() => { let k = req.body; el.innerHTML = k }) })\n", [("XSS", 1, 48, "el.innerHTML = k")]),
    "keyword_names_are_no_targets.py": ("f(y=request)\ndb.execute(y)\n", []),
    "hanging.py": ("x = request\ncon.cursor().execute(x)\n", [("SQLI", 2, 1, "con.cursor().execute(x)")]),
    "hanging.js": ("x = req;\nreturn new Pool(1).of(2)[3]\n  .query(x);\n", [("SQLI", 2, 8, "new Pool(1).of(2)[3]\n  .query(x)")]),
    "route.py": (ROUTE, [("SQLI", 4, 12, "con.execute(query)")]),
}


@pytest.fixture(scope="module")
def found(spark):
    own = facts(texts(spark, *[(p, {"py": "python", "js": "javascript"}[p.rsplit(".", 1)[1]], t) for p, (t, _) in FOUND.items()]))
    rows = rul.raw_findings(own, ["SQLI", "XSS"]).collect()
    return {p: sorted((r["rule_id"], r["location"]["line"], r["location"]["column"], r["location"]["snippet"].rstrip(";")) for r in rows if r["location"]["path"] == p) for p in FOUND}


@pytest.mark.parametrize("path", sorted(FOUND))
def test_findings(found, path):
    assert found[path] == FOUND[path][1]


def test_deep_functions(spark):
    own = rul.Facts(texts(spark, ("a.py", "python", DEEP), ("b.cs", "csharp", DEEP_CS)), location_mode="root_fallback", persisted=True)
    got = {r["location"]["path"]: (r["message"].rsplit(": ")[-1], r["location"]["line"], r["location"]["column"]) for r in rul.complexity(own).collect()}
    assert got == {"a.py": ("nesting 6 > 4", 1, 1), "b.cs": ("nesting 6 > 4", 1, 1)}
    assert {r["path"]: (r["max_nesting"], r["line_count"], r["top_level"]) for r in own.metrics.collect()} == {"a.py": (6, 8, True), "b.cs": (6, 20, False)}


def test_private_characters_and_escapes_come_back(spark):
    cases = ['x = "\\"\\n\\\\" + \\é->b', "\ue000\ue0a2 \\q a->b", "\ue800 a::b \\\\\\\"", "\\", "\\\n\\", "a->b->c?.d::e->", "\t\\\t\\\r\n"]
    files = texts(spark, *[(f"{k}{i}", k, t) for i, t in enumerate(cases) for k in ("python", "go")])
    rows = tokens(files)
    joined = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "text"))), lambda x: x["text"]), "").alias("joined"))
    assert files.join(joined, "path").where("text <> joined").count() == 0
    assert [r["mask"] for r in rows.where("path = 'go5' AND kind = 'name'").collect()] == ["a..b..c..d..e"]
    assert rows.where("path = 'go0' AND kind = 'string'").first()["text"] == '"\\"\\n\\\\"'


def test_equal_secrets_of_a_line_have_their_own_columns(spark):
    line = 'é token = "a"; token = "a"; password="b"'
    rows = rul.secret_lines(texts(spark, ("p", "python", line)), "path").orderBy("nth").collect()
    assert [(r["column"], r["match"]) for r in rows] == [(4, 'token = "a"'), (17, 'token = "a"'), (30, 'password="b"')]


def seconds(spark, text, work):
    began = time.time()
    work(texts(spark, ("p", "go", text))).write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_tokens_of_a_large_file(spark):
    """5 MB in one file; carrying the text on token rows took 43 s for 100 kB."""
    line = 'x = call(a, "text\\n", b.c->d) + 12; // note\n'
    seconds(spark, line, tokens)
    half, whole = (seconds(spark, line * (n // len(line)), tokens) for n in (2_500_000, 5_000_000))
    assert whole < 120 and whole < 3 * half + 5


def test_facts_of_a_large_file(spark):
    """One literal of 20,000 calls, and 3,000 functions: neither statements nor functions meet all tokens of the file."""
    literal = "a = [" + ", ".join(f"f{i}(g(x), {i})" for i in range(20_000)) + "];\n"
    functions = "".join(f"function h{i}(a) {{\n  if (a) {{ return q(a, 1); }}\n}}\n" for i in range(3_000))
    python = "".join(f"def h{i}(a):\n    if a:\n        return q(a)\n" for i in range(3_000))
    own = facts(texts(spark, ("a.js", "javascript", literal), ("b.js", "javascript", functions), ("c.py", "python", python)))
    began = time.time()
    assert own.arguments.count() == 20_000 * 3 + 3_000 * 2 + 3_000
    assert own.metrics.where("cyclomatic = 2 AND max_nesting = 2").count() == 6_000
    assert fact.located(own.files, own.code, own.functions.select("path", F.col("start_tok").alias("first_tok"), F.col("end_tok").alias("last_tok"))).count() == 6_000
    assert time.time() - began < 150


def test_brackets_that_never_close(spark):
    code = code_tokens(tokens(texts(spark, ("p", "javascript", "f(a, {b = [c\nx = y;"), ("q", "go", ")]}} f(x)"))))
    assert fact.calls(code).where("path = 'p' AND close_tok IS NULL").count() == 1 and fact.arguments(code, fact.calls(code)).where("path = 'p'").count() == 0
    assert [r["callee"] for r in fact.calls(code).where("path = 'q'").collect()] == ["f"]
