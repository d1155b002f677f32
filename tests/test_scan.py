"""Small literal cases of the scanner's semantics."""

import json

import pytest
from pyspark.sql import functions as F

from coderake.functions import vocabulary as voc
from coderake.functions.languages import BUILT_IN
from coderake.operators import findings as fnd
from coderake.operators import reports as rep
from coderake.operators import rules as rul
from coderake.operators import taint
from coderake.operators.tokens import tokens
from coderake.plans import policy as pol
from coderake.plans.scan import scan
from coderake.sources import files as src
from coderake.streaming.incremental import file_stream, scan_stream
from tests import whole_reports as whole


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, language string, text string")


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def facts(files):
    return rul.Facts(files, persisted=True)


def hits(found):
    return sorted((r["rule_id"], r["location"]["line"]) for r in found.collect())


def test_tokens_cover_hostile_texts(spark):
    cases = ["", '"' + '\\"' * 50_000 + '"', "a" + ".b" * 20_000, "/*" + "x" * 200_000 + "*/", '"""' + "y\n" * 50_000 + '"""', '"open', "é = 'ü' # ß\nx"]
    files = texts(spark, *[(f"{k}{i}", k, t) for i, t in enumerate(cases) for k in ("python", "go")])
    joined = tokens(files).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "text"))), lambda x: x["text"]), "").alias("joined"))
    wrong = files.where("text <> ''").join(joined, "path", "left").where("NOT (text <=> joined)")
    assert wrong.count() == 0


def test_columns_count_bytes(spark):
    row = tokens(texts(spark, ("p", "python", "é = x"))).where("text = 'x'").first()
    assert (row["col_no"], row["off"]) == (6, 4)


#: Code, and (rule, line) of what is found in it with the default policy.
CASES = {
    "sink_before_its_taint.py": ("cur.execute(x)\nx = req\n", [("SQLI", 1)]),
    "sanitizer_inside_counts_and_around_does_not.py": ("x = req\ncur.execute(escape(x))\nescape(cur.execute(x))\n", [("SQLI", 3)]),
    "strings_are_never_tainted.py": ('x = req\ncur.execute(f"select {x}")\n', []),
    "property_sink_and_arrow_chain.js": ("let y = req.body;\nel->innerHTML = y;\n", [("XSS", 2)]),
    "go_has_no_xss.go": ("x := req\nrender(x)\n", []),
    "suppressed_on_the_line_and_below.py": ("x = req\n# scan:ignore\ncur.execute(x)\ncur.execute(x)  # scan:ignore\ncur.execute(x)\ncur.execute(x)\n", [("SQLI", 6)]),
    "own_sanitizer.py": ("x = req\ncur.execute(wash(x))\n", []),
    "names_are_global.py": ("def f():\n    x = req\ndef g():\n    cur.execute(x)\n", [("SQLI", 4)]),
    "assigned_clean.py": ("x = req\ny = escape(x)\ncur.execute(y)\n", []),
}


@pytest.fixture(scope="module")
def scanned(spark):
    return scan(raw(spark, *[(k, v[0]) for k, v in CASES.items()]), sanitizers=["wash"])


def test_cases(scanned):
    found = {}
    for r in scanned.findings.collect():
        found.setdefault(r["location"]["path"], []).append((r["rule_id"], r["location"]["line"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: v[1] for k, v in CASES.items() if v[1]}
    assert scanned.summary.first()["suppressed"] == 3


def test_tainted_names(spark):
    own = facts(texts(spark, ("p", "python", 'v = request.args.get("id")\nw = v\nclean = escape(w)\nz = 1\n'), ("q", "python", "a = b\nb = req\n")))
    assert {r["path"]: r["names"] for r in own.tainted.collect()} == {"p": ["args", "get", "request", "v", "w"], "q": ["b", "req"]}


def test_paths(spark):
    files = raw(spark, ("a/build/x.py", ""), ("a/x.PY", ""), ("a/x.h", ""), ("a/x.txt", ""), ("a/.git", ""), ("a/py", ""))
    kept = src.with_language(src.not_ignored(files)).collect()
    assert sorted((r["path"], r["language"]) for r in kept) == [("a/x.PY", "python"), ("a/x.h", "c")]
    assert src.not_ignored(raw(spark, ("/x/build/a.py", "")), root="/x/build").count() == 1


def test_lines(spark):
    rows = src.code_lines(texts(spark, ("p", "go", "a\r\nb\x0bc\u2028d\n"), ("q", "go", ""), ("r", "go", None), ("s", "go", "\n"))).collect()
    assert [(r["path"], r["line_no"], r["line"]) for r in rows] == [("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c"), ("p", 4, "d"), ("s", 1, "")]


def test_policy(spark):
    over = spark.createDataFrame([("rules.enabled", "XSS"), ("thresholds", "none"), ("reporting.fail_on_severity", "Low")], "key_path string, value string")
    leaves = {r["key_path"]: r["value"] for r in pol.loaded(spark, over).collect()}
    assert leaves["rules.enabled"] == "XSS" and leaves["thresholds"] == "none"
    assert not any(k.startswith("thresholds.") for k in leaves)
    assert hits(scan(raw(spark, ("p.py", "x = req\ncur.execute(x)\nrender(x)\n")), over).found) == [("XSS", 3)]


def test_complexity_nesting_and_thresholds(spark):
    body = "def f():\n" + "".join("    " * n + "if a:\n" for n in range(1, 6)) + "    " * 6 + "pass\n"
    own = facts(texts(spark, ("p", "python", body), ("q", "go", "func f() {\n if a && b { for { if c { switch { } } } }\n}\n"), ("r", "ruby", "def f\n  x = 1\nend\ny = 2\n")))
    assert [(r["name"], r["start_line"], r["end_line"]) for r in own.functions.where("path = 'r'").collect()] == [("f", 1, 3)]
    found = {r["path"]: (r["cyclomatic"], r["max_nesting"], r["line_count"]) for r in own.metrics.where("path <> 'r'").collect()}
    assert found == {"p": (6, 6, 7), "q": (6, 5, 3)}
    assert [r["violated"] for r in rul.violations(own.metrics.where("path = 'p'")).collect()] == [["nesting 6 > 4"]]


def test_fixes_apply_in_order(spark):
    done = scan(raw(spark, ("p.py", 'password = "a"\ntoken = "b"\n')))
    fix = F.struct(F.lit("d").alias("description"), F.col("location.snippet").alias("before"), F.lit("x = env()").alias("after"), F.lit("").alias("diff"), (F.col("location.line") == 1).alias("auto_applicable"))
    found = done.findings.withColumn("fix", fix)
    assert [tuple(r) for r in fnd.apply_fixes(found, done.files).select("text", "applied", "skipped").collect()] == [('x = env()\ntoken = "b"\n', 1, 1)]
    assert fnd.fix_counts(fnd.apply_fixes(found, done.files, dry_run=True)).first().asDict() == {"auto_fixes_applied": 0, "auto_fixes_skipped": 2}


@pytest.mark.parametrize("severity, threshold, code", [("High", "High", 2), ("Low", "Medium", 0), ("odd", "High", 0), ("High", "odd", 2), ("Critical", "High", 2)])
def test_gate(spark, severity, threshold, code):
    assert fnd.gate(spark.createDataFrame([(severity,)], "severity string"), threshold).first()["exit_code"] == code


def test_reports_and_writers(spark, tmp_path):
    done = scan(raw(spark, ("p.py", "x = req\ncur.execute(x)\nrender(x)\n")))
    text = whole.text_report(done.findings, done.summary).first()[0]
    assert text.startswith("[High/Medium] SQLI: ") and text.endswith("Auto-fixes skipped: 0\n") and "  Snippet: render(x)\n" in text
    document = json.loads(whole.json_report(done.findings, done.summary).first()[0])
    assert document["summary"]["count"] == 2 and document["findings"][0]["fix"] is None
    sarif = json.loads(whole.sarif_report(done.findings).first()[0])
    assert [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["SQLI", "XSS"] and sarif["$schema"]
    for how in ("text", "json", "sarif", "jsonl", "parquet"):
        rep.write_report(done.findings, done.summary, f"{tmp_path}/{how}", how)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2


def test_scan_of_a_folder_and_of_nothing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_bytes(b"x = req\ncur.execute(x) # \xff\n")
    (tmp_path / "a/big.py").write_text("y = 1\n" * 1000)
    done = scan(src.read_files(spark, str(tmp_path)), max_file_bytes=1000)
    assert hits(done.found) == [("SQLI", 2)]
    assert [r["path"].rsplit("/", 1)[1] for r in done.left_out.collect()] == ["big.py"]
    nothing = scan(raw(spark).limit(0))
    assert nothing.found.count() == 0 and nothing.gate.first()["exit_code"] == 0
    assert whole.text_report(nothing.findings, nothing.summary).first()[0].startswith("Suppressed findings: 0")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.py").write_text("x = req\ncur.execute(x)\n")
    query = scan_stream(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert hits(spark.read.parquet(str(tmp_path / "out/findings"))) == [("SQLI", 2)]


def test_vocabulary_tables(spark):
    assert BUILT_IN.extensions(spark).count() == 23
    assert voc.taint_terms(spark).count() == 34
    assert voc.sinks(spark, [("SQLI", "call", "run")]).count() == 22
    assert taint.TAINT_TERMS["sanitizer"][0] == "escape"


#: Layouts in which literals, chains, declarations or one-line blocks hold what is tainted.
LAYOUTS = {
    "literal_argument.js": ('let y = req.body;\ndb.execute({text: "S" + y});\n', [("SQLI", 2)]),
    "argument_after_a_callback.js": ("let y = req.body;\nrun.execute(function (e) { done(e); }, y);\n", [("SQLI", 2)]),
    "sanitized_literal.js": ("let y = req.body;\ndb.execute(escape({text: y}), {a: 1});\n", []),
    "literal_value.py": ('x = {\n    "a": request.args.get("q"),\n}\ncur.execute(x)\n', [("SQLI", 4)]),
    "chain.py": ("a = b = input()\ncur.execute(b)\ncur.execute(a)\n", [("SQLI", 2), ("SQLI", 3)]),
    "declarations.js": ("let a = 1, b = req.query.q;\ndb.execute(b);\ndb.execute(a);\n", [("SQLI", 2)]),
    "pattern.js": ("const { a, b } = req.query;\ndb.execute(b);\n", [("SQLI", 2)]),
    "one_line_block.py": ("if c: x = input()\ncur.execute(x)\ncur.execute(c)\n", [("SQLI", 2)]),
    "tuple.py": ("a, b = 1, input()\ncur.execute(a)\n", [("SQLI", 2)]),
    "case_block.js": ("switch (c) {\n  case 1: {\n    x = req.body\n    y = 2\n  }\n}\ndb.execute(x)\ndb.execute(y)\n", [("SQLI", 7)]),
    "literal_with_function.js": ("let o = {\n  f: function (a) { return a; },\n  g: req.body,\n};\ndb.execute(o);\n", [("SQLI", 5)]),
}


def test_layouts(spark):
    found = {}
    for r in scan(raw(spark, *[(k, v[0]) for k, v in LAYOUTS.items()])).findings.collect():
        found.setdefault(r["location"]["path"], []).append((r["rule_id"], r["location"]["line"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: v[1] for k, v in LAYOUTS.items() if v[1]}


def test_one_row_for_each_sign(spark):
    own = facts(texts(spark, ("p", "javascript", "let a = 1, b = c = f(2, 3), d;\n"), ("q", "python", "if c: x: int = 1\n")))
    rows = own.assignments.join(own.code.select("path", "tok_no", "off"), ["path", "tok_no"]).orderBy("path", own.code["off"]).collect()
    assert [(r["path"], r["targets"]) for r in rows] == [("p", ["a"]), ("p", ["b"]), ("p", ["c"]), ("q", ["x"])]


def test_reports_are_rows(spark, tmp_path):
    done = scan(raw(spark, *[(f"p{i:03}.py", "x = req\ncur.execute(x)\nrender(x)\n") for i in range(40)]))
    twice = done.findings.unionByName(done.findings.where("location.path = 'p000.py'"))  # equal findings stay
    documents = {"text": whole.text_report(twice, done.summary), "json": whole.json_report(twice, done.summary), "sarif": whole.sarif_report(twice)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of so few rows
    for how, one in documents.items():
        rep.write_report(twice, done.summary, f"{tmp_path}/{how}", how)
        parts = sorted((tmp_path / how).glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert len(parts) > 1 and sum(p.stat().st_size > 0 for p in parts) > 1
        assert text == one.first()[0] if how == "text" else json.loads(text) == json.loads(one.first()[0])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nothing = done.findings.where("false")
    for how in ("json", "sarif"):
        rep.write_report(nothing, done.summary, f"{tmp_path}/no-{how}", how)
        assert json.loads("".join(p.read_text() for p in sorted((tmp_path / f"no-{how}").glob("part-*"))))


def test_nested_policy_documents(spark):
    defaults = {r["key_path"]: r["value"] for r in pol.loaded(spark).collect()}
    cases = {
        "none": ({}, {}),
        "deep": ({"thresholds": {"complexity": {"max_nesting": 9}}, "own": {"a": {"b": [1, "x", True], "c": 1.5}}}, {"thresholds.complexity.max_nesting": "9", "own.a.b": "1,x,true", "own.a.c": "1.5"}),
        "scalar over branch": ({"rules": {"severities": None}}, {**{k: ... for k in defaults if k.startswith("rules.severities.")}, "rules.severities": None}),
        "branch over scalar": ({"reporting": {"format": {"style": "x"}}}, {"reporting.format": ..., "reporting.format.style": "x"}),
        "hollow over scalar": ({"reporting": {"format": {}}, "rules": {}}, {"reporting.format": ...}),
        "list replaces": ({"rules": {"enabled": ["XSS"]}}, {"rules.enabled": "XSS"}),
        "empty list": ({"languages": {"enabled": []}}, {"languages.enabled": ""}),
        "dotted key": ({"a.b": {"c": 1}}, {"a\\.b.c": "1"}),
    }
    bad = [("broken", "{"), ("list", "[1]"), ("null", None)]
    documents = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in cases.items()] + bad, "team string, document string")
    got = {}
    for r in pol.merged(documents, "team").collect():
        got.setdefault(r["team"], {})[r["key_path"]] = r["value"]
    for k, (_, changes) in cases.items():
        want = {p: v for p, v in {**defaults, **changes}.items() if v is not ...}
        assert got.get(k, defaults if k == "none" else None) == want, k
    assert sorted(r["team"] for r in pol.malformed(documents, "team").collect()) == ["broken", "list", "null"]
    assert pol.merged(documents.limit(0), "team").count() == 0
    over = pol.leaves(spark.createDataFrame([('{"rules": {"enabled": ["XSS"]}}',)], "document string")).where("NOT hollow").drop("hollow")
    assert hits(scan(raw(spark, ("p.py", "x = req\ncur.execute(x)\nrender(x)\n")), over).found) == [("XSS", 3)]


def test_digest_of_a_report(spark):
    done = scan(raw(spark, *[(f"p{i:03}.py", "x = req\ncur.execute(x)\nrender(x) # é\n") for i in range(30)]))
    for how in ("text", "json", "sarif"):
        rows = rep.report_rows(done.findings, done.summary, how)
        placed = rep.with_offsets(rows).orderBy(*rep.PLACE).collect()
        document, whole_document = "", ""
        for r in placed:
            assert r["at"] == len(document.encode())
            document += r["value"] + "\n"
        spread = rep.report_digest(rows.repartition(7)).first()
        assert spread == rep.report_digest(rows).first() and spread["n_bytes"] == len(document.encode()) and spread["n_rows"] == len(placed)
        assert rep.report_digest(rep.report_rows(done.findings.where("location.path <> 'p007.py'"), done.summary, how)).first()["digest"] != spread["digest"]
    assert rep.report_digest(rows.limit(0)).first()["n_rows"] == 0
