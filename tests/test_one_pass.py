"""Tokens and code tokens come from one pass over a file's list of tokens, and tell only what facts ask for."""

from pyspark.sql import functions as F

from coderake.operators import rules as rul
from coderake.operators.tokens import code_of, tokens
from tests.test_scan import texts


def test_one_pass_makes_code(spark):
    own = rul.Facts(texts(spark, ("a.js", "javascript", "f(x, y);\n")))
    plan = own.code._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_escaped_nul_comes_back(spark):
    text = 'x = "a\\\0b" + "c"\n'
    rows = tokens(texts(spark, ("a.py", "python", text))).orderBy("tok_no").collect()
    assert "".join(r["text"] for r in rows) == text
    assert [(r["byte_off"], r["byte_end"]) for r in rows if r["kind"] == "string"] == [(4, 10), (13, 16)]


def test_only_what_is_asked_is_told(spark):
    """Neighbours stand where a fact reads them: at blocks, commas, signs, calls and lines of indented languages."""
    rows = code_of(texts(spark, ("a.js", "javascript", "if (a) { b(c + d, 1); }\n"))).orderBy("tok_no").collect()
    assert {r["mask"] for r in rows if r["prev"] is not None} == {"{"}
    assert {r["mask"] for r in rows if r["next_tok"] is not None} == {"b", ","}
    assert {r["mask"]: r["called"] for r in rows if r["called"]} == {"b": 1}


def test_large_and_small_files_and_none(spark):
    """Slices of files end with a file, whatever its size; files without tokens, or without code, are no files of code."""
    files = [("large.py", "python", "x = f(y)\n" * 20_000), ("empty.py", "python", ""), ("note.py", "python", "# nothing\n")] + [(f"{n}.py", "python", f"x{n} = f(y)\n") for n in range(30)]
    own = rul.Facts(texts(spark, *files))
    assert own.code.count() == 6 * 20_030 and own.calls.count() == 20_030
    assert own.assignments.groupBy("path").count().where("count = 1").count() == 30
    assert own.tokens.groupBy("path").agg(F.min("off").alias("first"), F.max("tok_no").alias("last"), F.count("*").alias("n")).where("first <> 0 OR last + 1 <> n").count() == 0


def test_code_is_written_with_numbers_for_words(spark):
    """Languages, kinds and sources come back as they were; no row of the written table carries them, or what a language alone tells."""
    files = texts(spark, ("a.py", "python", "x = request.args.get('id')\nif x: f(1, x)\n"), ("b.rb", "ruby", "q params[:id] if 'a' # b\n"), ("c.js", "javascript", "let a = `x`;\n/* c */"), ("d.go", "go", "input("), ("none.go", "go", " \n"))
    code = code_of(files)
    own = rul.Facts(files, persisted=True)
    assert own.code.columns == code.columns and [f.dataType for f in own.code.schema] == [f.dataType for f in code.schema]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(own.code) == rows(code) and code.where("source IS NOT NULL").count() > 2
    stored = {f.name: f.dataType.simpleString() for f in spark.read.parquet(*own.code.inputFiles()).schema}
    assert {c: stored.get(c) for c in ("language", "kind", "source", "blocks", "bare")} == {"language": "int", "kind": "int", "source": "int", "blocks": None, "bare": None}
