"""Languages as rows: literals, comments and calls as each language writes them, blocks by words, a language of one's own."""

import time

import pytest
from pyspark.sql import functions as F

from coderake.functions.languages import BUILT_IN, Languages, built_in, relation
from coderake.operators import rules as rul
from coderake.operators.tokens import tokens
from coderake.plans.scan import scan
from tests.test_scan import facts, raw, texts

EXTENSIONS = {"rb": "ruby", "kt": "kotlin", "cs": "csharp", "rs": "rust", "swift": "swift", "java": "java", "go": "go", "cpp": "cpp", "c": "c", "js": "javascript", "ts": "typescript", "py": "python"}

#: Code, and (line, column, snippet) of the SQL sinks found in it.
FOUND = {
    "command.rb": ("q = params[:id]\ndb.execute q\ndb.query 'x', q if ok\nputs 1\ndb.execute \"select \" +\n  q\n", [(2, 1, "db.execute q"), (3, 1, "db.query 'x', q"), (5, 1, 'db.execute "select " +\n  q')]),
    "command_in_a_block.rb": ("list.each do |i|\n  x = params[:a]; db.execute x, i unless i\nend\nrun { |r| db.raw x }\n", [(2, 19, "db.execute x, i"), (4, 11, "db.raw x")]),
    "symbols_and_clean.rb": ("x = params\ndb.execute :all, a\ndb.execute escape(x), 1\ndb.exec :y, only: x\n", [(4, 1, "db.exec :y, only: x")]),
    "no_command.rb": ("x = params\ny = execute ? x : 1\nz = execute - x\nexecute\nx\ndef execute x\nend\nexecute = x\n", []),
    "block_comment.rb": ("x = params\n=begin\ndb.execute(x)\n=end\ndb.query(x)\n", [(5, 1, "db.query(x)")]),
    "heredoc.rb": ("x = params\nsql = run(<<~SQL, x)\n  db.execute(x)\n  SQL\ny = <<-'T'\ndb.execute(x) \"\n  T\nz = <<DOC\ndb.execute x\nDOC\ndb.raw(x)\n", [(11, 1, "db.raw(x)")]),
    "many_lines.rb": ("x = params\ns = 'a\ndb.execute(x)\n'\nr = s =~ /it's \"/ ; db.query(x)\nw = %w[db.execute(x)]\n", [(5, 21, "db.query(x)")]),
    "text.kt": ('val x = req\nval s = """\ndb.execute(x) " \\"""\ndb.query(x)\n', [(4, 1, "db.query(x)")]),
    "verbatim.cs": ('var x = req.query;\nvar p = @"c:\\"; db.execute(x);\nvar s = @"a ""q""\ndb.execute(x)\n"; db.query(x);\n', [(2, 17, "db.execute(x)"), (5, 4, "db.query(x)")]),
    "lifetime.rs": ("let x = req;\nlet s = \"a\ndb.execute(x)\";\nlet r = r#\"say \"hi\" db.execute(x)\"#;\nfn life<'a, 'b>(y: &'a str, c: char) { let q = '\"'; let n = '\\n'; db.query(x); }\n", [(5, 67, "db.query(x)")]),
    "text.swift": ('let x = req\nlet s = """\ndb.execute(x)\n"""\nlet t = #"a " db.execute(x)"#\ndb.query(x)\n', [(6, 1, "db.query(x)")]),
    "text.java": ('String x = req;\nString s = """\n db.execute(x) \\" """;\ndb.query(x);\n', [(4, 1, "db.query(x)")]),
    "raw.go": ("x := req\ns := `a\\`\ndb.query(x)\n", [(3, 1, "db.query(x)")]),
    "raw.cpp": ("auto x = req;\nauto s = R\"(a \" db.execute(x))\";\nchar c = '\"'; db.query(x);\n", [(3, 15, "db.query(x)")]),
    "hash.c": ("#include \"a.h\"\nint x = req; db.query(x);\n", [(2, 14, "db.query(x)")]),
    "regex.js": ("let x = req;\nx.replace(/'/g, ''); db.query(x); y('a');\nlet r = /[/\"]/; db.raw(x); z(\"\");\na = b / c; d = e / f; db.exec(x);\nreturn /\\/'/.test(x) || db.execute(x)\n", [(2, 22, "db.query(x)"), (3, 17, "db.raw(x)"), (4, 23, "db.exec(x)"), (5, 25, "db.execute(x)")]),
    "regex.ts": ("let x: T = req\nif (s.match(/\"/)) db.query(x)\nf(a => /'/, x); db.exec(x)\n", [(2, 19, "db.query(x)"), (3, 17, "db.exec(x)")]),
    "goes_on.js": ("const q = 'SELECT ' +\n  req.query.id;\ndb.execute(q);\nn++\nm = q\ndb.execute(n)\n", [(3, 1, "db.execute(q)")]),
    "two_statements.py": ("x = request\ncur.execute\n(x)\n", []),
    "one_statement.py": ("x = request\nf(cur.execute\n(x))\n", [(2, 3, "cur.execute\n(x)")]),
}


@pytest.fixture(scope="module")
def found(spark):
    own = facts(texts(spark, *[(p, EXTENSIONS[p.rsplit(".", 1)[1]], t) for p, (t, _) in FOUND.items()]))
    rows = [(r["location"]["path"], r["location"]["line"], r["location"]["column"], r["location"]["snippet"]) for r in rul.sql_injection(own).collect()]
    return {p: sorted(r[1:] for r in rows if r[0] == p) for p in FOUND}


@pytest.mark.parametrize("path", sorted(FOUND))
def test_sinks(found, path):
    assert found[path] == FOUND[path][1]


def test_tokens_cover_literals_and_hostile_texts(spark):
    cases = ["", "'" * 3001, '"' * 3001, "/*" * 20_000, "r#" * 9_000 + '"', '@"' + '""' * 60_000, "/" + "[a]" * 40_000, "x = /" + "a" * 100_000 + "/g", "<<~A " * 300 + "\n", "<<~A\n" + "b\n" * 20_000 + "A\nc", "=begin\n" + "x" * 50_000, "%w[" * 900, "\\'\\\"\\`\\/" * 500]
    files = texts(spark, *[(f"{k}{i}", k, t) for i, t in enumerate(cases) for k in ("ruby", "csharp", "rust", "javascript", "swift", "kotlin")])
    joined = tokens(files).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "text"))), lambda x: x["text"]), "").alias("joined"))
    assert files.where("text <> ''").join(joined, "path", "left").where("NOT (text <=> joined)").count() == 0


def test_kinds(spark):
    rows = tokens(texts(spark, ("a.rb", "ruby", "f(<<~S, 1) # c\n x\nS\n%w[a b] `c`"), ("b.rs", "rust", "'a 'b' r#\"x\"# // c\n# #"), ("c.js", "javascript", "a = /x/ / b # `t\n`"), ("d.py", "python", "#\n'''a\n'''")))
    got = {}
    for r in rows.where("kind NOT IN ('space', 'newline', 'op')").orderBy("path", "tok_no").collect():
        got.setdefault(r["path"], []).append((r["kind"], r["text"]))
    assert got == {
        "a.rb": [("name", "f"), ("string", "<<~S"), ("number", "1"), ("comment", "# c"), ("heredoc", "\n x\nS"), ("string", "%w[a b]"), ("string", "`c`")],
        "b.rs": [("string", "'b'"), ("string", 'r#"x"#'), ("comment", "// c")],
        "c.js": [("name", "a"), ("string", "/x/"), ("name", "b"), ("string", "`t\n`")],
        "d.py": [("comment", "#"), ("string", "'''a\n'''")],
    }


RUBY = """
class Box
def one(a)
      if a then x = 1
  end
   z.each do |w|
 puts w if w
      end
 while x do x = 1 end
 until y
   begin
y = {if: 1, end: 2, k: :end}
   rescue
   end
     end
  return if x
  v = if a
    1
else 2 end
        case v
when 1 then 2 end
    end
def two; three.end; self.class; end
  def self.four() 5 end
end
def open_ended
"""


def test_blocks_by_words(spark):
    own = rul.Facts(texts(spark, ("a.rb", "ruby", RUBY)), persisted=True)
    rows = {r["name"]: (r["start_line"], r["end_line"], r["top_level"]) for r in own.functions.collect()}
    assert rows == {"one": (3, 22, False), "two": (23, 23, False), "self.four": (24, 24, False)}
    assert {r["name"]: r["max_nesting"] for r in own.metrics.collect()} == {"one": 3, "two": 1, "self.four": 1}


#: Two more languages, in rows alone.
LUA = [("lua", "extension", ".lua", "", ""), ("lua", "comment", "--", "\n", ""), ("lua", "comment", "--[[", "]]", ""), ("lua", "string", "[[", "]]", "raw"), ("lua", "string", '"', '"', "line"), ("lua", "string", "'", "'", "line"), ("lua", "blocks", "words", "", ""), ("lua", "calls", "bare", "", ""), ("lua", "rule", "SQLI", "", ""), ("lua", "rule", "COMPLEXITY", "", "")]
LUA += [("lua", role, w, "", "") for role, ws in {"keyword": ["function", "local", "if", "then", "else", "elseif", "end", "for", "while", "do", "return", "not", "and", "or", "in", "nil", "true", "false"], "function": ["function"], "opener": ["function", "if", "for", "while", "do"], "loop": ["for", "while"], "closer": ["end"], "end": ["then", "do", "end", "else"], "branch": ["if", "elseif", "for", "while", "and", "or"], "value": ["end", "nil", "true", "false"]}.items() for w in ws]
PHP = [("php", "extension", ".php", "", ""), ("php", "comment", "//", "\n", ""), ("php", "comment", "#", "\n", ""), ("php", "comment", "/*", "*/", ""), ("php", "string", '"', '"', "lines"), ("php", "string", "'", "'", "lines"), ("php", "blocks", "braces", "", ""), ("php", "rule", "SQLI", "", ""), ("php", "rule", "HARDCODED_SECRET", "", "")]
PHP += [("php", role, w, "", "") for role, ws in {"keyword": ["function", "if", "else", "foreach", "as", "return", "echo", "new"], "function": ["function"], "bracket": ["if", "while", "for"], "branch": ["if", "foreach", "&&"]}.items() for w in ws]


def test_languages_of_ones_own(spark):
    lua = "local x = request -- db.query(x)\n--[[ db.execute(x)\n]] local s = [[\ndb.execute(x) ']]\ndb:query(x)\ndb.execute(x)\nexec 'a'\nlocal function deep(a)\n for i in a do while i do\n if a then if i then if a and i then return 1 end end end\n end end\nend\n"
    php = "<?php\n$x = req; # db.query($x)\n$y = 'a\ndb.query($x)'; $db->query($x);\n$password = 'abc';\n"
    done = scan(raw(spark, ("a.lua", lua), ("b.php", php), ("c.py", "x = request\ncur.execute(x)\n"), ("d.txt", "x")), languages=relation(spark, LUA + PHP))
    got = sorted((r["location"]["path"], r["rule_id"], r["location"]["line"], r["message"].split(": ")[-1][:13]) for r in done.found.collect())
    assert [g[:3] for g in got] == [("a.lua", "COMPLEXITY", 8), ("a.lua", "SQLI", 5), ("a.lua", "SQLI", 6), ("b.php", "HARDCODED_SECRET", 5), ("b.php", "SQLI", 4), ("c.py", "SQLI", 2)]
    assert got[0][3] == "nesting 6 > 4"


def test_a_word_more(spark):
    """An alias of a function word, added to a built-in language."""
    rows = [("python", "function", "proc", "", ""), ("python", "keyword", "proc", "", "")]
    own = rul.Facts(texts(spark, ("p", "python", "proc f(a):\n    if a:\n        return a\n")), languages=Languages.of(relation(spark, rows)), persisted=True)
    assert [(r["name"], r["end_line"]) for r in own.functions.collect()] == [("f", 3)]
    assert own.calls.count() == 0 and Languages().rows == BUILT_IN.rows == sorted(set(built_in()))


def test_taint_of_very_many_names(spark):
    """A chain of 50,000 names, each tainted by the one before it."""
    chain = "x0 = request\n" + "".join(f"x{i} = x{i - 1}\n" for i in range(1, 50_000))
    clean = "".join(f"y{i} = y{i - 1}\n" for i in range(1, 20_000))
    own = facts(texts(spark, ("p", "python", chain + clean + "cur.execute(x49999)\ncur.execute(y19999)\n")))
    began = time.time()
    names = own.tainted.first()["names"]
    assert len(names) == 50_001 and "x49999" in names and "y7" not in names
    assert [r["location"]["line"] for r in rul.sql_injection(own).collect()] == [70_000]
    assert time.time() - began < 150
