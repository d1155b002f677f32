"""Code derived from the ``part`` table: templated files that exercise every rule, in SQL that several engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HASH = r"""concat(
  '# part ', p_brand, chr(10),
  'name = ', CASE WHEN p_partkey % 2 = 0 THEN 'request.args.get("id")' ELSE '"const"' END, chr(10),
  'alias = name + "x"', chr(10),
  'safe = escape(alias)', chr(10),
  'text = "quote ', chr(92), '" #no" + ', chr(39), 'it', chr(39), chr(10),
  'y = alias + "', p_brand, '"', CASE WHEN p_partkey % 5 = 0 THEN '  # scan:ignore' ELSE '' END, chr(10),
  'cur.execute("SELECT " + y, [safe, 1])', chr(10),
  'cur.execute("SELECT 1", escape(y))', chr(10),
  'db.query(safe)', chr(10),
  CASE WHEN p_partkey % 4 = 0 THEN concat('password = "s3cret', CAST(p_size AS varchar(10)), '"', chr(10)) ELSE '' END,
  'page.innerHTML = y', chr(10),
  'render("t", f(y).name)', chr(10),
  'def handler(a, b):', chr(10),
  '    ', repeat(chr(34), 3), ' a docstring', chr(10), '    of two lines ', repeat(chr(34), 3), chr(10),
  '    if a and b:', chr(10), '        for i in a:', chr(10), '            while b:', chr(10), '                with a:', chr(10),
  CASE WHEN p_partkey % 6 < 3 THEN concat('                    try:', chr(10), '                        if a or b:', chr(10), '                            a = 1', chr(10)) ELSE concat('                    a = 2', chr(10)) END,
  '    def inner(c):', chr(10), '        return c', chr(10),
  '    return a', chr(10),
  'if a: d = alias', chr(10),
  'b = c = d', chr(10),
  'con.cursor().execute(', chr(10), '  "SELECT " + b)', chr(10),
  'box = {"k": y, "l": [1, 2]}', chr(10),
  'db.query(text=box)', chr(10),
  'last = 1', chr(10))"""

_SLASH = r"""concat(
  '/* part', chr(10), p_brand, ' */', chr(10),
  'const name = ', CASE WHEN p_partkey % 2 = 0 THEN 'req.query.id' ELSE '"const"' END, ';', chr(10),
  'let alias = name + `t`; let safe = encodeURIComponent(alias);', chr(10),
  'let text = "quote ', chr(92), '" //no";', chr(10),
  'let y = alias + "', p_brand, '";', CASE WHEN p_partkey % 5 = 0 THEN '  // scan:ignore' ELSE '' END, chr(10),
  'db->query("SELECT " + y, [safe, 1]);', chr(10),
  'document.write(safe); document.write(y);', chr(10),
  'el.innerHTML = y;', chr(10),
  CASE WHEN p_partkey % 4 = 0 THEN concat('const api_key = "k', CAST(p_size AS varchar(10)), '";', chr(10)) ELSE '' END,
  'function handler(a, b) {', chr(10),
  '  if (a && b) {', chr(10), '    for (;;) {', chr(10), '      while (b) {', chr(10), '        do {', chr(10),
  CASE WHEN p_partkey % 6 < 3 THEN concat('          try {', chr(10), '            x(a ? { k: 1 } : b);', chr(10), '          } catch (e) { a = 1; }', chr(10)) ELSE concat('          a = 2;', chr(10)) END,
  '        } while (a);', chr(10), '      }', chr(10), '    }', chr(10), '  }', chr(10),
  '  run(a); const g = (c) => { return c; };', chr(10),
  '}', chr(10),
  'app.get("/u", (req, res) => {', chr(10),
  '  const id = ', CASE WHEN p_partkey % 3 = 0 THEN 'req.query.id' ELSE '"1"' END, ', box = { text: "S" + id, n: [1, 2] };', chr(10),
  '  m = k = id', chr(10), '  db.execute(box, k); open(m).query({ sql: m });', chr(10),
  '  for (let i = m; i < 3; i++) { el.outerHTML = i; }', chr(10),
  '});', chr(10),
  'void tail(int q) { q = 1; }', chr(10))"""

_RUBY = r"""concat(
  '# part ', p_brand, chr(10),
  'name = ', CASE WHEN p_partkey % 3 = 0 THEN 'params[:id]' ELSE '"const"' END, chr(10),
  'other = name + "x"', chr(10),
  'safe = escape(other)', chr(10),
  'text = "quote ', chr(92), '" #no" + ', chr(39), 'it', chr(39), chr(10),
  'y = other + "', p_brand, '"', CASE WHEN p_partkey % 5 = 0 THEN '  # scan:ignore' ELSE '' END, chr(10),
  '=begin', chr(10), 'cur.execute(y)', chr(10), '=end', chr(10),
  'cur.execute "SELECT " + y, [safe, 1]', chr(10),
  'con.cursor(1).execute "SELECT 1", escape(y)', chr(10),
  'db.query safe', chr(10),
  CASE WHEN p_partkey % 4 = 0 THEN concat('password = "s3cret', CAST(p_size AS varchar(10)), '"', chr(10)) ELSE '' END,
  'page.innerHTML = y', chr(10),
  'run(<<~SQL, y)', chr(10), '  db.execute(y) "', chr(10), '  SQL', chr(10),
  'note = ', chr(39), 'two', chr(10), 'db.execute(y)', chr(39), chr(10),
  'db.raw name if name =~ /it', chr(39), 's "/', chr(10),
  'list = %w[db.execute(y) b]', chr(10),
  'class Box', chr(10),
  '    def handler(a, b)', chr(10), '  if a && b', chr(10), '      a.each do |i|', chr(10), '    while b do', chr(10), '   case a', chr(10),
  ' when 1 then x = 1', chr(10), CASE WHEN p_partkey % 6 < 3 THEN concat('  unless b', chr(10), '    x = 2', chr(10), ' end', chr(10)) ELSE '' END,
  '      end', chr(10), '  end', chr(10), '    end', chr(10), ' end', chr(10),
  '   return if a', chr(10), '  def inner(c); c; end', chr(10), '  end', chr(10),
  'end', chr(10),
  'def self.low; z = name if safe; end', chr(10),
  'render json: y, status: :ok', chr(10),
  'long = name +', chr(10), '  "z"', chr(10),
  'db.query long', chr(10))"""

#: What ends the files of each language: literals that hold quotes, signs of comments or calls of their own.
_TAILS = {
    ".js": r"""concat('z.replace(/', chr(39), '/g, ""); db.query(name); z("it', chr(39), 's");', chr(10), 'let rx = /[/"]/; let s = "a" +', chr(10), '  y; db.exec(s);', chr(10))""",
    ".ts": r"""concat('z.replace(/', chr(39), '/g, ""); db.query(name); z("it', chr(39), 's");', chr(10), 'n++', chr(10), 'let rx = /[/"]/;', chr(10))""",
    ".java": r"""concat('String s = ', repeat(chr(34), 3), chr(10), ' db.execute(name) ', chr(92), '" ', repeat(chr(34), 3), ';', chr(10), 'db.query(s);', chr(10))""",
    ".kt": r"""concat('val s = ', repeat(chr(34), 3), chr(10), ' db.execute(name) " ', chr(92), repeat(chr(34), 3), chr(10), 'db.query(name)', chr(10))""",
    ".go": r"""concat('s := `a', chr(92), '`', chr(10), 'db.query(name)', chr(10))""",
    ".cs": r"""concat('var p = @"c:', chr(92), '"; db.execute(name);', chr(10), 'var v = @"a ""q""', chr(10), 'db.execute(name)"; db.query(v);', chr(10))""",
    ".rs": r"""concat('let s = "a', chr(10), 'db.execute(name)"; let r = r#"say "hi" db.execute(name)"#;', chr(10), 'fn life<', chr(39), 'a>(x: &', chr(39), 'a str, c: char) { let d = ', chr(39), '"', chr(39), '; db.query(name); }', chr(10))""",
    ".swift": r"""concat('let s = ', repeat(chr(34), 3), chr(10), 'db.execute(name)', chr(10), repeat(chr(34), 3), chr(10), 'let t = #"a " db.execute(name)"#', chr(10), 'db.query(name)', chr(10))""",
    ".cpp": r"""concat('auto s = R"(a " db.execute(name))"; char c = ', chr(39), '"', chr(39), '; db.query(name);', chr(10))""",
    ".h": r"""concat('char c = ', chr(39), '"', chr(39), '; db.query(name);', chr(10))""",
    ".py": r"""concat('cur.execute', chr(10), '(name)', chr(10))""",
}
_SUFFIXES = [".py", ".js", ".RB", ".ts", ".txt", ".java", ".py", ".go", ".cs", ".kt", ".rb", ".rs", ".swift", ".cpp", ".py", ".h"]
_SUFFIX = "CASE p_partkey % 16 " + " ".join(f"WHEN {n} THEN '{suffix}'" for n, suffix in enumerate(_SUFFIXES)) + " END"
_TAIL = "CASE p_partkey % 16 " + " ".join(f"WHEN {n} THEN {_TAILS[suffix]}" for n, suffix in enumerate(_SUFFIXES) if suffix in _TAILS) + " ELSE '' END"

#: Rows of ``part`` in one task, at most on average: some 40 MB of texts, which a task holds as it deals them out by path.
ROWS = 50_000

#: code_files(p_partkey, path, text): an ignored folder for each seventh file, sixteen suffixes of which one is unknown.
CODE_FILES = f"""SELECT p_partkey,
  concat('repo/', CASE WHEN p_partkey % 7 = 0 THEN 'build/' ELSE 'app/' END, 'f', CAST(p_partkey AS varchar(20)), {_SUFFIX}) AS path,
  concat(CASE WHEN p_partkey % 16 IN (2, 10) THEN {_RUBY} WHEN p_partkey % 16 IN (0, 4, 6, 14) THEN {_HASH} ELSE {_SLASH} END, {_TAIL}) AS text
FROM part"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = CODE_FILES.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}")
    # A part's row becomes a file of a thousand times its size: rows are dealt out first, to more tasks the more there are.
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(query, part=part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // ROWS)), "p_partkey"))
