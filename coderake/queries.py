"""One query per operator over the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.functions import vocabulary as voc
from coderake.operators import facts as fact
from coderake.operators import findings as fnd
from coderake.operators import reports as rep
from coderake.operators import rules as rul
from coderake.operators import taint
from coderake.operators import tokens as tkn
from coderake.oracle import LANG, PLAIN_LEXER, RANK, SECRET, array, over, q, words
from coderake.plans import policy as pol
from coderake.plans.scan import source_texts
from coderake.plans.tables import shared_dir, written
from coderake.sources import files as src
from coderake.sources.fixture import code_files

_FACTS: dict[tuple[str, str], rul.Facts] = {}
_SCANS: dict[tuple[str, str], DataFrame] = {}


def facts(spark: SparkSession, sf_dir: str) -> rul.Facts:
    """Facts about the derived code, written once for the queries of this session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = rul.Facts(source_texts(code_files(spark, sf_dir))[0], persisted=True)
    return _FACTS[key]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with ``suppressed``, kept like the facts."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCANS:
        own = facts(spark, sf_dir)
        rated = pol.with_rating(rul.raw_findings(own), F.broadcast(pol.rules(pol.loaded(spark))))
        _SCANS[key] = written(fnd.with_suppression(rated, own.files, "scan:ignore"), "found")
    return _SCANS[key]


def forget() -> None:
    """Drops what is kept for the queries of a session: they make facts and findings anew, also if a table has changed."""
    _FACTS.clear()
    _SCANS.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("rule_id", "location.path", F.col("location.line").alias("line"), F.col("location.column").alias("col"), F.col("location.snippet").alias("snippet"), *more)


Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# S: sources


@query(over("cf", "SELECT concat('d', CAST(p_partkey % 50 AS VARCHAR)) AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM cf GROUP BY 1"))
def s1_source_files(spark, d):
    """The derived code as real files in fifty folders, found again by the recursive scan; each text ends with a line break."""
    root = f"{shared_dir(spark)}/coderake/files-{uuid.uuid4().hex}"
    code_files(spark, d).select(F.concat(F.lit("d"), F.col("p_partkey") % 50).alias("folder"), "text").repartition("folder").write.partitionBy("folder").text(root)
    files = src.read_files(spark, root).select(F.regexp_extract("path", "/folder=([^/]+)/", 1).alias("folder"), "size")
    return files.where("folder <> ''").groupBy("folder").agg(F.sum("size").alias("size"))


@query(over("cf", f"SELECT path FROM cf WHERE NOT list_has_any(string_split(path, '/'), {array(voc.IGNORED_PARTS)})"))
def s2_not_ignored(spark, d):
    return src.not_ignored(code_files(spark, d)).select("path")


@query(over("cf", f"SELECT path, {LANG} AS language FROM cf WHERE {LANG} IS NOT NULL"))
def s3_language(spark, d):
    return src.with_language(code_files(spark, d)).select("path", "language")


@query(over("cf", f"SELECT path, {LANG} AS language FROM cf WHERE {LANG} IN ('python', 'go')"))
def s4_enabled_languages(spark, d):
    return src.enabled_languages(src.with_language(code_files(spark, d)), ["python", "go"]).select("path", "language")


@query("SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n_chars, md5(text || chr(65533)) AS text_md5 FROM documents")
def s5_decoded(spark, d):
    """Texts with one bad byte at the end, which becomes U+FFFD."""
    content = F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff")))
    text = src.decoded(content)
    return table(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


@query("""SELECT doc_id, CAST(n AS INT) AS line_no, md5(line) AS line_md5 FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line, len(l) AS last
  FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents WHERE text <> '')) WHERE n < last OR line <> ''""")
def s6_lines(spark, d):
    return src.code_lines(table(spark, d, "documents"), "doc_id").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


_DEFAULTS = ", ".join(f"({q(k)}, {q(v)})" for k, v in voc.DEFAULT_POLICY.items())
_OVERRIDES = """SELECT c_custkey, 'thresholds.complexity.max_cyclomatic' AS key_path, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'rules.severities', 'none' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'reporting.format.style', c_mktsegment FROM customer WHERE c_custkey % 7 = 0"""


def _overrides(spark, d):
    c = table(spark, d, "customer")
    rows = [(3, "thresholds.complexity.max_cyclomatic", F.col("c_nationkey").cast("string")), (5, "rules.severities", F.lit("none")), (7, "reporting.format.style", F.col("c_mktsegment"))]
    parts = [c.where(f"c_custkey % {n} = 0").select("c_custkey", F.lit(k).alias("key_path"), v.alias("value")) for n, k, v in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OVERLAY = f"""WITH o AS ({_OVERRIDES}), b AS (SELECT c_custkey, k AS key_path, v AS value FROM (SELECT DISTINCT c_custkey FROM o), (VALUES {_DEFAULTS}) t(k, v))
  SELECT c_custkey, key_path, value FROM o UNION ALL SELECT c_custkey, key_path, value FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c_custkey = b.c_custkey
    AND (o.key_path = b.key_path OR starts_with(b.key_path, o.key_path || '.') OR starts_with(o.key_path, b.key_path || '.')))"""


@query(_OVERLAY)
def s7_policy_overlay(spark, d):
    """Each customer's policy: the defaults under their overrides."""
    return pol.overlay(voc.default_policy(spark), _overrides(spark, d), "c_custkey").select("c_custkey", "key_path", "value")


#: A nested document for each customer, in SQL that both engines read.
_DOCUMENT = """concat('{"thresholds":{"complexity":{"max_cyclomatic":', CAST(c_nationkey AS varchar(9)), CASE WHEN c_custkey % 2 = 0 THEN ',"own":{"deep":{"er":true}}' ELSE '' END, '}},',
  CASE WHEN c_custkey % 5 = 0 THEN '"rules":{"severities":"none","enabled":["XSS","SQLI"]},' WHEN c_custkey % 5 = 1 THEN '"rules":{"severities":{"SQLI":"Low","OWN":"High"},"confidence":{}},' ELSE '' END,
  CASE WHEN c_custkey % 7 = 0 THEN concat('"reporting":{"format":{"style":"', c_mktsegment, '","lines":[1,2.5,"x"]}},') ELSE '' END,
  '"version":', CAST(c_custkey % 3 AS varchar(9)), '}')"""
_DEFAULT_DOCUMENT = """{"rules":{"enabled":["SQLI","XSS","HARDCODED_SECRET","COMPLEXITY"],"severities":{"SQLI":"High","XSS":"High","HARDCODED_SECRET":"High","COMPLEXITY":"Medium"},"confidence":{"SQLI":"Medium","XSS":"Medium","HARDCODED_SECRET":"High","COMPLEXITY":"Low"}},
  "thresholds":{"complexity":{"max_cyclomatic":15,"max_nesting":4,"max_function_lines":80}},"languages":{"enabled":["c","cpp","csharp","go","java","kotlin","javascript","typescript","python","ruby","rust","swift"]},
  "suppression":{"inline_comment":"scan:ignore"},"reporting":{"format":"text","fail_on_severity":"High"}}"""


@query(f"""WITH m AS (SELECT c_custkey, json_merge_patch('{_DEFAULT_DOCUMENT}'::JSON, {_DOCUMENT}::JSON) AS j FROM customer), t AS (SELECT m.c_custkey, t.* FROM m, json_tree(m.j) t)
  SELECT c_custkey, substring(fullkey, 3) AS key_path, CASE type WHEN 'ARRAY' THEN array_to_string(json_extract_string(value, '$[*]'), ',') ELSE json_extract_string(value, '$') END AS value FROM t WHERE type <> 'OBJECT' AND fullkey NOT LIKE '%[%'""")
def s7_policy_documents(spark, d):
    """Each customer's nested document merged over the defaults."""
    documents = spark.sql(f"SELECT c_custkey, {_DOCUMENT.replace('{', '{{').replace('}', '}}')} AS document FROM {{customer}}", customer=table(spark, d, "customer"))
    return pol.merged(documents, "c_custkey")


@query("""SELECT p_partkey, rule_id, CASE rule_id WHEN 'COMPLEXITY' THEN 'Medium' WHEN 'SQLI' THEN 'High' WHEN 'XSS' THEN 'High' ELSE 'Medium' END AS severity,
  CASE rule_id WHEN 'COMPLEXITY' THEN 'Low' ELSE 'Medium' END AS confidence FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SQLI' WHEN 1 THEN 'XSS' WHEN 2 THEN 'COMPLEXITY' ELSE 'OWN_RULE' END AS rule_id FROM part)""")
def s8_rating_lookup(spark, d):
    rule = F.when(F.col("p_partkey") % 4 == 0, "SQLI").when(F.col("p_partkey") % 4 == 1, "XSS").when(F.col("p_partkey") % 4 == 2, "COMPLEXITY").otherwise("OWN_RULE")
    return pol.with_rating(table(spark, d, "part").select("p_partkey", rule.alias("rule_id")), pol.rules(pol.loaded(spark)))


# P: facts


@query(over("tok", "SELECT path, tok_no, kind, text, off, line_no, col_no, paren_depth, brace_depth FROM tok"))
def p1_tokens(spark, d):
    return facts(spark, d).tokens.select("path", "tok_no", "kind", "text", "off", "line_no", "col_no", "paren_depth", "brace_depth")


@query(over("tok", "SELECT path, tok_no, kind, text FROM tok WHERE kind IN ('string', 'comment')"))
def p2_of_kinds(spark, d):
    return tkn.of_kinds(facts(spark, d).tokens, "string", "comment").select("path", "tok_no", "kind", "text")


@query(over("c0", "SELECT path, tok_no, array_to_string(parts, '/') AS chain FROM c0 WHERE len(parts) > 1"))
def p3_member_chains(spark, d):
    return facts(spark, d).code.where(F.size("parts") > 1).select("path", "tok_no", F.array_join("parts", "/").alias("chain"))


@query(over("calls", "SELECT path, tok_no, callee, parts[-1] AS last_name, close_tok FROM calls"))
def p4_calls(spark, d):
    return facts(spark, d).calls.select("path", "tok_no", "callee", F.element_at("parts", -1).alias("last_name"), "close_tok")


@query(over("args", "SELECT path, call_tok, arg_no, first_tok, last_tok FROM args"))
def p5_arguments(spark, d):
    return facts(spark, d).arguments


@query(over("asg", "SELECT path, tok_no, array_to_string(targets, ',') AS targets, array_to_string(target_chain, '.') AS chain, value_start, value_end FROM asg"))
def p6_assignments(spark, d):
    return facts(spark, d).assignments.select("path", "tok_no", F.array_join("targets", ",").alias("targets"), F.array_join("target_chain", ".").alias("chain"), "value_start", "value_end")


@query(over("asg", "SELECT a.path, a.tok_no AS assigned, array_to_string(list_sort(list_distinct(flatten(list(n.parts)))), ',') AS names FROM asg a JOIN nm n ON n.path = a.path AND n.tok_no BETWEEN a.value_start AND a.value_end GROUP BY 1, 2"))
def p7_identifiers(spark, d):
    own = facts(spark, d)
    return fact.extent_identifiers(own.code, taint._value_extents(own.assignments)).select("path", F.col("key").alias("assigned"), F.array_join("names", ",").alias("names"))


@query(over("fn", "SELECT path, name, start_tok, end_tok, start_line, end_line, top_level FROM fn"))
def p8_functions(spark, d):
    return facts(spark, d).functions.select("path", "name", "start_tok", "end_tok", "start_line", "end_line", "top_level")


@query(over("calls", r"SELECT c.path, c.tok_no, c.line_no AS line, c.col_no AS col, regexp_replace(substring(s.text, a.off + 1, b.off + length(b.mask) - a.off), '^\s+|\s+$', '', 'g') AS snippet FROM calls c JOIN c0 a ON a.path = c.path AND a.tok_no = c.tok_no JOIN c0 b ON b.path = c.path AND b.tok_no = c.close_tok JOIN src s ON s.path = c.path"))
def p9_locations(spark, d):
    own = facts(spark, d)
    extents = own.calls.select("path", F.col("tok_no").alias("first_tok"), F.col("close_tok").alias("last_tok"))
    return own.located(extents).select("path", F.col("first_tok").alias("tok_no"), F.col("location.line").alias("line"), F.col("location.column").alias("col"), F.col("location.snippet").alias("snippet"))


@query(over("tok", "SELECT path, count(*) AS n_code, CAST(sum(length(text)) AS BIGINT) AS code_chars FROM tok WHERE kind NOT IN ('string', 'comment', 'space', 'newline', 'heredoc') GROUP BY 1"))
def p10_code_only(spark, d):
    return tkn.code_only(facts(spark, d).tokens).groupBy("path").agg(F.count("*").alias("n_code"), F.sum(F.length("text")).alias("code_chars"))


_ELEMENTS = """, e AS (SELECT path, 'assignment' AS kind, 0 AS rank, tok_no, 0 AS arg_no, start_tok AS first_tok, value_end AS last_tok FROM asg
    UNION ALL SELECT path, 'value', 1, tok_no, 0, value_start, value_end FROM asg UNION ALL SELECT path, 'argument', 2, call_tok, arg_no, first_tok, last_tok FROM args
    UNION ALL SELECT path, 'function', 3, start_tok, 0, start_tok, end_tok FROM fn UNION ALL SELECT path, 'call', 4, tok_no, 0, start_tok, close_tok FROM calls WHERE close_tok IS NOT NULL
    UNION ALL SELECT path, 'name', 5, tok_no, 0, tok_no, tok_no FROM nm),
  el AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY first_tok, last_tok DESC, rank, tok_no, arg_no) - 1 AS INT) AS place FROM e),
  up AS (SELECT c.path, c.place, CAST(max(p.place) AS INT) AS parent, CAST(count(p.place) AS INT) AS depth FROM el c LEFT JOIN el p ON p.path = c.path AND p.place < c.place AND p.last_tok >= c.last_tok GROUP BY 1, 2),
  down AS (SELECT p.path, p.place, CAST(max(c.place) AS INT) AS last_place FROM el p JOIN el c ON c.path = p.path AND c.place >= p.place AND c.first_tok <= p.last_tok GROUP BY 1, 2)
  SELECT path, place, kind, tok_no, arg_no, first_tok, last_tok, coalesce(parent, -1) AS parent, depth, last_place FROM el JOIN up USING (path, place) JOIN down USING (path, place)"""


@query(over("fn", _ELEMENTS))
def p1_elements(spark, d):
    """All elements of each file in pre-order, as nested sets; -1 stands for no parent."""
    return facts(spark, d).elements.withColumn("parent", F.coalesce("parent", F.lit(-1)))


_DOC_LEXED = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[^\\n]', '~~', 'g'), '([A-Za-z0-9_])(?:->|::|\\?\\.)([A-Za-z_])', '\\1..\\2', 'g'), '([A-Za-z0-9_])(?:->|::|\\?\\.)([A-Za-z_])', '\\1..\\2', 'g'), " + q(PLAIN_LEXER) + ")) AS mask FROM documents) SELECT doc_id, count(*) AS n_tokens, CAST(sum(length(mask)) AS BIGINT) AS n_chars, count(*) FILTER (regexp_matches(mask, '^[A-Za-z_]')) AS n_names FROM t GROUP BY 1"


@query(_DOC_LEXED)
def p1_document_tokens(spark, d):
    """Tokens over whole documents; they cover each text."""
    lexed = F.explode_outer(tkn.plain_tokens(F.col("text"))).alias("mask")  # an inner one would lex each text twice
    rows = table(spark, d, "documents").select("doc_id", lexed).where("mask IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("mask")).alias("n_chars"), F.count_if(tkn.plain_kind(F.col("mask")) == "name").alias("n_names"))


# T: taint


@query(over("nc", "SELECT path, tok_no, array_to_string(parts, '.') AS name, source FROM nc WHERE source IS NOT NULL"))
def t1_sources(spark, d):
    own = facts(spark, d)
    return taint.sources(own.code).select("path", "tok_no", F.array_join("parts", ".").alias("name"), "source")


@query(over("hit", "SELECT a.path, a.tok_no AS assigned, EXISTS (SELECT 1 FROM hit WHERE hit.path = a.path AND hit.what = 'v' AND hit.key = a.tok_no) AS tainted FROM asg a"))
def t2_tainted_values(spark, d):
    own = facts(spark, d)
    hit = taint.tainted_extents(own.code, own.calls, taint._value_extents(own.assignments), own.tainted).select("path", F.col("key").alias("tok_no"), F.lit(True).alias("tainted"))
    return own.assignments.join(hit, ["path", "tok_no"], "left").select("path", F.col("tok_no").alias("assigned"), F.coalesce("tainted", F.lit(False)).alias("tainted"))


@query(over("lvn", "SELECT path, key AS assigned, t AS name_tok, is_source FROM lvn WHERE what = 'v'"))
def t3_live_names(spark, d):
    own = facts(spark, d)
    return taint.live_names(own.code, own.calls, taint._value_extents(own.assignments)).select("path", F.col("key").alias("assigned"), F.col("t").alias("name_tok"), "is_source")


@query(over("lvn", "SELECT l.path, l.key AS assigned, l.t AS name_tok FROM lvn l JOIN ex e ON e.path = l.path AND e.what = 'v' AND e.key = l.key WHERE l.what = 'v' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.path = l.path AND c.callee = 'request.args.get' AND c.tok_no >= e.first_tok AND c.close_tok <= e.last_tok AND l.t BETWEEN c.tok_no AND c.close_tok)"))
def t4_own_sanitizers(spark, d):
    """A caller's own sanitizer besides the built-in ones."""
    own = facts(spark, d)
    return taint.live_names(own.code, own.calls, taint._value_extents(own.assignments), {"sanitizer": ["request.args.get"]}).select("path", F.col("key").alias("assigned"), F.col("t").alias("name_tok"))


@query(over("tainted", "SELECT path, array_to_string(names, ',') AS names FROM tainted"))
def t5_tainted_names(spark, d):
    return facts(spark, d).tainted.select("path", F.array_join("names", ",").alias("names"))


# R: rules


def _rule(rule_id):
    return over("raw", f"SELECT rule_id, path, line, col, snippet FROM raw WHERE rule_id = {q(rule_id)}")


@query(_rule("SQLI"))
def r1_sql_injection(spark, d):
    return flat(rul.sql_injection(facts(spark, d)))


@query(over("sinks", "SELECT path, first_tok FROM sinks WHERE rule_id = 'XSS' AND what = 'call'"))
def r2_xss_calls(spark, d):
    return rul.sink_calls(facts(spark, d), "XSS").select("path", "first_tok")


@query(over("sinks", "SELECT path, first_tok FROM sinks WHERE rule_id = 'XSS' AND what = 'assignment'"))
def r3_xss_assignments(spark, d):
    return rul.sink_assignments(facts(spark, d), "XSS").select("path", "first_tok")


@query(f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(strlen(array_to_string(string_split_regex(line, {SECRET})[1:n], '') || array_to_string(ms[1:n - 1], '')) + 1 AS INT) AS col, m AS match
  FROM (SELECT doc_id, line_no, line, ms, generate_subscripts(ms, 1) AS n, unnest(ms) AS m FROM (SELECT *, regexp_extract_all(line, {SECRET}) AS ms FROM
  (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents))))""")
def r4_hardcoded_secret(spark, d):
    """Secrets in all documents."""
    return rul.secret_lines(table(spark, d, "documents"), "doc_id").select("doc_id", "line_no", F.col("column").alias("col"), "match")


@query(over("mt", "SELECT path, start_tok, cyclomatic FROM mt"))
def r5_cyclomatic(spark, d):
    own = facts(spark, d)
    return rul.cyclomatic(own.code, own.functions)


@query(over("mt", "SELECT path, start_tok, max_nesting FROM mt"))
def r6_max_nesting(spark, d):
    return facts(spark, d).metrics.select("path", "start_tok", "max_nesting")


@query(over("mt", "SELECT path, start_tok, line_count FROM mt"))
def r7_line_count(spark, d):
    return facts(spark, d).metrics.select("path", "start_tok", "line_count")


@query(over("vio", "SELECT path, name, start_tok, array_to_string(violated, ', ') AS violated FROM vio"))
def r8_complexity(spark, d):
    return rul.violations(facts(spark, d).metrics).select("path", "name", "start_tok", F.array_join("violated", ", ").alias("violated"))


@query(over("vio", r"SELECT v.path, v.start_tok, CASE WHEN top_level THEN a.line_no ELSE 1 END AS line, CASE WHEN top_level THEN NULL ELSE md5(regexp_replace(s.text, '^\s+|\s+$', '', 'g')) END AS root_md5 FROM (SELECT * FROM mt WHERE max_nesting > 0) v JOIN c0 a ON a.path = v.path AND a.tok_no = v.start_tok JOIN src s ON s.path = v.path"))
def r9_complexity_location(spark, d):
    """Functions with a nesting above 0; those inside others are reported at the root of the file."""
    own = facts(spark, d)
    rooted = rul.Facts(own.files, location_mode="root_fallback")
    rooted.__dict__["code"] = own.code
    rows = rul.complexity_locations(rooted, rul.violations(own.metrics, (10**6, 0, 10**6)))
    return rows.select("path", F.col("ord").alias("start_tok"), F.col("location.line").alias("line"), F.when(~F.col("top_level"), F.md5("location.snippet")).alias("root_md5"))


@query(over("raw", "SELECT rule_id, path, line, col, snippet FROM raw WHERE rule_id IN ('XSS', 'COMPLEXITY')"))
def r10_enabled_rules(spark, d):
    return flat(rul.raw_findings(facts(spark, d), ["XSS", "COMPLEXITY"]))


@query(over("calls", f"SELECT path, tok_no FROM calls WHERE language IN ({words(voc.RULE_LANGUAGES['XSS'])})"))
def r11_rule_languages(spark, d):
    return rul.applying(facts(spark, d).calls, "XSS").select("path", "tok_no")


@query(over("fnd", "SELECT rule_id, path, line, col, severity, confidence FROM fnd"))
def r12_rated(spark, d):
    return flat(found(spark, d), "severity", "confidence").drop("snippet")


# F: findings


@query(over("raw", "SELECT rule_id, path, line, col, snippet, message FROM raw"))
def f1_all_findings(spark, d):
    return flat(rul.raw_findings(facts(spark, d)), "message")


@query(over("fnd", "SELECT rule_id, path, line, col, suppressed FROM fnd"))
def f2_suppressed(spark, d):
    return flat(found(spark, d), "suppressed").drop("snippet")


@query(over("fnd", "SELECT rule_id, count(*) FILTER (NOT suppressed) AS kept, count(*) FILTER (suppressed) AS suppressed FROM fnd GROUP BY 1"))
def f3_kept(spark, d):
    return found(spark, d).groupBy("rule_id").agg(F.count_if(~F.col("suppressed")).alias("kept"), F.count_if("suppressed").alias("suppressed"))


@query(over("fnd", "SELECT CAST(row_number() OVER (ORDER BY path, line, rule_id, rule_no, ord) - 1 AS BIGINT) AS place, rule_id, path, line, col FROM fnd WHERE NOT suppressed"))
def f4_ordered(spark, d):
    """The report's order; a total order needs ranges of rows, whose sizes give each row its place."""
    rows = fnd.ordered(fnd.kept(found(spark, d))).withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())
    rows = written(rows, "ordered")
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # one row a partition
    start, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, start))
        start += sizes[p]
    begin = spark.createDataFrame(starts, "part int, start long")
    rows = rows.join(F.broadcast(begin), "part").withColumn("place", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    return flat(rows, "place").drop("snippet")


def _with_fixes(spark, d):
    """Findings of secrets get a fix, and those of sinks one that must be looked at."""
    rows = fnd.kept(found(spark, d))
    fix = lambda auto, after: F.struct(F.lit("Use the environment").alias("description"), F.col("location.snippet").alias("before"), F.lit(after).alias("after"), F.lit("").alias("diff"), F.lit(auto).alias("auto_applicable"))
    return rows.withColumn("fix", F.when(F.col("rule_id") == "HARDCODED_SECRET", fix(True, "secret = env()")).when(F.col("rule_id") == "SQLI", fix(False, "x")))


_FIXED = over("fnd", """, k AS (SELECT path, count(*) AS n, count(*) FILTER (rule_id = 'HARDCODED_SECRET') AS s, max(CASE WHEN rule_id = 'HARDCODED_SECRET' THEN snippet END) AS b FROM fnd WHERE NOT suppressed GROUP BY 1)
  SELECT k.path, md5(CASE WHEN s > 0 THEN substring(text, 1, instr(text, b) - 1) || 'secret = env()' || substring(text, instr(text, b) + length(b)) ELSE text END) AS text_md5, CAST(s AS BIGINT) AS applied, CAST(n - s AS BIGINT) AS skipped FROM k JOIN src ON src.path = k.path""")


@query(_FIXED)
def f5_apply_fixes(spark, d):
    return fnd.apply_fixes(_with_fixes(spark, d), facts(spark, d).files).select("path", F.md5("text").alias("text_md5"), "applied", "skipped")


@query(over("fnd", "SELECT CAST(count(*) FILTER (rule_id = 'HARDCODED_SECRET') AS BIGINT) AS auto_fixes_applied, CAST(count(*) FILTER (rule_id <> 'HARDCODED_SECRET') AS BIGINT) AS auto_fixes_skipped FROM fnd WHERE NOT suppressed"))
def f6_fix_counts(spark, d):
    return fnd.fix_counts(fnd.apply_fixes(_with_fixes(spark, d), facts(spark, d).files))


@query(over("fnd", f"SELECT path, max({RANK}) >= 3 AS failed, CASE WHEN max({RANK}) >= 3 THEN 2 ELSE 0 END AS exit_code FROM fnd WHERE NOT suppressed GROUP BY 1 UNION ALL SELECT '*', max({RANK}) >= 3, CASE WHEN max({RANK}) >= 3 THEN 2 ELSE 0 END FROM fnd WHERE NOT suppressed"))
def f7_gate(spark, d):
    """The gate of each file, and of the whole scan."""
    rows = fnd.kept(found(spark, d))
    whole = fnd.gate(rows).select(F.lit("*").alias("path"), "failed", "exit_code")
    return fnd.gate(rows.groupBy(F.col("location.path").alias("path"))).unionByName(whole)


@query(over("fnd", "SELECT count(*) FILTER (NOT suppressed) AS count, count(*) FILTER (suppressed) AS suppressed, CAST(0 AS BIGINT) AS auto_fixes_applied, CAST(0 AS BIGINT) AS auto_fixes_skipped FROM fnd"))
def f8_summary(spark, d):
    return fnd.summary(found(spark, d), fnd.fix_counts(None, spark))


# O: reports

_BLOCK = "'[' || severity || '/' || confidence || '] ' || rule_id || ': ' || title || chr(10) || '  Location: ' || path || ':' || line || ':' || col || chr(10) || '  Snippet: ' || snippet || chr(10) || '  Message: ' || message || chr(10) || '  Remediation: ' || remediation || chr(10) || '  References:' || chr(10) || '    - ' || reference"


_TEXT_ROWS = f""", b AS (SELECT 0 AS part, path, line, rule_id, rule_no, ord, {_BLOCK} || chr(10) AS value FROM fnd WHERE NOT suppressed
  UNION ALL SELECT 1, NULL, NULL, NULL, NULL, NULL, 'Suppressed findings: ' || (SELECT count(*) FROM fnd WHERE suppressed) || chr(10) || 'Auto-fixes applied: 0' || chr(10) || 'Auto-fixes skipped: 0'),
  o AS (SELECT value, CAST(coalesce(sum(strlen(value) + 1) OVER (ORDER BY part, path, line, rule_id, rule_no, ord, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM b)
  SELECT count(*) AS n_rows, CAST(sum(strlen(value) + 1) AS BIGINT) AS n_bytes, CAST(sum(CAST('0x' || md5(place || ':' || value)[1:15] AS HUGEINT)) AS VARCHAR) AS digest FROM o"""


@query(over("fnd", _TEXT_ROWS))
def o1_text_report(spark, d):
    """The digest of the whole report, in order."""
    rows = found(spark, d)
    return rep.report_digest(rep.report_rows(fnd.kept(rows), fnd.summary(rows, fnd.fix_counts(None, spark)), "text"))


@query(over("fnd", "SELECT (SELECT count(*) FROM fnd WHERE NOT suppressed) AS count, (SELECT count(*) FROM fnd WHERE suppressed) AS suppressed, rule_id, severity, path, CAST(line AS INT) AS line, CAST(col AS INT) AS col, snippet, message, true AS fix_is_null FROM fnd WHERE NOT suppressed"))
def o2_json_report(spark, d):
    """The rows of the JSON document, read back."""
    rows = found(spark, d)
    text = rep.report_rows(fnd.kept(rows), fnd.summary(rows, fnd.fix_counts(None, spark)), "json")
    head = text.where("part = 0").select(F.from_json(F.concat("value", F.lit("]}")), "summary struct<count:bigint,suppressed:bigint>").alias("r")).select("r.summary.*").first()
    schema = "rule_id string, severity string, message string, location struct<path:string,line:int,column:int,snippet:string>, fix string"
    back = text.where("part = 1").select(F.from_json(F.ltrim("value", F.lit(",")), schema).alias("f"))
    return back.select(F.lit(head["count"]).alias("count"), F.lit(head["suppressed"]).alias("suppressed"), "f.rule_id", "f.severity", "f.location.path", F.col("f.location.line").alias("line"), F.col("f.location.column").alias("col"), F.col("f.location.snippet").alias("snippet"), "f.message", F.col("f.fix").isNull().alias("fix_is_null"))


@query(over("fnd", "SELECT '2.1.0' AS version, rule_id, CASE severity WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level, path, CAST(line AS INT) AS line, CAST(col AS INT) AS col, snippet, message FROM fnd WHERE NOT suppressed"))
def o3_sarif_report(spark, d):
    """The rows of the SARIF document, read back."""
    text = rep.report_rows(fnd.kept(found(spark, d)), None, "sarif")
    head = text.where("part = 0").select(F.from_json(F.concat("value", F.lit("]}]}")), "version string").alias("r")).select("r.version").first()
    schema = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,snippet:struct<text:string>>>>>"
    back = text.where("part = 1").select(F.from_json(F.ltrim("value", F.lit(",")), schema).alias("x"))
    at = F.col("x.locations")[0]["physicalLocation"]
    return back.select(F.lit(head["version"]).alias("version"), F.col("x.ruleId").alias("rule_id"), "x.level", at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line"), at["region"]["startColumn"].alias("col"), at["region"]["snippet"]["text"].alias("snippet"), F.col("x.message.text").alias("message"))


@query(over("fnd", ", g AS (SELECT *, row_number() OVER (ORDER BY path, line, rule_id, rule_no, ord) AS n FROM fnd WHERE NOT suppressed) SELECT CAST(row_number() OVER (ORDER BY min(n)) - 1 AS INT) AS place, rule_id AS id, arg_max(title, n) AS name, arg_max(message, n) AS description, arg_max(severity, n) AS severity FROM g GROUP BY rule_id"))
def o4_sarif_rules(spark, d):
    """The SARIF document's rule list with places."""
    back = rep._rules_listed(fnd.kept(found(spark, d))).select(F.posexplode("rules").alias("place", "x"))
    return back.select("place", "x.id", "x.name", F.col("x.fullDescription.text").alias("description"), "x.properties.severity")


@query("SELECT c_custkey, severity, CASE WHEN lower(severity) IN ('critical', 'high') THEN 'error' WHEN lower(severity) = 'medium' THEN 'warning' ELSE 'note' END AS level FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'mEDIUM' WHEN 3 THEN 'Low' WHEN 4 THEN c_mktsegment ELSE '' END AS severity FROM customer)")
def o5_sarif_level(spark, d):
    n = F.col("c_custkey") % 6
    severity = F.when(n == 0, "CRITICAL").when(n == 1, "High").when(n == 2, "mEDIUM").when(n == 3, "Low").when(n == 4, F.col("c_mktsegment")).otherwise("")
    return table(spark, d, "customer").select("c_custkey", severity.alias("severity")).withColumn("level", rep.sarif_level(F.col("severity")))


@query(over("fnd", "SELECT rule_id, path, line, col, snippet FROM fnd WHERE NOT suppressed"))
def o6_written_report(spark, d):
    """Findings written as Parquet by rule, and read back."""
    path = f"{shared_dir(spark)}/coderake/report-{uuid.uuid4().hex}"
    rep.write_report(fnd.kept(found(spark, d)), None, path, "parquet")
    return flat(spark.read.parquet(path))


@query(over("calls", "SELECT path, tok_no AS ord, line_no AS line FROM calls WHERE callee = 'render'"))
def u1_own_rule(spark, d):
    """A caller's own rule beside the built-in ones: a function from facts to findings."""

    def rendered(own: rul.Facts) -> DataFrame:
        rows = own.calls.where("callee = 'render'").select("path", F.struct("path", F.col("line_no").alias("line"), F.col("col_no").alias("column"), F.col("callee").alias("snippet")).alias("location"), F.col("tok_no").alias("ord"))
        return rul._finding("XSS", rows)

    return rul.raw_findings(facts(spark, d), rules={"RENDERED": rendered}).select("location.path", "ord", F.col("location.line").alias("line"))
