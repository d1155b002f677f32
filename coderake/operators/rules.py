"""Rules as functions from facts to findings. A rule takes ``Facts`` and gives rows of FINDING without its rating;
adding a rule means adding a function to RULES, adding a sink or a sanitizer means adding a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderake.functions.languages import BUILT_IN, Languages, has
from coderake.functions.vocabulary import RULE_TEXT, SINKS
from coderake.operators import facts as fact
from coderake.operators import taint
from coderake.operators.elements import elements, enclosing
from coderake.operators.tokens import code_of, named_code, numbered_code, tokens
from coderake.plans.tables import written
from coderake.sources.files import LINE_END

SECRET = r"""(?i)(?:token|secret|password|passwd|api_?key|credential)\w*\s*[:=]\s*(?:"[^"\n]+"|'[^'\n]+')"""
FIX = "struct<description:string,before:string,after:string,diff:string,auto_applicable:boolean>"

#: Bytes of texts in one part, at most on average: some 1.5 million tokens.
PART_BYTES = 4 << 20


class Facts:
    """Lazily planned facts about files (path, language, text). persisted: write tokens and facts, which most rules read,
    to the shared folder as they are first needed."""

    def __init__(self, files: DataFrame, sanitizers: list[str] = (), sinks: list[tuple[str, str, str]] = (), thresholds: tuple[int, int, int] = (15, 4, 80), location_mode: str = "function", persisted: bool = False, languages: Languages = BUILT_IN) -> None:
        self.languages = languages
        self.given, self.more, self.more_sinks = files, {"sanitizer": list(sanitizers)}, list(sinks)
        self.thresholds, self.location_mode, self.persisted = thresholds, location_mode, persisted

    @cached_property
    def parts(self) -> int:
        """In how many parts files are dealt out: as many as other shuffles have at first, and more if their texts would make
        these larger than PART_BYTES, so that no part's tokens spill however many files there are."""
        least = int(self.given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if not self.persisted:  # everything is to stay one lazy plan
            return least
        size = self.given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        return min(max(least, -(-size // PART_BYTES)), 100_000)

    def _kept(self, found: DataFrame) -> DataFrame:
        """found: dealt out by path in so many parts, else each task writes to all of them."""
        return written(found, "facts", by="path", parts=self.parts) if self.persisted else found

    @property
    def _dealt(self) -> int | None:
        return self.parts if self.persisted else None

    @cached_property
    def files(self) -> DataFrame:
        """The files as they were given, dealt out by path like their facts: made once, and filters on texts work where these are."""
        return self._kept(self.given.repartition(self.parts, "path")) if self.persisted else self.given

    @cached_property
    def tokens(self) -> DataFrame:
        return self._kept(tokens(self.files, languages=self.languages, parts=self.parts))

    @cached_property
    def code(self) -> DataFrame:
        # Not from the written tokens: texts are dealt out once for both, and most rules need no other token.
        if not self.persisted:
            return code_of(self.files, languages=self.languages, parts=self.parts)
        return named_code(self._kept(numbered_code(self.files, self.languages, self.parts)), self.languages)

    @cached_property
    def calls(self) -> DataFrame:
        return self._kept(fact.calls(self.code))

    @cached_property
    def arguments(self) -> DataFrame:
        return self._kept(fact.arguments(self.code, self.calls, self._dealt))

    @cached_property
    def assignments(self) -> DataFrame:
        return self._kept(fact.assignments(self.code))

    @cached_property
    def functions(self) -> DataFrame:
        return self._kept(fact.functions(self.code))

    @cached_property
    def elements(self) -> DataFrame:
        return self._kept(elements(fact.names(self.code), self.calls, self.arguments, self.assignments, self.functions, self._dealt))

    @cached_property
    def metrics(self) -> DataFrame:
        return self._kept(function_metrics(self))

    @cached_property
    def tainted(self) -> DataFrame:
        return self._kept(taint.tainted_names(taint.events(self.code, self.calls, self.assignments, self.more), self._dealt))

    @cached_property
    def sinks(self) -> DataFrame:
        return self._kept(tainted_sinks(self))

    def located(self, extents: DataFrame) -> DataFrame:
        # Few beside tokens: dealt out by path like these, which then stay where they are.
        return fact.located(self.files, self.code, extents.repartition(self.parts, "path") if self.persisted else extents)

    def sink_names(self, rule_id: str, kind: str) -> list[str]:
        return SINKS.get((rule_id, kind), []) + [n for r, k, n in self.more_sinks if (r, k) == (rule_id, kind)]


def applying(rows: DataFrame, rule_id: str, languages: Languages = BUILT_IN) -> DataFrame:
    return rows.where(F.col("language").isin(*languages.under(rule_id)))


def tainted_sinks(facts: Facts) -> DataFrame:
    """path, language, kind (call or property), rule_id, first_tok, last_tok: sinks of all rules that something tainted reaches, told in
    one pass over the names of files: calls whose last or whole name is a sink's, with a tainted argument, and assignments to a
    sink property whose value is tainted."""
    rule_ids = sorted({r for r, _ in SINKS} | {r for r, _, _ in facts.more_sinks})

    def of(rows: DataFrame, kind: str, last: str, named) -> DataFrame:
        asked = [F.when(F.col("language").isin(*facts.languages.under(r)) & named(facts.sink_names(r, kind)), r) for r in rule_ids]
        rows = rows.withColumn("rules", F.array_compact(F.array(*asked))).where(F.size("rules") > 0)
        return rows.select("*", F.struct(F.lit(kind).alias("kind"), "tok_no").alias("key"), F.col("start_tok").alias("first"), F.col(last).alias("last"))

    calls = of(facts.calls, "call", "close_tok", lambda words: F.element_at("parts", -1).isin(*words) | F.col("callee").isin(*words))
    assigned = of(facts.assignments, "property", "value_end", lambda words: F.element_at("target_chain", -1).isin(*words))
    extents = facts.arguments.join(calls.select("path", F.col("tok_no").alias("call_tok"), "key"), ["path", "call_tok"]).select("path", "key", "first_tok", "last_tok")
    extents = extents.unionByName(assigned.select("path", "key", F.col("value_start").alias("first_tok"), F.col("value_end").alias("last_tok")))
    hit = taint.tainted_extents(facts.code, facts.calls, extents.repartition(facts.parts, "path"), facts.tainted, facts.more, facts._dealt)
    columns = ["path", "language", "key", "rules", "first", "last"]
    rows = calls.select(columns).unionByName(assigned.select(columns)).repartition(facts.parts, "path").join(hit, ["path", "key"])
    return rows.select("path", "language", "key.kind", F.explode("rules").alias("rule_id"), F.col("first").alias("first_tok"), F.col("last").alias("last_tok"))


def sink_calls(facts: Facts, rule_id: str) -> DataFrame:
    """Calls whose last or whole name is a sink's, with a tainted argument: path, language, first_tok, last_tok."""
    return facts.sinks.where((F.col("rule_id") == rule_id) & (F.col("kind") == "call")).select("path", "language", "first_tok", "last_tok")


def sink_assignments(facts: Facts, rule_id: str) -> DataFrame:
    """Assignments to a sink property whose value is tainted."""
    return facts.sinks.where((F.col("rule_id") == rule_id) & (F.col("kind") == "property")).select("path", "language", "first_tok", "last_tok")


def _finding(rule_id: str, rows: DataFrame, message=None) -> DataFrame:
    """FINDING rows (without a rating) from path, location, ord and, for COMPLEXITY, message."""
    return _findings(rows.withColumn("rule_id", F.lit(rule_id)), [rule_id], message).drop("rule_no")


def _findings(rows: DataFrame, rule_ids: list[str], message=None) -> DataFrame:
    """The same for rows of several rules with rule_id and, where there is one, rule_no; message: null for the rule's own text."""
    def said(what) -> Column:
        *others, last = rule_ids
        own = what(*RULE_TEXT[last])
        for r in others:
            own = F.when(F.col("rule_id") == r, what(*RULE_TEXT[r])).otherwise(own)
        return own

    text = said(lambda title, text, remediation, references: F.lit(text))
    own = text if message is None else F.coalesce(message, text) if len(rule_ids) > 1 else message
    columns = [
        "rule_id", said(lambda title, *_: F.lit(title)).alias("title"), own.alias("message"), "location", said(lambda title, text, remediation, references: F.lit(remediation)).alias("remediation"),
        said(lambda title, text, remediation, references: F.array(*[F.lit(r) for r in references])).alias("references"), F.lit(None).cast(FIX).alias("fix"), F.col("ord"),
    ]
    return rows.select(*columns, *[c for c in ("rule_no",) if c in rows.columns])


def _sql_extents(facts: Facts) -> DataFrame:
    return sink_calls(facts, "SQLI").select("path", "first_tok", "last_tok", F.col("first_tok").alias("ord"), F.lit(None).cast("string").alias("message"))


def _script_extents(facts: Facts) -> DataFrame:
    rows = facts.sinks.where("rule_id = 'XSS'")
    return rows.select("path", "first_tok", "last_tok", F.col("first_tok").alias("ord"), F.lit(None).cast("string").alias("message"))


def _complex_extents(facts: Facts) -> DataFrame:
    found = violations(applying(facts.metrics, "COMPLEXITY", facts.languages), facts.thresholds)
    return found.select("path", F.col("start_tok").alias("first_tok"), F.col("end_tok").alias("last_tok"), F.col("start_tok").alias("ord"), _over().alias("message"))


def _over() -> Column:
    return F.concat(F.lit("Function '"), F.col("name"), F.lit("' is over its limits: "), F.array_join("violated", ", "))


def sql_injection(facts: Facts) -> DataFrame:
    return _finding("SQLI", facts.located(_sql_extents(facts)))


def cross_site_scripting(facts: Facts) -> DataFrame:
    return _finding("XSS", facts.located(_script_extents(facts)))


def secret_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, column, match: credential words with a non-empty literal, by line, in code or plain text."""
    rows = texts.where(F.regexp_like("text", F.lit(SECRET))).select(*keys, F.posexplode_outer(F.split("text", LINE_END)).alias("n", "line"))
    # What stands between the matches gives the place of each, also where the same text occurs before.
    found, between = F.regexp_extract_all("line", F.lit(SECRET), F.lit(0)), F.split("line", SECRET, -1)
    rows = rows.select(*keys, (F.col("n") + 1).alias("line_no"), found.alias("found"), between.alias("between"), F.posexplode(found).alias("nth", "match"))
    before = F.concat(F.array_join(F.slice("between", 1, F.col("nth") + 1), ""), F.array_join(F.slice("found", 1, F.col("nth")), ""))
    return rows.select(*keys, "line_no", (F.octet_length(before) + 1).cast("int").alias("column"), "nth", "match")


def hardcoded_secret(facts: Facts) -> DataFrame:
    rows = secret_lines(applying(facts.files, "HARDCODED_SECRET", facts.languages), "path")
    where = F.struct("path", F.col("line_no").alias("line"), "column", F.col("match").alias("snippet"))
    return _finding("HARDCODED_SECRET", rows.select("path", where.alias("location"), (F.col("line_no") * 1000 + F.col("nth")).alias("ord")))


def cyclomatic(code: DataFrame, functions: DataFrame) -> DataFrame:
    """path, start_tok, cyclomatic: one more than the branches inside, those of nested functions included."""
    branches = code.where(has("roles", "branch") & F.col("kind").isin("name", "op")).select("path", F.col("tok_no").alias("t"))
    extents = functions.select("path", F.struct("start_tok", "end_tok").alias("key"), F.col("start_tok").alias("first_tok"), F.col("end_tok").alias("last_tok"))
    inside = enclosing(extents, branches).groupBy("path", "key.start_tok", "key.end_tok").agg(F.count("*").alias("n"))
    return functions.select("path", "start_tok", "end_tok").join(inside, ["path", "start_tok", "end_tok"], "left").select("path", "start_tok", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("cyclomatic"))


def line_levels(lines: DataFrame) -> DataFrame:
    """path, line_no, level: how many enclosing lines of less indentation a line has. A line encloses a later one if the
    last line before that of no more than its indentation is itself; so each line asks once for each lesser indentation."""
    depths = lines.groupBy("path").agg(F.collect_set("indent").alias("depths"))
    w = Window.partitionBy("path", "depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("path", "line_no", "indent").join(depths, "path").select("path", "line_no", "indent", F.explode("depths").alias("depth"))
    rows = rows.withColumn("last", F.last(F.when(F.col("indent") <= F.col("depth"), F.col("indent")), ignorenulls=True).over(w))
    inside = (F.col("depth") < F.col("indent")) & (F.col("last") == F.col("depth"))
    return rows.groupBy("path", "line_no").agg(F.count_if(inside).cast("int").alias("level"))


def max_nesting(code: DataFrame, functions: DataFrame) -> DataFrame:
    """path, start_tok, max_nesting: blocks inside blocks, the body being the first."""
    literal = F.coalesce(F.col("prev").isin("=", "(", ",", ":", "[", "?", "return"), F.lit(False))
    blocks = code.where((F.col("mask") == "{") & ~literal & (F.col("blocks") == "braces")).select("path", F.col("tok_no").alias("t"), (F.col("brace_depth") + 1).alias("level"))
    blocks = blocks.unionByName(fact.word_blocks(code).select("path", F.col("tok_no").alias("t"), (F.col("depth") + 1).alias("level")))
    spans = functions.select("path", "blocks", "start_tok", "end_tok", "start_line", "end_line", "depth")
    braced = spans.where("blocks <> 'indent'").select("path", F.struct("start_tok", F.col("depth").alias("around")).alias("key"), F.col("start_tok").alias("first_tok"), F.col("end_tok").alias("last_tok"))
    levels = line_levels(fact.indented_lines(code))
    heads = levels.select("path", F.col("line_no").alias("start_line"), F.col("level").alias("around"))
    plain = spans.where("blocks = 'indent'").join(heads, ["path", "start_line"]).select("path", F.struct("start_tok", "around").alias("key"), (F.col("start_line") + 1).alias("first_tok"), F.col("end_line").alias("last_tok"))
    found = enclosing(braced, blocks).unionByName(enclosing(plain, levels.select("path", F.col("line_no").alias("t"), "level")))
    return found.groupBy("path", "key.start_tok").agg((F.max("level") - F.max("key.around")).cast("int").alias("max_nesting"))


def function_metrics(facts: Facts) -> DataFrame:
    """path, language, name, start_tok, end_tok, start_line, end_line, top_level, cyclomatic, max_nesting, line_count."""
    rows = facts.functions.join(cyclomatic(facts.code, facts.functions), ["path", "start_tok"]).join(max_nesting(facts.code, facts.functions), ["path", "start_tok"], "left")
    return rows.select("path", "language", "name", "start_tok", "end_tok", "start_line", "end_line", "top_level", "cyclomatic", F.coalesce("max_nesting", F.lit(0)).alias("max_nesting"), (F.col("end_line") - F.col("start_line") + 1).alias("line_count"))


def violations(metrics: DataFrame, thresholds: tuple[int, int, int] = (15, 4, 80)) -> DataFrame:
    """Metrics over a threshold, with ``violated``: what is exceeded and by how much, in a fixed order."""
    over = [F.when(F.col(c) > most, F.concat(F.lit(f"{word} "), F.col(c).cast("string"), F.lit(f" > {most}"))) for c, word, most in zip(("cyclomatic", "max_nesting", "line_count"), ("cyclomatic", "nesting", "lines"), thresholds)]
    found = metrics.withColumn("violated", F.array_compact(F.array(*over)))
    return found.where(F.size("violated") > 0)


def complexity_locations(facts: Facts, found: DataFrame) -> DataFrame:
    """Where a function is reported: at itself, or with location_mode root_fallback at the file's first token, with the
    whole file as the snippet, unless it is top level."""
    own = facts.located(found.withColumnRenamed("start_tok", "first_tok").withColumnRenamed("end_tok", "last_tok")).withColumnRenamed("first_tok", "ord")
    if facts.location_mode == "function":
        return own
    root = own.where("NOT top_level").join(facts.files.select("path", "text"), "path")
    whole = F.struct("path", F.lit(1).alias("line"), F.lit(1).alias("column"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("snippet"))
    return own.where("top_level").unionByName(root.withColumn("location", whole).drop("text"))


def complexity(facts: Facts) -> DataFrame:
    found = complexity_locations(facts, violations(applying(facts.metrics, "COMPLEXITY", facts.languages), facts.thresholds))
    return _finding("COMPLEXITY", found, _over())


#: Rules in the order in which their findings are emitted.
RULES: dict[str, Callable[[Facts], DataFrame]] = {"SQLI": sql_injection, "XSS": cross_site_scripting, "HARDCODED_SECRET": hardcoded_secret, "COMPLEXITY": complexity}


#: Rules that tell extents of code alone: texts and tokens are met once for all of them.
EXTENTS: dict[Callable[[Facts], DataFrame], Callable[[Facts], DataFrame]] = {sql_injection: _sql_extents, cross_site_scripting: _script_extents, complexity: _complex_extents}


def raw_findings(facts: Facts, enabled: list[str] | None = None, rules: dict[str, Callable[[Facts], DataFrame]] = RULES) -> DataFrame:
    """All rules' rows with emission order (rule_no, ord); a rule that is not enabled is not planned. Duplicates stay."""
    chosen = [(no, rule_id, rule) for no, (rule_id, rule) in enumerate(rules.items()) if enabled is None or rule_id in enabled]
    # At the root of a file functions are reported with all of its text.
    together = [x for x in chosen if x[2] in EXTENTS and x[1] in RULE_TEXT and (x[2] is not complexity or facts.location_mode == "function")]
    out = None
    for no, rule_id, rule in together:
        rows = EXTENTS[rule](facts).withColumn("rule_id", F.lit(rule_id)).withColumn("rule_no", F.lit(no))
        out = rows if out is None else out.unionByName(rows)
    out = None if out is None else _findings(facts.located(out), [rule_id for _, rule_id, _ in together], F.col("message"))
    for no, rule_id, rule in chosen:
        if (no, rule_id, rule) not in together:
            rows = rule(facts).withColumn("rule_no", F.lit(no))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else sql_injection(facts).where("false").withColumn("rule_no", F.lit(0))
