"""Vocabularies as plain values and as small dimension tables. Extending the scanner means adding rows here or passing more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names that decide results.
IGNORED_PARTS = [".git", ".hg", ".svn", ".idea", ".vscode", ".venv", "node_modules", "dist", "build", "target", "vendor", "bin", "obj", "out"]

LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "go": [".go"],
    "ruby": [".rb"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"],
    "csharp": [".cs"],
    "swift": [".swift"],
}

TAINT_TERMS = {
    "source_function": ["input", "gets", "readline", "read_line", "console.readLine", "console.readline", "scanf", "fgets"],
    "source_identifier": ["request", "req", "params", "query", "body", "form", "headers", "cookies"],
    "source_property": ["params", "query", "body", "form", "headers", "cookies", "args", "argv"],
    "sanitizer": ["escape", "encodeURI", "encodeURIComponent", "sanitize", "sanitizeHTML", "sanitizeHtml", "htmlspecialchars", "html.escape", "cgi.escape", "urllib.parse.quote"],
}


def source_kind(parts: list[str], is_call: bool) -> str | None:
    """What makes a name of those parts a source: call, member or identifier; none for no source."""
    functions, identifiers, properties = (TAINT_TERMS[f"source_{x}"] for x in ("function", "identifier", "property"))
    if is_call and (".".join(parts) in functions or any(p in properties for p in parts)):
        return "call"
    if len(parts) > 1 and (parts[0] in identifiers or any(p in properties for p in parts[1:])):
        return "member"
    return "identifier" if any(p in identifiers for p in parts) else None


SINKS = {
    ("SQLI", "call"): ["execute", "executemany", "query", "raw", "exec", "executeQuery", "prepareStatement"],
    ("XSS", "property"): ["innerHTML", "outerHTML", "html", "dangerouslySetInnerHTML"],
    ("XSS", "call"): ["document.write", "document.writeln", "response.write", "res.send", "res.write", "render", "send", "write", "setInnerHTML", "setHtml"],
}

RULE_LANGUAGES = {
    "SQLI": sorted(LANGUAGE_EXTENSIONS),
    "XSS": ["javascript", "typescript", "python", "ruby", "java", "kotlin"],
    "HARDCODED_SECRET": sorted(LANGUAGE_EXTENSIONS),
    "COMPLEXITY": sorted(LANGUAGE_EXTENSIONS),
}

SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}

DEFAULT_POLICY = {
    "rules.enabled": "SQLI,XSS,HARDCODED_SECRET,COMPLEXITY",
    "rules.severities.SQLI": "High",
    "rules.severities.XSS": "High",
    "rules.severities.HARDCODED_SECRET": "High",
    "rules.severities.COMPLEXITY": "Medium",
    "rules.confidence.SQLI": "Medium",
    "rules.confidence.XSS": "Medium",
    "rules.confidence.HARDCODED_SECRET": "High",
    "rules.confidence.COMPLEXITY": "Low",
    "thresholds.complexity.max_cyclomatic": "15",
    "thresholds.complexity.max_nesting": "4",
    "thresholds.complexity.max_function_lines": "80",
    "languages.enabled": "c,cpp,csharp,go,java,kotlin,javascript,typescript,python,ruby,rust,swift",
    "suppression.inline_comment": "scan:ignore",
    "reporting.format": "text",
    "reporting.fail_on_severity": "High",
}
# End of the fixed values.

#: First words of a line that a colon may part from a statement in the same line, where blocks follow indentation.
BLOCK_WORDS = ["if", "elif", "else", "for", "while", "with", "try", "except", "finally", "match", "case", "class", "def", "async"]
#: Words whose brackets hold statements, so that a sign in them assigns.
BRACKET_WORDS = ["for", "if", "while", "switch", "until", "foreach", "using", "try", "with"]
FUNCTION_WORDS = ["def", "function", "func", "fn", "fun"]
#: Words of code that name nothing: never callees, targets or identifiers.
KEYWORDS = ["if", "elif", "elsif", "else", "unless", "for", "foreach", "while", "until", "do", "try", "catch", "except", "finally", "with", "switch", "case", "when", "match", "loop", "select", "return", "yield", "await", "async", "new", "delete", "typeof", "in", "is", "and", "or", "not", "const", "let", "var", "val", "mut", "def", "function", "func", "fn", "fun", "class", "import", "from", "as", "end", "begin", "rescue", "raise", "throw", "throws", "pass", "break", "continue", "lambda", "public", "private", "static", "final", "void", "int", "string", "bool", "True", "False", "None", "true", "false", "null", "nil"]
#: Words and signs that open one more path through a function.
BRANCHES = ["if", "elif", "elsif", "unless", "for", "foreach", "while", "until", "do", "try", "catch", "with", "switch", "case", "when", "match", "loop", "select", "and", "or", "&&", "||", "?"]

RULE_TEXT = {
    "SQLI": ("Tainted input may reach a SQL call", "Input that a user controls seems to reach a SQL call; pass it as a parameter instead of building the statement from it.", "Bind values as parameters of a prepared statement.", ["https://owasp.org/www-community/attacks/SQL_Injection"]),
    "XSS": ("Tainted input may reach an HTML sink", "Input that a user controls seems to reach an HTML sink; encode it before it is rendered.", "Encode output for its context or sanitize it with a vetted library.", ["https://owasp.org/www-community/attacks/xss/"]),
    "HARDCODED_SECRET": ("Credential in source text", "A literal seems to hold a credential; move it to a secret store.", "Read credentials from the environment or a secret store, and rotate this one.", ["https://owasp.org/www-community/vulnerabilities/Use_of_hard-coded_password"]),
    "COMPLEXITY": ("Function over its complexity limits", "", "Split the function, reduce its nesting and simplify its control flow.", ["https://owasp.org/www-community/controls/Code_Review"]),
}


def taint_terms(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(t, r) for d in (TAINT_TERMS, more or {}) for r, ts in d.items() for t in ts], "term string, role string")


def sinks(spark: SparkSession, more: list[tuple[str, str, str]] = ()) -> DataFrame:
    return spark.createDataFrame([(r, k, n) for (r, k), ns in SINKS.items() for n in ns] + list(more), "rule_id string, kind string, name string")


def rule_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, k) for r, ks in RULE_LANGUAGES.items() for k in ks], "rule_id string, language string")


def severity_rank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITY_RANK.items()), "severity string, rank int")


def default_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_POLICY.items()), "key_path string, value string")
