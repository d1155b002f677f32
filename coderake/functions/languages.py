"""Languages as rows. A relation (language, role, value, close, how) says all that the scanner knows of a language:

- ``extension``: a suffix of its files.
- ``comment``: ``value`` opens it and ``close`` ends it (a line break for those of one line); how ``line start``: both
  stand at the beginning of a line.
- ``string``: what opens and what closes it, and how it is read: ``line`` (up to the end of the line at most, a backslash
  escapes), ``lines`` (any number of lines), ``raw`` (backslashes are plain), ``doubled`` (raw, its quote twice stands
  for itself), ``char`` (one character or escape; else the quote begins a lifetime), ``regex`` (only where an operand is
  expected), ``heredoc`` (up to a line that holds the opener's own word).
- ``blocks``: ``braces``, ``indent`` (of lines) or ``words`` (that open a block, up to one that ends it).
- ``calls``: ``bare`` if the brackets of arguments may be left out.
- ``rule``: a rule that is applied to it.
- all other roles: words and signs with a meaning, see ROLES.

``Languages`` compiles rows into one lexer a language and a relation of words, which files and tokens are joined with.
Adding a language, or a word to one, means adding rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.functions.vocabulary import BLOCK_WORDS, BRACKET_WORDS, BRANCHES, FUNCTION_WORDS, KEYWORDS, LANGUAGE_EXTENSIONS, RULE_LANGUAGES

SCHEMA = "language string, role string, value string, close string, how string"

#: What words and signs can be, as bits: no name; head of a function; one more path through a function; head of a line that
#: a colon parts from a statement; word whose brackets hold statements; opener of a block by words; what ends it; loop
#: whose ``do`` is its own; word that stands behind a statement; end of a statement; keyword that is a value.
ROLES = {"keyword": 1, "function": 2, "branch": 4, "head": 8, "bracket": 16, "opener": 32, "closer": 64, "loop": 128, "modifier": 256, "end": 512, "value": 1024}

_SLASHES = [("//", "\n", ""), ("/*", "*/", "")]
_QUOTES = [('"', '"', "line"), ("'", "'", "line")]
_TRIPLE = '"""'
COMMENTS = {"python": [("#", "\n", "")], "ruby": [("#", "\n", ""), ("=begin", "=end", "line start")]}
STRINGS = {
    "python": [(_TRIPLE, _TRIPLE, "lines"), ("'''", "'''", "lines"), *_QUOTES],
    "javascript": [*_QUOTES, ("`", "`", "lines"), ("/", "/", "regex")],
    "typescript": [*_QUOTES, ("`", "`", "lines"), ("/", "/", "regex")],
    "java": [(_TRIPLE, _TRIPLE, "lines"), *_QUOTES],
    "kotlin": [(_TRIPLE, _TRIPLE, "raw"), *_QUOTES],
    "go": [("`", "`", "raw"), *_QUOTES],
    "ruby": [('"', '"', "lines"), ("'", "'", "lines"), ("`", "`", "lines"), ("/", "/", "regex"), ("<<", "", "heredoc"), *[(f"%{k}{a}", b, "lines") for k in "qQwWiI" for a, b in ("()", "[]", "{}")]],
    "rust": [('r##"', '"##', "raw"), ('r#"', '"#', "raw"), ('r"', '"', "raw"), ('"', '"', "lines"), ("'", "'", "char")],
    "c": _QUOTES,
    "cpp": [('R"(', ')"', "raw"), *_QUOTES],
    "csharp": [(_TRIPLE, _TRIPLE, "raw"), ('$@"', '"', "doubled"), ('@$"', '"', "doubled"), ('@"', '"', "doubled"), *_QUOTES],
    "swift": [('#"""', '"""#', "raw"), ('#"', '"#', "raw"), (_TRIPLE, _TRIPLE, "lines"), ('"', '"', "line")],
}
RUBY_WORDS = {
    "keyword": ["then", "module", "alias", "undef", "self", "super", "ensure", "next", "redo", "retry"],
    "opener": ["def", "class", "module", "begin", "case", "if", "unless", "while", "until", "for", "do"],
    "closer": ["end"],
    "loop": ["while", "until", "for"],
    "modifier": ["if", "unless", "while", "until", "rescue"],
    "end": ["then", "do", "end", "else"],
    "value": ["end", "self", "true", "false", "nil", "return", "break", "next", "redo", "retry", "raise", "yield", "super"],
}


def built_in() -> list[tuple[str, str, str, str, str]]:
    """The rows of the twelve built-in languages."""
    shared = {"keyword": KEYWORDS, "function": FUNCTION_WORDS, "branch": BRANCHES, "head": BLOCK_WORDS, "bracket": BRACKET_WORDS}
    out = []
    for k, extensions in LANGUAGE_EXTENSIONS.items():
        out += [(k, "extension", e, "", "") for e in extensions]
        out += [(k, "comment", *c) for c in COMMENTS.get(k, _SLASHES)]
        out += [(k, "string", *s) for s in STRINGS[k]]
        out.append((k, "blocks", {"python": "indent", "ruby": "words"}.get(k, "braces"), "", ""))
        out += [(k, role, w, "", "") for role, ws in shared.items() for w in ws]
        out += [(k, "rule", r, "", "") for r, ks in RULE_LANGUAGES.items() if k in ks]
    out.append(("ruby", "calls", "bare", "", ""))
    return out + [("ruby", role, w, "", "") for role, ws in RUBY_WORDS.items() for w in ws]


def relation(spark: SparkSession, more: list[tuple[str, ...]] = ()) -> DataFrame:
    """The built-in rows, and more of them."""
    return spark.createDataFrame(built_in() + list(more), SCHEMA)


#: What may stand before a regular expression: signs after which an operand follows, and words.
_OPERAND = r"(?:(?<=[=(,:;!&|?{}\[+~][ \t]{0,4})|(?<==>[ \t]{0,4})|(?<=\b(?:return|typeof|case|when|if|unless|while|and|or|not)[ \t]{1,4}))"


def _comment(opens: str, closes: str, how: str, private) -> str:
    o, c = re.escape(opens), re.escape(closes)
    if closes == "\n":
        return o + r"[^\n]*"
    if how == "line start":
        return rf"(?<![^\n]){o}[\s\S]*?\n{c}[^\n]*"
    return rf"{o}[\s\S]*?{_either(closes, private)}"


def _either(closes: str, private) -> str:
    """What closes, its first character escaped or not."""
    return f"[{re.escape(closes[0])}{private(closes[0])}]{re.escape(closes[1:])}"


def _string(opens: str, closes: str, how: str, private) -> str:
    o, c, q = re.escape(opens), re.escape(closes), re.escape(closes[:1])
    if how == "line":
        return rf"{o}[^{q}\n]*{c}"
    if how == "lines":
        return rf"{o}[^{q}]*{c}" if len(closes) == 1 else rf"{o}[\s\S]*?{c}"
    if how == "raw":
        return rf"{o}[^{q}{private(closes)}]*{_either(closes, private)}" if len(closes) == 1 else rf"{o}[\s\S]*?{_either(closes, private)}"
    if how == "doubled":
        return rf"{o}(?:[^{q}{private(closes)}]++|{_either(closes, private)}{q})*+{_either(closes, private)}"
    if how == "char":
        return rf"{o}(?:{private('')}[^{q}\n]*|[^{q}\n]){c}|{o}[A-Za-z_]\w*"
    if how == "regex":
        return rf"{_OPERAND}{o}(?![*/])(?:[^/\n\[]++|\[[^\]\n]*+\])++{c}[a-z]*"
    if how == "heredoc":
        body = r"[^\n]*\n(?:[\s\S]*?\n)??[ \t]*"
        return rf"{o}[~-](['\"]?)([A-Za-z_]\w*)\1{body}\2(?![^\n])|{o}(['\"]?)([A-Z]\w*)\3{body}\4(?![^\n])"
    raise ValueError(f"no such string: {how}")


class Languages:
    """Rows of languages, compiled. They are a vocabulary, read on the driver once."""

    def __init__(self, rows: list[tuple[str, str, str, str, str]] | None = None) -> None:
        self.rows = sorted(set(rows if rows is not None else built_in()))

    @classmethod
    def of(cls, rows: DataFrame) -> Languages:
        return cls([tuple(r) for r in rows.select("language", "role", "value", "close", "how").collect()])

    def _named(self, role: str) -> dict[str, list[tuple[str, str, str]]]:
        out: dict[str, list[tuple[str, str, str]]] = {}
        for k, r, *rest in self.rows:
            if r == role:
                out.setdefault(k, []).append(tuple(rest))
        return out

    @cached_property
    def names(self) -> list[str]:
        return sorted({k for k, *_ in self.rows})

    @cached_property
    def comments(self):
        return self._named("comment")

    @cached_property
    def strings(self):
        return self._named("string")

    @cached_property
    def blocks(self) -> dict[str, str]:
        return {k: v[0][0] for k, v in self._named("blocks").items()}

    def lexer(self, language: str, base: int) -> str:
        """One regular expression that matches each token of the language in a marked text, whose private characters begin
        at ``base``: the longest opener of a comment or a string first, then names, numbers, signs, blanks, anything."""
        private = lambda c: chr(base + 128 + ord(c)) if c else chr(base)
        found = [(len(o), _comment(o, c, how, private)) for o, c, how in self.comments.get(language, [])]
        found += [(len(o), _string(o, c, how, private)) for o, c, how in self.strings.get(language, [])]
        opened = [p for _, p in sorted(found, key=lambda x: -x[0])]
        return "|".join([*opened, f"[A-Za-z_][\\w.{chr(base + 1)}-{chr(base + 6)}]*", "[0-9]+", r"==|!=|<=|>=|&&|\|\||:=|\+\+|--", r"[ \t]+", r"[\s\S]"])

    def lexers(self, spark: SparkSession, ranges: tuple[int, int]) -> DataFrame:
        """(language, lexer, lexer2, blocks, bare): a row a language."""
        rows = [(k, self.lexer(k, ranges[0]), self.lexer(k, ranges[1]), self.blocks.get(k, "braces"), k in self.bare) for k in self.names]
        return spark.createDataFrame(rows, "language string, lexer string, lexer2 string, blocks string, bare boolean")

    @cached_property
    def roles(self) -> dict[tuple[str, str], int]:
        """Words and signs of languages with the bits of what they are."""
        bits: dict[tuple[str, str], int] = {}
        for k, role, value, *_ in self.rows:
            if role in ROLES:
                bits[k, value] = bits.get((k, value), 0) | ROLES[role]
        return bits

    def words(self, spark: SparkSession) -> DataFrame:
        """(language, mask, roles): the same as rows."""
        return spark.createDataFrame([(*key, n) for key, n in self.roles.items()], "language string, mask string, roles int")

    def extensions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v, k) for k, r, v, *_ in self.rows if r == "extension"], "ext string, language string")

    @cached_property
    def _opened(self) -> tuple[dict, dict, dict, set[str]]:
        """By language: what opens comments, what opens strings, and quotes (with what closes them) that may open something
        else; and signs that are a comment alone."""
        comments = {k: tuple(o for o, *_ in rows) for k, rows in self.comments.items()}
        strings = {k: tuple(o for o, _, how in rows if how != "char") for k, rows in self.strings.items()}
        chars = {k: tuple((o, c) for o, c, how in rows if how == "char") for k, rows in self.strings.items()}
        return comments, strings, chars, {o for rows in self.comments.values() for o, c, _ in rows if c == "\n" and len(o) == 1}

    def kind(self, language: str, mask: str) -> str:
        """Of a token: newline, comment, string, heredoc (a body, with the line break before it), name, number, space or op."""
        comments, strings, chars, alone = self._opened
        first, last = mask[:1], mask[-1:]
        # No string or comment that begins with a letter ends with one.
        if first.isascii() and (first.isalpha() or first == "_") and last.isascii() and (last.isalnum() or last in "_."):
            return "name"
        if mask == "\n":
            return "newline"
        if first in (" ", "\t", "\r"):
            return "space"
        number = "number" if "0" <= first <= "9" else "op"
        if len(mask) == 1 and first not in alone:
            return number
        if first == "\n":
            return "heredoc"
        if mask.startswith(comments.get(language, ())):
            return "comment"
        if any(mask.startswith(o) and len(mask) > len(o) for o in strings.get(language, ())):
            return "string"
        if any(mask.startswith(o) and mask.endswith(c) and len(mask) > len(o) + len(c) for o, c in chars.get(language, ())):
            return "string"
        return number

    @cached_property
    def heredocs(self) -> list[str]:
        return sorted(k for k, rows in self.strings.items() if any(how == "heredoc" for *_, how in rows))

    @cached_property
    def bare(self) -> list[str]:
        return sorted(k for k, rows in self._named("calls").items() if any(v == "bare" for v, *_ in rows))

    def under(self, rule_id: str) -> list[str]:
        """Languages that a rule is applied to."""
        return sorted(k for k, rows in self._named("rule").items() if any(v == rule_id for v, *_ in rows))


def has(roles: Column | str, role: str) -> Column:
    """Whether a word has a role; no word has none."""
    return F.coalesce((F.col(roles) if isinstance(roles, str) else roles).bitwiseAND(F.lit(ROLES[role])) != 0, F.lit(False))


BUILT_IN = Languages()
