"""The operators once more as SQL for DuckDB, to hold the Spark queries against."""

from __future__ import annotations

from coderake.functions.vocabulary import BRANCHES, FUNCTION_WORDS, IGNORED_PARTS, KEYWORDS, LANGUAGE_EXTENSIONS, RULE_LANGUAGES, RULE_TEXT, SEVERITY_RANK, SINKS, TAINT_TERMS
from coderake.sources.fixture import CODE_FILES

# The lexers once more, written out on their own. A masked text shows an escaped double quote as ~ and chr(1), an escaped
# backtick as ~ and chr(2), any other escape as two tildes.
_REST = r"""|[A-Za-z_][0-9A-Za-z_.]*|[0-9]+|[=!<>]=|&&|\|\||:=|\+\+|--|[ \t]+|[\s\S]"""
PLAIN_LEXER = r"""/\*[\s\S]*?\*/|//[^\n]*|`[^`]*`|"[^"\n]*"|'[^'\n]*'|[A-Za-z_][0-9A-Za-z_.]*|[0-9]+|[=!<>]=|&&|\|\||:=|[ \t]+|[\s\S]"""
_COMMENTS, _QUOTED = r"/\*[\s\S]*?\*/|//[^\n]*", r"""|"[^"\n]*"|'[^'\n]*'"""
_SCRIPT = r"|[(=][ \t]*/(?:[^/*\n\[]|\[[^\]\n]*\])(?:[^/\n\[]|\[[^\]\n]*\])*/[a-z]*|`[^`]*`"
RUBY_LEXER = r"""(?m:^=begin[\s\S]*?\n=end[^\n]*)|#[^\n]*|<<~SQL[^\n]*\n[\s\S]*?\n[ \t]*SQL|~[ \t]*/[^/*\n][^/\n]*/[a-z]*|%[qQwWiI](?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})|"[^"]*"|'[^']*'|`[^`]*`""" + _REST
LEXERS = {
    "python": '"""[\\s\\S]*?"""|' + r"'''[\s\S]*?'''|#[^\n]*" + _QUOTED + _REST,
    "ruby": RUBY_LEXER,
    "javascript": _COMMENTS + _SCRIPT + _QUOTED + _REST,
    "typescript": _COMMENTS + _SCRIPT + _QUOTED + _REST,
    "java": '"""[\\s\\S]*?"""|' + _COMMENTS + _QUOTED + _REST,
    "kotlin": '"""[\\s\\S]*?["\\x01]""|' + _COMMENTS + _QUOTED + _REST,
    "go": "`[^`\\x02]*[`\\x02]|" + _COMMENTS + _QUOTED + _REST,
    "csharp": '"""[\\s\\S]*?["\\x01]""|(?:\\$@|@\\$|@)"(?:[^"\\x01]|["\\x01]")*["\\x01]|' + _COMMENTS + _QUOTED + _REST,
    "rust": _COMMENTS + r"""|r##"[\s\S]*?["\x01]##|r#"[\s\S]*?["\x01]#|r"[^"\x01]*["\x01]|"[^"]*"|'(?:~[^'\n]*|[^'\n])'|'[A-Za-z_][0-9A-Za-z_]*""" + _REST,
    "swift": '#"""[\\s\\S]*?["\\x01]""#|#"[\\s\\S]*?["\\x01]#|"""[\\s\\S]*?"""|' + _COMMENTS + '|"[^"\\n]*"' + _REST,
    "cpp": r'R"\([\s\S]*?\)"|' + _COMMENTS + _QUOTED + _REST,
    "c": _COMMENTS + _QUOTED + _REST,
}
UNBRACED = ("python", "ruby")
RUBY_KEYWORDS = ("then", "module", "alias", "undef", "self", "super", "ensure", "next", "redo", "retry")
RUBY_VALUES = ("end", "self", "true", "false", "nil", "return", "break", "next", "redo", "retry", "raise", "yield", "super")
RUBY_OPENERS = ("def", "class", "module", "begin", "case", "if", "unless", "while", "until", "for", "do")
RUBY_BEHIND = ("if", "unless", "while", "until", "rescue")
RUBY_ENDS = ("then", "do", "end", "else")
GOES_ON = (",", "=", ":=", "+", "-", "*", "&&", "||", ".")
BLOCK_WORDS = ("if", "elif", "else", "for", "while", "with", "try", "except", "finally", "match", "case", "class", "def", "async")
BRACKET_WORDS = ("for", "if", "while", "switch", "until", "foreach", "using", "try", "with")
BEFORE_LITERALS = ("=", ":=", "(", ",", "[", "?", "return", "||", "&&", "const", "let", "var")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(map(q, items))


def array(items) -> str:
    return f"[{words(items)}]"


#: Credential words with a literal, as a string of SQL.
SECRET = "'(?i)(?:token|secret|password|passwd|api_?key|credential)\\w*\\s*[:=]\\s*(?:\"[^\"\\n]+\"|''[^''\\n]+'')'"
LANG = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ({words(es)}) THEN {q(k)}" for k, es in LANGUAGE_EXTENSIONS.items()) + " END"
SIGN = r"regexp_replace({}, '([A-Za-z0-9_])(?:->|::|\?\.)([A-Za-z_])', '\1..\2', 'g')"
ESCAPED = r"""regexp_replace(replace(replace(replace(text, '\\', '~~'), '\"', '~' || chr(1)), '\`', '~' || chr(2)), '\\[^\n]', '~~', 'g')"""
MASK = SIGN.format(SIGN.format(ESCAPED))


def keyword(language: str, mask: str) -> str:
    """Whether a word names nothing."""
    return f"({mask} IN ({words(KEYWORDS)}) OR ({language} = 'ruby' AND {mask} IN ({words(RUBY_KEYWORDS)})))"


def ends_value(language: str, kind: str, mask: str) -> str:
    return f"(({kind} = 'name' AND (NOT {keyword(language, mask)} OR ({language} = 'ruby' AND {mask} IN ({words(RUBY_VALUES)})))) OR {kind} IN ('number', 'string') OR {mask} IN (')', ']', '}}'))"


def same_statement(line: str, other: str, at: str = "c") -> str:
    """Whether a bracket may go on with what stands before it."""
    return f"({at}.language NOT IN ({words(UNBRACED)}) OR {line} = {other} OR ({at}.language = 'python' AND ({at}.paren_depth > 0 OR {at}.brace_depth > 0)))"


#: A word of Ruby that stands behind a statement in its line, and one that ends a statement.
BEHIND = f"(c.mask IN ({words(RUBY_BEHIND)}) AND coalesce(c.prev_line = c.line_no AND {ends_value('c.language', 'c.prev_kind', 'c.prev')}, false))"
WORD_ENDS = f"(c.language = 'ruby' AND c.kind = 'name' AND coalesce(c.prev, '') <> '.' AND (c.mask IN ({words(RUBY_ENDS)}) OR {BEHIND}))"
#: What follows the name of a call without brackets.
OPERAND = f"n.language = 'ruby' AND n.next_line = n.line_no AND n.next_off > n.off + length(n.mask) AND ((n.next_kind = 'name' AND (NOT {keyword('n.language', 'n.next')} OR (n.next IN ({words(RUBY_VALUES)}) AND n.next <> 'end'))) OR n.next_kind IN ('number', 'string') OR n.next IN ('[', '@', '$') OR (n.next = ':' AND n.next2_off = n.next_off + 1))"


CTES = {
    "cf": f"({CODE_FILES})",
    "src": f"(SELECT path, {LANG} AS language, text FROM cf WHERE NOT list_has_any(string_split(path, '/'), {array(IGNORED_PARTS)}) AND {LANG} IS NOT NULL)",
    "lx": "(SELECT path, language, text, flatten(list_transform(CASE language " + " ".join(f"WHEN {q(k)} THEN regexp_extract_all(mt, {q(v)})" for k, v in LEXERS.items()) + rf""" END, lambda t:
      CASE WHEN regexp_matches(t, '^<<~SQL') THEN list_concat(list_concat(['<<~SQL'], regexp_extract_all(regexp_extract(t, '^<<~SQL([^\n]*)', 1), {q(RUBY_LEXER)})), [regexp_extract(t, '(?s)^[^\n]*(\n.*)$', 1)])
      WHEN regexp_matches(t, '^[(=~][ \t]*/') THEN list_filter([t[1], regexp_extract(t, '^.([ \t]*)', 1), regexp_extract(t, '(?s)^.[ \t]*(/.*)$', 1)], lambda x: x <> '') ELSE [t] END)) AS toks FROM (SELECT *, {MASK} AS mt FROM src))""",
    "t0": "(SELECT path, language, text AS file_text, generate_subscripts(toks, 1) - 1 AS tok_no, translate(unnest(toks), chr(1) || chr(2), '~~') AS mask FROM lx)",
    "t1": "(SELECT *, CAST(coalesce(sum(length(mask)) OVER w, 0) AS INT) AS off, CAST(1 + coalesce(sum(length(mask) - length(replace(mask, chr(10), ''))) OVER w, 0) AS INT) AS line_no, CAST(coalesce(sum((mask IN ('(', '['))::INT - (mask IN (')', ']'))::INT) OVER w, 0) AS INT) AS paren_depth, CAST(coalesce(sum((mask = '{')::INT - (mask = '}')::INT) OVER w, 0) AS INT) AS brace_depth FROM t0 WINDOW w AS (PARTITION BY path ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "t2": "(SELECT *, substring(file_text, off + 1, length(mask)) AS text, strlen(substring(file_text, 1, off)) - strlen(regexp_replace(substring(file_text, 1, off), '[^\\n]*$', '')) + 1 AS col_no FROM t1)",
    "tok": r"""(SELECT path, language, CAST(tok_no AS INT) AS tok_no, CASE WHEN mask = chr(10) THEN 'newline' WHEN mask[1] = chr(10) THEN 'heredoc'
      WHEN CASE WHEN language IN ('python', 'ruby') THEN mask LIKE '#%' OR mask LIKE '=begin%' ELSE mask LIKE '//%' OR mask LIKE '/*%' END THEN 'comment'
      WHEN length(mask) > 1 AND (mask[1] IN ('"', '`', '/', '%') OR (mask[1] = chr(39) AND (language <> 'rust' OR (length(mask) > 2 AND mask[-1] = chr(39)))) OR mask LIKE '<<%' OR regexp_matches(mask, '^([@$]+"|r#*"|R"|#")')) THEN 'string'
      WHEN regexp_matches(mask, '^[A-Za-z_]') THEN 'name' WHEN regexp_matches(mask, '^[0-9]') THEN 'number' WHEN regexp_matches(mask, '^[ \t\r]') THEN 'space' ELSE 'op' END AS kind, text, mask, off, line_no, CAST(col_no AS INT) AS col_no, paren_depth, brace_depth FROM t2)""",
    "c0": "(SELECT *, CASE WHEN kind = 'name' THEN list_filter(string_split(mask, '.'), lambda p: p <> '') END AS parts, lag(mask) OVER w AS prev, lag(mask, 2) OVER w AS prev2, lag(kind) OVER w AS prev_kind, lag(tok_no) OVER w AS prev_tok, lag(tok_no, 2) OVER w AS prev2_tok, lag(line_no) OVER w AS prev_line, lag(off + length(mask)) OVER w AS prev_end, lead(mask) OVER w AS next, lead(kind) OVER w AS next_kind, lead(off) OVER w AS next_off, lead(tok_no) OVER w AS next_tok, lead(line_no) OVER w AS next_line, lead(off, 2) OVER w AS next2_off FROM tok WHERE kind NOT IN ('space', 'newline', 'comment', 'heredoc') WINDOW w AS (PARTITION BY path ORDER BY tok_no))",
    # The match of an opening bracket: the first closing one after it at its own inner depth.
    "pr": "(SELECT o.path, o.tok_no AS open_tok, min(c.tok_no) AS close_tok FROM c0 o JOIN c0 c ON o.path = c.path AND c.tok_no > o.tok_no AND ((o.mask IN ('(', '[') AND c.mask IN (')', ']') AND c.paren_depth = o.paren_depth + 1) OR (o.mask = '{' AND c.mask = '}' AND c.brace_depth = o.brace_depth + 1)) GROUP BY 1, 2)",
    "heads": f"""(
      SELECT path, language, name, start_tok, start_line, body_tok, depth, close_tok FROM (
        SELECT k.path, k.language, CASE WHEN k.next_kind = 'name' THEN k.next ELSE '<anonymous>' END AS name, k.tok_no AS start_tok, k.line_no AS start_line, k.brace_depth AS depth,
          (SELECT min(b.tok_no) FROM c0 b WHERE b.path = k.path AND b.mask = '{{' AND b.brace_depth = k.brace_depth AND b.tok_no > k.tok_no) AS body_tok,
          (SELECT min(b.tok_no) FROM c0 b WHERE b.path = k.path AND b.mask = ';' AND b.brace_depth = k.brace_depth AND b.tok_no > k.tok_no) AS stop
        FROM c0 k WHERE k.mask IN ({words(FUNCTION_WORDS)}) AND k.language NOT IN ({words(UNBRACED)})) h JOIN pr USING (path) WHERE pr.open_tok = h.body_tok AND body_tok < coalesce(stop, 2147483647)
      UNION ALL
      SELECT b.path, b.language, n.mask, n.tok_no, n.line_no, b.tok_no, b.brace_depth, bp.close_tok FROM c0 b JOIN pr bp ON bp.path = b.path AND bp.open_tok = b.tok_no
        JOIN pr hp ON hp.path = b.path AND hp.close_tok = b.prev_tok JOIN c0 o ON o.path = b.path AND o.tok_no = hp.open_tok JOIN c0 n ON n.path = b.path AND n.tok_no = o.prev_tok
        WHERE b.mask = '{{' AND b.prev = ')' AND b.language NOT IN ({words(UNBRACED)}) AND n.kind = 'name' AND n.mask NOT IN ({words(KEYWORDS)}) AND coalesce(n.prev, '') NOT IN ({words(FUNCTION_WORDS)})
      UNION ALL
      SELECT b.path, b.language, '<anonymous>', b.prev_tok, b.prev_line, b.tok_no, b.brace_depth, bp.close_tok FROM c0 b JOIN pr bp ON bp.path = b.path AND bp.open_tok = b.tok_no WHERE b.mask = '{{' AND b.prev = '>' AND b.prev2 = '=' AND b.language NOT IN ({words(UNBRACED)})
    )""",
    "nm": f"(SELECT c.* FROM c0 c WHERE kind = 'name' AND NOT {keyword('language', 'mask')})",
    "oo": "(SELECT t.path, t.language, t.tok_no, t.mask, t.kind, coalesce(max(o.open_tok), -1) AS o FROM tok t LEFT JOIN pr o ON o.path = t.path AND o.open_tok < t.tok_no AND o.close_tok > t.tok_no WHERE t.kind NOT IN ('space', 'comment') GROUP BY ALL)",
    "bd": f"(SELECT t.path, t.o, t.tok_no, t.kind FROM oo t LEFT JOIN c0 c ON c.path = t.path AND c.tok_no = t.tok_no LEFT JOIN (SELECT path, tok_no, lag(CASE WHEN kind NOT IN ('newline', 'heredoc') THEN mask END IGNORE NULLS) OVER (PARTITION BY path ORDER BY tok_no) AS before FROM oo) l ON l.path = t.path AND l.tok_no = t.tok_no WHERE t.mask = ';' OR (t.kind IN ('newline', 'heredoc') AND coalesce(l.before, '') NOT IN ({words(GOES_ON)})) OR coalesce({WORD_ENDS}, false) OR (t.mask = '{{' AND t.language <> 'python' AND coalesce(c.prev, '') NOT IN ({words(BEFORE_LITERALS)}) AND NOT (coalesce(c.prev, '') = ':' AND coalesce((SELECT arg_max(m.mask, m.tok_no) FROM c0 m WHERE m.path = t.path AND m.tok_no < t.tok_no AND m.mask IN ('case', 'default', ';', '{{', '}}', '?')), '') NOT IN ('case', 'default'))))",
    # Where a call begins: back over a member sign to the call or bracket it hangs on, as often as that goes.
    "back": f"(SELECT c.path, c.tok_no, CASE WHEN o.prev_kind = 'name' AND NOT {keyword('o.language', 'o.prev')} AND {same_statement('o.prev_line', 'o.line_no', 'o')} THEN o.prev_tok ELSE p.open_tok END AS pos FROM c0 c JOIN pr p ON p.path = c.path AND p.close_tok = CASE WHEN c.prev = '.' AND c.prev2 = ')' THEN c.prev2_tok END JOIN c0 o ON o.path = p.path AND o.tok_no = p.open_tok WHERE c.kind = 'name')",
    "hang": "(SELECT path, tok_no, tok_no AS pos FROM nm WHERE next = '(' OR language = 'ruby' UNION ALL SELECT h.path, h.tok_no, b.pos FROM hang h JOIN back b ON b.path = h.path AND b.tok_no = h.pos)",
    "begun": "(SELECT h.path, h.tok_no, CASE WHEN c.prev = 'new' THEN c.prev_tok ELSE c.tok_no END AS start_tok FROM (SELECT path, tok_no, min(pos) AS pos FROM hang GROUP BY 1, 2) h JOIN c0 c ON c.path = h.path AND c.tok_no = h.pos)",
    "bare": f"""(SELECT n.*, t.o, least(coalesce((SELECT min(b.tok_no) FROM bd b WHERE b.path = n.path AND b.o = t.o AND b.tok_no > n.tok_no), 2147483647), coalesce(p.close_tok, 2147483647)) AS stop FROM nm n JOIN oo t ON t.path = n.path AND t.tok_no = n.tok_no LEFT JOIN pr p ON p.path = n.path AND p.open_tok = t.o WHERE coalesce(n.prev, '') NOT IN ({words(FUNCTION_WORDS)}) AND {OPERAND})""",
    "calls": f"""(SELECT n.path, n.language, n.tok_no, n.parts, array_to_string(n.parts, '.') AS callee, pr.close_tok, n.next_tok AS lo, pr.close_tok AS hi, n.next_tok AS o, g.start_tok, n.line_no, n.col_no FROM nm n JOIN begun g ON g.path = n.path AND g.tok_no = n.tok_no LEFT JOIN pr ON pr.path = n.path AND pr.open_tok = n.next_tok
      WHERE n.next = '(' AND {same_statement('n.line_no', 'n.next_line', 'n')} AND coalesce(n.prev, '') NOT IN ({words(FUNCTION_WORDS)}) AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.path = n.path AND h.start_tok = n.tok_no)
      UNION ALL SELECT * FROM (SELECT n.path, n.language, n.tok_no, n.parts, array_to_string(n.parts, '.'), (SELECT max(c.tok_no) FROM c0 c WHERE c.path = n.path AND c.tok_no < n.stop) AS last, n.next_tok - 1, (SELECT max(c.tok_no) FROM c0 c WHERE c.path = n.path AND c.tok_no < n.stop) + 1, n.o, g.start_tok, n.line_no, n.col_no FROM bare n JOIN begun g ON g.path = n.path AND g.tok_no = n.tok_no WHERE n.next_tok < n.stop))""",
    "ar": "(SELECT c.path, c.tok_no AS call_tok, t.tok_no AS t, t.mask = ',' AND t.o = c.o AS comma, CAST(1 + sum((t.mask = ',' AND t.o = c.o)::INT) OVER (PARTITION BY c.path, c.tok_no ORDER BY t.tok_no) AS INT) AS arg_no FROM calls c JOIN oo t ON t.path = c.path AND t.kind NOT IN ('newline', 'heredoc') AND t.tok_no > c.lo AND t.tok_no < c.hi)",
    "args": "(SELECT path, call_tok, arg_no, min(t) AS first_tok, max(t) AS last_tok FROM ar WHERE NOT comma GROUP BY 1, 2, 3)",
    # Statements are what lies between the ends in one bracket: semicolons, line breaks, braces that open a block.
    "sg0": f"(SELECT c.path, c.language, c.tok_no, c.next_tok, t.o FROM c0 c JOIN oo t ON t.path = c.path AND t.tok_no = c.tok_no LEFT JOIN c0 b ON b.path = c.path AND b.tok_no = t.o WHERE c.mask IN ('=', ':=') AND NOT coalesce(c.prev_end = c.off AND c.prev IN ('+', '-', '*', '/', '%', '&', '|', '^', '<', '>', '!', '~', '?', ':', '='), false) AND NOT coalesce(c.next = '>' AND c.next_off = c.off + 1, false) AND (t.o = -1 OR b.mask = '{{' OR (b.mask = '(' AND b.prev IN ({words(BRACKET_WORDS)}) AND c.language NOT IN ({words(UNBRACED)}))))",
    "sg1": "(SELECT s.*, coalesce((SELECT max(b.tok_no) FROM bd b WHERE b.path = s.path AND b.o = s.o AND b.tok_no < s.tok_no), s.o) AS u0, (SELECT min(b.tok_no) FROM bd b WHERE b.path = s.path AND b.o = s.o AND b.tok_no > s.tok_no) AS u1 FROM sg0 s)",
    "sg2": f"(SELECT s.*, CASE WHEN (s.language IN ({words(UNBRACED)}) AND h.mask IN ({words(BLOCK_WORDS)})) OR h.mask IN ('case', 'default') THEN (SELECT min(x.tok_no) FROM oo x WHERE x.path = s.path AND x.o = s.o AND x.mask = ':' AND x.tok_no > s.u0 AND x.tok_no < coalesce(s.u1, 2147483647)) END AS colon FROM sg1 s JOIN oo h ON h.path = s.path AND h.tok_no = (SELECT min(x.tok_no) FROM oo x WHERE x.path = s.path AND x.o = s.o AND x.kind NOT IN ('newline', 'heredoc') AND x.tok_no > s.u0))",
    "sg3": f"(SELECT s.*, (SELECT max(x.tok_no) FROM oo x WHERE x.path = s.path AND x.o = s.o AND x.mask = ',' AND x.tok_no < s.tok_no AND x.tok_no > (SELECT min(y.tok_no) FROM sg2 y WHERE y.path = s.path AND y.o = s.o AND y.u0 = s.u0) AND s.language NOT IN ({words(UNBRACED)})) AS comma, (SELECT max(y.tok_no) FROM sg2 y WHERE y.path = s.path AND y.o = s.o AND y.u0 = s.u0 AND y.tok_no < s.tok_no) AS sign0 FROM sg2 s)",
    "sg4": "(SELECT s.*, greatest(u0, coalesce(comma, -1), coalesce(sign0, -1), CASE WHEN colon < tok_no THEN colon ELSE -1 END) AS part FROM sg3 s)",
    "sg": """(SELECT s.path, s.language, s.tok_no, s.next_tok AS value_start,
        (SELECT min(x.tok_no) FROM oo x WHERE x.path = s.path AND x.o = s.o AND x.kind NOT IN ('newline', 'heredoc') AND x.tok_no > s.part) AS left_first,
        coalesce((SELECT min(x.tok_no) FROM oo x WHERE x.path = s.path AND x.o = s.o AND x.mask = ':' AND x.tok_no > s.part AND x.tok_no < s.tok_no), s.tok_no) AS left_end,
        least(CASE WHEN s.u1 IS NOT NULL AND s.u1 < coalesce(e.close_tok, 2147483647) THEN (SELECT max(c.tok_no) FROM c0 c WHERE c.path = s.path AND c.tok_no <= s.u1 AND NOT (c.tok_no = s.u1 AND c.kind = 'name')) WHEN e.close_tok IS NOT NULL THEN (SELECT max(c.tok_no) FROM c0 c WHERE c.path = s.path AND c.tok_no < e.close_tok) ELSE (SELECT max(c.tok_no) FROM c0 c WHERE c.path = s.path) END,
          (SELECT max(c.tok_no) FROM c0 c WHERE c.path = s.path AND c.tok_no < (SELECT min(y.comma) FROM sg4 y WHERE y.path = s.path AND y.o = s.o AND y.u0 = s.u0 AND y.tok_no > s.tok_no AND y.part = y.comma)),
          (SELECT max(c.tok_no) FROM c0 c WHERE c.path = s.path AND c.tok_no < s.colon AND s.colon > s.tok_no)) AS value_end
        FROM sg4 s LEFT JOIN pr e ON e.path = s.path AND e.open_tok = s.o)""",
    "wb": f"""(SELECT *, CAST(coalesce(sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS depth FROM (SELECT w.* FROM
        (SELECT c.*, t.o, c.mask <> 'end' AND NOT {BEHIND} AS opens FROM c0 c JOIN oo t ON t.path = c.path AND t.tok_no = c.tok_no WHERE c.language = 'ruby' AND c.kind = 'name' AND (c.mask IN ({words(RUBY_OPENERS)}) OR c.mask = 'end') AND coalesce(c.prev, '') <> '.' AND NOT coalesce(c.next = ':' AND c.next_off = c.off + length(c.mask), false) AND NOT coalesce(c.prev = ':' AND c.prev_end = c.off, false)) w
        WHERE (w.opens OR w.mask = 'end') AND NOT (w.mask = 'do' AND EXISTS (SELECT 1 FROM c0 c JOIN oo t ON t.path = c.path AND t.tok_no = c.tok_no WHERE c.path = w.path AND c.language = 'ruby' AND c.mask IN ('while', 'until', 'for') AND c.kind = 'name' AND coalesce(c.prev, '') <> '.' AND NOT {BEHIND} AND t.o = w.o AND c.tok_no < w.tok_no
          AND c.tok_no > (SELECT coalesce(max(b.tok_no), -1) FROM bd b WHERE b.path = w.path AND b.o = w.o AND b.tok_no < w.tok_no)))))""",
    "lf": "(SELECT s.path, s.tok_no AS sign, c.* EXCLUDE (path) FROM sg s JOIN nm c ON c.path = s.path AND c.tok_no >= s.left_first AND c.tok_no < s.left_end)",
    "asg": "(SELECT s.path, s.language, s.tok_no, l.start_tok, l.targets, l.target_chain, l.line_no, l.col_no, s.value_start, s.value_end FROM sg s JOIN (SELECT path, sign, min(tok_no) AS start_tok, list_sort(list_distinct(flatten(list(parts)))) AS targets, arg_max(parts, tok_no) AS target_chain, arg_min(line_no, tok_no) AS line_no, arg_min(col_no, tok_no) AS col_no FROM lf GROUP BY 1, 2) l ON l.path = s.path AND l.sign = s.tok_no WHERE s.value_start <= s.value_end)",
    "ln0": "(SELECT path, line_no, min(tok_no) AS tok_no, max(tok_no) AS last_tok FROM c0 WHERE language = 'python' GROUP BY 1, 2)",
    "ln": "(SELECT l.path, l.line_no, c.col_no - 1 AS indent, c.mask AS first, l.tok_no, l.last_tok FROM ln0 l JOIN c0 c ON c.path = l.path AND c.tok_no = l.tok_no WHERE c.paren_depth = 0)",
    "ih": "(SELECT c.path, c.language, CASE WHEN c.next_kind = 'name' THEN c.next ELSE '<anonymous>' END AS name, c.tok_no AS start_tok, c.line_no AS start_line, l.indent AS depth, (SELECT min(x.line_no) FROM ln x WHERE x.path = c.path AND x.line_no > c.line_no AND x.indent <= l.indent) AS follow FROM c0 c JOIN ln l ON l.path = c.path AND l.line_no = c.line_no WHERE c.mask = 'def' AND c.language = 'python')",
    "ie": "(SELECT h.*, (SELECT max(x.line_no) FROM ln x WHERE x.path = h.path AND (h.follow IS NULL OR x.line_no < h.follow)) AS end_line FROM ih h)",
    "fn": """(SELECT h.path, h.language, h.name, h.start_tok, h.close_tok AS end_tok, h.start_line, e.line_no AS end_line, h.depth = 0 AS top_level, h.depth FROM heads h JOIN c0 e ON e.path = h.path AND e.tok_no = h.close_tok
      UNION ALL SELECT w.path, w.language, CASE WHEN w.next_kind = 'name' THEN w.next ELSE '<anonymous>' END, w.tok_no, e.tok_no, w.line_no, e.line_no, w.depth = 0, w.depth FROM wb w JOIN wb e ON e.path = w.path AND e.tok_no = (SELECT min(x.tok_no) FROM wb x WHERE x.path = w.path AND NOT x.opens AND x.tok_no > w.tok_no AND x.depth = w.depth + 1) WHERE w.opens AND w.mask = 'def'
      UNION ALL SELECT i.path, i.language, i.name, i.start_tok, (SELECT max(c.tok_no) FROM c0 c WHERE c.path = i.path AND c.line_no = i.end_line), i.start_line, i.end_line, i.depth = 0, i.depth FROM ie i)""",
    # A line's level: earlier lines of less indentation than every line after them up to this one.
    "lv": "(SELECT i.path, i.line_no, count(j.line_no) AS level FROM ln i LEFT JOIN ln j ON j.path = i.path AND j.line_no < i.line_no AND j.indent < (SELECT min(k.indent) FROM ln k WHERE k.path = i.path AND k.line_no > j.line_no AND k.line_no <= i.line_no) GROUP BY 1, 2)",
    "mt": f"""(SELECT f.path, f.language, f.name, f.start_tok, f.end_tok, f.start_line, f.end_line, f.top_level,
        CAST(1 + (SELECT count(*) FROM c0 b WHERE b.path = f.path AND b.tok_no BETWEEN f.start_tok AND f.end_tok AND b.mask IN ({words(BRANCHES)})) AS INT) AS cyclomatic,
        CAST(CASE f.language WHEN 'python' THEN coalesce((SELECT max(v.level) FROM lv v WHERE v.path = f.path AND v.line_no > f.start_line AND v.line_no <= f.end_line) - (SELECT v.level FROM lv v WHERE v.path = f.path AND v.line_no = f.start_line), 0)
          WHEN 'ruby' THEN (SELECT max(w.depth) + 1 FROM wb w WHERE w.path = f.path AND w.opens AND w.tok_no BETWEEN f.start_tok AND f.end_tok) - f.depth
          ELSE coalesce((SELECT max(b.brace_depth) + 1 FROM c0 b WHERE b.path = f.path AND b.tok_no BETWEEN f.start_tok AND f.end_tok AND b.mask = '{{' AND coalesce(b.prev, '') NOT IN ('=', '(', ',', ':', '[', '?', 'return')) - f.depth, 0) END AS INT) AS max_nesting,
        f.end_line - f.start_line + 1 AS line_count FROM fn f)""",
    "nc": f"""(SELECT n.*, k.close_tok, CASE
        WHEN k.tok_no IS NOT NULL AND (k.callee IN ({words(TAINT_TERMS['source_function'])}) OR list_has_any(n.parts, {array(TAINT_TERMS['source_property'])})) THEN 'call'
        WHEN len(n.parts) > 1 AND (n.parts[1] IN ({words(TAINT_TERMS['source_identifier'])}) OR list_has_any(n.parts[2:], {array(TAINT_TERMS['source_property'])})) THEN 'member'
        WHEN list_has_any(n.parts, {array(TAINT_TERMS['source_identifier'])}) THEN 'identifier' END AS source
      FROM nm n LEFT JOIN calls k ON k.path = n.path AND k.tok_no = n.tok_no)""",
    "sz": f"(SELECT path, tok_no AS a, close_tok AS b FROM calls WHERE callee IN ({words(TAINT_TERMS['sanitizer'])}))",
    "ex": "(SELECT path, 'v' AS what, tok_no AS key, 0 AS arg_no, value_start AS first_tok, value_end AS last_tok FROM asg UNION ALL SELECT path, 'a', call_tok, arg_no, first_tok, last_tok FROM args)",
    "lvn": "(SELECT e.path, e.what, e.key, e.arg_no, n.tok_no AS t, n.parts, n.source IS NOT NULL AS is_source FROM ex e JOIN nc n ON n.path = e.path AND n.tok_no BETWEEN e.first_tok AND e.last_tok WHERE NOT EXISTS (SELECT 1 FROM sz WHERE sz.path = e.path AND sz.a >= e.first_tok AND sz.b <= e.last_tok AND n.tok_no BETWEEN sz.a AND sz.b))",
    "ev": f"""(SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, targets, idents, seeds) AS k FROM (
        SELECT a.path, a.start_tok AS ord, CASE WHEN coalesce(l.src, false) THEN [] ELSE a.targets END AS targets, coalesce(l.idents, []) AS idents, CASE WHEN l.src THEN a.targets ELSE [] END AS seeds
          FROM asg a LEFT JOIN (SELECT path, key, list_distinct(flatten(list(parts))) AS idents, bool_or(is_source) AS src FROM lvn WHERE what = 'v' GROUP BY 1, 2) l ON l.path = a.path AND l.key = a.tok_no
        UNION ALL SELECT s.path, s.tok_no, [], [], CASE s.source WHEN 'call' THEN (SELECT list_distinct(flatten(list(i.parts))) FROM nm i WHERE i.path = s.path AND i.tok_no BETWEEN s.tok_no AND s.close_tok) WHEN 'member' THEN s.parts ELSE list_filter(s.parts, lambda p: p IN ({words(TAINT_TERMS['source_identifier'])})) END FROM nc s WHERE s.source IS NOT NULL))""",
    "fold": f"(SELECT path, 0::BIGINT AS k, []::VARCHAR[] AS names FROM (SELECT DISTINCT path FROM ev) UNION ALL SELECT f.path, e.k, list_distinct(list_concat(list_concat(f.names, e.seeds), CASE WHEN list_has_any(e.idents, f.names) OR list_has_any(e.idents, {array(TAINT_TERMS['source_identifier'])}) THEN e.targets ELSE [] END)) FROM fold f JOIN ev e ON e.path = f.path AND e.k = f.k + 1)",
    "tainted": "(SELECT path, list_sort(arg_max(names, k)) AS names FROM fold GROUP BY 1)",
    "hit": f"(SELECT DISTINCT l.path, l.what, l.key, l.arg_no FROM lvn l LEFT JOIN tainted t ON t.path = l.path WHERE l.is_source OR list_has_any(l.parts, {array(TAINT_TERMS['source_identifier'])}) OR coalesce(list_has_any(l.parts, t.names), false))",
    "sinks": "(" + " UNION ALL ".join(f"SELECT path, {q(r)} AS rule_id, {no} AS rule_no, 'call' AS what, start_tok AS first_tok, close_tok AS last_tok FROM calls WHERE language IN ({words(RULE_LANGUAGES[r])}) AND (parts[-1] IN ({words(SINKS[r, 'call'])}) OR callee IN ({words(SINKS[r, 'call'])})) AND EXISTS (SELECT 1 FROM hit WHERE hit.path = calls.path AND hit.what = 'a' AND hit.key = calls.tok_no)" for no, r in enumerate(("SQLI", "XSS"))) + f" UNION ALL SELECT path, 'XSS', 1, 'assignment', start_tok, value_end FROM asg WHERE language IN ({words(RULE_LANGUAGES['XSS'])}) AND target_chain[-1] IN ({words(SINKS['XSS', 'property'])}) AND EXISTS (SELECT 1 FROM hit WHERE hit.path = asg.path AND hit.what = 'v' AND hit.key = asg.tok_no))",
    "vio": "(SELECT *, list_filter([CASE WHEN cyclomatic > 15 THEN 'cyclomatic ' || cyclomatic || ' > 15' END, CASE WHEN max_nesting > 4 THEN 'nesting ' || max_nesting || ' > 4' END, CASE WHEN line_count > 80 THEN 'lines ' || line_count || ' > 80' END], lambda x: x IS NOT NULL) AS violated FROM mt WHERE cyclomatic > 15 OR max_nesting > 4 OR line_count > 80)",
    "sl": "(SELECT path, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM (SELECT path, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS lines FROM src))",
    "raw": f"""(
      SELECT s.path, s.rule_id, s.rule_no, s.first_tok AS ord, a.line_no AS line, a.col_no AS col, regexp_replace(substring(x.text, a.off + 1, b.off + length(b.mask) - a.off), '^\\s+|\\s+$', '', 'g') AS snippet, CASE s.rule_id {' '.join(f"WHEN {q(r)} THEN {q(RULE_TEXT[r][1])}" for r in ('SQLI', 'XSS'))} END AS message
        FROM sinks s JOIN c0 a ON a.path = s.path AND a.tok_no = s.first_tok JOIN c0 b ON b.path = s.path AND b.tok_no = s.last_tok JOIN src x ON x.path = s.path
      UNION ALL SELECT v.path, 'COMPLEXITY', 3, v.start_tok, a.line_no, a.col_no, regexp_replace(substring(x.text, a.off + 1, b.off + length(b.mask) - a.off), '^\\s+|\\s+$', '', 'g'), 'Function ''' || v.name || ''' is over its limits: ' || array_to_string(v.violated, ', ')
        FROM vio v JOIN c0 a ON a.path = v.path AND a.tok_no = v.start_tok JOIN c0 b ON b.path = v.path AND b.tok_no = v.end_tok JOIN src x ON x.path = v.path
      UNION ALL SELECT path, 'HARDCODED_SECRET', 2, line_no * 1000 + n - 1, line_no, strlen(array_to_string(string_split_regex(line, {SECRET})[1:n], '') || array_to_string(ms[1:n - 1], '')) + 1, m, {q(RULE_TEXT['HARDCODED_SECRET'][1])}
        FROM (SELECT path, line_no, line, ms, generate_subscripts(ms, 1) AS n, unnest(ms) AS m FROM (SELECT *, regexp_extract_all(line, {SECRET}) AS ms FROM sl))
    )""",
    "fnd": f"(SELECT r.*, CASE rule_id {' '.join(f'WHEN {q(k)} THEN {q(v[0])}' for k, v in RULE_TEXT.items())} END AS title, CASE rule_id {' '.join(f'WHEN {q(k)} THEN {q(v[2])}' for k, v in RULE_TEXT.items())} END AS remediation, CASE rule_id {' '.join(f'WHEN {q(k)} THEN {q(v[3][0])}' for k, v in RULE_TEXT.items())} END AS reference, CASE rule_id WHEN 'COMPLEXITY' THEN 'Medium' ELSE 'High' END AS severity, CASE rule_id WHEN 'COMPLEXITY' THEN 'Low' WHEN 'HARDCODED_SECRET' THEN 'High' ELSE 'Medium' END AS confidence, EXISTS (SELECT 1 FROM sl WHERE sl.path = r.path AND sl.line_no IN (r.line, r.line - 1) AND contains(sl.line, 'scan:ignore')) AS suppressed FROM raw r)",
}
ALWAYS = {"lx", "tok", "c0", "pr", "heads", "nm", "back", "begun", "calls", "oo", "bd", "sg0", "sg1", "sg2", "sg3", "sg4", "sg", "args", "asg", "ln", "fn", "wb", "lv", "nc", "lvn", "ev", "tainted", "hit", "raw", "fnd", "mt"}
RANK = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SEVERITY_RANK.items()) + " ELSE 0 END"


def over(last: str, select: str) -> str:
    """A query over the relations up to ``last``."""
    names = list(CTES)
    used = names[: names.index(last) + 1]
    head = "WITH RECURSIVE " if {"fold", "hang"} & set(used) else "WITH "
    return head + ", ".join(f"{n} AS {'MATERIALIZED ' if n in ALWAYS else ''}{CTES[n]}" for n in used) + " " + select
