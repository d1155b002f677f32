"""Code as a token relation: one row per token, made with regular expressions, windows and no parser.

Before lexing, each escape and each member sign between names becomes private-use characters, one for
one, so the lexers loop over single characters or possessively, no text can exhaust the regex engine's
stack, and a token's original text comes back by translating it: no token row carries its file's text,
and the work grows in proportion to a file's size. Tokens cover the text. Which lexer reads a file, and
what its words mean, comes from the rows of languages. A file's tokens go on as one list, from which rows are made in
Arrow batches of whole files: what is asked of a word is asked once for all its tokens, and running sums and neighbours are
taken where the tokens are, so nothing is sorted or spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coderake.functions.languages import BUILT_IN, ROLES, Languages
from coderake.functions.vocabulary import source_kind

#: A lexer for texts in no language: comments and strings as many languages have them.
PLAIN_LEXER = r"""/\*[\s\S]*?\*/|//[^\n]*|`[^`]*`|"[^"\n]*"|'[^'\n]*'|[A-Za-z_][\w.]*|[0-9]+|==|!=|<=|>=|&&|\|\||:=|[ \t]+|[\s\S]"""
KEYS = ("path", "language")
#: What stands before the opening brace of a literal or a pattern; before that of a block stands something else.
BEFORE_LITERALS = ("=", ":=", "(", ",", "[", "?", "return", "||", "&&", "const", "let", "var")
#: A line that ends with one of these goes on in the next one.
GOES_ON = (",", "=", ":=", "+", "-", "*", "&&", "||", ".")
#: Kinds of tokens that are no code.
TRIVIA = ("space", "newline", "comment", "heredoc")

# Private-use characters that stand for escapes and signs. A text that has some of the first range gets the second; one
# that has some of both shows theirs as what they would stand for.
_RANGES = (0xE000, 0xE800)
_ASCII = [c for c in range(128) if c != 10]
_SIGNS = {"->": (1, 2), "::": (3, 4), "?.": (5, 6)}


def _private(base: int) -> tuple[str, str, str]:
    """Private characters, what they stand for, and what a mask shows for them."""
    marks = [(0, "\\", "~"), *[(128 + c, chr(c), "~") for c in _ASCII], *[(n, c, ".") for sign, ns in _SIGNS.items() for n, c in zip(ns, sign)]]
    return "".join(chr(base + n) for n, _, _ in marks), "".join(c for _, c, _ in marks), "".join(m for _, _, m in marks)


def _second(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{chr(_RANGES[0])}-{chr(_RANGES[0] + 255)}]"))


def marked(text: Column, base: int = _RANGES[0]) -> Column:
    """The text with escapes and the signs ->, :: and ?. between names as private characters."""
    plain = "".join(map(chr, _ASCII))
    hidden = "".join(chr(base + 128 + c) for c in _ASCII)
    escape = chr(base)
    # What follows a backslash is escaped, backslashes first: they pair from the left.
    paired = F.replace(text, F.lit("\\\\"), F.lit(escape + chr(base + 128 + 92)))
    pieces = F.split(paired, r"\\", -1)
    first = lambda p: F.substring(p, 1, 1)
    closed = F.transform(pieces, lambda p, i: F.when(i == 0, p).when((p == "") | (first(p) == "\n"), F.concat(F.lit("\\"), p)).otherwise(F.concat(F.lit(escape), F.translate(first(p), plain, hidden), F.substring(p, F.lit(2), F.length(p)))))
    text = F.when(F.contains(text, F.lit("\\")), F.array_join(closed, "")).otherwise(text)
    for sign, (one, two) in _SIGNS.items():
        text = F.regexp_replace(text, rf"(?<=\w){sign.replace('?', '[?]').replace('.', '[.]')}(?=[A-Za-z_])", chr(base + one) + chr(base + two))
    return text


def plain_tokens(text: Column) -> Column:
    """A text's tokens as an array, in no language, with private characters as in ``marked``."""
    def lexed(base: int) -> Column:
        return F.regexp_extract_all(marked(text, base), F.lit(PLAIN_LEXER.replace(r"[\w.]", f"[\\w.{chr(base + 1)}-{chr(base + 6)}]")), F.lit(0))

    return F.when(_second(text), lexed(_RANGES[1])).otherwise(lexed(_RANGES[0]))


def plain_kind(token: Column) -> Column:
    """Whether a plain token is a name, a comment or a string; null for what is none."""
    first = F.substring(token, 1, 1)
    comment = token.startswith("//") | token.startswith("/*")
    return F.when(comment, "comment").when(first.isin('"', "'", "`") & (F.length(token) > 1), "string").when(F.regexp_like(first, F.lit("[A-Za-z_]")), "name")


def lexed(files: DataFrame, languages: Languages = BUILT_IN) -> DataFrame:
    """files (language, text and others) without text, and with blocks, bare, second (the range of private characters) and raws:
    the tokens in one array. A file's lexer comes with its language's row."""
    # A row for each language: small by nature.
    rows = files.join(F.broadcast(languages.lexers(files.sparkSession, _RANGES)), "language").withColumn("second", _second(F.col("text")))
    # Written once for each file: the arrays below read it several times.
    rows = rows.withColumn("marks", F.when(F.col("second"), marked(F.col("text"), _RANGES[1])).otherwise(marked(F.col("text"), _RANGES[0])))
    rows = rows.withColumn("lexer", F.when(F.col("second"), F.col("lexer2")).otherwise(F.col("lexer"))).drop("text", "lexer2")
    rows = rows.withColumn("raws", F.regexp_extract_all("marks", "lexer", F.lit(0))).drop("marks")
    if languages.heredocs:
        rows = rows.withColumn("raws", F.when(F.col("language").isin(*languages.heredocs) & F.exists("raws", _is_heredoc), F.flatten(F.transform("raws", _parted))).otherwise(F.col("raws")))
    return rows.drop("lexer")


def _is_heredoc(token: Column) -> Column:
    return token.startswith("<<") & (F.length(token) > 2)


def _parted(token: Column) -> Column:
    """A heredoc's opener, the tokens of the rest of its line, and its body with the line break before it."""
    opener = F.regexp_extract(token, r"^<<[~-]?(['\"]?)\w+\1", 0)
    after = F.instr(token, "\n")
    rest = F.substring(token, F.length(opener) + 1, after - F.length(opener) - 1)
    parts = F.concat(F.array(opener), F.regexp_extract_all(rest, F.col("lexer"), F.lit(0)), F.array(F.substring(token, after, F.length(token))))
    return F.when(_is_heredoc(token), parts).otherwise(F.array(token))


def in_both_ranges(text: Column) -> Column:
    """Whether some of a text's own characters are shown as what private ones stand for."""
    return _second(text) & F.regexp_like(text, F.lit(f"[{chr(_RANGES[1])}-{chr(_RANGES[1] + 255)}]"))


def _whole_files(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The same rows in batches that part no file, of ROWS rows or more but for the last, and where files begin in each."""
    held, size, last = [], 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        own = [batch.column(k) for k in keys]
        differ = [np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))) for c in own]
        begins = np.concatenate([[last != [c[0].as_py() for c in own]], np.logical_or.reduce(differ)]).astype(bool)
        last = [c[-1].as_py() for c in own]
        at = int(np.flatnonzero(begins)[-1]) if begins.any() else 0
        if begins.any() and size + at >= ROWS:
            held.append((batch.slice(0, at), begins[:at]))
            yield _joined(held)
            held, size, batch, begins = [], 0, batch.slice(at), begins[at:]
        held.append((batch, begins))
        size += batch.num_rows
    if held:
        yield _joined(held)


def _joined(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> tuple[pa.RecordBatch, np.ndarray]:
    return pa.Table.from_batches([b for b, _ in held]).combine_chunks().to_batches()[0], np.flatnonzero(np.concatenate([x for _, x in held]))


def _ahead(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of what stands before each row in its group; start: where each row's group begins."""
    total = np.cumsum(values, dtype=np.int64) - values
    return total - total[start]


def _latest(here: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The last row up to each one in its group where something holds, or -1."""
    found = np.maximum.accumulate(np.where(here, np.arange(len(here)), -1))
    return np.where(found >= start, found, -1)


def _starts(begins: np.ndarray, size: int) -> np.ndarray:
    """Where each row's group begins, given where groups do."""
    return np.repeat(begins, np.diff(np.append(begins, size)))


def _before(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The rows of ``_latest`` as of the row before."""
    moved = np.concatenate([[-1], at[:-1]])
    return np.where(moved >= start, moved, -1)


def _at(values: np.ndarray, rows: np.ndarray, none) -> np.ndarray:
    return np.where(rows >= 0, values[rows], none)


def _taken(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows, pa.int64(), mask=rows < 0))


def _ints(values: np.ndarray, none: bool = False, kind: pa.DataType = pa.int32()) -> pa.Array:
    """none: negative ones are null."""
    return pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=values < 0 if none else None)


class _Words:
    """A column of words of which many are alike: what is asked of them is asked once for each."""

    def __init__(self, column: pa.Array) -> None:
        found = column if pa.types.is_dictionary(column.type) else column.dictionary_encode()
        self.column, self.codes, self.own = column, found.indices.to_numpy(zero_copy_only=False), found.dictionary

    def of(self, what: pa.Array) -> np.ndarray:
        return what.to_numpy(zero_copy_only=False)[self.codes]

    def among(self, *words: str) -> np.ndarray:
        return self.of(pc.is_in(self.own, pa.array(words, pa.string())))


#: Rows of which running sums are taken at once, or those of one file, if these are more.
ROWS = 1 << 15
_PLACES = "off int, byte_off int, byte_end int, line_no int, col_no int, paren_depth int, brace_depth int, breaks int"
_PLACED = [c.split()[0] for c in _PLACES.split(", ")]


def _placed(batch: pa.RecordBatch, begins: np.ndarray) -> list[pa.Array]:
    """_PLACES of rows with mask and text."""
    start = _starts(begins, batch.num_rows)
    mask, text = _Words(batch.column("mask")), _Words(batch.column("text"))
    size, lines = mask.of(pc.utf8_length(mask.own)).astype(np.int64), mask.of(pc.count_substring(mask.own, "\n")).astype(np.int64)
    octets = text.of(pc.binary_length(text.own)).astype(np.int64)
    in_last_line = text.of(pa.array([len(t) - 1 - t.rfind(b"\n") for t in text.own.cast(pa.binary()).to_pylist()], pa.int64()))
    byte_off = _ahead(octets, start)
    line_start = _at(byte_off + octets - in_last_line, _before(_latest(lines > 0, start), start), 0)
    depth = lambda opening, closing: _ahead(mask.among(*opening).astype(np.int64) - mask.among(*closing), start)
    broken = mask.of(pc.starts_with(mask.own, "\n")).astype(np.int64)
    more = [_ahead(size, start), byte_off, byte_off + octets, _ahead(lines, start) + 1, byte_off - line_start + 1, depth("([", ")]"), depth("{", "}"), _ahead(broken, start)]
    return [_ints(x) for x in more]


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


def _given(batches: Iterator[tuple[pa.RecordBatch, list[pa.Array]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Those columns of batches with more of them, as plain ones."""
    for batch, more in batches:
        found = dict(zip(names[len(names) - len(more) :], more))
        yield pa.RecordBatch.from_arrays([_plain(found[n] if n in found else batch.column(n)) for n in names], names=names)


def _some_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of files in slices of ROWS tokens or more, but for the last of a batch, and how many tokens each file has."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("raws")), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS)) + 1
            yield batch.slice(at, until - at), sizes[at:until]
            at = until


def _meaning(languages: Languages) -> Callable[[str, bool, str], tuple[str, str, str, int, list[str] | None]]:
    """What a token of a marked text is: (mask, text, kind, roles, parts), by its language and the range of private characters.
    Short words are remembered."""
    back = [[str.maketrans(private, c) for c in (text, mask)] for private, text, mask in map(_private, _RANGES)]

    def told(language: str, second: bool, raw: str):
        text, mask = (raw, raw) if raw.isascii() else (raw.translate(t) for t in back[second])
        kind = languages.kind(language, mask)
        return mask, text, kind, languages.roles.get((language, mask), 0), [p for p in mask.split(".") if p] if kind == "name" else None

    kept = lru_cache(1 << 16)(told)
    return lambda language, second, raw: (kept if len(raw) <= 64 else told)(language, second, raw)


_WORDS = {"mask": pa.string(), "text": pa.string(), "kind": pa.string(), "roles": pa.int32(), "parts": pa.list_(pa.string())}


def _spread(batch: pa.RecordBatch, sizes: np.ndarray, meaning, keys: tuple[str, ...]) -> tuple[pa.RecordBatch, np.ndarray]:
    """A row for each token of files: keys, blocks, bare, tok_no and _WORDS; and where files begin."""
    file = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    raw = batch.column("raws").flatten().dictionary_encode()
    language, second = batch.column("language").dictionary_encode(), np.asarray(batch.column("second").fill_null(False)).astype(np.int64)
    speech = language.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + second
    several = 2 * len(language.dictionary)
    # Each word of a language once.
    own, codes = np.unique(raw.indices.to_numpy(zero_copy_only=False).astype(np.int64) * several + speech[file], return_inverse=True)
    words, spoken = raw.dictionary.to_pylist(), language.dictionary.to_pylist()
    told = list(zip(*[meaning(spoken[k % several // 2], bool(k % 2), words[k // several]) for k in own.tolist()])) or [()] * len(_WORDS)
    codes, rows = pa.array(codes.astype(np.int32)), pa.array(file)
    found = [pa.array(x, kind) for x, kind in zip(told, _WORDS.values())]
    found = [pa.DictionaryArray.from_arrays(codes, x) if kind == pa.string() else x.take(codes) for x, kind in zip(found, _WORDS.values())]
    given = [*dict.fromkeys((*keys, "blocks", "bare"))]
    columns = [*[(batch.column(c) if c in ("path", "bare") else batch.column(c).dictionary_encode()).take(rows) for c in given], _ints(np.arange(len(file)) - starts[file]), *found]
    return pa.RecordBatch.from_arrays(columns, names=[*given, "tok_no", *_WORDS]), starts[sizes > 0]


_TOKENS = "tok_no int, kind string, text string, mask string, off int, byte_off int, byte_end int, line_no int, col_no int, paren_depth int, brace_depth int, breaks int"


def _rows(files: DataFrame, keys: tuple[str, ...], languages: Languages, parts: int | None, what, columns: str | StructType) -> DataFrame:
    """keys, blocks, bare and the columns that what(batch, begins) gives (a batch, and the last of the columns) for tokens of files; or, with
    a schema, these columns alone."""
    parts = parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lexed(files.repartition(parts, keys[0]), languages).select(*dict.fromkeys((*keys, "language")), "blocks", "bare", "second", "raws")
    schema = columns if isinstance(columns, StructType) else StructType([*[lists.schema[k] for k in (*keys, "blocks", "bare")], *StructType.fromDDL(columns).fields])

    def each(batches):
        meaning = _meaning(languages)
        return _given((what(*_spread(batch, sizes, meaning, keys)) for batch, sizes in _some_files(batches)), schema.names)

    return lists.mapInArrow(each, schema)


def _set_in(batch: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.RecordBatch, list[pa.Array]]:
    return batch, _placed(batch, begins)


def _near_in(batch: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.RecordBatch, list[pa.Array]]:
    """Code tokens alone, and what is near them."""
    file = _starts(begins, batch.num_rows)
    code = np.flatnonzero(~_Words(batch.column("kind")).among(*TRIVIA))
    own = pa.RecordBatch.from_arrays([*batch.columns, *_placed(batch, begins)], names=[*batch.schema.names, *_PLACED]).take(pa.array(code))
    begins = np.flatnonzero(np.diff(file[code], prepend=-1))
    return own, _near(own, begins)


def tokens(files: DataFrame, keys: tuple[str, ...] = KEYS, languages: Languages = BUILT_IN, parts: int | None = None) -> DataFrame:
    """keys, blocks, bare, tok_no, kind, text, mask, off (code points), byte_off, byte_end, line_no, col_no (bytes, from 1),
    paren_depth, brace_depth and breaks (line breaks that are tokens; all three before the token). files: keys and text, dealt out by path
    in so many parts (or in as many as other shuffles have at first); a file's tokens stay together and in order."""
    return _rows(files, keys, languages, parts, _set_in, _TOKENS)


def of_kinds(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def code_only(rows: DataFrame) -> DataFrame:
    """Tokens that are code: strings and comments carry no names."""
    return rows.where(~F.col("kind").isin("string", *TRIVIA))


def chain_parts(mask: Column) -> Column:
    """[a, b, c] of a.b.c."""
    return F.filter(F.split(mask, r"\."), lambda p: p != "")


#: What code tokens learn of what is near them, where a fact asks for that; what few tokens learn stands in one struct, null for the others.
_NEAR = {
    "prev": "string", "next_tok": "int", "unit_no": "bigint", "called": "int", "source": "string",
    "call": "struct<close_tok:int,start_tok:int,inner_first:int,inner_last:int>",
    "assign": "struct<value_start:int,value_end:int,start_tok:int,line_no:int,col_no:int,off:int,targets:array<array<string>>>",
    "comma": "struct<prev_tok:int,outer_tok:int>",
    "block": "struct<prev2:string,prev_tok:int,prev_line:int,close_tok:int,close_line:int,head:string,head_kind:string,head_tok:int,head_line:int,head_roles:int,head_prev_roles:int>",
    "word": "struct<next:string,next_kind:string,next_off:int,prev_end:int,behind:boolean,body_tok:int,body_close:int,body_line:int,stop_tok:int>",
    "first": "struct<prev:string,prev_tok:int,prev_line:int>",
}
_CODE = "tok_no int, kind string, mask string, roles int, parts array<string>, off int, byte_off int, byte_end int, line_no int, col_no int, paren_depth int, brace_depth int, " + ", ".join(f"{k} {v}" for k, v in _NEAR.items())
#: Kinds of sources, as they are written; the last is that of a call without an end.
_SOURCES = ("call", "member", "identifier", "open")
_SIGNS_BEFORE = tuple("+-*/%&|^<>!~?:=")


def _near(batch: pa.RecordBatch, begins: np.ndarray) -> list[pa.Array]:
    """_NEAR of code tokens: neighbours; unit_no, which counts the statements of one bracket level; called (1: the name of a call
    with brackets, 2: of one without, else 0) and that call; source, what makes a name one; assign, at the sign of an assignment,
    its value and what names stand before it; and what the order of the level or the pairs of brackets give. Braces of literals end nothing
    around them; a bracket's end closes the statement in it; a line does not end it where more must follow. Where words make blocks,
    these and words behind a statement end it too. A line break stands at the level of the code token after it, so that
    code tokens tell all statements apart."""
    n = batch.num_rows
    i, start = np.arange(n), _starts(begins, n)
    end = np.append(begins[1:], n)[np.searchsorted(begins, start)]
    beside = {k: np.where((i + k >= start) & (i + k < end), i + k, -1) for k in (-2, -1, 1, 2)}
    number = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tok_no", "off", "line_no", "paren_depth", "brace_depth", "breaks", "roles")}
    mask, kind, blocks = (_Words(batch.column(c)) for c in ("mask", "kind", "blocks"))
    tok, line = number["tok_no"], number["line_no"]
    # Whether a token (k: one that many tokens on) is one of some words, or has a role; what is not there is none.
    said = lambda k, *words: _at(mask.among(*words), beside[k], False)
    role = lambda word: (number["roles"] & ROLES[word]) != 0
    is_name, prev = kind.among("name"), beside[-1]
    prev_tok, prev_line = _at(tok, prev, -1), _at(line, prev, -1)
    braces, indent, words = (blocks.among(b) for b in ("braces", "indent", "words"))
    deep = (number["paren_depth"] != 0) | (number["brace_depth"] != 0)
    opens = mask.among("(", "[", "{")

    mark = _before(_latest(mask.among("case", "default", ";", "{", "}", "?"), start), start)
    literal = indent | said(-1, *BEFORE_LITERALS) | (said(-1, ":") & ~_at(mask.among("case", "default"), mark, False))
    ends_value = (is_name & (~role("keyword") | role("value"))) | kind.among("number", "string") | mask.among(")", "]", "}")
    behind = (prev_line == line) & _at(ends_value, prev, False)
    word_ends = words & is_name & ~said(-1, ".") & (role("end") | (role("modifier") & behind))
    starts_line = (prev >= 0) & (number["breaks"] > _at(number["breaks"], prev, 0)) & ~said(-1, *GOES_ON)
    ends = mask.among(";", "}", ")", "]") | (mask.among("{") & ~literal) | word_ends

    closed = said(-1, ")", "]")
    same = braces | (prev_line == line) | (indent & ((number["paren_depth"] > 0) | (number["brace_depth"] > 0)))
    called = mask.among("(", "[") & same & (_at(is_name & ~role("keyword"), prev, False) | closed)
    arrow = (mask.among("-") & said(1, ">") & closed) | (mask.among(">") & said(-1, "-") & said(-2, ")", "]")) | (is_name & said(-1, ">") & said(-2, "-"))
    goes_on = mask.among(".") | (is_name & said(-1, ".", "new")) | called | arrow

    # Levels in turn, each in order; places in that order lead back to rows.
    own = np.lexsort((i, number["brace_depth"], number["paren_depth"], start))
    changes = np.zeros(n, bool)
    for c in (start, number["paren_depth"], number["brace_depth"]):
        changes[1:] |= np.diff(c[own]) != 0
    changes[:1] = True
    level = _starts(np.flatnonzero(changes), n)
    back = np.empty(n, np.int64)
    back[own] = i
    rows_of = lambda places: np.where(places >= 0, own[places], -1)[back]
    unit_no = _ahead(ends[own].astype(np.int64), level) + _ahead(starts_line[own].astype(np.int64), level) + starts_line[own]
    outer = np.where(deep, rows_of(_latest(said(-1, "(", "[", "{")[own], level)), -1)
    chain = rows_of(_latest(~goes_on[own], level))
    follows = np.append(own[1:], 0)
    broken_at = np.where(np.append(level[1:] == level[:-1], False) & starts_line[follows], prev_tok[follows], -1)[back]
    around = mask.among(")", "}") & deep
    own_end = np.where(ends, np.where(~word_ends & ~around, tok, prev_tok), broken_at)
    own_last = np.where(ends, prev_tok, broken_at)
    size = mask.of(pc.utf8_length(mask.own)).astype(np.int64)
    off = number["off"]
    prev_end, next_off = _at(off + size, prev, -1), _at(off, beside[1], -1)
    # Neither the second half of another sign nor the first of an arrow.
    sign = mask.among("=", ":=") & ~((prev_end == off) & said(-1, *_SIGNS_BEFORE)) & ~((next_off == off + 1) & said(1, ">"))
    units = np.flatnonzero(changes | np.append(True, np.diff(unit_no) != 0)) if n else np.zeros(0, int)
    file_end = tok[end - 1]
    most = lambda x: np.repeat(np.maximum.reduceat(x[own], units), np.diff(np.append(units, n)))[back]
    unit_end, unit_last, assigns = most(own_end), most(own_last), most(sign.astype(np.int64)) > 0

    # Brackets of one kind at one depth pair up in their order.
    paren = mask.among("(", "[", ")", "]")
    which = np.flatnonzero(paren | mask.among("{", "}"))
    pair = np.where(paren, number["paren_depth"], number["brace_depth"])[which] + opens[which]
    order = np.lexsort((which, pair, paren[which], start[which]))
    which, pair = which[order], pair[order]
    alike = (np.diff(pair) == 0) & (np.diff(paren[which].astype(int)) == 0) & (np.diff(start[which]) == 0)
    closing, opening = np.full(n, -1), np.full(n, -1)
    closing[which[:-1][alike]] = which[1:][alike]
    opening[which[1:][alike]] = which[:-1][alike]
    closing, opening = np.where(opens, closing, -1), np.where(paren & ~opens, opening, -1)
    close_tok, close_prev_tok, close_line = (_at(x, closing, -1) for x in (tok, prev_tok, line))

    # The next block and the next end of a statement behind a token, at its depth in braces.
    order = np.lexsort((-i, number["brace_depth"], start))
    depths = np.zeros(n, bool)
    depths[:1], depths[1:] = True, (np.diff(number["brace_depth"][order]) != 0) | (np.diff(start[order]) != 0)
    depths = _starts(np.flatnonzero(depths), n)

    def next_of(word: str) -> np.ndarray:
        places, out = _before(_latest(mask.among(word)[order], depths), depths), np.empty(n, np.int64)
        out[order] = np.where(places >= 0, order[places], -1)
        return out

    body, stop = next_of("{"), next_of(";")
    body_close, stop_tok = _at(close_tok, body, -1), _at(tok, stop, -1)
    # Where functions of languages with braces begin: at a word, or at a name before brackets and a block.
    heads = braces & is_name & role("function") & (body_close >= 0) & ((stop < 0) | (body < stop))
    head = np.where(prev >= 0, opening[prev], -1)
    named = _at(_at(is_name & ~role("keyword"), prev, False) & ~_at(role("function"), beside[-2], False), head, False)
    heads[prev[head[braces & mask.among("{") & said(-1, ")") & named & (closing >= 0)]]] = True

    after_next = lambda values: _at(values, beside[1], -1)
    # Calls: names before brackets, or, where these may be left out, before blanks and an operand in their line.
    unit_end, unit_last = np.where(unit_end >= 0, unit_end, file_end), np.where(unit_last >= 0, unit_last, file_end)
    named = is_name & ~role("keyword") & ~_at(role("function"), prev, False)
    next_line = _at(line, beside[1], -1)
    bracketed = named & said(1, "(") & (braces | (line == next_line) | (indent & ((number["paren_depth"] > 0) | (number["brace_depth"] > 0)))) & ~heads
    word = is_name & (~role("keyword") | (role("value") & ~role("closer")))
    operand = _at(word | kind.among("number", "string") | mask.among("[", "@", "$"), beside[1], False) | (said(1, ":") & (_at(off, beside[2], -1) == next_off + 1))
    may = np.asarray(batch.column("bare").fill_null(False))
    bare = named & ~bracketed & may & (line == next_line) & (next_off > off + size) & operand & (_at(tok, beside[1], np.iinfo(np.int32).max) <= unit_last)

    # What makes names sources.
    plain_name = is_name & ~role("keyword")
    as_call, as_name = (mask.of(pa.array(x, pa.int64())) for x in zip(*map(_sourced, mask.own.to_pylist())))
    call_close = np.where(bracketed, after_next(close_tok), unit_last)
    source = np.where(bracketed | bare, np.where(call_close >= 0, as_call, np.where((as_name < 0) & (as_call >= 0), len(_SOURCES) - 1, as_name)), as_name)
    source = pa.array(_SOURCES).take(pa.array(np.where(plain_name, source, -1), pa.int64(), mask=~plain_name | (source < 0)))

    # Which tokens the facts ask for what.
    called = bracketed | bare
    block, comma = mask.among("{"), mask.among(",")
    worded = words & is_name & (role("opener") | role("closer"))
    first_in_line = indent & (prev_line != line)
    assigned, assign = _assigned(batch, number, mask, sign, assigns, unit_end, unit_no, own, outer, prev, beside[1], start, plain_name, braces)
    near = lambda c, k, where: _taken(batch.column(c), np.where(where, beside[k], -1))
    around = np.where(comma & (outer >= 0), prev[np.maximum(outer, 0)], -1)
    head = np.where(block, head, -1)
    heads = {-1: np.where(head >= 0, prev[np.maximum(head, 0)], -1), -2: np.where(head >= 0, beside[-2][np.maximum(head, 0)], -1)}
    told = worded | role("function")
    heading = braces & is_name & role("function")
    only = lambda where, values: _ints(np.where(where, values, -1), True)
    some = lambda name, where, columns: _some(where, dict(zip(_fields(name), columns)))
    return [
        near("mask", -1, block | worded), near("tok_no", 1, comma | bracketed), pa.array(unit_no[back], pa.int64(), mask=~(worded | (may & (bare | comma)))), _ints(np.where(bracketed, 1, np.where(bare, 2, 0))), source,
        some("call", called, [only(called, x) for x in (call_close, _at(tok, chain, -1), np.where(bracketed, _at(tok, beside[2], -1), after_next(tok)), np.where(bracketed, after_next(close_prev_tok), unit_last))]),
        some("assign", assigned, assign),
        some("comma", comma, [only(comma, prev_tok), only(comma, _at(tok, around, -1))]),
        some("block", block, [near("mask", -2, block), *[only(block, x) for x in (prev_tok, prev_line, close_tok, close_line)], *[_taken(batch.column(c), heads[-1]) for c in ("mask", "kind", "tok_no", "line_no", "roles")], _taken(batch.column("roles"), heads[-2])]),
        some("word", told, [near("mask", 1, told), near("kind", 1, told), near("off", 1, worded), only(worded, prev_end), pa.array(behind, mask=~worded), *[only(heading, x) for x in (_at(tok, body, -1), body_close, _at(close_line, body, -1), stop_tok)]]),
        some("first", first_in_line, [near("mask", -1, first_in_line), only(first_in_line, prev_tok), only(first_in_line, prev_line)]),
    ]


def _fields(name: str) -> list[str]:
    """Names of a struct's fields."""
    return [c.split(":")[0] for c in _NEAR[name].removeprefix("struct<").split(",")]


def _some(where: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    """A struct for the rows where something holds, null for the others."""
    return pa.StructArray.from_arrays([_plain(c) for c in columns.values()], list(columns), mask=pa.array(~where))


@lru_cache(1 << 16)
def _sourced(mask: str) -> tuple[int, int]:
    """Places in _SOURCES of what a name is as a call, and else; -1 for no source."""
    parts = [p for p in mask.split(".") if p] if mask[:1].isalpha() or mask[:1] == "_" else []
    return tuple(_SOURCES.index(x) if (x := source_kind(parts, is_call)) else -1 for is_call in (True, False))


def _assigned(batch, number, mask, sign, assigns, unit_end, unit_no, own, outer, prev, following, start, plain_name, braces) -> tuple[np.ndarray, list[pa.Array]]:
    """Which tokens are signs of assignments to names, and for these the value and the names before it (see _NEAR).
    own: rows by level, unit_no: in that order. A statement stands in a file or a block, wherever that is, or in the brackets of a word
    like for or while. A sign's targets begin after the sign, the comma of a further declaration or the block's colon before it, and end
    at a type's colon. A value ends with its statement, or before the comma of the next declaration."""
    n, tok = batch.num_rows, number["tok_no"]
    bracket = np.where(outer >= 0, prev[np.maximum(outer, 0)], -1)
    of_word = np.where(bracket >= 0, prev[np.maximum(bracket, 0)], -1)
    in_brackets = braces & _at(mask.among("("), bracket, False) & ((_at(number["roles"], of_word, 0) & ROLES["bracket"]) != 0)
    # Only what stands at the statement's own bracket level parts it.
    kept = assigns & ((bracket < 0) | _at(mask.among("{"), bracket, False) | in_brackets)
    places = np.flatnonzero(kept[own])
    at, unit = own[places], unit_no[places]
    size = len(at)
    begins = np.ones(size, bool)
    if size:
        begins[1:] = np.logical_or.reduce([np.diff(x) != 0 for x in (start[at], number["paren_depth"][at], number["brace_depth"][at], unit)])
    begin = _starts(np.flatnonzero(begins), size)
    here = np.arange(size)
    next_of = lambda where: np.minimum.accumulate(np.where(where, here, size)[::-1])[::-1]
    signs, is_colon, is_comma = sign[at], mask.among(":")[at], mask.among(",")[at]
    head, indented = at[begin], ~braces[at]
    parted = (indented & ((number["roles"][head] & ROLES["head"]) != 0)) | mask.among("case", "default")[head]
    last = np.append(begin[1:] != begin[:-1], True) if size else begins
    end = next_of(last)
    colon = next_of(is_colon)[begin]
    colon = np.where(parted & (colon <= end), colon, -1)
    at_colon = colon == here
    parts = signs | at_colon | (is_comma & ~indented & (_ahead(signs.astype(np.int64), begin) > 0))
    opened = _before(_latest(parts, begin), begin)
    left = np.where(opened >= 0, opened + 1, begin)
    typed = next_of(is_colon & ~at_colon)[left] if size else here
    left_end = np.where(typed < here, at[np.minimum(typed, max(size - 1, 0))], at)
    prev_tok = _at(tok, prev[at], -1)
    before_comma = np.where((opened >= 0) & is_comma[opened], prev_tok[opened], -1) if size else here
    further = next_of(signs & (before_comma >= 0))
    further = np.append(further[1:], size)
    most = np.iinfo(np.int64).max
    next_comma = np.where(further <= end, before_comma[np.minimum(further, max(size - 1, 0))], most) if size else here
    by_colon = np.where(colon > here, _at(prev_tok, colon, most), most)
    value_end = np.minimum(np.minimum(unit_end[at], next_comma), by_colon)
    value_start = _at(tok, following[at], most)

    names = np.flatnonzero(plain_name)
    low, high = np.searchsorted(names, at[left]), np.searchsorted(names, left_end)
    good = signs & (value_start <= value_end) & (high > low)
    rows = at[good]
    order = np.argsort(rows)
    rows, low, high = rows[order], low[good][order], high[good][order]
    assigned = np.zeros(n, bool)
    assigned[rows] = True
    count = np.zeros(n, np.int64)
    count[rows] = high - low
    first = np.full(n, -1)
    first[rows] = names[low]
    spread = lambda values: _ints(_filled(n, rows, values[good][order]), True)
    held = np.repeat(low, high - low) + np.arange(int(count.sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    targets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), batch.column("parts").take(pa.array(names[held])))
    return assigned, [spread(value_start), spread(value_end), *[_taken(batch.column(c), first) for c in ("tok_no", "line_no", "col_no", "off")], targets]


def _filled(size: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(size, -1)
    out[rows] = values
    return out


def code_of(files: DataFrame, keys: tuple[str, ...] = KEYS, languages: Languages = BUILT_IN, parts: int | None = None) -> DataFrame:
    """Tokens of files (as for ``tokens``) without white space, comments and bodies of heredocs, with what the facts need:
    roles (of words), parts (of names) and _NEAR: calls with where the chain of members, calls and subscripts begins that they
    continue (start_tok), assignments at their signs, commas with the opening bracket around them (outer_tok), blocks with what stands
    before them and before the brackets at their head, words with what is beside them, whether they follow an expression on their
    line (behind) and where functions of languages with braces have their bodies, and first tokens of lines of indented languages."""
    return _rows(files, keys, languages, parts, _near_in, _CODE)


#: Kinds of code tokens.
_KINDS = ("name", "number", "string", "op")
_NUMBERED = "path string, language int, " + _CODE.replace("kind string", "kind int").replace("source string", "source int")


def numbered_code(files: DataFrame, languages: Languages = BUILT_IN, parts: int | None = None) -> DataFrame:
    """``code_of`` as it is written: with numbers for languages, kinds and sources, and without what a language alone tells, so that
    no row carries these words. ``named_code`` gives them back."""
    schema = StructType.fromDDL(_NUMBERED)
    words = {"language": languages.names, "kind": _KINDS, "source": _SOURCES}

    def numbered(batch: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.RecordBatch, list[pa.Array]]:
        own, near = _near_in(batch, begins)
        found = dict(zip((*own.schema.names, *_NEAR), (*own.columns, *near)))
        return own, [_number(found[n], words[n]) if n in words else found[n] for n in schema.names]

    return _rows(files, KEYS, languages, parts, numbered, schema)


def _number(column: pa.Array, words: tuple[str, ...]) -> pa.Array:
    found = column if pa.types.is_dictionary(column.type) else column.dictionary_encode()
    return pc.index_in(found.dictionary, pa.array(words, pa.string())).take(found.indices)


def named_code(rows: DataFrame, languages: Languages = BUILT_IN) -> DataFrame:
    """The rows of ``code_of`` from those of ``numbered_code``."""
    # Not element_at: it takes a null place in a constant array for one that is there.
    of = lambda c, words: F.get(F.array(*[F.lit(w) for w in words]), F.col(c))
    told = {"kind": of("kind", _KINDS), "source": of("source", _SOURCES)}
    own = [of("language", x).alias(n) for n, x in (("language", languages.names), ("blocks", [languages.blocks.get(k, "braces") for k in languages.names]), ("bare", [k in languages.bare for k in languages.names]))]
    return rows.select("path", *own, *[told[c].alias(c) if c in told else c for c in rows.columns[2:]])


def code_tokens(rows: DataFrame, keys: tuple[str, ...] = KEYS, languages: Languages = BUILT_IN) -> DataFrame:
    """The same from ``tokens``: those of a file together and in order."""
    # A row for each word of each language: small by nature.
    code = rows.where(~F.col("kind").isin(*TRIVIA)).drop("text").join(F.broadcast(languages.words(rows.sparkSession)), ["language", "mask"], "left").withColumn("roles", F.coalesce("roles", F.lit(0)))
    code = code.withColumn("parts", F.when(F.col("kind") == "name", chain_parts(F.col("mask")))).select(*keys, "blocks", "bare", *[f.name for f in StructType.fromDDL(_CODE).fields if f.name in (*_WORDS, "tok_no")], *_PLACED)
    schema = StructType([*[code.schema[k] for k in (*keys, "blocks", "bare")], *StructType.fromDDL(_CODE).fields])
    return code.mapInArrow(lambda batches: _given(((b, _near(b, begins)) for b, begins in _whole_files(batches, keys)), schema.names), schema)
