"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a VARIANT of any layout. Its fingerprint is a hash of its nested field
paths, types and ignorable fields (ids, names, origins) left out. A table of mappings,
declared as data, says for each known fingerprint where the turns are; records are routed
by comparing fingerprints. One with an unknown fingerprint has null turns, layout and
text, and ``unknown_layouts`` reports how many there are of each.

Template: ``<|turn|>role`` newline, text, ``<|end|>`` newline. A text that holds a
control string gets one backslash more after the string's first character; reading
back takes one away, so every text comes back as it was.

Cases: null texts and roles are empty; an empty list of turns is a known layout and gives
no turns and an empty text; a null record is of an unknown layout; turns that tie are ordered by role and text;
repeated rows are turns of their own; a conversation without rows does not exist;
an empty table leaves conversation -1 alone; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>"
#: Control strings of this and other templates: an opening character, backslashes put there by escaping, the rest.
#: Single character classes only, so that no text makes the regex engine recurse.
CONTROL = r"([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|[^|<>\n]*\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?INST\]|/?s>|/?SYS>>|\|[^|<>\n]*\|>)"
TURN = "array<struct<role:string,text:string>>"
#: Fields that say nothing about a record's layout, wherever they stand in it, if they are scalars.
IGNORABLE = ("id", "conv_id", "conversation_id", "name", "source", "origin", "lang", "language", "timestamp", "created", "model", "category", "weight")
_SCALAR = r"(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|DECIMAL\([0-9,]*\))"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. ``example`` is a type in DDL; ``turns`` a path to a list with ``role`` and
    ``text`` fields in it, or ``single`` pairs of (role, path) for layouts with one field a turn; an empty optional
    field gives no turn. ``roles`` renames roles."""

    name: str
    example: str
    turns: str = ""
    role: str = ""
    text: str = ""
    single: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Layouts in public use.
MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>", "$.messages", "role", "content"),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: STRING, value: STRING>>>", "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("dialogue", "OBJECT<turns: ARRAY<OBJECT<speaker: STRING, text: STRING>>>", "$.turns", "speaker", "text"),
    Mapping("prompt_completion", "OBJECT<completion: STRING, prompt: STRING>", single=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", "OBJECT<prompt: STRING, response: STRING>", single=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("system_prompt_response", "OBJECT<prompt: STRING, response: STRING, system: STRING>", single=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("instruction_output", "OBJECT<instruction: STRING, output: STRING>", single=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input_output", "OBJECT<input: STRING, instruction: STRING, output: STRING>", single=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
)


def _paths(schema: Column) -> Column:
    """A schema text without its scalar types and ignorable fields: the nested names of the others alone."""
    kept = F.regexp_replace(schema, rf"\b(?:{'|'.join(IGNORABLE)}): {_SCALAR}(?:, |(?=>))", "")
    return F.regexp_replace(F.regexp_replace(kept, ", >", ">"), f": {_SCALAR}", "")


def fingerprint(record: Column) -> Column:
    """sha2 of the nested field paths of a VARIANT record."""
    return F.sha2(_paths(F.schema_of_variant(record)), 256)


def _known(mark: Column, m: Mapping) -> Column:
    """Whether a fingerprint is that of a mapping's layout, or of the same one with an empty list."""
    examples = [m.example] + ([re.sub(r"ARRAY<OBJECT<[^<>]*>>", "ARRAY<VOID>", m.example)] if m.turns else [])
    return mark.isin(*[F.sha2(_paths(F.lit(e)), 256) for e in examples])


def layout(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The name of the mapping of a record's fingerprint; null for an unknown layout."""
    mark = fingerprint(record)
    return F.coalesce(*[F.when(_known(mark, m), F.lit(m.name)) for m in mappings])


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """array<struct<role,text>> of a record by the mapping of its fingerprint; null for an unknown layout."""
    mark, out = fingerprint(record), None
    for m in mappings:
        out = F.when(_known(mark, m), _turns(record, m)) if out is None else out.when(_known(mark, m), _turns(record, m))
    return out


def _turns(record: Column, m: Mapping) -> Column:
    if not m.turns:
        each = [F.struct(F.lit(r).alias("role"), F.coalesce(F.variant_get(record, p, "string"), F.lit("")).alias("text")) for r, p in m.single]
        return F.filter(F.array(*each), lambda t: (t["role"] == "assistant") | (F.length(t["text"]) > 0))
    listed = F.variant_get(record, m.turns, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
    field = lambda t, name: F.coalesce(t[name], F.lit(""))
    return F.transform(listed, lambda t: F.struct(_renamed(field(t, m.role), m.roles).alias("role"), field(t, m.text).alias("text")))


def _renamed(role: Column, roles) -> Column:
    for old, new in roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def formatted(turns: Column) -> Column:
    """The training text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """array<struct<start,length>>: code points of the training text that are learned, one span for each assistant turn."""
    head, tail = len(START) + 1, len(END) + 1
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("learned"), (F.length(escaped(t["role"])) + head).alias("before"), F.length(escaped(t["text"])).alias("length")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s, t):
        span = F.array(F.struct((s["at"] + t["before"]).alias("start"), t["length"].alias("length")))
        return F.struct((s["at"] + t["before"] + t["length"] + tail).alias("at"), F.when(t["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(sizes, zero, step, lambda s: s["spans"])


def format_chats(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout, turns, formatted and loss_spans to rows with a VARIANT record."""
    with_turns = records.select("*", fingerprint(F.col(record_col)).alias("fingerprint"), layout(F.col(record_col), mappings).alias("layout"), canonical_turns(F.col(record_col), mappings).alias("turns"))
    return with_turns.select("*", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def unknown_layouts(done: DataFrame, record_col: str = "record") -> DataFrame:
    """fingerprint, records, example (a schema): the layouts of formatted rows that no mapping knows. To take one in,
    declare a mapping with its example."""
    return done.where("layout IS NULL").groupBy("fingerprint").agg(F.count("*").alias("records"), F.min(F.schema_of_variant(record_col)).alias("example"))


def read_back(text: Column) -> Column:
    """array<struct<role,text>> of a training text."""
    blocks = F.filter(F.split(text, r"<\|turn\|>"), lambda b: F.length(b) > 0)
    cut = lambda b: F.instr(b, "\n")
    return F.transform(blocks, lambda b: F.struct(unescaped(F.substring(b, F.lit(1), cut(b) - 1)).alias("role"), unescaped(F.substring(b, cut(b) + 1, F.length(b) - cut(b) - len(END) - 1)).alias("text")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the turns of each conversation as one record; layouts alternate with the id, as they would
    in a collection from several places. Rows of a conversation are few: each is one training text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    as_list = lambda role, text: F.transform("t", lambda t: F.struct(t["text"].alias(text), t["role"].alias(role)))
    messages = F.to_variant_object(F.struct(as_list("role", "content").alias("messages")))
    spoken = F.to_variant_object(F.struct(as_list("from", "value").alias("conversations")))
    dialogue = F.to_variant_object(F.struct(as_list("speaker", "text").alias("turns")))
    # A role that the from/value layout would rename keeps to another layout.
    plain = ~F.exists("t", lambda t: t["role"].isin("human", "gpt"))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    return listed.select("conv_id", F.when((kind == 1) & plain, spoken).when(kind == 2, dialogue).otherwise(messages).alias("record"))


def op7_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    marked = marked.select("conv_id", F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_chats(conversation_records(rows.unionByName(marked)))
    back = done.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH rows_all AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|[^|<>\n]*\|>)', '\1\2\\\3', 'g') AS e,
         regexp_replace(role, '([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|[^|<>\n]*\|>)', '\1\2\\\3', 'g') AS er FROM rows_all
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(e) + 17) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
