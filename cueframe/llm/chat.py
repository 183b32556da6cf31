"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is known by the hash of its nested field paths.  The hash selects a declarative mapping
that turns prompt, instruction and message layouts into canonical turns ``(role, text)``; typed tables
are mapped when the plan is built, JSON rows one by one.  A row with a known layout's fields and further ones has that layout, of several the
one with most fields, then the first declared; an empty list of turns gives no turns.

Defined cases: null texts and roles are empty; rows of one conversation are ordered by
``(turn, role, text)``, nulls first, so ties and repeated rows have one result; a JSON row of an unknown
layout (or that is no JSON) keeps its row with null ``turns``; an empty table gives an empty table; further columns of the
input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_OPEN, TURN_END = "<|im|>", "<|end|>\n"
#: (character, its code) after which no control string can be left; the escape sign comes first when escaping, last when undoing it.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))
TURNS = "array<struct<role:string,text:string>>"


def path_form(kind: T.DataType) -> str:
    """Nested field paths of a type in one canonical string, without value types."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, path_form(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return "OBJECT<" + ", ".join(f"{name}: {form}" if form else name for name, form in inner) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{path_form(kind.elementType)}>"
    return ""


def fingerprint(kind: T.DataType) -> str:
    return hashlib.sha256(path_form(kind).encode()).hexdigest()


def json_fingerprint(payload: Column) -> Column:
    """The same hash, taken from each row's own JSON."""
    form = F.schema_of_variant(F.try_parse_json(payload))
    form = F.regexp_replace(form, r":? ?(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)", "")
    return F.sha2(form, 256)


@dataclass(frozen=True)
class Layout:
    """One declared layout: its schema, and how its fields become turns (SQL over the fields)."""

    name: str
    schema: str
    turns: str

    @property
    def key(self) -> str:
        return fingerprint(T._parse_datatype_string(self.schema))


def _pair(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _listed(field: str, role: str, text: str) -> str:
    speaker = f"CASE m.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.{role} END"
    return f"transform({field}, m -> named_struct('role', {speaker}, 'text', m.{text}))"


LAYOUTS = (
    Layout("turn", "role string, text string", "array(named_struct('role', role, 'text', text))"),
    Layout("messages", "messages array<struct<role:string,content:string>>", _listed("messages", "role", "content")),
    Layout("conversations", "conversations array<struct<`from`:string,value:string>>", _listed("conversations", "`from`", "value")),
    Layout("dialog", "dialog array<struct<speaker:string,text:string>>", _listed("dialog", "speaker", "text")),
    Layout("prompt_completion", "prompt string, completion string", f"array({_pair('user', 'prompt')}, {_pair('assistant', 'completion')})"),
    Layout("prompt_response", "prompt string, response string", f"array({_pair('user', 'prompt')}, {_pair('assistant', 'response')})"),
    Layout("system_prompt_response", "system string, prompt string, response string", f"array({_pair('system', 'system')}, {_pair('user', 'prompt')}, {_pair('assistant', 'response')})"),
    Layout("question_answer", "question string, answer string", f"array({_pair('user', 'question')}, {_pair('assistant', 'answer')})"),
    Layout("instruction_output", "instruction string, output string", f"array({_pair('user', 'instruction')}, {_pair('assistant', 'output')})"),
    Layout(
        "instruction_input_output",
        "instruction string, input string, output string",
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', instruction, nullif(input, ''))), " + _pair("assistant", "output") + ")",
    ),
)


def _leaf(value: str) -> str:
    """SQL: whether the variant is there and a plain value."""
    return f"(schema_of_variant({value}) NOT LIKE 'OBJECT<%' AND schema_of_variant({value}) NOT LIKE 'ARRAY<%' AND schema_of_variant({value}) <> 'VARIANT')"


def _wider(layout: Layout, empty: bool = False) -> Column:
    """Whether the variant ``v`` has all fields of the layout, whatever others; with ``empty``, its list without elements."""
    tests = []
    for field in T._parse_datatype_string(layout.schema).fields:
        if not isinstance(field.dataType, T.ArrayType):
            tests.append("false" if empty else f"coalesce({_leaf(f"variant_get(v, '$.{field.name}', 'variant')")}, false)")
            continue
        items = f"try_variant_get(v, '$.{field.name}', 'array<variant>')"
        if empty:
            tests.append(f"coalesce(size({items}) = 0, false)")
            continue
        tests.append(f"coalesce(forall({items}, m -> schema_of_variant(m) LIKE 'OBJECT<%' OR schema_of_variant(m) = 'VOID'), false)")
        for inner in field.dataType.elementType.fields:
            value = f"try_variant_get(m, '$.{inner.name}', 'variant')"
            tests.append(f"coalesce(exists({items}, m -> coalesce({_leaf(value)}, false)) AND forall({items}, m -> coalesce({_leaf(value)}, true)), false)")
    return F.expr(" AND ".join(tests))


def _size(layout: Layout) -> int:
    fields = T._parse_datatype_string(layout.schema).fields
    return sum(len(f.dataType.elementType.fields) if isinstance(f.dataType, T.ArrayType) else 1 for f in fields)


def turns_from_json(df: DataFrame, id_col: str, payload_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per input row: id, ``layout`` (null if unknown) and canonical ``turns``."""
    df = df.select(F.col(id_col).alias("conv_id"), F.col(payload_col).cast("string").alias("payload"))
    df = df.withColumn("key", json_fingerprint("payload")).withColumn("v", F.try_parse_json("payload"))
    exact, wide, empty, turns = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        exact = F.coalesce(exact, F.when(F.col("key") == layout.key, layout.name))
        empty = F.coalesce(empty, F.when(_wider(layout, empty=True), layout.name))
    for layout in sorted(layouts, key=_size, reverse=True):
        wide = F.coalesce(wide, F.when(_wider(layout), layout.name))
    df = df.withColumn("layout", F.coalesce(exact, wide, empty))
    for layout in layouts:
        parsed = F.from_json("payload", T._parse_datatype_string(layout.schema))
        fields = [f.name for f in T._parse_datatype_string(layout.schema).fields]
        for field in fields:
            df = df.withColumn(f"{layout.name}__{field}", parsed[field])
        turns = F.when(F.col("layout") == layout.name, _turns(layout, {field: f"`{layout.name}__{field}`" for field in fields})).otherwise(turns)
    return df.select("conv_id", "key", "layout", turns.alias("turns"))


def _turns(layout: Layout, columns: dict[str, str]) -> Column:
    """The layout's turns, its fields read from these columns."""
    body = layout.turns
    for field, column in columns.items():
        body = _qualified(body, field, column)
    return F.expr(body).cast(TURNS)


def _qualified(body: str, field: str, column: str) -> str:
    import re

    return re.sub(rf"(?<![\w.'`]){re.escape(field)}(?![\w'`(])", column, body)


def turn_rows(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` from a table of ``conv_id``, ``turn`` if each row is a turn, and the fields of a declared layout, or from one list ``turns``."""
    if "turns" in df.columns:
        rows = df.select("conv_id", F.posexplode("turns").alias("turn", "t"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    kind = T.StructType([f for f in df.schema if f.name not in ("conv_id", "turn")])
    layout = next((layout for layout in layouts if layout.key == fingerprint(kind)), None)
    if layout is None:
        raise ValueError("no mapping for this layout")
    turns = _turns(layout, {c: f"`{c}`" for c in kind.names})
    if "turn" not in df.columns:
        return turn_rows(df.select("conv_id", turns.alias("turns")))
    return df.select("conv_id", "turn", F.inline(turns))


def escaped(text: Column, header: bool = False) -> Column:
    for plain, code in ESCAPES if header else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, header: bool = False) -> Column:
    for plain, code in reversed(ESCAPES if header else ESCAPES[:-1]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one text per conversation and, for each assistant turn in order, the span ``(start, length)``
    of its text in ``formatted`` (code points, from 0)."""
    body = escaped(F.coalesce("text", F.lit("")))
    rows = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(TURN_OPEN), escaped(F.coalesce("role", F.lit("")), header=True), F.lit("\n")).alias("head"),
        body.alias("body"),
    )
    piece = F.concat("head", "body", F.lit(TURN_END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("past", F.sum(F.length(piece)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("past") - F.length("body") - len(TURN_END)).alias("start"), F.length("body").cast("long").alias("length"))
    rows = rows.select("conv_id", F.struct("at", piece.alias("piece"), F.when(F.col("role") == "assistant", span).alias("span")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Turns read back from ``format_chat``'s output alone: ``conv_id, at, role, text, loss`` (the unescaped text under the mask)."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    rows = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        F.map_from_entries("loss_spans").alias("mask"),
        F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("at", "piece"),
    )
    order = Window.partitionBy("conv_id").orderBy("at")
    past = F.sum(F.length("piece") + len(TURN_END)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", F.substring_index("piece", "\n", 1)).withColumn("first", past - F.length("piece") - len(TURN_END))
    start = F.length("head") + 1
    text = F.substring(F.col("piece"), start + 1, F.length("piece"))
    covered = F.col("mask")[F.col("first") + start]
    return rows.select(
        "conv_id", "at", "formatted_chars",
        unescaped(F.substring(F.col("head"), F.lit(len(TURN_OPEN) + 1), F.length("head")), header=True).alias("role"),
        unescaped(text).alias("text"),
        unescaped(F.when(covered.isNotNull(), F.substring(F.col("piece"), start + 1, covered.cast("int"))).otherwise("")).alias("loss"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    rows = read_chat(formatted).groupBy("conv_id", "formatted_chars").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "loss"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.withColumn("loss_text", F.array_join(F.transform("t", lambda x: x["loss"]), ""))
    return rows.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation whose texts hold control strings, added to the table by contract.
CONTROL_TURNS = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    values = ", ".join(f"({c}L, {t}L, '{role}', '{text}')" for c, t, role, text in CONTROL_TURNS)
    added = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    return digests(format_chat(turn_rows(turns.unionByName(added))))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(replace(coalesce(text, ''), '\\', '\\e'), '<', '\\l'), '[', '\\b') AS body,
         replace(replace(replace(replace(coalesce(role, ''), '\\', '\\e'), '<', '\\l'), '[', '\\b'), chr(10), '\\n') AS head
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(a, b, c, d))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(15 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
