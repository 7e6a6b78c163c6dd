"""Chat records of any known layout as one training text each, in DataFrame operations only.

A layout is known by its nested field paths. Their fingerprint, that of a frame's schema or of a JSON
record, selects a declarative mapping to canonical turns: role and text, in order. A record's
fingerprint also says which of its paths hold a value, and selects the layout that needs most of what
is filled. Fields that no layout uses don't count, so further columns and keys of any name do no harm.

The template marks where a turn starts, where its text starts and where it ends. Inside roles and
texts a backslash is doubled and put after the first character of every control string, those of
other templates too, so no text can pass for a mark and the original can be read back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What follows "<" or "[" in a control string, of this template or of others.
CONTROL_REST = r"(?=\||/?s>|/?<SYS>>|/SYS>>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """``paths`` identify it; ``turns`` is SQL for array<struct<role,text>> over the probed fields.

    ``at`` is the path of a turn's own place where a row is one turn, not a conversation.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    at: str = ""


def _turns(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"named_struct('role', {r}, 'text', coalesce({t}, ''))" for r, t in pairs)
    return f"array({inner})"


def _each(field: str, role: str, text: str) -> str:
    return f"transform({field}, x -> named_struct('role', x.{role}, 'text', coalesce(x.{text}, '')))"



#: The type of every probed field; names with [] are arrays of structs.
FIELDS = {
    "messages": "array<struct<role:string,content:variant>>",
    "conversations": "array<struct<`from`:string,value:variant>>",
    "system": "string",
    "prompt": "string",
    "completion": "string",
    "response": "string",
    "instruction": "string",
    "input": "string",
    "output": "string",
}
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _each("messages", "role", "content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), _each("conversations", "`from`", "value")),
    Layout("prompt", ("completion", "prompt"), _turns(("'user'", "prompt"), ("'assistant'", "completion"))),
    Layout("response", ("prompt", "response"), _turns(("'user'", "prompt"), ("'assistant'", "response"))),
    Layout("system_prompt", ("completion", "prompt", "system"), _turns(("'system'", "system"), ("'user'", "prompt"), ("'assistant'", "completion"))),
    Layout("instruction", ("instruction", "output"), _turns(("'user'", "instruction"), ("'assistant'", "output"))),
    Layout(
        "instruction_input",
        ("input", "instruction", "output"),
        _turns(("'user'", "concat_ws('\\n\\n', instruction, nullif(input, ''))"), ("'assistant'", "output")),
    ),
)
#: A system text beside any other layout is its first turn.
LAYOUTS += tuple(
    Layout(f"system_{x.name}", ("system", *x.paths), f"concat({_turns(("'system'", 'system'))}, {x.turns})")
    for x in LAYOUTS
    if x.name not in ("prompt", "system_prompt")
)
#: One row per turn, with the conversation's id: the layout of tables.
LAYOUTS += (Layout("turn_rows", ("role", "text", "turn"), _turns(("role", "text")), at="turn"),)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(schema: T.StructType) -> set[str]:
    """Nested field paths of a schema, a for a field, a[].b for a field of an array's structs."""
    out = set()
    for f in schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out |= {f"{f.name}[].{x}" for x in schema_paths(kind.elementType)}
        elif isinstance(kind, T.StructType):
            out |= {f"{f.name}.{x}" for x in schema_paths(kind)}
        else:
            out.add(f.name)
    return out


KNOWN = {p for x in LAYOUTS for p in x.paths}
#: A record is a whole conversation.
RECORDS = tuple(x for x in LAYOUTS if not x.at)


def layout_of(paths: set[str]) -> Layout:
    """The layout whose fingerprint the known ones of ``paths`` have.

    Where they are of no layout, it is that of most paths, all of which are there: other fields of
    known names do no harm. The first of equals is taken. A table of turns is one whatever else it has.
    """
    for x in LAYOUTS:
        if x.at and set(x.paths) <= paths:
            return x
    by = {fingerprint(x.paths): x for x in reversed(LAYOUTS)}
    exact = by.get(fingerprint(paths & KNOWN))
    inside = [x for x in LAYOUTS if set(x.paths) <= paths]
    if exact is None and not inside:
        raise ValueError(f"no layout has the paths {sorted(paths)}")
    return exact or max(inside, key=lambda x: len(x.paths))


def turns_of_frame(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a frame whose schema has a known layout, by its fingerprint.

    Null roles and texts are empty, null turns and ids stay null; repeated rows repeat, an empty
    table gives no rows; columns that no layout uses are left alone.
    """
    layout = layout_of(schema_paths(df.schema))
    rows = df.select(
        F.col(id_column).alias("conv_id"),
        F.col(layout.at or id_column).alias("at"),
        F.posexplode(F.expr(layout.turns)).alias("turn", "t"),
    )
    turn = F.col("at" if layout.at else "turn").cast("long")
    return rows.select("conv_id", turn.alias("turn"), *_clean("t.role", "t.text"))


def _clean(role: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c.split(".")[-1]) for c in (role, text)]


def _quoted(names) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in names) + ")"


def _paths(v: str) -> tuple[str, str]:
    """SQL for the paths of layouts that a JSON value has, over all elements of its arrays, and for those with a value."""
    known = sorted({p for x in RECORDS for p in x.paths})
    out = []
    for keys in ("map_keys({})", "map_keys(map_filter({}, (k, y) -> NOT is_variant_null(y)))"):
        named = keys.format("coalesce(try_variant_get({}, '$', 'map<string,variant>'), cast(map() AS map<string,variant>))")
        found = [named.format(v)]
        for field in sorted({p.partition("[].")[0] for p in known if "[]." in p}):
            items = f"coalesce(try_variant_get({v}, '$.{field}', 'array<variant>'), cast(array() AS array<variant>))"
            own = f"array_distinct(flatten(transform({items}, x -> {named.format('x')})))"
            found.append(f"transform({own}, p -> concat('{field}[].', p))")
        out.append(f"array_sort(array_intersect(concat({', '.join(found)}), {_quoted(known)}))")
    return tuple(out)


def _layouts(rows: DataFrame) -> DataFrame:
    """fp, layout of every distinct fingerprint of ``rows`` (has, filled, fp): three to the number of known paths at most."""
    ranks = []
    for n, x in enumerate(RECORDS):
        need, size = _quoted(x.paths), len(x.paths)
        rank = f"named_struct('given', -size(array_intersect(filled, {need})), 'need', {size}, 'n', {n})"
        ranks.append(f"CASE WHEN size(array_intersect(has, {need})) = {size} THEN {rank} END")
    kinds = rows.groupBy("fp").agg(F.first("has").alias("has"), F.first("filled").alias("filled"))
    return kinds.selectExpr("fp", f"array_min(array_compact(array({', '.join(ranks)}))).n AS layout")


def _field(name: str, kind: str) -> str:
    """SQL for a probed field of ``v``, null unless the layout has it; contents of an array's turns as text.

    Of a content that is a list of parts the texts follow each other; a part without text stays as its JSON.
    """
    users = [str(n) for n, x in enumerate(RECORDS) if any(p.partition("[].")[0] == name for p in x.paths)]
    value = f"try_variant_get(v, '$.{name}', '{kind}')"
    if "variant" in kind:
        role, text = (x.partition(":")[0] for x in kind.removeprefix("array<struct<").removesuffix(">>").split(","))
        part = "coalesce(try_variant_get(p, '$.text', 'string'), try_variant_get(p, '$', 'string'), '')"
        listed = f"array_join(transform(try_variant_get(x.{text}, '$', 'array<variant>'), p -> {part}), '')"
        whole = f"CASE WHEN startswith(schema_of_variant(x.{text}), 'ARRAY') THEN {listed} ELSE try_variant_get(x.{text}, '$', 'string') END"
        value = f"transform({value}, x -> named_struct('{role.strip('`')}', x.{role}, '{text}', {whole}))"
    return f"CASE WHEN layout IN ({', '.join(users)}) THEN {value} END AS {name}"


def _mapped(df: DataFrame, record: str, id_column: str) -> DataFrame:
    """conv_id, v, turns of every record; turns are null where no layout's paths are all there.

    The hash of a record's paths, and of those that hold a value, is its fingerprint. Each distinct one
    selects a layout once; records meet that small table, and only their layout's fields are read.
    """
    rows = df.select(F.col(id_column).alias("conv_id"), F.try_parse_json(F.col(record)).alias("v"))
    has, filled = _paths("v")
    shown = rows.selectExpr("conv_id", "v", f"{has} AS has", f"{filled} AS filled")
    shown = shown.withColumn("fp", F.xxhash64("has", F.lit("|"), "filled"))
    rows = shown.select("conv_id", "v", "fp").join(F.broadcast(_layouts(shown.select("fp", "has", "filled"))), "fp")
    rows = rows.selectExpr("conv_id", "v", "layout", *[_field(k, kind) for k, kind in FIELDS.items()])
    cases = " ".join(f"WHEN {n} THEN {x.turns}" for n, x in enumerate(RECORDS))
    return rows.selectExpr("conv_id", "v", f"CASE layout {cases} END AS turns")


def turns_of_records(df: DataFrame, record: str = "record", id_column: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of JSON records in a string column, each with a layout of its own.

    Of the layouts whose paths are all among a record's keys, it has the one with most paths that
    hold a value, then the one with fewest nulls, then the first. A null text is empty; of a content
    that is a list of parts the texts follow each other, and a part without text stays as its JSON.
    A record that is no JSON, or of no known layout, has no turns: ``unmatched_records`` has those.
    Repeated rows and ids repeat their turns, null ids stay null, an empty table gives no rows, and a
    very long record is one row's work.
    """
    rows = _mapped(df, record, id_column).select("conv_id", F.posexplode("turns").alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *_clean("t.role", "t.text"))


def unmatched_records(df: DataFrame, record: str = "record", id_column: str = "conv_id") -> DataFrame:
    """conv_id, reason, records: how many records of an id ``turns_of_records`` has no turns of, and why.

    A null record is no JSON; repeated rows count again, a null id is an id, an empty table gives no rows.
    """
    rows = _mapped(df, record, id_column).filter(F.coalesce(F.size("turns"), F.lit(0)) <= 0)
    reason = F.when(F.col("v").isNull(), "no json").when(F.col("turns").isNull(), "no layout").otherwise("no turns")
    return rows.groupBy("conv_id", reason.alias("reason")).agg(F.count("*").alias("records"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(?<=[<\[])" + CONTROL_REST, r"\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a lone backslash stands only between "<" or "[" and a control string's rest."""
    bare = F.regexp_replace(text, r"(?<=[<\[])\\" + CONTROL_REST, "")
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    ``loss`` are spans of the texts of ``learn_from``: turn, from, to count code points within the
    turn's part, start and end in the whole text. Turns are ordered by turn, then role and text;
    null turns come first, null roles and texts are empty, null conv_ids are one conversation.
    Repeated rows are repeated turns; an empty table gives no rows. A conversation is one text, so
    its turns meet in one task, and only they; very long texts are held whole there.
    """
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("part", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0)).alias("at"),
        "part",
        F.char_length("head").alias("from"),
        (F.char_length("head") + F.char_length("body")).alias("to"),
        (F.col("role") == learn_from).alias("learn"),
    )
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "at", "part", "from", "to", "learn"))).alias("p"))
    span = lambda x: F.struct(
        x["n"].alias("turn"), x["from"].alias("from"), x["to"].alias("to"), (x["at"] + x["from"]).alias("start"), (x["at"] + x["to"]).alias("end")
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["learn"]), span).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars, from ``formatted`` and ``loss`` alone.

    One row for each of ``formatted``, null ids and repeated rows as they are; without turns to learn
    from, loss_text is empty. An empty table gives no rows; a very long text is one row's work.
    """
    end = END.replace("|", r"\|")
    rows = formatted.withColumn("parts", F.split("formatted", end))
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p))
    role = lambda b: F.substring_index(b, SEP, 1)

    def turn(p: Column) -> Column:
        b = body(p)
        text = F.substring(b, F.char_length(role(b)) + F.lit(len(SEP) + 1), F.char_length(b))
        return F.struct(unescape(role(b)).alias("role"), unescape(text).alias("text"))

    taken = F.transform("loss", lambda s: unescape(F.substring(F.get("parts", s["turn"] - 1), s["from"] + 1, s["to"] - s["from"])))
    return rows.select(
        "conv_id",
        F.transform(F.slice("parts", 1, F.size("parts") - 1), turn).alias("turns"),
        F.array_join(taken, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
