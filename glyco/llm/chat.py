"""Chat formatting: layouts recognised by their schema fingerprint, then one reversible template."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template. Escaped texts hold neither "#" nor "<", escaped roles no ":" either.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """How a record holds its turns.

    ``turns`` names an array of structs, or is empty when every row is one turn; ``role`` and ``text``
    are fields of a turn. With ``fixed``, turns are made of (role, fields) instead, empty ones left out.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def shape(self) -> str:
        if self.fixed:
            return _object(["conv_id", *[f for _, fields in self.fixed for f in fields]])
        if self.turns:
            return _object(["conv_id", f"{self.turns}: ARRAY<{_object([self.role, self.text])}>"])
        return _object(["conv_id", self.order, self.role, self.text])


    def fields(self) -> list[str]:
        """Columns of a table in this layout."""
        if self.fixed:
            return ["conv_id", *[f for _, fields in self.fixed for f in fields]]
        return ["conv_id", self.turns] if self.turns else ["conv_id", self.order, self.role, self.text]


def _object(fields: list[str]) -> str:
    return f"OBJECT<{', '.join(sorted(fields))}>"


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn rows", role="role", text="text", order="turn"),
    Layout("messages", turns="messages", role="role", text="content", roles=NAMES),
    Layout("from and value", turns="conversations", role="from", text="value", roles=NAMES),
    Layout("prompt", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt with system", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def fingerprint(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.shape()): x for x in LAYOUTS}


def shape_of(kind: T.DataType) -> str:
    """Nested field paths of a type, sorted."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            inner = shape_of(f.dataType)
            parts.append(f"{f.name}: {inner}" if inner else f.name)
        return _object(parts)
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{shape_of(kind.elementType)}>"
    return ""


def _rename(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in layout.roles:
        out = F.when(F.lower(role) == old, new).otherwise(out)
    return out


def _as_turns(df: DataFrame, layout: Layout) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if layout.fixed:
        made = [(role, F.concat_ws("\n", *[F.nullif(text(F.col(f)), F.lit("")) for f in fields])) for role, fields in layout.fixed]
        turns = F.filter(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), t.alias("text")) for i, (r, t) in enumerate(made)]), lambda t: t["text"] != "")
        return df.select("conv_id", F.inline(turns))
    if layout.turns:
        each = F.transform(layout.turns, lambda t, i: F.struct(i.cast("long").alias("turn"), _rename(t[layout.role], layout).alias("role"), text(t[layout.text]).alias("text")))
        return df.select("conv_id", F.inline(each))
    return df.select("conv_id", F.col(layout.order).cast("long").alias("turn"), _rename(F.col(layout.role), layout).alias("role"), text(F.col(layout.text)).alias("text"))


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose columns a table has, whatever other columns stand beside them.

    The shape of each layout's own columns is hashed. Of several that match, the one with most fields is taken, of
    equal ones the first in ``LAYOUTS``.
    """
    found = []
    for layout in LAYOUTS:
        own = shape_of(T.StructType([f for f in schema.fields if f.name in layout.fields()]))
        if BY_FINGERPRINT.get(fingerprint(own)) is layout:
            found.append((own.count(","), layout))
    if not found:
        raise ValueError(f"no layout has the fields {shape_of(schema)}")
    return max(found, key=lambda x: x[0])[1]


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout, picked by the fingerprint of its schema.

    Other columns are ignored, also where another layout names them.
    """
    return _as_turns(df, layout_of(df.schema))


def canonical_json(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Turns of JSON records in mixed layouts, and the records whose layout is unknown.

    Each record's own schema is hashed, so one table may mix layouts. Records that are not JSON count as
    unknown; nothing is dropped.
    """
    primitive = r": (STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP)(?=[,>])"
    value = F.try_parse_json(column)
    marked = df.withColumn("_value", value).withColumn("_shape", F.sha2(F.regexp_replace(F.schema_of_variant("_value"), primitive, ""), 256))
    parts = []
    for key, layout in BY_FINGERPRINT.items():
        fields = {"conv_id": "bigint"}
        if layout.fixed:
            fields |= {f: "string" for _, names in layout.fixed for f in names}
        elif layout.turns:
            fields[layout.turns] = f"array<struct<{layout.role}: string, {layout.text}: string>>"
        else:
            fields |= {layout.order: "bigint", layout.role: "string", layout.text: "string"}
        own = marked.filter(F.col("_shape") == key)
        parts.append(_as_turns(own.select(*[F.try_variant_get("_value", f"$.{n}", kind).alias(n) for n, kind in fields.items()]), layout))
    turns = parts[0]
    for more in parts[1:]:
        turns = turns.unionByName(more)
    unknown = marked.filter(F.col("_shape").isNull() | ~F.col("_shape").isin(list(BY_FINGERPRINT)))
    return turns, unknown.drop("_value", "_shape")


def escape(text: Column, pairs=ESCAPES) -> Column:
    """Control characters as a backslash and a letter; every backslash then starts such a pair."""
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and end in code points).

    Turns are ordered by turn (null last), then role, then text, so ties and repeated rows have one
    order and all stay. Null roles and texts count as empty; a null conv_id is a conversation of its own;
    an empty table gives no rows. ``loss_spans`` cover the escaped text of each assistant turn. A
    conversation is the unit of output and is put together in one row.
    """
    whole = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    made = whole.withColumns({"head": head, "body": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    size = F.char_length("head") + F.char_length("body") + len(TAIL)
    made = made.withColumn("place", F.row_number().over(order)).withColumn("end", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.col("end") - len(TAIL)
    span = F.when(F.col("role") == LOSS_ROLE, F.struct((stop - F.char_length("body")).alias("start"), stop.alias("end")))
    parts = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(TAIL)).alias("part"), span.alias("span")))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.col("parts.part"), "").alias("formatted"), F.array_compact(F.col("parts.span")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, TAIL, -1)
    at = lambda p: F.locate(MIDDLE, p)
    turn = lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(HEAD) + 1), at(p) - len(HEAD) - 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(p, at(p) + len(MIDDLE), F.char_length(p))).alias("text"),
    )
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
