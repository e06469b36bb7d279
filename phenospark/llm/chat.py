"""Chat formatting by schema fingerprints, with DataFrame functions alone.

A record is JSON. The nested field paths of its value, without leaf types, are hashed to a fingerprint, which selects a
declarative mapping to canonical turns (role, text); records of unknown layout get no turns and keep their fingerprint.
Turns are written with ``<|im_start|>role`` and ``<|im_end|>``. Control strings in texts are escaped reversibly: a
backslash is put after the ``<`` of every ``<``, backslashes, ``|``. The loss mask is spans of code points, those of
assistant texts.

Tables of turns are grouped to structs, whose field paths are fingerprinted from their type: no JSON is written or parsed, so
no limit of the parser applies to them. JSON records that try_parse_json can't read, those with a string of more than
20,000,000 characters among them, get no turns and a null fingerprint.

Defined cases: null texts and roles are empty; rows of one conversation sort by turn, then role, then text; repeated
rows are turns each. A conversation is one row of the result, so that its turns meet in one task by definition; texts of
different conversations never do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
_TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths, as schema_of_variant lists them without leaf types, and the turns that it stands for.

    ``turns`` are (role, path) pairs for flat layouts; ``items`` is (path of a list, role field, text field)."""

    paths: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    lead: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("{messages:[{content,role}]}", items=("messages", "role", "content")),
    Mapping("{messages:[{content,role}],system}", items=("messages", "role", "content"), lead=(("system", "system"),)),
    Mapping("{conversations:[{from,value}]}", items=("conversations", "from", "value")),
    Mapping("{conversations:[{from,value}],system}", items=("conversations", "from", "value"), lead=(("system", "system"),)),
    Mapping("{completion,prompt}", turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("{prompt,response}", turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("{instruction,output}", turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("{input,instruction,output}", turns=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("{input,instruction,output,system}", turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("{answer,question}", turns=(("user", "question"), ("assistant", "answer"))),
)
#: Names of roles in other layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value: Column) -> Column:
    """Nested field paths of a variant: names in order, objects in braces, lists in brackets, leaf types left out."""
    s = F.regexp_replace(F.schema_of_variant(value), r"OBJECT<", "{")
    s = F.regexp_replace(s, r"ARRAY<", "[")
    s = F.regexp_replace(s, r": (?:STRING|VOID|VARIANT|BIGINT|DOUBLE|BOOLEAN|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|DECIMAL\(\d+,\d+\))", "")
    s = F.regexp_replace(s, r"\[\{([^<>\[\]{}]*)>>", "[{$1}]")
    s = F.regexp_replace(s, r"\[([^<>\[\]{}]*)>", "[$1]")
    s = F.regexp_replace(F.regexp_replace(s, r">", "}"), r"[\s`]+", "")
    return s


def type_paths(kind: DataType) -> str:
    """The same paths of a column's type."""
    if isinstance(kind, StructType):
        return "{" + ",".join(f.name + (f":{inner}" if (inner := type_paths(f.dataType)) else "") for f in sorted(kind.fields, key=lambda f: f.name)) + "}"
    return f"[{type_paths(kind.elementType)}]" if isinstance(kind, ArrayType) else ""


def fingerprint(value: Column) -> Column:
    return F.xxhash64(field_paths(value))


def _turns(get: Callable[[str, str], Column], m: Mapping, roles: dict[str, str] = ROLES) -> Column:
    """The turns of a record; get gives the value at a path as a type, ``roles`` other names of roles."""

    def text(path: str) -> Column:
        parts = [F.coalesce(get(p, "string"), F.lit("")) for p in path.split("+")]
        return parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")

    def turn(role: Column, said: Column) -> Column:
        return F.struct(role.alias("role"), said.alias("text"))

    lead = F.array(*[turn(F.lit(role), text(path)) for role, path in (m.lead or m.turns)])
    if not m.items:
        return lead
    path, role, said = m.items
    items = get(path, f"array<struct<{role}:string,{said}:string>>")
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])

    def known_as(x: Column) -> Column:
        return F.coalesce(F.try_element_at(names, F.coalesce(x, F.lit(""))), x, F.lit("")) if roles else F.coalesce(x, F.lit(""))

    known = F.transform(items, lambda x: turn(known_as(x[role]), F.coalesce(x[said], F.lit(""))))
    return F.concat(lead, known) if m.lead else known


def canonical(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The records with fingerprint (long) and turns (null where no mapping has it)."""
    value = F.try_parse_json(F.col(f"`{json_col}`"))
    out = records.withColumn("__value", value).withColumn("fingerprint", fingerprint(F.col("__value")))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("__value"), f"$.{path}", kind)

    turns = None
    for m in mappings:
        hit = F.col("fingerprint") == F.xxhash64(F.lit(m.paths))
        turns = F.when(hit, _turns(get, m)) if turns is None else turns.when(hit, _turns(get, m))
    return out.withColumn("turns", turns.cast(_TURN)).drop("__value")


def _fits(kind: StructType, m: Mapping) -> bool:
    """Whether a struct has all the fields that a mapping reads."""
    names = set(kind.names)
    flat = {p for _, path in (*m.turns, *m.lead) for p in path.split("+")}
    if not flat <= names or m.items and m.items[0] not in names:
        return False
    inner = kind[m.items[0]].dataType if m.items else None
    return inner is None or isinstance(inner, ArrayType) and isinstance(inner.elementType, StructType) and set(m.items[1:]) <= set(inner.elementType.names)


def canonical_struct(records: DataFrame, struct_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The same for a struct column, whose type has one layout for all records. Its roles are taken as they are: a table
    of turns says who speaks."""
    kind = records.schema[struct_col].dataType
    out = records.withColumn("fingerprint", F.xxhash64(F.lit(type_paths(kind))))

    def get(path: str, kind: str) -> Column:
        value = F.col(f"`{struct_col}`.`{path}`")
        return value.cast(kind) if kind == "string" else value  # a cast of structs goes by place, not by name

    turns = F.lit(None).cast(_TURN)
    for m in reversed([m for m in mappings if _fits(kind, m)]):
        turns = F.when(F.col("fingerprint") == F.xxhash64(F.lit(m.paths)), _turns(get, m, {}).cast(_TURN)).otherwise(turns)
    return out.withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """The records with formatted (string) and loss_mask (array of start, length in code points of formatted)."""
    parts = F.transform(turns_col, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    tail = f"{END}\n"
    out = records.withColumn("__parts", parts)
    out = out.withColumn("formatted", F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.array(F.struct(begin.cast("long").alias("start"), size.alias("length")))
        spans = F.when(p["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + size + len(tail)).cast("long").alias("at"), spans.alias("spans"))

    return out.withColumn("loss_mask", F.aggregate("__parts", zero, step, lambda acc: acc["spans"])).drop("__parts")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
            unescape(F.substr(c, F.instr(c, "\n") + 1, F.length(c) - F.instr(c, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def from_rows(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and record: each conversation's rows as one struct of messages."""
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("content")).alias("m"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    messages = F.transform("ms", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return grouped.select("conv_id", F.struct(messages.alias("messages")).alias("record"))


def format_rows(conversations: DataFrame, **named: str) -> DataFrame:
    """conv_id, fingerprint, turns, formatted, loss_mask of every conversation of a table of turns."""
    return render(canonical_struct(from_rows(conversations, **named), "record")).drop("record")


def digest(done: DataFrame) -> DataFrame:
    back = done.withColumn("__turns", read_back(F.col("formatted"))).withColumn("__loss", masked(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
