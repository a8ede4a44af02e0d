"""Chat formatting: layouts told by a fingerprint of their field paths, mapped to turns, written by a template.

A record's nested field paths (``messages[].role``, ``instruction``) that any declared layout knows are
sorted and hashed; the hash selects the layout, and the layout's declared steps turn the record into
canonical turns (role, text). Records are structs, whose schema is known and where a field counts if it
is not null, or JSON texts, whose paths are taken from the schema of each single value. Fields that no
layout knows are left alone. All of it is DataFrame functions.

A template writes turns one after the other between marks. Control strings inside a text get a backslash
after their first character, and one more if they have some already, so the escape can be taken back
exactly and no text can end its turn. The loss mask lists the assistant texts as spans of bytes.

A record of no known layout keeps its row, with null for layout and turns; so does a null or broken JSON
text. Null texts and roles are empty. In a table of one row a turn, turns ascend, null turns last, ties by
role and text; repeated rows are turns of their own, and rows without a conversation id are one
conversation. A conversation is one value of the result and has to fit a task. Empty tables give empty
results. Other columns pass through inside ``_given`` or are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrill.llm import common
from voxrill.llm.registry import query


@dataclass(frozen=True)
class One:
    """A turn of a fixed role from one or more text fields, blank lines between those that are not empty."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for every element of an array."""

    array: str
    role: str
    text: str
    names: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Layout:
    """Steps in order, the paths that a record must have and those that it may have."""

    name: str
    steps: tuple[One | Each, ...]
    needs: frozenset[str]
    may: frozenset[str] = frozenset()

    def path_sets(self) -> list[frozenset[str]]:
        return [self.needs | set(c) for k in range(len(self.may) + 1) for c in combinations(sorted(self.may), k)]


# Role names and field names of common data sets.
SPEAKERS = {"human": "user", "prompter": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant"}
_PARTS = ("messages[].content[]", "messages[].content[].type", "messages[].content[].text")


def _pair(name: str, asked: tuple[str, ...], answered: str, needs: set[str], may: tuple[str, ...] = ()) -> Layout:
    return Layout(name, (One("system", ("system",)), One("user", asked), One("assistant", (answered,))), frozenset(needs), frozenset({"system", *may}))


LAYOUTS = (
    Layout("messages", (Each("messages", "role", "content"),), frozenset({"messages[]"}), frozenset({"messages[].role", "messages[].content", *_PARTS})),
    Layout("turn rows", (Each("messages", "role", "text"),), frozenset({"messages[]"}), frozenset({"messages[].role", "messages[].text"})),
    Layout(
        "speakers", (One("system", ("system",)), Each("conversations", "from", "value", SPEAKERS)),
        frozenset({"conversations[]"}), frozenset({"system", "conversations[].from", "conversations[].value"}),
    ),
    _pair("prompt and response", ("prompt",), "response", {"prompt", "response"}),
    _pair("prompt and completion", ("prompt",), "completion", {"prompt", "completion"}),
    _pair("instruction", ("instruction", "input"), "output", {"instruction", "output"}, ("input",)),
    _pair("question and answer", ("context", "question"), "answer", {"question", "answer"}, ("context",)),
    _pair("preference", ("prompt",), "chosen", {"prompt", "chosen"}, ("rejected",)),
)


def _hash(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted(set().union(*(lay.needs | lay.may for lay in layouts)))


# --- field paths ---------------------------------------------------------------------

_TOKEN = r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>|[A-Z][A-Z_]*"


def json_paths(value: Column) -> Column:
    """The nested field paths of a VARIANT value; null fields have none, an array's elements go together."""
    entry = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    tokens = F.regexp_extract_all(F.schema_of_variant(value), F.lit(f"({_TOKEN})"), 0)

    def step(state: Column, token: Column) -> Column:
        stack, paths = state["stack"], state["paths"]
        top = F.element_at(stack, -1)["path"]
        name = F.regexp_replace(F.regexp_replace(token, "^`|`?: $", ""), "``", "`")
        below = F.slice(stack, 1, F.size(stack) - 1)
        # A value that is complete also ends the field that holds it.
        ended = lambda s: F.when(F.element_at(s, -1)["kind"] == "field", F.slice(s, 1, F.size(s) - 1)).otherwise(s)
        is_field = F.endswith(token, F.lit(": "))
        pushed = (
            F.when(is_field, F.concat(stack, F.array(entry(F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name)), "field"))))
            .when(token == "OBJECT<", F.concat(stack, F.array(entry(top, "object"))))
            .when(token == "ARRAY<", F.concat(stack, F.array(entry(F.concat(top, F.lit("[]")), "array"))))
            .when(token == ">", ended(below)).otherwise(ended(stack))
        )
        is_value = ~is_field & ~token.isin("OBJECT<", "ARRAY<", ">", "VOID")
        found = F.when(token == "ARRAY<", F.array(F.concat(top, F.lit("[]")))).when(is_value, F.array(top)).otherwise(F.array().cast("array<string>"))
        return F.struct(pushed.alias("stack"), F.concat(paths, found).alias("paths"))

    start = F.struct(F.array(entry(F.lit(""), "array")).alias("stack"), F.array().cast("array<string>").alias("paths"))
    return F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"]))


def _typed(kind: T.DataType, name: str) -> T.DataType | None:
    return next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None


def _present(value: Column, kind: T.DataType, path: str) -> Column | None:
    """Whether a typed value has a path; None where its schema rules it out."""
    if path == "":
        return value.isNotNull() if not isinstance(kind, (T.StructType, T.ArrayType)) else None
    head, _, rest = path.partition(".")
    name = head.removesuffix("[]")
    inner = _typed(kind, name)
    if inner is None:
        return None
    field_ = value.getField(name)
    if not head.endswith("[]"):
        return _present(field_, inner, rest)
    if not isinstance(inner, T.ArrayType):
        return None
    if not rest:
        return field_.isNotNull()
    if _present(F.lit(None).cast(inner.elementType), inner.elementType, rest) is None:
        return None
    return F.coalesce(F.exists(field_, lambda e: _present(e, inner.elementType, rest)), F.lit(False))


def struct_paths(value: Column, kind: T.StructType, known: list[str]) -> Column:
    """Those of the ``known`` paths that a struct has in this row."""
    tests = [(p, _present(value, kind, p)) for p in known]
    found = [F.when(t, F.lit(p)) for p, t in tests if t is not None]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def fingerprint(paths: Column, known: list[str]) -> Column:
    """The hash of those paths that are known to some layout."""
    return F.sha2(F.array_join(F.sort_array(F.array_intersect(paths, F.lit(known))), "\n"), 256)


# --- canonical turns -----------------------------------------------------------------


class _Struct:
    """Access to the fields of a typed record; what its schema lacks is null."""

    def __init__(self, kind: T.DataType):
        self.kind = kind

    def text(self, value: Column, name: str) -> Column:
        return F.lit(None).cast("string") if _typed(self.kind, name) is None else value.getField(name).cast("string")

    def elements(self, value: Column, name: str) -> tuple[Column, _Struct]:
        kind = _typed(self.kind, name)
        if not isinstance(kind, T.ArrayType):
            return F.lit(None).cast("array<struct<x:int>>"), _Struct(T.StructType())
        return value.getField(name), _Struct(kind.elementType)


class _Json:
    """The same for a VARIANT."""

    def text(self, value: Column, name: str) -> Column:
        """A scalar as a string; of a list of parts the texts, joined."""
        at = F.try_variant_get(value, f"$['{name}']", "variant")
        parts = F.try_variant_get(value, f"$['{name}']", "array<variant>")
        texts = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
        return F.when(F.startswith(F.schema_of_variant(at), F.lit("ARRAY")), texts).otherwise(F.try_variant_get(value, f"$['{name}']", "string"))

    def elements(self, value: Column, name: str) -> tuple[Column, _Json]:
        return F.try_variant_get(value, f"$['{name}']", "array<variant>"), self


_NO_TURNS = "array<struct<role:string,text:string>>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _steps_turns(step: One | Each, value: Column, access) -> Column:
    """The turns that one step of a layout makes of a record."""
    if isinstance(step, One):
        texts = [access.text(value, p) for p in step.paths]
        joined = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array_compact(F.array(*texts)), lambda t: t != ""), "\n\n")
        return F.when(F.coalesce(*texts).isNotNull(), F.array(_turn(F.lit(step.role), joined))).otherwise(F.array().cast(_NO_TURNS))
    array, inner = access.elements(value, step.array)

    def one(e: Column) -> Column:
        role = inner.text(e, step.role)
        for name, canonical_name in step.names.items():
            role = F.when(inner.text(e, step.role) == name, canonical_name).otherwise(role)
        return _turn(role, inner.text(e, step.text))

    return F.coalesce(F.transform(array, one), F.array().cast(_NO_TURNS))


def _turns(layout: Layout, value: Column, access) -> Column:
    made = [_steps_turns(s, value, access) for s in layout.steps]
    return F.concat(*made) if len(made) > 1 else made[0]


def canonical(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(_given, fingerprint, layout, turns) of every row; ``record_col`` is a struct, a VARIANT or a JSON text.

    ``turns`` is an array of (role, text), null where no layout has the record's fingerprint.
    """
    kind = records.schema[record_col].dataType
    value, known = records[record_col], _known(layouts)
    if isinstance(kind, T.StructType):
        access, paths = _Struct(kind), lambda v: struct_paths(v, kind, known)
    else:
        access, paths = _Json(), json_paths
        value = value if isinstance(kind, T.VariantType) else F.try_parse_json(value)
    rows = records.select(F.struct(*[records[c] for c in records.columns]).alias("_given"), value.alias("_value"))
    told = rows.withColumn("fingerprint", fingerprint(paths(F.col("_value")), known))
    layout, turns, taken = F.lit(None).cast("string"), F.lit(None).cast(_NO_TURNS), set()
    chosen = []
    for lay in layouts:
        hashes = {_hash(p) for p in lay.path_sets()} - taken
        taken |= hashes
        chosen.append((lay, F.col("fingerprint").isin(sorted(hashes))))
    for lay, test in reversed(chosen):
        layout = F.when(test, lay.name).otherwise(layout)
    told = told.withColumn("layout", layout)
    for lay, _ in chosen:
        turns = F.when(F.col("layout") == lay.name, _turns(lay, F.col("_value"), access)).otherwise(turns)
    return told.select("_given", "fingerprint", "layout", turns.alias("turns"))


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): the rows of each conversation as one record of the layout ``turn rows``."""
    one = F.struct(rows[turn_col].isNull().alias("last"), rows[turn_col].alias("at"), rows[role_col].alias("role"), rows[text_col].alias("text"))
    sorted_ = F.sort_array(F.collect_list("_one"))
    messages = F.transform(sorted_, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return rows.select(rows[id_col].alias("conv_id"), one.alias("_one")).groupBy("conv_id").agg(F.struct(messages.alias("messages")).alias("record"))


# --- templates -----------------------------------------------------------------------

# Control strings of common templates, after their first character.
_CONTROL = r"(?=/?INST\]|/?s>|/?SYS>|\|\w+\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2")


@dataclass(frozen=True)
class Template:
    """What stands before and after a text, by role; any other role is written out after ``other[0]`` on a line of its own.

    Every closing mark holds a control string, so it cannot occur inside an escaped text, and the opening
    marks tell the roles apart.
    """

    name: str
    marks: dict[str, tuple[str, str]]
    other: tuple[str, str]

    def opening(self, role: Column) -> Column:
        named = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        out = F.concat(F.lit(self.other[0]), escape(named), F.lit("\n"))
        for r, (opens, _) in self.marks.items():
            out = F.when(role == r, opens).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.other[1])
        for r, (_, closes) in self.marks.items():
            out = F.when(role == r, closes).otherwise(out)
        return out


# The marks of two public templates.
INST = Template("inst", {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}, ("<|role|>", "<|end|>"))
CHATML = Template("chatml", {}, ("<|im_start|>", "<|im_end|>\n"))


def formatted(turns: Column, template: Template = INST, learn: str = "assistant") -> Column:
    """(text, loss): the turns as the template writes them, and the (start, length) in bytes of every text to learn."""
    pieces = F.transform(turns, lambda t: F.struct(
        template.opening(t["role"]).alias("opens"), escape(t["text"]).alias("body"), template.closing(t["role"]).alias("closes"), (t["role"] == learn).alias("learn"),
    ))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.octet_length(p["opens"])
        span = F.struct(start.alias("start"), F.octet_length(p["body"]).cast("long").alias("length"))
        spans = F.when(p["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + F.octet_length(p["body"]) + F.octet_length(p["closes"])).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    # Computed once per row, then read twice.
    return F.element_at(F.transform(F.array(pieces), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: F.concat(p["opens"], p["body"], p["closes"])), "").alias("text"),
        F.aggregate(ps, begin, step, lambda s: s["spans"]).alias("loss"),
    )), 1)


def read_back(text: Column, template: Template = INST) -> Column:
    """The turns of a formatted text."""
    closes = sorted({c for _, c in template.marks.values()} | {template.other[1]})
    pieces = F.filter(F.split(text, f"(?<={'|'.join(map(re.escape, closes))})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        inside = lambda opens, ends: F.substring(p, F.lit(1) + opens, F.char_length(p) - opens - F.lit(len(ends)))
        before, after = template.other
        head = F.substring_index(p, "\n", 1)
        role = unescape(F.substring(head, F.lit(len(before) + 1), F.char_length(head)))
        role = F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        body = inside(F.char_length(head) + 1, after)
        for r, (opens, ends) in template.marks.items():
            fits = F.startswith(p, F.lit(opens))
            role, body = F.when(fits, r).otherwise(role), F.when(fits, inside(F.lit(len(opens)), ends)).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda raw, s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    return F.element_at(F.transform(F.array(text.cast("binary")), lambda raw: F.array_join(F.transform(loss, lambda s: part(raw, s)), "")), 1)


def chats(records: DataFrame, record_col: str, template: Template = INST, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(_given, fingerprint, layout, turns, text, loss) of every record; the last three null where no layout fits."""
    made = canonical(records, record_col, layouts).withColumn("_made", F.when(F.col("turns").isNotNull(), formatted(F.col("turns"), template)))
    return made.select("_given", "fingerprint", "layout", "turns", F.col("_made.text").alias("text"), F.col("_made.loss").alias("loss"))


def layouts_found(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """How many records have each fingerprint, and the layout it selects: what a new data set still needs declared."""
    return canonical(records, record_col, layouts).groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("records"))


_CHAT_SQL = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), marked AS (
    SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:/?INST\]|/?s>|/?SYS>|\|\w+\|>)')) AS controls,
        CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 1 + 5 ELSE 8 + length(role) + 1 + 7 END AS marks
    FROM given
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text) + controls + marks) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op11_chat", _CHAT_SQL)
def op11_chat(spark, d):
    """Every conversation, and one that consists of control strings, formatted and read back."""
    rows = common.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    out = chats(from_rows(rows.unionByName(extra)), "record")
    read = out.select(F.col("_given.conv_id").alias("conv_id"), "text", read_back(F.col("text")).alias("turns"), loss_text(F.col("text"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
