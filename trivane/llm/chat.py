"""Chat formatting by schema fingerprint, in DataFrame operations only.

A record's fingerprint is the SHA-256 of its sorted nested field paths that hold
a value. A table of declarative layouts says which fingerprints stand for which
prompt, instruction or message layout and how its fields become turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns.

    list_path with role_key and text_key: an array of messages. Otherwise
    fields: (role, path) in the order of the turns; paths of the same role that
    follow each other are joined by an empty line (instruction and input).
    optional names the paths that a record may lack, other_keys what messages may
    hold besides.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    list_path: str = ""
    role_key: str = ""
    text_key: str = ""
    optional: tuple[str, ...] = ()
    other_keys: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.list_path:
            return [self.list_path, f"{self.list_path}[].{self.role_key}", f"{self.list_path}[].{self.text_key}", *[f"{self.list_path}[].{k}" for k in self.other_keys]]
        return [p for _, p in self.fields]

    def fingerprints(self) -> list[str]:
        """One for each set of optional paths that may be missing. A list may also be empty, or hold only null roles or texts."""
        must = [p for p in self.paths() if p not in self.optional]
        if self.list_path:
            may, must = self.paths()[1:], self.paths()[:1]
        else:
            may = list(self.optional)
        sets = chain.from_iterable(combinations(may, n) for n in range(len(may) + 1))
        return [fingerprint_of([*must, *s]) for s in sets]


LAYOUTS = (
    Layout("messages", list_path="messages", role_key="role", text_key="content"),
    Layout("conversations", list_path="conversations", role_key="from", text_key="value"),
    Layout("turns", list_path="turns", role_key="role", text_key="text", other_keys=("turn",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "completion")),
    Layout("response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("nested", fields=(("user", "data.prompt"), ("assistant", "data.response"))),
)
#: Names that sources use for the canonical roles; others stay as they are, in lower case.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

#: The control strings of the template; LINE is a line end inside a role.
BOS, EOS, OPEN, CLOSE, LINE = "<s>", "</s>", "[INST]", "[/INST]", "<n>"


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def record_schema(layouts=LAYOUTS) -> T.StructType:
    """The union of all layouts, for reading JSON records."""
    tree: dict = {}
    for layout in layouts:
        if layout.list_path:
            tree.setdefault(layout.list_path, {"[]": {}})["[]"].update({layout.role_key: None, layout.text_key: None})
        for _, path in layout.fields:
            node = tree
            *parents, leaf = path.split(".")
            for p in parents:
                node = node.setdefault(p, {})
            node.setdefault(leaf, None)

    def build(node):
        if node is None:
            return T.StringType()
        if "[]" in node:
            return T.ArrayType(build(node["[]"]))
        return T.StructType([T.StructField(k, build(v)) for k, v in node.items()])

    return build(tree)


def _some(array: Column, field: str) -> Column:
    return F.exists(array, lambda x: x[field].isNotNull())


def present_paths(schema: T.StructType) -> dict[str, Column]:
    """Each nested field path under ``schema``, with the condition that a row has a value there."""
    out: dict[str, Column] = {}

    def walk(kind, path: str, col: Column):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", col[f.name])
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out[path] = col.isNotNull()
            for f in kind.elementType.fields:
                out[f"{path}[].{f.name}"] = F.coalesce(_some(col, f.name), F.lit(False))
        else:
            out[path] = col.isNotNull()

    for f in schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"))
    return out


def fingerprint(schema: T.StructType) -> Column:
    """SHA-256 of the sorted paths that have a value in the row."""
    paths = present_paths(schema)
    return F.sha2(F.concat_ws("\n", *[F.when(paths[p], F.lit(p)) for p in sorted(paths)]), 256)


def _role(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), low)


def _has(schema: T.StructType, path: str) -> bool:
    kind = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def _turns(layout: Layout, schema: T.StructType) -> Column | None:
    if layout.list_path:
        if not _has(schema, layout.list_path) or not isinstance(schema[layout.list_path].dataType, T.ArrayType):
            return None
        inner = schema[layout.list_path].dataType.elementType
        if not isinstance(inner, T.StructType) or not {layout.role_key, layout.text_key} <= set(inner.names):
            return None
        return F.transform(
            F.col(f"`{layout.list_path}`"),
            lambda x: F.struct(_role(x[layout.role_key]).alias("role"), F.coalesce(x[layout.text_key].cast("string"), F.lit("")).alias("text")),
        )
    parts: list[tuple[str, list[Column]]] = []
    for role, path in layout.fields:
        if not _has(schema, path):
            continue
        if not parts or parts[-1][0] != role:
            parts.append((role, []))
        parts[-1][1].append(F.col(path).cast("string"))
    if not parts:
        return None
    turns = [F.when(F.coalesce(*cols).isNotNull(), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *cols).alias("text"))) for role, cols in parts]
    return F.filter(F.array(*turns), lambda x: x.isNotNull())


def to_turns(records: DataFrame, fields: list[str] | None = None, layouts=LAYOUTS) -> DataFrame:
    """Add fingerprint string, layout string and turns array<struct<role, text>>.

    fields: the columns of the record (default: all). A row whose fingerprint no
    layout has gets a null layout and no turns, so that callers can look at it. Columns of ``records`` named fingerprint, layout or turns
    are replaced (turns may be the record's own); repeated rows stay; an empty table gives no rows.
    """
    fields = fields or records.columns
    schema = T.StructType([records.schema[f] for f in fields])
    names = {p: x.name for x in layouts for p in x.fingerprints()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = records.withColumn("fingerprint", fingerprint(schema)).withColumn("layout", F.try_element_at(table, F.col("fingerprint")))
    turns = None
    for layout in layouts:
        if (col := _turns(layout, schema)) is not None:
            hit = F.col("layout") == layout.name
            turns = F.when(hit, col) if turns is None else turns.when(hit, col)
    empty = F.array().cast(TURNS)
    return found.withColumn("turns", empty if turns is None else F.coalesce(turns.cast(TURNS), empty))


def read_json_records(lines: DataFrame, column: str = "value", layouts=LAYOUTS) -> DataFrame:
    """JSON strings of any mix of layouts as one record of nullable fields, beside the other columns. Bad JSON gives nulls."""
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.from_json(F.col(column), record_schema(layouts)).alias("__r")).select(*rest, "__r.*")


def turns_from_rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One record (conv_id, turns) for each conversation kept as a row a turn, ordered by turn, then role and text.

    Null turns come first, null roles and texts count as empty, rows with a null key are one conversation; repeated
    rows are turns of their own; other columns are not looked at; an empty table gives no rows. A conversation is one value, so
    it has to fit into a task's memory.
    """
    packed = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(packed)).alias("turns"))


def escape(text: Column) -> Column:
    """Make control strings in ``text`` inert: a backslash inside each, every backslash doubled before."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<)(/?[sn]>)|(\[)(/?INST\])", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(<)\\(/?[sn]>)|(\[)\\(/?INST\])", r"$1$3$2$4"), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def format_chats(chats: DataFrame) -> DataFrame:
    """Add segments array<struct<text, loss>> and formatted string, for rows with turns.

    A turn is ``<s>role\\ntext</s>``, within ``[INST] `` and ``[/INST]`` unless the
    assistant speaks. Only the assistant's texts are under the loss mask. No
    turns give an empty string. Null roles and texts count as empty. Columns of ``chats`` named segments or formatted
    are replaced; repeated rows stay; an empty table gives no rows. Very long texts are formatted whole.
    """

    def pieces(x):
        role, text = F.coalesce(x["role"], F.lit("")), F.coalesce(x["text"], F.lit(""))
        own = role == "assistant"
        seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(BOS), F.when(own, F.lit("")).otherwise(F.lit(OPEN + " ")), _escape_role(role), F.lit("\n")), F.lit(False)),
            seg(escape(text), own),
            seg(F.concat(F.when(own, F.lit("")).otherwise(F.lit(CLOSE)), F.lit(EOS)), F.lit(False)),
        )

    out = chats.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chats(formatted: Column) -> Column:
    """The turns that a formatted string holds."""

    def turn(x):
        bare = F.regexp_replace(x, r"^<s>(\[INST\] )?", "")
        bare = F.when(x.startswith(BOS + OPEN), F.regexp_replace(bare, r"\[/INST\]$", "")).otherwise(bare)
        head = F.substring_index(bare, "\n", 1)
        return F.struct(_unescape_role(head).alias("role"), unescape(F.substring(bare, F.length(head) + 2, F.length(bare))).alias("text"))

    return F.transform(F.filter(F.split(formatted, EOS, -1), lambda x: x != ""), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
