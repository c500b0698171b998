"""Chat formatting of heterogeneous conversation layouts, in DataFrame functions only.

A *layout* declares which nested field paths hold what: single fields that are
one turn each (prompt / completion, instruction / input / output, question /
answer), an array of messages with a role and a text field, or, in a table with
one row per turn, the conversation, turn number, role and text. The declared
paths that a record has are sorted and hashed; this fingerprint selects the
mapping that turns the record into canonical turns, ``array<struct<role, text>>``.
For a table whose columns alone settle it, the fingerprint is taken from the
schema; otherwise (a union schema, or JSON text) from each record.

``formatted`` writes every turn as::

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts and roles one backslash is put between ``<`` and ``|`` wherever
``<``, any backslashes and ``|`` follow each other, so no control string
survives, and taking that backslash out restores the text exactly. Roles also
carry ``%`` and line breaks as ``%25`` and ``%0A``. ``loss_spans`` are the code
point spans of the assistants' texts.

Defined cases: null texts and roles read as empty; a record of an unknown
layout has a null ``layout`` and no turns; turns of one number are ordered by
role, then text; repeated rows are turns of their own; a null conversation id
is a conversation; other columns are ignored, whatever their names (``with_format``
keeps them); an empty table gives no rows; very long texts are taken whole.

A conversation is one output record, so its turns meet in one row, which costs
time in proportion to them; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkflow.llm.common import private_name

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"
SPANS = "array<struct<start: int, length: int>>"


@dataclass(frozen=True)
class Layout:
    """``fields``: (role, path, whether it must be there); ``messages``: (array, role path, text path).

    ``rows``: (conversation, turn, role, text) of a table with one row per turn.
    """
    name: str
    fields: tuple[tuple[str, str, bool], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    def needed(self) -> list[str]:
        own = [p for _, p, must in self.fields if must]
        return own + ([f"{self.messages[0]}[].{x}" for x in self.messages[1:]] if self.messages else []) + [*(self.rows or ())]

    def optional(self) -> list[str]:
        return [p for _, p, must in self.fields if not must]


_SYSTEM = ("system", "system", False)
LAYOUTS = (
    Layout("messages", (_SYSTEM,), ("messages", "role", "content")),
    Layout("share", (_SYSTEM,), ("conversations", "from", "value")),
    Layout("prompt_completion", (_SYSTEM, ("user", "prompt", True), ("assistant", "completion", True))),
    Layout("prompt_response", (_SYSTEM, ("user", "prompt", True), ("assistant", "response", True))),
    Layout("instruction_output", (_SYSTEM, ("user", "instruction", True), ("user", "input", False),
                                  ("assistant", "output", True))),
    Layout("question_answer", (_SYSTEM, ("user", "question", True), ("assistant", "answer", True))),
)
#: Layouts of whole tables; only a table's schema selects them, when its columns make up no other layout.
ROW_LAYOUTS = (Layout("turn_rows", rows=("conv_id", "turn", "role", "text")),)
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

KNOWN_PATHS = sorted({p for x in LAYOUTS for p in x.needed() + x.optional()})
ROW_PATHS = sorted({p for x in ROW_LAYOUTS for p in x.needed()})


def fingerprint(paths) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _fingerprints() -> dict[str, Layout]:
    out: dict[str, Layout] = {}
    for x in LAYOUTS + ROW_LAYOUTS:
        some = x.optional()
        for chosen in chain.from_iterable(combinations(some, k) for k in range(len(some) + 1)):
            out[fingerprint([*x.needed(), *chosen])] = x
    return out


FINGERPRINTS = _fingerprints()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a type; array elements are written ``[]``."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{dot}{f.name}")]
    return [prefix]


def _top(path: str) -> str:
    return path.split("[]")[0]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    low = F.lower(_text(c))
    out = low
    for other, role in ROLE_NAMES.items():
        out = F.when(low == other, F.lit(role)).otherwise(out)
    return out


def _turns(layout: Layout, present: set[str], field) -> Column:
    """The canonical turns of a record of ``layout``; ``field`` gives a column by top-level name."""
    single = [(role, p) for role, p, must in layout.fields if must or p in present]
    parts = []
    if single:
        own = F.array(*[F.struct(F.lit(role).alias("role"), _text(field(p)).alias("text"),
                                 field(p).isNotNull().alias("there")) for role, p in single])
        must = {p for _, p, m in layout.fields if m}
        keep = F.array(*[F.lit(p in must) for _, p in single])
        kept = F.filter(F.zip_with(own, keep, lambda t, k: F.struct(
            t["role"].alias("role"), t["text"].alias("text"), (k | t["there"]).alias("there"))),
            lambda t: t["there"])
        parts.append(F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    if layout.messages:
        name, role, text = layout.messages
        listed = F.coalesce(field(name), F.array())
        parts.append(F.transform(listed, lambda m: F.struct(
            _role(m[role]).alias("role"), _text(m[text]).alias("text"))))
    return F.concat(*parts).cast(TURNS)


def with_turns(records: DataFrame, within: str | None = None) -> DataFrame:
    """``records`` plus ``layout`` and ``turns``; ``within``: a struct column that holds the fields.

    Existing columns of these two names are replaced. Of a table with one row
    per turn: one row per conversation, with its id, ``layout`` and ``turns``.
    """
    kind = records.schema[within].dataType if within else records.schema
    field = (lambda n: F.col(within)[n]) if within else (lambda n: F.col(f"`{n}`"))
    paths = set(schema_paths(kind))
    known = set(KNOWN_PATHS) & paths
    whole = FINGERPRINTS.get(fingerprint(known))
    if within is None and not any(set(x.needed()) <= known for x in LAYOUTS):
        whole = FINGERPRINTS.get(fingerprint(set(ROW_PATHS) & paths))
    if whole is not None and whole.rows:
        return from_turn_rows(records, *whole.rows).withColumn("layout", F.lit(whole.name))
    if whole is not None:
        layout, turns = F.lit(whole.name), _turns(whole, known, field)
    else:
        found = F.concat_ws(",", *[F.when(field(_top(p)).isNotNull(), F.lit(p)) for p in sorted(known)])
        print_of = F.sha2(found, 256)
        layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
        for value, x in FINGERPRINTS.items():
            if set(x.needed()) <= known:
                layout = F.when(print_of == value, F.lit(x.name)).otherwise(layout)
        for x in LAYOUTS:
            if set(x.needed()) <= known:
                turns = F.when(layout == x.name, _turns(x, known, field)).otherwise(turns)
    return records.withColumns({"layout": layout, "turns": turns})


def record_schema() -> T.StructType:
    """All declared paths as one type, for reading JSON records."""
    fields: dict[str, T.DataType] = {}
    for x in LAYOUTS:
        for _, p, _ in x.fields:
            fields[p] = T.StringType()
        if x.messages:
            name, role, text = x.messages
            fields[name] = T.ArrayType(T.StructType([T.StructField(role, T.StringType()),
                                                     T.StructField(text, T.StringType())]))
    return T.StructType([T.StructField(n, t) for n, t in sorted(fields.items())])


def from_json_records(records: DataFrame, column: str) -> DataFrame:
    """``records`` with one JSON object of any declared layout per row, plus ``layout`` and ``turns``."""
    tmp = private_name(records, "_record")
    parsed = records.withColumn(tmp, F.from_json(F.col(column), record_schema()))
    return with_turns(parsed, tmp).drop(tmp)


def from_turn_rows(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation from one row per turn: ``conversation`` and ``turns`` in order."""
    one = F.struct(F.col(turn).alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
    grouped = rows.select(F.col(conversation).alias(conversation), one.alias("one")) \
        .groupBy(conversation).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def with_format(records: DataFrame, turns: str = "turns") -> DataFrame:
    """``records`` plus ``formatted`` and ``loss_spans`` (existing columns of these names are replaced)."""
    safe = F.transform(F.col(turns), lambda t: F.struct(
        t["role"].alias("plain"), _escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    head = len(START) + 1
    tail = len(END) + 1
    block = 512

    def step(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.lit(head) + F.char_length(t["role"])
        span = F.struct(start.alias("start"), F.char_length(t["text"]).alias("length"))
        return F.struct(
            (start + F.char_length(t["text"]) + F.lit(tail)).cast("int").alias("at"),
            F.when(t["plain"] == "assistant", F.array_append(so_far["spans"], span))
             .otherwise(so_far["spans"]).cast(SPANS).alias("spans"))

    def step_block(so_far: Column, turns_of_block: Column) -> Column:
        """A block's spans in an array of their own: appending copies an array, so none may grow with the turns."""
        begin = F.struct(so_far["at"].alias("at"), F.array().cast(SPANS).alias("spans"))
        done = F.array(F.aggregate(turns_of_block, begin, step))
        return F.element_at(F.transform(done, lambda d: F.struct(
            d["at"].alias("at"), F.array_append(so_far["blocks"], d["spans"]).alias("blocks"))), 1)

    held = private_name(records, "_safe_turns")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(block)), lambda i: i <= F.size(held))
    blocks = F.transform(starts, lambda i: F.slice(held, i, F.lit(block)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("blocks"))
    out = records.withColumn(held, safe)
    return out.withColumns({
        "formatted": F.array_join(F.transform(held, lambda t: F.concat(
            F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), ""),
        "loss_spans": F.aggregate(blocks, none, step_block, lambda x: F.flatten(x["blocks"])).cast(SPANS),
    }).drop(held)


def turns_of(formatted: Column) -> Column:
    """The turns, read back from formatted text."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    written = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        n = F.char_length(piece) - F.char_length(role) - F.lit(1 + len(END) + 1)
        return F.struct(_unescaped_role(role).alias("role"),
                        unescaped(piece.substr(F.char_length(role) + 2, n)).alias("text"))

    return F.transform(written, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    Taking a part of a text walks to its start, so the spans are read in blocks,
    each from the stretch of text that it lies in.
    """
    block = 128
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(block)), lambda i: i <= F.size(spans))

    def read(own: Column) -> Column:
        first, last = F.element_at(own, 1)["start"], F.element_at(own, -1)
        stretch = F.array(formatted.substr(first + 1, last["start"] + last["length"] - first))
        return F.element_at(F.transform(stretch, lambda text: F.array_join(F.transform(own, lambda s: unescaped(
            text.substr(s["start"] - first + 1, s["length"]))), "")), 1)

    return F.array_join(F.transform(starts, lambda i: F.element_at(F.transform(
        F.array(F.slice(spans, i, F.lit(block))), read), 1)), "")
