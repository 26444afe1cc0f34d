"""Chat formatting by schema fingerprints, in native expressions only.

A record is JSON text of some layout: a message list, a prompt with its completion, an
instruction with input and output, a preference pair, and others. Its fingerprint is the hash of
those of its nested field paths that any layout speaks of, sorted: ``messages[]`` is a list,
``messages[].role`` a field of its items, ``messages[].content[]`` a list or a mixed value there,
``prompt`` a plain value. Other paths (ids, scores, rejected answers) don't count. Each layout
declares the paths that a record must have, those that it may have, and how turns follow from
them; it is selected by fingerprint, not by trial: layouts stand in an order, and the first one takes
the record for which the hash of those paths that it speaks of is one of its own. So a message list
beside a plain ``completion``, or an ``output`` beside a ``response``, is read by the first one and the
other field is left out.

The template marks turns with ``<|im_start|>role`` and ``<|im_end|>``. In texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark, and undoing the two in
reverse order gives back every text. Roles are escaped by percent codes. ``human`` and ``gpt`` become
user and assistant in lists that name roles ``from``; in others roles stay as they are.

Defined cases: null roles and texts are empty; a conversation's rows are ordered by turn,
then role, then text; repeated rows are repeated turns; a null conversation id is an id of
its own; an empty list has no turns; a record of an unknown layout or that is no JSON has null
turns and keeps its fingerprint; texts of any length and any number of turns are kept whole,
within a row's 128 MB of variant; an empty table gives no rows; other columns of the turns table
are ignored; ``format_records`` keeps a record's other columns, but replaces those that carry a
name of its output (fingerprint, turns, formatted, loss_spans).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import pieces, running
from .shared import fresh

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
TURNS = "array<struct<role:string,text:string>>"
ROLE_NAMES = (("human", "user"), ("gpt", "assistant"))


@dataclass(frozen=True)
class Text:
    """A turn of ``role``: the fields' texts that aren't empty, a blank line between; without
    any text it is left out where it is ``optional``."""

    role: str
    fields: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Items:
    """The turns of a list's items: their role and text have one of these names. ``after``: turns
    that go before them where the list starts with the assistant."""

    field: str
    role: tuple[str, ...] = ("role",)
    text: tuple[str, ...] = ("content",)
    after: tuple[Text, ...] = ()

    def paths(self) -> tuple[str, ...]:
        return (*(f"{self.field}[].{n}" for n in (*self.role, *self.text)), *(f"{self.field}[].{n}[]" for n in self.text))


@dataclass(frozen=True)
class Pairs:
    """Earlier rounds as pairs of a user's and an assistant's text."""

    field: str


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Text | Items | Pairs, ...]

    def paths(self) -> tuple[str, ...]:
        return tuple(sorted((*self.required, *self.optional)))

    def spoken(self, paths: Column) -> Column:
        """Those of a record's paths that this layout speaks of."""
        return F.filter(paths, lambda p: p.isin(*self.paths()))

    def fingerprints(self) -> Column:
        more = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return F.array(*(F.xxhash64(F.lit(",".join(sorted((*self.required, *c))))) for c in more))


_SYSTEM, _EARLIER = Text("system", ("system",), True), Pairs("history")
_MESSAGES, _SHARED, _ROWS = Items("messages"), Items("conversations", ("from", "role"), ("value", "content")), Items("turns", ("role",), ("text",))
_PROMPT, _COMPLETION = Items("prompt"), Items("completion")
_CHOSEN = Items("chosen", after=(Text("user", ("prompt",), True),))


def _fixed(name: str, user: tuple[str, ...], answer: str, optional: tuple[str, ...] = ()) -> Layout:
    required = tuple(f for f in (*user, answer) if f not in optional)
    return Layout(name, required, (*optional, "system", "history[]", "history[][]"), (_SYSTEM, _EARLIER, Text("user", user), Text("assistant", (answer,))))


#: In the order in which they are tried: those that need most first, lists before plain fields.
LAYOUTS = (
    Layout("prompt_completion_lists", ("prompt[]", "completion[]"), (*_PROMPT.paths(), *_COMPLETION.paths(), "system"), (_SYSTEM, _PROMPT, _COMPLETION)),
    Layout("preference_lists", ("prompt[]", "chosen[]"), (*_PROMPT.paths(), *_CHOSEN.paths(), "system"), (_SYSTEM, _PROMPT, Items("chosen"))),
    Layout("messages", ("messages[]",), (*_MESSAGES.paths(), "system", "prompt"), (_SYSTEM, _MESSAGES)),
    Layout("conversations", ("conversations[]",), (*_SHARED.paths(), "system"), (_SYSTEM, _SHARED)),
    Layout("turns", ("turns[]",), (*_ROWS.paths(), "system"), (_SYSTEM, _ROWS)),
    Layout("prompt_list", ("prompt[]",), (*_PROMPT.paths(), "system", "completion", "response", "chosen"), (_SYSTEM, _PROMPT, Text("assistant", ("completion", "response", "chosen"), True))),
    Layout("preference", ("chosen[]",), (*_CHOSEN.paths(), "system", "prompt"), (_SYSTEM, _CHOSEN)),
    _fixed("instruction", ("instruction", "input"), "output", ("input",)),
    _fixed("instruction_response", ("instruction", "input"), "response", ("input",)),
    _fixed("prompt", ("prompt",), "completion"),
    _fixed("prompt_response", ("prompt",), "response"),
    _fixed("question", ("question",), "answer"),
    _fixed("question_response", ("question",), "response"),
    _fixed("query", ("query",), "response"),
    _fixed("query_answer", ("query",), "answer"),
    _fixed("preference_text", ("prompt",), "chosen"),
)
PATHS = tuple(sorted({p for x in LAYOUTS for p in (*x.required, *x.optional)}))
FIELDS = tuple(sorted({p.split("[")[0] for p in PATHS}))


def _schema(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def field_paths(value: Column) -> Column:
    """A parsed record's field paths that layouts speak of, sorted."""
    found = []
    for field in FIELDS:
        schema = _schema(value, f"$.{field}")
        is_list = schema.startswith("ARRAY<")
        own = [p for p in PATHS if p.split("[")[0] == field]
        # The items' own fields as "name: TYPE", with what is nested in them folded up.
        inner = F.regexp_extract(schema, r"^ARRAY<OBJECT<(.*)>>$", 1)
        for _ in range(4):
            inner = F.regexp_replace(inner, r"(?:ARRAY|OBJECT)<[^<>]*>", "VARIANT")
        inner = F.concat(F.lit(", "), inner, F.lit(","))
        for p in own:
            if "[]." in p:
                name = p.split(".")[1].removesuffix("[]")
                kind = "VARIANT," if p.endswith("[]") else r"(?!VARIANT,|VOID,)"
                there = is_list & inner.rlike(rf", {name}: {kind}")
            elif p.endswith("[][]"):
                there = schema.startswith("ARRAY<ARRAY<")
            else:
                there = is_list if p.endswith("[]") else ~schema.rlike("^(?:ARRAY<|OBJECT<|VOID$)")
            found.append(F.when(there, F.lit(p)))
    return F.array_sort(F.array_compact(F.array(*found)))


def hash_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, ","))


def fingerprint(record: Column) -> Column:
    return hash_of(field_paths(F.try_parse_json(record)))


def _text_of(item: Column, names: tuple[str, ...]) -> Column:
    """The text of an item's field: a plain value, or a list's texts and ``text`` fields, a line each."""
    out = []
    for name in names:
        parts = F.try_variant_get(item, f"$.{name}", "array<variant>")
        plain = lambda p: F.when(~F.schema_of_variant(p).rlike("^(?:ARRAY<|OBJECT<|VOID$)"), F.try_variant_get(p, "$", "string"))
        texts = F.array_compact(F.transform(parts, lambda p: F.coalesce(plain(p), F.try_variant_get(p, "$.text", "string"))))
        out.append(F.when(_schema(item, f"$.{name}").startswith("ARRAY<"), F.array_join(texts, "\n")).otherwise(F.try_variant_get(item, f"$.{name}", "string")))
    return F.coalesce(*out, F.lit(""))


def _role_of(item: Column, names: tuple[str, ...]) -> Column:
    role = F.coalesce(*(F.try_variant_get(item, f"$.{n}", "string") for n in names), F.lit(""))
    if "from" not in names:
        return role
    told = role
    for a, b in ROLE_NAMES:
        told = F.when(role == a, F.lit(b)).otherwise(told)
    return told


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(value: Column, part: Text | Items | Pairs) -> Column:
    none = F.array().cast(TURNS)
    if isinstance(part, Text):
        text = F.concat_ws("\n\n", *(F.nullif(F.try_variant_get(value, f"$.{f}", "string"), F.lit("")) for f in part.fields))
        own = F.array(_turn(F.lit(part.role), text)).cast(TURNS)
        return F.when(text != "", own).otherwise(none) if part.optional else own
    if isinstance(part, Pairs):
        pairs = F.try_variant_get(value, f"$.{part.field}", "array<array<string>>")
        both = F.transform(pairs, lambda p: F.array(*(_turn(F.lit(r), F.coalesce(F.get(p, F.lit(k)), F.lit(""))) for k, r in enumerate(("user", "assistant")))))
        return F.coalesce(F.flatten(both).cast(TURNS), none)
    items = F.try_variant_get(value, f"$.{part.field}", "array<variant>")
    turns = F.coalesce(F.transform(items, lambda x: _turn(_role_of(x, part.role), _text_of(x, part.text))).cast(TURNS), none)
    for before in part.after:
        turns = F.concat(F.when(F.get(turns, F.lit(0))["role"] == "assistant", _turns(value, before)).otherwise(none), turns)
    return turns


def canonical(value: Column, paths: Column) -> Column:
    """The turns of a parsed record with these field paths, by the first layout that takes it."""
    out = F.lit(None).cast(TURNS)
    for layout in reversed(LAYOUTS):
        turns = F.concat(*(_turns(value, part) for part in layout.turns))
        out = F.when(F.array_contains(layout.fingerprints(), hash_of(layout.spoken(paths))), turns).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit(BREAK), escape(t["text"]), F.lit(END + BREAK))), "")


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted conversation, with their texts' bounds in it."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    tail = len(END + BREAK)

    def step(before: Column, part: Column) -> Column:
        role, at = F.substring_index(part, BREAK, 1), before["at"] + len(START)
        end = at + F.length(part)
        return F.struct(end.alias("at"), _unescape_role(role).alias("role"), (at + F.length(role) + 1).alias("start"), (end - tail).alias("end"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("role"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    turns = running(parts, zero, step, "struct<at:int,role:string,start:int,end:int>")
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["start"].alias("start"), t["end"].alias("end")))


def format_records(records: DataFrame, record: str = "record", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``records`` with fingerprint, turns, formatted and loss_spans (bounds of the texts that
    the loss covers, in code points of ``formatted``)."""
    made = ("fingerprint", "turns", "formatted", "loss_spans")
    v, paths = fresh(records, "__value", "__paths")
    kept = [n for n in records.columns if n not in made]
    out = records.select(*kept, F.try_parse_json(record).alias(v))
    out = out.withColumn(paths, field_paths(F.col(v))).withColumn("fingerprint", hash_of(F.col(paths)))
    out = out.withColumn("turns", canonical(F.col(v), F.col(paths))).withColumn("formatted", render(F.col("turns")))
    spans = F.transform(F.filter(parse(F.col("formatted")), lambda t: t["role"].isin(*loss_roles)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return out.select(*kept, *made[:3], spans.alias("loss_spans"))


def turns_to_records(rows: DataFrame, layouts: tuple[str, ...] = ("turns",)) -> DataFrame:
    """conv_id and record of a table with a row for each turn. With several ``layouts`` (of turns,
    messages, conversations and prompt_response) a hash of the id picks one of those that can
    hold the conversation as it is; the first one must hold any."""
    item = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("own"))
    named = lambda role, text, field: F.to_json(F.struct(F.transform("own", lambda t: F.struct(_foreign(t["role"], role).alias(role), t["text"].alias(text))).alias(field)))
    roles = F.transform("own", lambda t: t["role"])
    as_json = {
        "turns": (F.lit(True), named("role", "text", "turns")),
        "messages": (F.lit(True), named("role", "content", "messages")),
        "conversations": (~F.arrays_overlap(roles, F.array(*(F.lit(a) for a, _ in ROLE_NAMES))), named("from", "value", "conversations")),
        "prompt_response": (roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(F.col("conv_id").alias("id"), F.col("own")[0]["text"].alias("prompt"), F.get("own", F.lit(1))["text"].alias("response")))),
    }
    out = as_json[layouts[0]][1]
    for k, name in enumerate(layouts[1:], 1):
        can, text = as_json[name]
        out = F.when((F.pmod(F.xxhash64("conv_id"), F.lit(len(layouts))) == k) & can, text).otherwise(out)
    return own.select("conv_id", out.alias("record"))


def _foreign(role: Column, name: str) -> Column:
    """A role by the name that lists with a ``from`` field have for it."""
    if name != "from":
        return role
    told = role
    for a, b in ROLE_NAMES:
        told = F.when(role == b, F.lit(a)).otherwise(told)
    return told


def cut(formatted: Column, spans: Column) -> Column:
    """The texts of spans of a formatted conversation, unescaped."""
    bounds = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))
    return F.transform(pieces(formatted, bounds), unescape)


def digests(formatted: DataFrame) -> DataFrame:
    text = F.col("formatted")
    (own,) = fresh(formatted, "__read")
    read = formatted.withColumn(own, parse(text))
    told = F.array_join(F.transform(F.arrays_zip(F.col(own).alias("turn"), cut(text, F.col(own)).alias("text")), lambda t: F.concat(t["turn"]["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(cut(text, F.col("loss_spans")), "")
    return read.select(
        "conv_id",
        F.size(own).cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    )
