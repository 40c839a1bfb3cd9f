"""Chat formatting in DataFrame functions alone: schema fingerprints choose the mapping of each record to canonical turns.

A record is a JSON object in one of many layouts. Its fingerprint is the SHA-256 of its nested field paths, scalar types left out.
Fields that hold no text, and those known to be metadata (``METADATA``), don't count where no mapping reads them; any other field that no
mapping reads makes the layout an unknown one, so that no turn is lost unseen. A registry maps fingerprints to declarative
mappings (where the turns are, which field is the role, which the text). The fingerprints of a mapping are generated from its
required and optional fields. A turn's text may be an array of parts: it is then their texts, one after another, and parts of
other kinds are left out. ``left_out`` names the fields of a record that its mapping doesn't read.

Variants hold no text over 20 M characters and 128 MiB in all. Records of more than ``LONG`` bytes are therefore fingerprinted
by their shape (keys cut, texts emptied, like elements in a row made one) and their fields read with a schema; scalars
that are no texts are given there as they are written, and a record with texts in parts is of an unknown layout there.

Formatted: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Roles are percent-encoded in the header. Within texts each control
string gets a backslash after its first character, besides those that were there already, so that taking one away gives
the text back. The loss mask is a list of runs, three for each turn (header, text, end), with their lengths in code points; the
texts of assistant turns are under it.

Defined results: a record that is null, no JSON object or of an unknown layout has layout, turns and formatted text null; null
texts and roles are empty; a conversation's turns are sorted by turn (null first), role and text, rows that repeat included; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import fenced

START, END = "<|im_start|>", "<|im_end|>\n"
#: Bytes of a record up to which it is read as a variant.
LONG = 16 << 20
_CORRUPT = "__fernway_corrupt"

# What makes a control string after its first character.
_LEAD, _REST = r"[<\[]", r"/?s>|\||</?SYS>>|/?INST\]"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    With ``turns``, that field is an array of objects with fields ``role`` and ``text``, and ``roles`` renames roles; a ``system`` text
    comes before them, and the array ``then`` or the assistant's text ``last`` after them. Else ``fields`` lists (role, field, ...) in the
    order of the turns; the texts of several fields, but empty ones, are joined by an empty line. ``turns`` may be a path of names with dots
    between. ``ignored``: fields with text that are known not to be turns.
    """

    layout: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, ...], ...] = ()
    then: str = ""
    last: str = ""
    ignored: tuple[str, ...] = ()

    @property
    def arrays(self) -> tuple[str, ...]:
        return tuple(x for x in (self.turns, self.then) if x)

    @property
    def scalars(self) -> tuple[str, ...]:
        return (*self.required, *self.optional, *([self.last] if self.last else []), *self.ignored)

    @property
    def names(self) -> set[str]:
        """All field names that the mapping knows, at whatever depth."""
        return {x for path in (*self.scalars, *self.arrays, self.role, self.text) for x in path.split(".") if x}


# Layouts in use.
_HUMAN = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", optional=("system",), turns="messages", role="role", text="content"),
    Mapping("conversations", optional=("system",), turns="conversations", role="from", text="value", roles=_HUMAN),
    Mapping("prompt-messages", turns="prompt", role="role", text="content", then="completion"),
    Mapping("prompt-messages", turns="prompt", role="role", text="content", last="completion"),
    Mapping("prompt-messages", turns="prompt", role="role", text="content", last="response"),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), fields=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("prompt-completion", ("prompt", "completion"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", ("prompt", "response"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question-answer", ("question", "answer"), ("context",), fields=(("user", "context", "question"), ("assistant", "answer"))),
    Mapping("query-response", ("query", "response"), ("system",), fields=(("system", "system"), ("user", "query"), ("assistant", "response"))),
    Mapping("preference", ("prompt", "chosen"), ("system",), fields=(("system", "system"), ("user", "prompt"), ("assistant", "chosen")), ignored=("rejected",)),
    Mapping("conversation", optional=("system",), turns="conversation", role="role", text="content"),
    Mapping("conversation", optional=("system",), turns="conversation", role="from", text="value", roles=_HUMAN),
    Mapping("dialog", turns="dialog", role="speaker", text="text", roles=_HUMAN),
    Mapping("dialogue", turns="dialogue", role="speaker", text="text", roles=_HUMAN),
    Mapping("messages", optional=("system",), turns="data.messages", role="role", text="content"),
)

#: Names of fields that describe a record or a turn.
METADATA = (
    *("author", "category", "conv_id", "conversation_id", "created", "created_at", "dataset", "date", "hash", "id", "idx", "index", "kind", "lang", "language", "license", "meta", "message_id", "metadata", "model"),
    *("name", "origin", "quality", "rating", "score", "source", "split", "tags", "time", "timestamp", "title", "topic", "type", "url", "user_id", "uuid", "version", "weight"),
)


def _tree(fields: Sequence[str]) -> str:
    return f"OBJECT<{', '.join(sorted(fields))}>"


def _at_path(path: str, tree: str) -> str:
    """A field of the tree at the end of the path."""
    *outer, last = path.split(".")
    found = f"{last}: {tree}"
    for name in reversed(outer):
        found = f"{name}: {_tree((found,))}"
    return found


def fingerprints_of(mapping: Mapping) -> dict[str, bool]:
    """Those of the mapping's records, and whether texts are in parts there: the required fields with each choice of the optional ones."""
    kinds = {"": False, ": PARTS": True, ": VARIANT": True}
    inner = {f"ARRAY<{_tree((mapping.role, mapping.text + kind))}>": rich for kind, rich in kinds.items()} | {"ARRAY<>": False}
    always = [*mapping.required, *([mapping.last] if mapping.last else [])]
    optional = (*mapping.optional, *mapping.ignored)
    found = {}
    for n in range(len(optional) + 1):
        for some in combinations(optional, n):
            for arrays in product(inner, repeat=len(mapping.arrays)):
                tree = _tree((*always, *some, *(_at_path(name, x) for name, x in zip(mapping.arrays, arrays, strict=True))))
                found[hashlib.sha256(tree.encode()).hexdigest()] = any(inner[x] for x in arrays)
    return found


_NESTED = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*+>)*+>)*+>"
#: Marks of types with text while a tree is made smaller.
_STRING, _VARIANT = "\u0001", "\u0002"


def fingerprint(record: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """SHA-256 of the tree of a variant's fields, but those that no mapping reads and that hold no text or are metadata; scalar types left out."""
    scalar = r"(?:VOID|BOOLEAN|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+, ?\d+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID)"
    texts = "|".join(sorted({m.text for m in mappings if m.turns}))
    known = "|".join(sorted({x for m in mappings for x in m.names}))
    bare = _NESTED.replace("[^<>]", f"[^<>{_STRING}{_VARIANT}]")
    field = r"(?:`(?:[^`]|``)*+`|[^<>,:`]++)"
    of_others = rf"{field}: (?:{scalar}|(?:ARRAY|OBJECT){bare})"
    of_metadata = rf"(?:{'|'.join(METADATA)}): (?:{scalar}|{_STRING}|{_VARIANT}|(?:ARRAY|OBJECT){_NESTED})"
    tree = F.regexp_replace(F.schema_of_variant(record), rf"([<, ])({texts}): ARRAY{_NESTED}", "$1$2: PARTS")
    tree = F.regexp_replace(F.regexp_replace(tree, r"(: |ARRAY<)STRING(?=[,>])", f"$1{_STRING}"), r"(: |ARRAY<)VARIANT(?=[,>])", f"$1{_VARIANT}")
    for _ in range(3):  # each takes out what is nested three deep
        tree = F.regexp_replace(tree, rf"([<,]) ?+(?!(?:{known})[:,>])(?:{of_metadata}|{of_others})(?=[,>])", "$1")
    tree = F.regexp_replace(F.regexp_replace(tree, r",(?=[,>])", ""), r"<,+ ?", "<")
    tree = F.regexp_replace(tree, rf"ARRAY<(?:{scalar}|{_STRING}|{_VARIANT})>", "ARRAY<>")
    tree = F.regexp_replace(F.regexp_replace(tree, rf": (?:{scalar}|{_STRING})(?=[,>])", ""), _VARIANT, "VARIANT")
    return F.sha2(tree.cast("binary"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _shape(record: Column) -> Column:
    """The record with escapes taken out, keys cut, texts emptied and runs of like elements made one: of the same fingerprint, and short."""
    bare = F.regexp_replace(record, r"(?s)\\.", "")
    empty = F.regexp_replace(bare, r'"([^"]{0,32})[^"]*"(?=\s*:)|"[^"]*"', '"$1"')
    return F.regexp_replace(empty, r"(\{[^{}\[\]]*\}\s*,\s*)\1+", "$1")


def _schema(mapping: Mapping) -> str:
    """Of the mapping's records, for a parser without a limit on texts."""
    fields = [f"`{x}` string" for x in mapping.scalars]
    for path in mapping.arrays:
        top, *inner = path.split(".")
        kind = f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>"
        for name in reversed(inner):
            kind = f"struct<`{name}`:{kind}>"
        fields.append(f"`{top}` {kind}")
    return ", ".join([*fields, f"`{_CORRUPT}` string"])


def _field(parsed: Column, path: str) -> Column:
    for name in path.split("."):
        parsed = parsed[name]
    return parsed


def _text_of(content: Column) -> Column:
    """The text of a variant that is a text or an array of parts."""
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.try_variant_get(p, "$.text", "string"))
    parts = F.array_join(F.array_compact(F.transform(F.try_variant_get(content, "$", "array<variant>"), part)), "")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), parts).otherwise(F.try_variant_get(content, "$", "string"))


def _turns(mapping: Mapping, get: Callable[[str, str], Column], rich: bool = False) -> Column:
    """``get`` gives a record's field as a type; ``rich``: texts may be in parts."""
    if mapping.turns:

        def named(role: Column) -> Column:
            for old, new in mapping.roles:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return role

        def turns_in(name: str) -> Column:
            found = get(name, f"array<struct<`{mapping.role}`:string,`{mapping.text}`:{'variant' if rich else 'string'}>>")
            return F.transform(found, lambda t: _turn(named(t[mapping.role]), _text_of(t[mapping.text]) if rich else t[mapping.text]))

        found = [turns_in(x) for x in mapping.arrays]
        if "system" in mapping.optional:
            system = get("system", "string")
            found.insert(0, F.when(system.isNotNull(), F.array(_turn(F.lit("system"), system))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
        if mapping.last:
            found.append(F.array(_turn(F.lit("assistant"), get(mapping.last, "string"))))
        return F.concat(*found)
    turns = []
    for role, *fields in mapping.fields:
        texts = [get(f, "string") for f in fields]
        turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts]).alias("text"))
        turns.append(turn if set(fields) & set(mapping.required) else F.when(texts[0].isNotNull(), turn))
    return F.array_compact(F.array(*turns))


def canonical(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Every row with its record's layout, its turns, an array of (role, text), and the names of its fields that are left out."""
    known = {f: f"{k}{'+' if rich else ''}" for k, m in enumerate(mappings) for f, rich in fingerprints_of(m).items()}
    chosen = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    long = F.octet_length(record) > LONG
    df = records.withColumn("__fernway_v", F.try_parse_json(F.when(long, _shape(F.col(record))).otherwise(F.col(record))))
    df = df.withColumn("__fernway_m", fenced(F.try_element_at(chosen, F.coalesce(fingerprint(F.col("__fernway_v"), mappings), F.lit("")))))
    df = df.withColumn("__fernway_m", F.when(~long | ~F.col("__fernway_m").endswith("+"), F.col("__fernway_m")))
    turns = layout = None
    for k, m in enumerate(mappings):
        plain, rich, name = F.col("__fernway_m") == str(k), F.col("__fernway_m") == f"{k}+", f"__fernway_{k}"
        parsed = F.from_json(F.col(record), _schema(m), {"maxStringLen": str((1 << 31) - 1), "columnNameOfCorruptRecord": _CORRUPT})
        df = df.withColumn(name, fenced(F.when(plain & long, parsed)))
        get = lambda f, t: F.try_variant_get(F.col("__fernway_v"), f"$.{f}", t)
        whole = F.when(F.col(name)[_CORRUPT].isNull(), _turns(m, lambda f, _, name=name: _field(F.col(name), f)))
        found = F.when(long, whole).otherwise(_turns(m, get))
        turns = F.when(plain, found) if turns is None else turns.when(plain, found)
        layout = F.when(plain | rich, m.layout) if layout is None else layout.when(plain | rich, m.layout)
        if m.turns:
            turns = turns.when(rich, _turns(m, get, rich=True))
    df = df.withColumn("turns", fenced(turns))
    # A long record of a known shape that does not parse is broken; one that does has turns, or null for them.
    broken = F.coalesce(*[F.col(f"__fernway_{k}")[_CORRUPT] for k in range(len(mappings))]).isNotNull()
    df = df.withColumn("layout", F.when(~broken, layout))
    reads = None
    for k, m in enumerate(mappings):
        top = F.array(*[F.lit(x) for x in sorted({p.split(".")[0] for p in (*m.scalars, *m.arrays)} - set(m.ignored))])
        chosen_here = F.col("__fernway_m").isin(str(k), f"{k}+")
        reads = F.when(chosen_here, top) if reads is None else reads.when(chosen_here, top)
    df = df.withColumn("left_out", F.when(F.col("layout").isNotNull(), F.array_sort(F.array_except(F.json_object_keys(F.col(record)), reads))))
    return df.drop("__fernway_v", "__fernway_m", *[f"__fernway_{k}" for k in range(len(mappings))])


def escaped(text: Column) -> Column:
    """The text without control strings; :func:`unescaped` gives it back."""
    return F.regexp_replace(text, rf"({_LEAD})(\\*)({_REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, rf"({_LEAD})\\(\\*)({_REST})", "$1$2$3")


def formatted(turned: DataFrame) -> DataFrame:
    """Every row with ``formatted`` and ``loss_mask``, an array of runs (length, loss), from ``turns``."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    df = turned.withColumn("__fernway_p", fenced(parts))
    no = F.lit(False)
    runs = F.transform(
        "__fernway_p",
        lambda p: F.array(
            F.struct(F.length(p["head"]).alias("length"), no.alias("loss")),
            F.struct(F.length(p["text"]).alias("length"), p["loss"].alias("loss")),
            F.struct(F.lit(len(END)).alias("length"), no.alias("loss")),
        ),
    )
    whole = F.array_join(F.transform("__fernway_p", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return df.withColumns({"formatted": whole, "loss_mask": F.flatten(runs)}).drop("__fernway_p")


def read_back(df: DataFrame) -> DataFrame:
    """Every row with ``read_turns`` (role, text) and ``loss_text``, read from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    df = df.withColumn("__fernway_all", fenced(pieces)).withColumn("__fernway_parts", fenced(F.expr("slice(__fernway_all, 1, greatest(size(__fernway_all) - 1, 0))"))).drop("__fernway_all")
    at = F.lit(len(START) + 1)
    turns = F.transform(
        "__fernway_parts",
        lambda p: F.struct(
            F.url_decode(F.substring(F.substring_index(p, "\n", 1), at, F.length(p))).alias("role"),
            unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )
    under = F.transform("__fernway_parts", lambda p, i: F.when(F.get("loss_mask", 3 * i + 1)["loss"], unescaped(F.substring(p, F.get("loss_mask", 3 * i)["length"] + 1, F.get("loss_mask", 3 * i + 1)["length"]))).otherwise(F.lit("")))
    return df.withColumns({"read_turns": turns, "loss_text": F.array_join(under, "")}).drop("__fernway_parts")


def message_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows by turn (conv_id, turn, role, text) of each conversation as a JSON object of messages."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(records: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Every row with layout, turns, left_out, formatted and loss_mask."""
    return formatted(canonical(records, record, mappings))
