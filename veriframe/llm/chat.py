"""Chat formatting: schema fingerprints choose a mapping to canonical turns, a template marks them.

The nested field paths of every distinct schema of a table, whatever their depth, are hashed; each
fingerprint is looked up in declarative layouts, and records follow their schema. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from .common import let, materialise, row_key, running_offsets

TURNS = "array<struct<role:string,text:string>>"
#: The template's control strings and what stands for them inside texts. Every backslash of a text
#: becomes \b first, so a backslash is always followed by one of these letters and reading back is exact.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
OPEN, CLOSE = "### ", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """How one shape of record maps to turns.

    Either items, the name of a list with a role and a text for each turn ("" where the record itself is that
    list), or parts: roles, each with the
    names of fields whose texts, joined by a blank line, make one turn. needed are the fields that must be
    there; the other ones may be absent. roles renames roles."""

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    needed: tuple[str, ...] = ()


#: Where a record has the fields of several layouts, the first of these is taken: lists of turns hold all
#: of a talk, and fields beside them repeat a part of it.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("list", items="", role="role", text="content"),
    Layout("turn_rows", items="turns", role="role", text="text"),
    Layout("from_value", items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), needed=("instruction", "output")),
    Layout("prompt_completion", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), needed=("prompt", "completion")),
    Layout("prompt_response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), needed=("prompt", "response")),
    Layout("question_answer", parts=(("user", ("context", "question")), ("assistant", ("answer",))), needed=("question", "answer")),
)
#: Objects that a layout's fields may stand in, besides the record itself.
WRAPPERS = ("", "data", "record", "example", "sample", "conversation", "row")

#: Schemas that are sent to all tasks; more are joined by shuffle, where one with over one in HOT_SHARE
#: records is dealt over parts.
LISTED, HOT_SHARE = 10_000, 1000

#: Tokens of a schema as schema_of_variant writes it: a field's name, the start and end of an object or a
#: list, and a plain value's kind.
TOKEN = r"`(?:[^`]|``)*`:|[^\s:<>,`]+:|OBJECT<|ARRAY<|>|[A-Z]+"


def field_paths(schema: Column) -> Column:
    """Sorted nested field paths of a schema: a.b for a field in an object, a[] for a list, a[]* for what
    it holds that is no object or list, or is of mixed kinds.

    Plain values of whatever kind give their path; nulls give none, so a field that is null is absent; an
    empty object or list gives its own path. Names with dots or brackets are kept in backquotes."""
    kind = "struct<stack:array<string>,name:string,paths:array<string>>"
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths")).cast(kind)

    def step(s: Column, token: Column) -> Column:
        top = F.element_at(s["stack"], F.lit(-1))
        here = lambda name: F.when((top == "") | (name == ""), F.concat(top, name)).otherwise(F.concat_ws(".", top, name))
        value = F.when(s["name"] == "", F.concat(top, F.lit("*"))).otherwise(here(s["name"]))
        opened = lambda path: F.struct(F.array_append(s["stack"], path).alias("stack"), F.lit("").alias("name"), F.array_append(s["paths"], path).alias("paths"))
        return (
            F.when(token.endswith(":"), F.struct(s["stack"].alias("stack"), plain(token).alias("name"), s["paths"].alias("paths")))
            .when(token == "OBJECT<", opened(here(s["name"])))
            .when(token == "ARRAY<", opened(F.concat(here(s["name"]), F.lit("[]"))))
            .when(token == ">", F.struct(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1).alias("stack"), F.lit("").alias("name"), s["paths"].alias("paths")))
            .when(token == "VOID", F.struct(s["stack"].alias("stack"), F.lit("").alias("name"), s["paths"].alias("paths")))
            .otherwise(F.struct(s["stack"].alias("stack"), F.lit("").alias("name"), F.array_append(s["paths"], value).alias("paths")))
            .cast(kind)
        )

    def plain(token: Column) -> Column:
        name = F.substr(token, F.lit(1), F.length(token) - 1)
        return F.when(name.rlike(r"^`[^`.\[\]]*`$"), F.translate(name, "`", "")).otherwise(name)

    tokens = F.regexp_extract_all(F.regexp_replace(schema, r"DECIMAL\([0-9]+,[0-9]+\)", "DECIMAL"), F.lit(TOKEN), F.lit(0))
    found = F.aggregate(tokens, start, step)["paths"]
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: (p != "") & (p != "*"))))


def place(x: Layout, wrapper: str) -> str:
    """Path of a layout's list in a wrapper; the record or the wrapper itself is the list where items is empty."""
    return f"{wrapper}.{x.items}[]" if wrapper and x.items else f"{wrapper}{x.items}[]"


def accepts(x: Layout, wrapper: str, paths: Column) -> Column:
    """Whether a record with these paths has the layout x in the wrapper, with something in it: fields of
    parts, or a list that has roles or texts."""
    at = f"{wrapper}." if wrapper else ""
    has = lambda p: F.array_contains(paths, p)
    if x.items is None:
        return F.forall(F.array(*[F.lit(at + p) for p in x.needed]), lambda p: has(p) | has(F.concat(p, F.lit("[]"))))
    items = place(x, wrapper)
    return has(f"{items}.{x.role}") | has(f"{items}.{x.text}") | has(f"{items}.{x.text}[]")


def empty(x: Layout, wrapper: str, paths: Column) -> Column:
    """Whether the list of the layout x is there, by its name, and empty."""
    if not x.items:
        return F.lit(False)
    items = place(x, wrapper)
    return F.array_contains(paths, items) & ~F.exists(paths, lambda p: F.startswith(p, F.lit(items)) & (p != items))


def schemas(shapes: DataFrame, layouts: Sequence[Layout] = LAYOUTS, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(key, fingerprint, paths, layout, wrapper, n): one row for each distinct schema, whose digest is key. Paths are
    read here and nowhere else, so once a schema and not once a record.

    Layouts are tried in order, wrappers inside each, first those with something in them, then empty
    lists; layout and wrapper are null where none fits."""
    each = shapes.groupBy("schema").agg(F.count(F.lit(1)).alias("n")).withColumn("paths", field_paths(F.col("schema")))
    fits = [F.when(f(x, w, F.col("paths")), F.struct(F.lit(x.name).alias("layout"), F.lit(w).alias("wrapper"))) for f in (accepts, empty) for x in layouts for w in wrappers]
    found = each.withColumn("fit", F.coalesce(*fits))
    return found.select(schema_key(F.col("schema")).alias("key"), fingerprint(F.col("paths")).alias("fingerprint"), "paths", "fit.layout", "fit.wrapper", "n")


def catalogue(shapes: DataFrame, layouts: Sequence[Layout] = LAYOUTS, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(fingerprint, paths, layout, wrapper, n) of every shape of record: one row for each fingerprint.

    shapes has a row for each record with its schema; schemas of equal paths have one fingerprint, and so one layout."""
    one = [F.first(c).alias(c) for c in ("paths", "layout", "wrapper")]
    return schemas(shapes, layouts, wrappers).groupBy("fingerprint").agg(*one, F.sum("n").alias("n"))


def schema_key(schema: Column) -> Column:
    return F.md5(F.coalesce(schema, F.lit("")))


def fingerprint(paths: Column) -> Column:
    """Digest of sorted paths; null paths, of what is no record at all, have that of an empty text."""
    return F.sha2(F.coalesce(F.array_join(paths, "\n"), F.lit("")), 256)


def text_of(value: Column) -> Column:
    """A content's text: a text as it is, the texts of a list of parts end to end, with [kind] for parts
    that have none, null as an empty text, and anything else as its JSON."""
    kind = F.schema_of_variant(value)
    get = lambda v, path: F.try_variant_get(v, F.lit(path), "string")
    part = lambda v: F.when(F.schema_of_variant(v) == "STRING", get(v, "$")).otherwise(F.coalesce(get(v, "$.text"), F.concat(F.lit("["), get(v, "$.type"), F.lit("]")), F.to_json(v)))
    parts = F.array_join(F.transform(F.try_variant_get(value, F.lit("$"), "array<variant>"), part), "")
    return F.when(value.isNull() | (kind == "VOID"), F.lit("")).when(kind == "STRING", get(value, "$")).when(F.startswith(kind, F.lit("ARRAY<")), parts).otherwise(F.to_json(value))


def turns_of(x: Layout, value: Column) -> Column:
    """Canonical turns of a variant that has the layout x."""
    got = lambda v, name: F.try_variant_get(v, F.lit(f"$['{name}']"), "variant")
    if x.items is not None:
        path = f"$['{x.items}']" if x.items else "$"
        roles = F.create_map(*[F.lit(s) for pair in x.roles for s in pair]) if x.roles else None
        named = lambda r: F.coalesce(F.try_element_at(roles, r), r) if roles is not None else r
        one = lambda t: F.struct(named(text_of(got(t, x.role))).alias("role"), text_of(got(t, x.text)).alias("text"))
        return F.transform(F.try_variant_get(value, F.lit(path), "array<variant>"), one)
    there = lambda p: got(value, p).isNotNull() & (F.schema_of_variant(got(value, p)) != "VOID")
    texts = lambda ps: F.concat_ws("\n\n", *[F.when(there(p), text_of(got(value, p))) for p in ps])
    some = lambda ps: F.exists(F.array(*[there(p) for p in ps]), lambda ok: F.coalesce(ok, F.lit(False)))
    turns = [F.when(some(ps), F.struct(F.lit(role).alias("role"), texts(ps).alias("text"))) for role, ps in x.parts]
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, json: str | None = None, layouts: Sequence[Layout] = LAYOUTS, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(record, fingerprint, layout, wrapper, turns) for every row of records; record holds the row as it came.

    json names a column of JSON texts; without it the columns of records are the fields. The fingerprint is
    of all nested field paths that have a value, metadata's too; the catalogue of distinct schemas says
    which fingerprint and layout each has, and where. A list that is empty counts only where nothing else fits. A record that no layout fits, that can't be parsed or is null has a
    null layout and null turns: rejects() counts those. A missing or null role or text is an empty one, an
    empty list gives no turns, and content given as parts is put together. Rows are matched to the
    catalogue by their schema's digest; a schema of many rows is dealt over many tasks. Repeated rows stay; no
    rows give none; no column of records can clash."""
    value = F.try_parse_json(F.col(json)) if json else F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    rows = records.select(F.struct("*").alias("record"), value.alias("value"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows.withColumn("schema", F.schema_of_variant("value")).withColumn("schema", F.coalesce("schema", F.lit(""))))
    shapes = materialise(schemas(rows, layouts, wrappers).drop("paths"))
    rows = rows.withColumn("key", schema_key(F.col("schema")))
    n_shapes, n = shapes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_shapes <= LISTED:
        found = rows.join(F.broadcast(shapes.drop("n")), "key")
    else:
        found = join_counted(rows, shapes, "key", "n", F.col("row"), max(1, n // HOT_SHARE))
    inner = F.col("value")
    for w in wrappers:
        inner = F.when(F.col("wrapper") == w, F.try_variant_get("value", F.lit(f"$['{w}']"), "variant")).otherwise(inner) if w else inner
    found = found.withColumn("value", inner)
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, turns_of(x, F.col("value")).cast(TURNS)).otherwise(turns)
    return found.select("record", "fingerprint", "layout", "wrapper", turns.alias("turns"))


def rejects(records: DataFrame, json: str | None = None, layouts: Sequence[Layout] = LAYOUTS, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(fingerprint, paths, n): the shapes of record that no layout fits and how many records have each."""
    value = F.try_parse_json(F.col(json)) if json else F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    found = catalogue(records.select(F.coalesce(F.schema_of_variant(value), F.lit("")).alias("schema")), layouts, wrappers)
    return found.where(F.col("layout").isNull()).select("fingerprint", "paths", "n")


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: Column, loss_role: str = "assistant") -> Column:
    """struct<text, mask> of the template over turns; mask holds (start, length), in code points, of the
    escaped text of each turn that loss counts on. No turns give an empty text and an empty mask."""

    def laid(pieces: Column) -> Column:
        whole = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
        lengths = F.transform(pieces, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))
        mask = lambda at: F.filter(
            F.zip_with(pieces, at, lambda p, o: F.struct((o + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length"), p["loss"].alias("loss"))),
            lambda m: m["loss"],
        )
        plain = F.transform(mask(running_offsets(lengths)), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))
        return F.struct(whole.alias("text"), plain.alias("mask"))

    piece = lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")
    )
    return let(F.transform(turns, piece), laid)


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    line = lambda p: F.substring_index(p, "\n", 1)
    one = lambda p: F.struct(
        unescape(F.substring(line(p), len(OPEN) + 1, 2**31 - 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(p, F.length(line(p)) + 2)).alias("text"),
    )
    pieces = F.split(text, CLOSE, -1)
    return let(pieces, lambda ps: F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), one))


def under_mask(text: Column, mask: Column) -> Column:
    """All text that the loss mask covers, in order, as it was before escaping."""
    part = lambda m: unescape(F.substr(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return F.array_join(F.transform(mask, part), "")


def conversations_as_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record a conversation, (conv_id, turns), from rows by turn.

    Rows are ordered by turn, null first, then role and text; repeated rows stay. A null role or
    text is an empty one. Which conversation a row without an id belongs to isn't known: each is one of
    its own; rows that are equal in all four columns share one."""
    each = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.concat_ws(":", F.col(turn).cast("string"), row_key(role, text)))
    grouped = rows.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), each.alias("t")).groupBy("conv_id", "alone").agg(F.collect_list("t").alias("ts"))
    return grouped.select("conv_id", F.transform(F.array_sort("ts"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_records(records: DataFrame, json: str | None = None, layouts: Sequence[Layout] = LAYOUTS, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(record, fingerprint, layout, wrapper, formatted, loss_mask) for every row of records, as canonical_turns()
    finds them; a record without a layout has null in both."""
    found = canonical_turns(records, json, layouts, wrappers).withColumn("f", formatted(F.col("turns")))
    return found.select("record", "fingerprint", "layout", "wrapper", F.col("f.text").alias("formatted"), F.col("f.mask").alias("loss_mask"))
