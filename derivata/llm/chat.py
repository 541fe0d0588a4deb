"""Chat formatting from heterogeneous layouts.

A layout is known by its fingerprint: the digest of its sorted nested field paths. The fingerprint selects a
declarative mapping, which compiles to a Spark column of turns. A table of one layout has the fingerprint of its schema
(:func:`canonical_turns`); records of many layouts, as JSON, have one each (:func:`turns_of_records`). Other fields may
come along: where the whole fingerprint is unknown, the layout with most paths among those there decides, and of
equally many the one that :data:`LAYOUTS` has first. No mapping is guessed: none such is an error that names the paths.

Roles go by other names in some layouts ("from": "human") and are translated there; rows by turn keep theirs.

The template is local to a turn, so turns are formatted where they are, by built-in functions and without a shuffle,
and a conversation of any length is never gathered. A turn is

    <|im_start|>ROLE newline TEXT <|im_end|> newline

Control strings inside a role or text get a backslash after their first character, a backslash is doubled, and a line
feed in a role gets one before it; so no text can end its turn, and unescaping gives back every character.

Null roles, texts and turn numbers: empty, empty and first. Turns of one number follow by their formatted text; repeated
rows are repeated turns. Conversation ids are of any type; a null one is a conversation like any other.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Strings that chat templates use for control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learnt.
LEARNT = "assistant"

#: Names of roles in known layouts, and what they are here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

def field_paths(schema: DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; [] stands for each element, {} for a map."""
    if isinstance(schema, StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [f"{at}{{}}" if isinstance(schema, MapType) else at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _rows(turn: str, role: str, text: str):
    return {"rows": (turn, role, text)}


def _list(each: str, role: str, text: str):
    return {"list": (each, role, text)}


def _fixed(*turns: tuple[str, tuple[str, ...]]):
    return {"fixed": turns}


#: Declarative mappings by the field paths of the layouts they are for, conv_id apart.
LAYOUTS = {
    ("role", "text", "turn"): _rows("turn", "role", "text"),
    ("content", "role", "turn"): _rows("turn", "role", "content"),
    ("messages[].content", "messages[].role"): _list("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _list("conversations", "from", "value"),
    ("instruction", "output"): _fixed(("user", ("instruction",)), ("assistant", ("output",))),
    ("input", "instruction", "output"): _fixed(("user", ("instruction", "input")), ("assistant", ("output",))),
    ("input", "instruction", "output", "system"): _fixed(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ("prompt", "response"): _fixed(("user", ("prompt",)), ("assistant", ("response",))),
    ("completion", "prompt"): _fixed(("user", ("prompt",)), ("assistant", ("completion",))),
    ("prompt", "response", "system"): _fixed(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ("answer", "question"): _fixed(("user", ("question",)), ("assistant", ("answer",))),
}
MAPPINGS = {fingerprint(paths): paths for paths in LAYOUTS}
_BY_SIZE = sorted(LAYOUTS, key=len, reverse=True)


def layout_of(paths) -> tuple[str, ...]:
    """The paths of the layout that decides for these field paths."""
    paths = set(paths) - {"conv_id"}
    if known := MAPPINGS.get(fingerprint(paths)):
        return known
    if not (fit := [x for x in _BY_SIZE if set(x) <= paths]):
        raise ValueError(f"no mapping for the layout {fingerprint(paths)}: {sorted(paths)}")
    return fit[0]


def _turns(layout: tuple[str, ...], field) -> Column:
    """array<struct<turn, role, text>> by a layout's mapping; ``field`` gives the column of a name."""
    mapping = LAYOUTS[layout]
    turn = lambda n, role, text: F.struct(n.cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "rows" in mapping:
        n, role, text = (field(x) for x in mapping["rows"])
        return F.array(turn(n, role.cast("string"), text.cast("string")))
    if "list" in mapping:
        each, role, text = mapping["list"]
        known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.transform(field(each), lambda t, i: turn(i, F.coalesce(F.try_element_at(known, F.coalesce(t[role], F.lit(""))), t[role]), t[text]))
    parts = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(field(c).cast("string"), F.lit("")) for c in columns]).alias("text")) for role, columns in mapping["fixed"]]
    return F.transform(F.filter(F.array(*parts), lambda t: (t["text"] != "") | (t["role"] != "system")), lambda t, i: turn(i, t["role"], t["text"]))


def canonical_turns(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of every turn of a table of one layout. ``id_col`` names the conversation where it
    isn't conv_id.

    Empty parts of a fixed layout (no input, no system text) make no turn or line; a list may be null or empty."""
    turns = _turns(layout_of(field_paths(df.schema)), lambda c: F.col(f"`{c}`"))
    return df.select(F.col(f"`{id_col or 'conv_id'}`").alias("conv_id"), F.inline(turns))


#: What the mappings read of a record.
_RECORD = "conv_id bigint, turn bigint, role string, text string, content string, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>, instruction string, input string, output string, system string, prompt string, response string, completion string, question string, answer string"


def _keys_of(json: Column, at: str = "") -> Column:
    return F.transform(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), lambda k: F.concat(F.lit(at), k))


def turns_of_records(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of every turn of records (JSON objects) of any mix of known layouts.

    A list's paths are those of its first element. A null record, one that is no JSON, and one of an unknown layout give
    no turns; :func:`unknown_layouts` lists them."""
    known = _fingerprinted(df, json_col, id_col)
    record = F.from_json("json", _RECORD)
    turns = F.coalesce(*[F.when(F.col("layout") == fingerprint(layout), _turns(layout, lambda c: F.col("r")[c])) for layout in LAYOUTS])
    return known.withColumn("r", record).select("conv_id", F.inline(turns))


def unknown_layouts(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(paths, n) of the records that :func:`turns_of_records` gives no turns of, by their sorted field paths."""
    return _fingerprinted(df, json_col, id_col).where("layout IS NULL").groupBy(F.array_join("paths", ",").alias("paths")).agg(F.count("*").alias("n"))


def _fingerprinted(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(conv_id, json, paths, layout): each record's sorted field paths, and the fingerprint of the layout they select."""
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{json_col}`").alias("json"))
    lists = [each for each, _, _ in (m["list"] for m in LAYOUTS.values() if "list" in m)]
    outer = F.filter(_keys_of(F.col("json")), lambda k: ~k.isin("conv_id", *lists))
    inner = [_keys_of(F.get_json_object("json", f"$.{each}[0]"), f"{each}[].") for each in lists]
    paths = F.array_sort(F.array_distinct(F.concat(outer, *inner)))
    own = F.substring(F.sha2(F.array_join("paths", "\n"), 256), 1, 16)
    exact = F.when(own.isin(list(MAPPINGS)), own)
    fits = lambda x: F.forall(F.array(*map(F.lit, x)), lambda p: F.array_contains("paths", p))
    found = F.coalesce(exact, *[F.when(fits(x), F.lit(fingerprint(x))) for x in _BY_SIZE])
    return rows.withColumn("paths", paths).withColumn("layout", found)


_RISKY = "|".join([rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL] + [r"\\"])
_ESCAPED = re.compile(r"\\([\s\S])")
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*)" + re.escape(END) + "\n")


def escape(text: Column) -> Column:
    """A backslash after the first character of each control string, and after each backslash."""
    return F.regexp_replace(text, _RISKY, r"$0\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turn(piece: str) -> tuple[str, str]:
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) of canonical turns: the pieces that, by conversation and turn,
    make up the text, and the part of each piece under the loss mask (both 0 where nothing is learnt)."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    parts = turns.select("conv_id", "turn", (F.col("role") == LEARNT).alias("learnt"), head.alias("head"), escape(F.col("text")).alias("body"))
    begin = F.length("head")
    mask = lambda at: F.when(F.col("learnt"), at).otherwise(F.lit(0))
    return parts.select("conv_id", "turn", F.concat("head", "body", F.lit(f"{END}\n")).alias("formatted"), mask(begin).alias("loss_start"), mask(begin + F.length("body")).alias("loss_end"))


def format_chat(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """The formatted turns of a table of one layout; see :func:`formatted`."""
    return formatted(canonical_turns(df, id_col))


class _Running:
    """Digests of a conversation as its turns come by."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.learnt = conv, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int):
        role, text = parse_turn(piece)
        self.said.update(f"{role}\n{text}\n".encode())
        loss = unescape(piece[start:end])
        self.loss.update(loss.encode())
        self.turns, self.chars, self.learnt = self.turns + 1, self.chars + len(piece), self.learnt + len(loss)

    def row(self):
        return self.conv, self.turns, self.said.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars


_DIGEST = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _digest_batches(batches):
    now, done, own = None, [], pa.null()

    def rows():
        kinds = [("conv_id", own), *_DIGEST]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    for batch in batches:
        own = batch.schema.field("conv_id").type
        for conv, piece, start, end in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Running(conv)
            now.add(piece, start, end)
        if done:
            yield rows()
            done = []
    if now:
        done = [now.row()]
        yield rows()


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted pieces back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a sequence needs its turns in order, so a conversation's pieces stream through one task, sorted on
    disk if need be; of each conversation only the running digests are in memory."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    own = formatted.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_digest_batches, f"conv_id {own}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
