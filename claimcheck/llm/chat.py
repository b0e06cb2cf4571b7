"""Chat formatting: records of several layouts become canonical turns, and turns become one marked and masked text."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
HEAD, HEAD_END = "### ", ":\n"
#: Roles of other layouts, and what they are called here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


class Layout(NamedTuple):
    """Where a record has its turns: an array of messages with a role and a text field, or one field for each turn in order."""

    paths: str
    messages: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


#: Nested field paths, as field_paths gives them, and how to read a record that has them.
LAYOUTS = (
    Layout("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages", "role", "content"),
    Layout("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value"),
    Layout("OBJECT<turns: ARRAY<OBJECT<role, text>>>", "turns", "role", "text"),
    Layout("OBJECT<prompt>", fields=(("user", "prompt"),)),
    Layout("OBJECT<prompt, response>", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("OBJECT<input, instruction, output>", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("OBJECT<prompt, response, system>", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT record, without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|VARIANT|BINARY|TIMESTAMP(?:_NTZ)?|DECIMAL\([0-9,]+\))(?=[,>])", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout (the field paths that its fingerprint selected, else null) and turns, an array of (role, text).

    Null roles and texts become empty. A record of no known layout, a null one and one with an empty list of messages
    have no turns; their layout is null, so a caller can tell them apart. Added columns replace columns of the same name.
    """
    source = F.col(record)
    records = records.drop("layout", "turns").withColumn("_print", fingerprint(field_paths(source)))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for layout in layouts:
        if layout.messages:
            read = F.transform(F.try_variant_get(source, f"$.{layout.messages}", f"array<struct<{layout.role}:string,{layout.text}:string>>"), _turn_of(layout))
        else:
            read = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(source, f"$.{field}", "string"), F.lit("")).alias("text")) for role, field in layout.fields))
        chosen = F.col("_print") == fingerprint(F.lit(layout.paths))
        turns, name = F.when(chosen, read).otherwise(turns), F.when(chosen, layout.paths).otherwise(name)
    renamed = F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.struct(_role(t["role"]).alias("role"), t["text"].alias("text")))
    return records.withColumns({"layout": name, "turns": renamed}).drop("_print")


def _turn_of(layout: Layout):
    return lambda m: F.struct(F.coalesce(m[layout.role], F.lit("")).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    for other, own in ROLES.items():
        role = F.when(role == other, own).otherwise(role)
    return role


def escape(text: Column) -> Column:
    """The text without a character that a control string needs: \\ # < become \\b \\h \\l."""
    for character, code in (("\\", "b"), ("#", "h"), ("<", "l")):
        text = F.replace(text, F.lit(character), F.lit("\\" + code))
    return text


def unescape(text: Column) -> Column:
    """What escape() was given. Each backslash of an escaped text begins a pair; \\b comes last, as it makes backslashes."""
    for character, code in (("<", "l"), ("#", "h"), ("\\", "b")):
        text = F.replace(text, F.lit("\\" + code), F.lit(character))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(records: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """records (turns) with formatted and mask: runs (length, loss) that cover formatted from its start to its end.

    A turn is "### role:", a line end, its text, and "</turn>" with a line end; role and text are escaped, so only the
    template can make these strings. The mask has three runs for each turn; the text's is under the loss if the role is
    loss_role. No turns give an empty text and no runs.
    """

    def head(t: Column) -> Column:
        return F.concat(F.lit(HEAD), _escape_role(t["role"]), F.lit(HEAD_END))

    def runs(t: Column) -> Column:
        run = lambda length, loss: F.struct(length.cast("int").alias("length"), loss.alias("loss"))
        return F.array(run(F.length(head(t)), F.lit(False)), run(F.length(escape(t["text"])), t["role"] == loss_role), run(F.lit(len(TURN_END)), F.lit(False)))

    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(TURN_END))), "")
    return records.withColumns({"formatted": text, "mask": F.flatten(F.transform("turns", runs))})


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, re.escape(TURN_END)), lambda p, _k: F.startswith(p, F.lit(HEAD)))

    def turn(piece: Column) -> Column:
        end = F.locate(HEAD_END, piece)
        role = F.replace(F.substring(piece, F.lit(len(HEAD) + 1), end - 1 - len(HEAD)), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, end + len(HEAD_END), F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss, unescaped, in order: formatted is cut where the running sum of the mask's lengths says.

    The text is held in blocks of 1,024 characters, so that a cut reads its own blocks and not the text from its start.
    """

    def step(state: Column, run: Column) -> Column:
        at, length = state["at"], run["length"]
        first = F.shiftright(at, 10)
        blocks = F.slice(state["blocks"], first + 1, F.shiftright(at + length - 1, 10) - first + 1)
        piece = F.substring(F.array_join(blocks, ""), at.bitwiseAND(1023) + 1, length)
        taken = F.when(run["loss"] & (length > 0), F.concat(state["parts"], F.array(piece))).otherwise(state["parts"])
        return F.struct((at + length).alias("at"), taken.alias("parts"), state["blocks"].alias("blocks"))

    blocks = F.regexp_extract_all(formatted, F.lit("(?s).{1,1024}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"), blocks.alias("blocks"))
    return unescape(F.array_join(F.aggregate(mask, start, step, lambda state: state["parts"]), ""))
