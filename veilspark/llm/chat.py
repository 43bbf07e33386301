"""Chat formatting by schema fingerprints, in DataFrame and SQL functions only.

A record's layout is known by its nested field paths. Paths that no mapping speaks of are left out, the rest is sorted
and hashed; the hash picks a declarative mapping that turns the layout (prompt and response, instruction with input and
output, messages in several spellings, or one row a turn) into canonical turns. Turns are then written in one template
and can be read back exactly.

Template of a turn: ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Inside roles and texts a backslash is doubled and a
control string gets a backslash after its first character, so none of them stands there; reading back undoes that.
The loss mask lists (start, length) of each assistant text in the formatted string, in code points.

Defined cases: a null text or role counts as empty; a null conversation id is a conversation of its own; turns go by
turn number, then role, then text, nulls first; repeated rows are turns of their own; a field that is null is there, and
counts as empty; values that are no strings are taken as JSON; list elements that are no turns are left out; records of
an unknown layout get null turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOS, OPEN, CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BOS, EOS, OPEN, CLOSE)
TURNS = "array<struct<role: string, text: string>>"


def _text(record: str, path: str) -> str:
    """SQL of a field's text: strings as they are, other values as JSON, null for null and for what is not there."""
    at = f"{record}, '$.{path}'"
    return f"coalesce(try_variant_get({at}, 'string'), nullif(to_json(try_variant_get({at}, 'variant')), 'null'))"


def _list(path: str, role: str, text: str, names: str = "") -> str:
    """SQL of the turns in a list of objects; elements that have neither field give no turn."""
    there = f"filter(try_variant_get(r, '$.{path}', 'array<variant>'), m -> {_there('m', role)} or {_there('m', text)})"
    named = f"case {_text('m', role)} {names} else {_text('m', role)} end" if names else _text("m", role)
    return f"transform({there}, m -> struct({named} as role, {_text('m', text)} as text))"


def _there(record: str, path: str) -> str:
    """SQL of whether a record has a path; a field that is null is there."""
    return f"try_variant_get({record}, '$.{path}', 'variant') is not null"


def _pair(user: str, assistant: str, system: bool = True) -> str:
    """SQL of a system turn, where there is one, a user's and an assistant's."""
    turns = f"array(struct('user' as role, {user} as text), struct('assistant' as role, {assistant} as text))"
    first = f"struct('system' as role, {_text('r', 'system')} as text)"
    return f"if({_text('r', 'system')} is null, {turns}, concat(array({first}), {turns}))" if system else turns


#: Declarative mappings: layout -> (its field paths, optional paths, SQL over the record `r`, a variant, giving TURNS).
#: Each subset of the optional paths is a layout too.
MAPPINGS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "messages": (("messages[].role", "messages[].content"), (), _list("messages", "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), (), _list("conversations", "from", "value", "when 'human' then 'user' when 'gpt' then 'assistant'")),
    "instruction": (
        ("instruction", "output"), ("input", "system"),
        _pair(f"concat_ws('\\n', {_text('r', 'instruction')}, nullif({_text('r', 'input')}, ''))", _text("r", "output")),
    ),
    "prompt": (("prompt", "response"), ("system",), _pair(_text("r", "prompt"), _text("r", "response"))),
    "completion": (("prompt", "completion"), ("system",), _pair(_text("r", "prompt"), _text("r", "completion"))),
    "nested": (("data.prompt", "data.response"), (), _pair(_text("r", "data.prompt"), _text("r", "data.response"), system=False)),
}
#: Layouts of typed tables with one row a turn: paths -> roles of the columns.
ROW_LAYOUTS: dict[str, dict[str, str]] = {
    "turn_rows": {"conversation": "conv_id", "order": "turn", "role": "role", "text": "text"},
    "message_rows": {"conversation": "conversation_id", "order": "message_index", "role": "author", "text": "content"},
}


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a typed schema; `[]` marks arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _subsets(optional: tuple[str, ...]) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for path in optional:
        out += [(*s, path) for s in out]
    return out


def registry() -> dict[str, str]:
    """Fingerprint of each layout -> its mapping's name."""
    return {fingerprint((*needed, *some)): name for name, (needed, optional, _) in MAPPINGS.items() for some in _subsets(optional)}


KNOWN_PATHS = sorted({p for needed, optional, _ in MAPPINGS.values() for p in (*needed, *optional)})


def record_fingerprint(record: str) -> Column:
    """Fingerprint of a variant record, by the known paths that it has."""

    def there(path: str) -> str:
        if "[]" in path:  # in some element
            top, leaf = path.split("[].")
            return f"exists(try_variant_get({record}, '$.{top}', 'array<variant>'), e -> {_there('e', leaf)})"
        return _there(record, path)

    paths = ", ".join(f"if(coalesce({there(p)}, false), '{p}', null)" for p in KNOWN_PATHS)
    return F.expr(f"substring(sha2(array_join(array_compact(array({paths})), '\\n'), 256), 1, 16)")


def records_to_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turns) of records in JSON of mixed layouts; an unknown layout or broken JSON gives nulls. Narrow."""
    base = df.select(F.col(f"`{id_col}`"), F.expr(f"try_parse_json(`{json_col}`)").alias("r")).withColumn("__print", record_fingerprint("r"))
    layout = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for print_, name in registry().items():
        layout = F.when(F.col("__print") == print_, name).otherwise(layout)
    base = base.withColumn("layout", layout)
    for name, (_, _, sql) in MAPPINGS.items():
        turns = F.when(F.col("layout") == name, F.expr(sql).cast(TURNS)).otherwise(turns)
    filled = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return base.select(F.col(f"`{id_col}`"), "layout", filled.alias("turns"))


def rows_to_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with one row a turn, whose layout the fingerprint of its columns picks.

    One shuffle by conversation; a conversation is one string in the end, so its turns meet in one row.
    """
    known = {p for columns in ROW_LAYOUTS.values() for p in columns.values()}
    by_print = {fingerprint(c.values()): c for c in ROW_LAYOUTS.values()}
    paths = set(schema_paths(df.schema))
    columns = by_print.get(fingerprint(paths & known)) or next((c for c in ROW_LAYOUTS.values() if set(c.values()) <= paths), None)
    if columns is None:
        raise ValueError(f"no mapping for a table of {sorted(paths)}")
    turn = F.struct(F.col(f"`{columns['order']}`").alias("turn"), F.coalesce(F.col(f"`{columns['role']}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{columns['text']}`"), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(f"`{columns['conversation']}`").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns"))


def escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def formatted(df: DataFrame, turns: str = "turns", train_on: str = "assistant") -> DataFrame:
    """df with `formatted` (one string) and `loss_mask` (array of (start, length) in it, of the texts to train on)."""
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(BOS + OPEN), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(CLOSE)).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (t["role"].eqNullSafe(F.lit(train_on))).alias("trained"),
        ),
    )
    out = df.withColumn("__pieces", pieces)
    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(EOS))), "")
    mask = F.expr(
        f"""aggregate(__pieces, struct(0L as at, cast(array() as array<struct<start: bigint, length: bigint>>) as spans), (acc, p) -> struct(
            acc.at + length(p.head) + length(p.body) + {len(EOS)} as at,
            if(p.trained, concat(acc.spans, array(struct(acc.at + length(p.head) as start, cast(length(p.body) as bigint) as length))), acc.spans) as spans)).spans"""
    )
    return out.withColumn("formatted", text).withColumn("loss_mask", mask).drop("__pieces")


def read_turns(text: str = "formatted") -> Column:
    """The turns of a formatted string: the exact inverse of formatted()."""
    chunks = F.filter(F.split(F.col(text), EOS, -1), lambda c: c != "")
    head = len(BOS + OPEN)

    def turn(c: Column) -> Column:
        at = F.instr(c, CLOSE)
        return F.struct(
            unescaped(F.substring(c, F.lit(head + 1), at - F.lit(head + 1))).alias("role"),
            unescaped(F.substring(c, at + F.lit(len(CLOSE)), F.length(c))).alias("text"),
        )

    return F.transform(chunks, turn)


def masked_text(text: str = "formatted", mask: str = "loss_mask") -> Column:
    """All text under the mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.col(text), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
