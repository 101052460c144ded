"""Chat formatting: layouts recognised by a hash of their field paths, one reversible template."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``many`` is the path of a list of messages whose ``role`` and ``text`` paths are read
    from each item; without it the record gives one turn for each (role, path) of ``fixed``
    whose value is not null. ``aliases`` renames roles.
    """

    name: str
    many: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        """The field paths that the mapping reads."""
        if self.many is not None:
            return (f"{self.many}[].{self.role}", f"{self.many}[].{self.text}")
        if self.role is not None:
            return (self.role, self.text)
        return tuple(path for _, path in self.fixed)


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("messages", many="messages", role="role", text="content"),
    Mapping("speakers", many="conversations", role="from", text="value", aliases=_SPEAKERS),
    Mapping("instruction-input", fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt-completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("turn", role="role", text="content"),
    Mapping("speaker", role="from", text="value", aliases=_SPEAKERS),
    Mapping("nested-turn", role="message.author.role", text="message.content.text"),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """The paths of all leaves; list places are written as [] and empty containers end a path."""
    found, waiting = set(), [(value, prefix)]
    while waiting:
        value, path = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(v, f"{path}.{k}" if path else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            waiting += [(v, f"{path}[]") for v in value]
        else:
            found.add(path)
    return found


def fingerprint(paths: set[str]) -> str:
    """The same for any order of fields, items and values."""
    return sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def apply_mapping(mapping: Mapping, record: object) -> list[dict]:
    """The turns of a record in the mapping's layout."""
    names = dict(mapping.aliases)
    if mapping.many is not None:
        items = _at(record, mapping.many) or []
        pairs = [(_at(i, mapping.role), _at(i, mapping.text)) for i in items]
    elif mapping.role is not None:
        pairs = [(_at(record, mapping.role), _at(record, mapping.text))]
    else:
        pairs = [(role, v) for role, path in mapping.fixed if (v := _at(record, path)) is not None]
    return [{"role": names.get(_text(r), _text(r)), "text": _text(t)} for r, t in pairs]


class Layouts:
    """Fingerprints met so far and the mapping chosen for each; the table is bounded."""

    def __init__(self, mappings: tuple[Mapping, ...], kept: int = 10_000):
        self.mappings, self.kept, self.chosen = mappings, kept, {}

    def choose(self, paths: set[str], key: str) -> Mapping | None:
        """The first mapping all of whose paths the layout has; more fields do no harm."""
        if key not in self.chosen:
            if len(self.chosen) >= self.kept:
                self.chosen.clear()
            self.chosen[key] = next((m for m in self.mappings if paths.issuperset(m.paths())), None)
        return self.chosen[key]


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """struct(layout, fingerprint, turns) of a JSON record in any of the known layouts.

    The hash of the record's nested field paths selects a declarative mapping, once for
    each layout met. A null record, invalid JSON or an unknown layout gives layout null and
    turns null (with the fingerprint where there is one), so it can be set aside with a
    filter. Null texts and roles become empty; other values than text keep their JSON form.
    """
    kind = f"struct<layout:string,fingerprint:string,turns:{TURNS}>"
    arrow = pa.struct(
        [
            ("layout", pa.string()),
            ("fingerprint", pa.string()),
            ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        ]
    )

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        layouts = Layouts(mappings)
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                try:
                    value = None if text is None else json.loads(text)
                except (ValueError, RecursionError):
                    value = None
                if not isinstance(value, dict):
                    rows.append({"layout": None, "fingerprint": None, "turns": None})
                    continue
                paths = field_paths(value)
                key = fingerprint(paths)
                mapping = layouts.choose(paths, key)
                rows.append(
                    {
                        "layout": mapping.name if mapping else None,
                        "fingerprint": key,
                        "turns": apply_mapping(mapping, value) if mapping else None,
                    }
                )
            yield pa.array(rows, type=arrow)

    return run(record)


def escape(text: Column) -> Column:
    """Mark backslashes and the start of every control string, so none is left inside a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\([\\|])"), F.lit("$1"))


def escape_role(role: Column) -> Column:
    """As for a text; a line end would end the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A line end first: backslash, n behind an even number of backslashes.
    lines = F.regexp_replace(role, F.lit(r"(?<!\\)((?:\\\\)*)\\n"), F.lit("$1\n"))
    return unescape(lines)


def format_turn(role: Column, text: Column, learn: tuple[str, ...] = ("assistant",)) -> Column:
    """struct(formatted, loss_start, loss_end): one turn, and the code points to learn from.

    The span is empty (0, 0) for roles that are not learned. Null role or text: empty.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    body = escape(text)
    learned = role.isin(*learn)
    return F.struct(
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("formatted"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, F.length(head) + F.length(body)).otherwise(0).cast("long").alias("loss_end"),
    )


def read_turn(formatted: Column) -> Column:
    """struct(role, text) of a formatted turn, unescaped."""
    pattern = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    return F.struct(
        unescape_role(F.regexp_extract(formatted, pattern, 1)).alias("role"),
        unescape(F.regexp_extract(formatted, pattern, 2)).alias("text"),
    )


def conversation_digests(formatted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Read formatted turns back and digest each conversation.

    ``formatted`` has one row per turn: key, the order columns, formatted, loss_start,
    loss_end. Returns key, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars. The turns of a conversation are streamed in order through running
    digests, so memory does not follow its length. An empty table gives no rows.
    """
    turn = read_turn(F.col("formatted"))
    masked = F.col("formatted").substr(
        (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")
    )
    read = formatted.select(
        F.col(key).alias("_key"), *order, turn.alias("_turn"), unescape(masked).alias("_loss"),
        F.length("formatted").cast("long").alias("_chars"),
    ).select("_key", *order, F.col("_turn.role").alias("_role"), F.col("_turn.text").alias("_text"), "_loss", "_chars")
    dealt = (
        read.repartition("_key")
        .sortWithinPartitions("_key", *order)
        .select("_key", "_role", "_text", "_loss", "_chars")
    )
    kind = formatted.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key_type = None, None

        def closed() -> tuple:
            name, n, turns, loss_chars, loss, chars = state
            return name, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def table(rows: list) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            key_type, rows = batch.column(0).type, []
            for name, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != name:
                    if state is not None:
                        rows.append(closed())
                    state = [name, 0, sha256(), 0, sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += chars
            if rows:
                yield table(rows)
        if state is not None:
            yield table([closed()])

    return dealt.mapInArrow(run, schema)
