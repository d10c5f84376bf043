"""Chat formatting: records of many layouts become canonical turns, and turns become training text.

A record's layout is known by the fingerprint of its nested field paths. A registry maps fingerprints to
declarative mappings, which say where the turns, their roles and their texts are. The template marks
each turn and escapes its own control strings inside texts, so that the text reads back exactly; the
spans of assistant texts form the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, partitions

Turn = tuple[str, str]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``parts``: (path, role) pairs of single texts, in order. ``turns``: path of a list of turns, whose
    items keep role and text under ``role`` and ``text``. ``join``: further paths whose text is put behind
    the first part that is no system text with a blank line. ``key``, ``order``: of tables whose rows are single
    turns, the columns that name the conversation and the turn's place in it.
    """

    parts: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    join: tuple[str, ...] = ()
    key: str = ""
    order: str = ""


#: The key of tables that hold canonical turns already.
CANONICAL_KEY = "conv_id"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: Layouts by their field paths; ``[]`` stands for the items of a list. Paths beside these are passed over.
LAYOUTS: list[tuple[tuple[str, ...], Mapping]] = [
    (("conv_id", "turn", "role", "text"), Mapping(key="conv_id", order="turn", role="role", text="text")),
    (("conversation_id", "position", "role", "content"), Mapping(key="conversation_id", order="position", role="role", text="content")),
    (("conversation_id", "position", "from", "value"), Mapping(key="conversation_id", order="position", role="from", text="value")),
    (("messages[].role", "messages[].content"), Mapping(turns="messages", role="role", text="content")),
    (("conversations[].from", "conversations[].value"), Mapping(turns="conversations", role="from", text="value")),
    (("system", "conversations[].from", "conversations[].value"), Mapping(parts=(("system", "system"),), turns="conversations", role="from", text="value")),
    (("system", "messages[].role", "messages[].content"), Mapping(parts=(("system", "system"),), turns="messages", role="role", text="content")),
    (("prompt", "completion"), Mapping(parts=(("prompt", "user"), ("completion", "assistant")))),
    (("prompt", "response"), Mapping(parts=(("prompt", "user"), ("response", "assistant")))),
    (("question", "answer"), Mapping(parts=(("question", "user"), ("answer", "assistant")))),
    (("instruction", "output"), Mapping(parts=(("instruction", "user"), ("output", "assistant")))),
    (("instruction", "input", "output"), Mapping(parts=(("instruction", "user"), ("output", "assistant")), join=("input",))),
    (("prompt[].role", "prompt[].content", "completion"), Mapping(turns="prompt", role="role", text="content", parts=(("completion", "assistant"),))),
]
LAYOUTS += [(("system", *paths), Mapping(parts=(("system", "system"), *m.parts), join=m.join)) for paths, m in LAYOUTS if m.parts and not m.turns]
LAYOUTS += [
    # The prompt repeats the first message, the text what prompt and completion hold.
    (("messages[].role", "messages[].content", "prompt"), Mapping(turns="messages", role="role", text="content")),
    (("system", "messages[].role", "messages[].content", "prompt"), Mapping(parts=(("system", "system"),), turns="messages", role="role", text="content")),
    (("prompt", "completion", "text"), Mapping(parts=(("prompt", "user"), ("completion", "assistant")))),
]
KNOWN = {path for paths, _ in LAYOUTS for path in paths}


def fingerprint(paths: Iterable[str]) -> str:
    """A hash of the known field paths of a layout, in any order; unknown ones don't count."""
    return hashlib.blake2b("\n".join(sorted(set(paths) & KNOWN)).encode(), digest_size=8).hexdigest()


REGISTRY = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}
ROW_PATHS = [paths for paths, mapping in LAYOUTS if mapping.key]


def row_mapping(paths: Iterable[str]) -> Mapping:
    """The mapping of a table of turn rows. Columns of other layouts may stand beside a layout's own; of several layouts
    that a table holds whole, the first one listed counts. A table that holds none is refused."""
    present = set(paths)
    for known in ROW_PATHS:
        mapping = REGISTRY.get(fingerprint(present & set(known)))
        if mapping is not None and mapping.key:
            return mapping
    raise ValueError(f"no mapping for the layout {sorted(present)}")


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def record_paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a parsed JSON record."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def canonical_turns(record: dict) -> list[Turn] | None:
    """The turns of a record by the mapping of its layout; None if the layout is unknown."""
    present = {k: v for k, v in record.items() if v is not None}
    mapping = REGISTRY.get(fingerprint(record_paths(present)))
    if mapping is None or not (mapping.turns or mapping.parts):
        return None
    texts = [[role, str(present.get(path) or "")] for path, role in mapping.parts]
    for path in mapping.join:
        if present.get(path):
            next(t for t in texts if t[0] != "system")[1] += f"\n\n{present[path]}"
    listed = [[ROLES.get(r := str(t.get(mapping.role) or ""), r), str(t.get(mapping.text) or "")] for t in present.get(mapping.turns) or []] if mapping.turns else []
    before = [t for t in texts if t[0] == "system"] if listed else texts
    return [(r, t) for r, t in [*before, *listed, *([t for t in texts if t[0] != "system"] if listed else [])]]


def turns_of_json(records: DataFrame, column: str = "record") -> DataFrame:
    """Turn rows (conv_id, turn, role, text) of rows with ``conv_id`` and a JSON text, by its layout.

    Null and broken records and those that are no objects give no turns. An object of unknown layout gives one row that
    holds its JSON as the text; null ``turn`` and ``role`` flag it.
    """
    bounded_batches(records.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column(column).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                turns = canonical_turns(record) if isinstance(record, dict) else []
                if turns is None:
                    out.append((conv, None, None, text))
                out += [(conv, i, role, said) for i, (role, said) in enumerate(turns or [])]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), column).mapInArrow(run, "conv_id long, turn long, role string, text string")


OPEN, CLOSE, COLON = "### ", "</turn>", ": "
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_NEXT_CLOSE = re.compile(r"\\.|(</turn>)", re.DOTALL)
_NEXT_COLON = re.compile(r"\\.|(: )", re.DOTALL)


def escape(text: str, control: re.Pattern[str] = _CONTROL) -> str:
    """Puts a backslash before each control string and backslash."""
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment of the training text, and the span of its text under the loss mask (empty if it has none)."""
    head, body = OPEN + escape(role, _ROLE_CONTROL) + COLON, escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + CLOSE + "\n", *span


def _until(pattern: re.Pattern[str], text: str, at: int) -> re.Match[str]:
    for m in pattern.finditer(text, at):
        if m[1]:
            return m
    raise ValueError("the text does not follow the template")


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns of a training text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("the text does not follow the template")
        colon = _until(_NEXT_COLON, formatted, at + len(OPEN))
        close = _until(_NEXT_CLOSE, formatted, colon.end())
        yield unescape(formatted[at + len(OPEN) : colon.start()]), unescape(formatted[colon.end() : close.start()])
        at = close.end() + 1


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Turn rows with the turns of a conversation together and in order, spread by conversation.

    The mapping that the fingerprint of the table's fields selects says which columns these are; other columns are
    passed over, whatever their names. Roles are put through ``ROLES``, but for those of canonical turns, which stay. Null turns come first, equal turns follow by role and text. Rows are streamed, so a
    conversation of any length needs no more memory than a batch.
    """
    mapping = row_mapping(schema_paths(rows.schema))
    empty, role = F.lit(""), F.col(mapping.role)
    if mapping.key != CANONICAL_KEY:
        role = F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[role], role)
    columns = {"conv_id": F.col(mapping.key).cast("long"), "turn": F.col(mapping.order).cast("long"), "role": F.coalesce(role, empty), "text": F.coalesce(mapping.text, empty)}
    turns = rows.select(*(c.alias(name) for name, c in columns.items()))
    return turns.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SEGMENTS = "conv_id long, turn long, segment string, loss_start int, loss_end int"


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_end``: the training text of each turn, in order within a conversation.

    A conversation's text is its segments one after another; the loss span counts code points within
    the segment. Null texts and roles are empty; null ``conv_id`` rows form one conversation. An empty
    table gives no rows.
    """
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            made = [format_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True))],
                names=["conv_id", "turn", "segment", "loss_start", "loss_end"],
            )

    return ordered_turns(rows).mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation, from its formatted segments in order: see ``op7_chat_format``."""

    def run(batches):
        conv, state = None, None

        def row():
            n, turns, loss, chars, formatted = state
            return conv[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for c, segment, start, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or conv != (c,):
                    if state is not None:
                        out.append(row())
                    conv, state = (c,), [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in read_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                said = unescape(segment[start:end])
                state[2].update(said.encode())
                state[3] += len(said)
                state[4] += len(segment)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds, strict=True)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
