"""Chat formatting: many layouts of records into canonical turns, and turns into one text.

**Layouts.** A record is a JSON object.  The set of its nested field paths (``[]`` stands for
a list's items) is its schema; a hash of the sorted paths is its fingerprint.  A mapping says,
for one schema, where the turns are: either a list with the fields of role and text in each
item, or single fields that hold the text of one role each.  Records whose fingerprint has no
mapping of its own take the first mapping all of whose paths they have.

**Template.** A turn is ``<s>ROLE\\n`` text ``</s>\\n``.  The strings that mark turns, and those
of other templates, are escaped inside texts by a backslash after their first character, as is
every backslash run there, so reading back is exact.  The loss mask covers the texts of
assistant turns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of this template and of common other ones.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
BEGIN, END, LINE = "<s>", "</s>\n", "\n"

_FIRST = "".join(sorted({regex.escape(c[0]) for c in CONTROL}))
_ESCAPE = regex.compile(rf"([{_FIRST}])(\\*)(?=" + "|".join(sorted({regex.escape(c[1:]) for c in CONTROL})) + ")")
_UNESCAPE = regex.compile(rf"([{_FIRST}])\\(\\*)(?=" + "|".join(sorted({regex.escape(c[1:]) for c in CONTROL})) + ")")
_TURN = regex.compile(r"<s>([^\n]*)\n(.*?)</s>\n", regex.DOTALL)
_ROLE = regex.compile(r"\\(n|\\)")


def escape(text: str) -> str:
    """One backslash more between the first character and the rest of every control string."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


# -- layouts --------------------------------------------------------------------

@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns."""

    turns: str | None = None  # path of the list, such as "messages"
    role: str = "role"
    text: str = "content"
    single: tuple[tuple[str, str], ...] = ()  # (path, role) in order
    roles: dict[str, str] = field(default_factory=dict, hash=False)  # other names of roles

    def paths(self) -> set[str]:
        if self.turns is not None:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        return {path for path, _ in self.single}


_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
PLAIN = [Mapping(turns="messages"), Mapping(turns="turns", text="text"), Mapping(turns="conversations", role="from", text="value")]
MAPPINGS = [
    Mapping(turns="messages", roles=_ROLES),
    Mapping(turns="turns", text="text", roles=_ROLES),
    Mapping(turns="conversations", role="from", text="value", roles=_ROLES),
    Mapping(single=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping(single=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping(single=(("instruction", "user"), ("output", "assistant"))),
    Mapping(single=(("prompt", "user"), ("completion", "assistant"))),
    Mapping(single=(("prompt", "user"), ("response", "assistant"))),
    Mapping(single=(("question", "user"), ("answer", "assistant"))),
]


def field_paths(value, at: str = "") -> Iterator[str]:
    """Paths of all leaves of a JSON value."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from field_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


class Mapper:
    """Chooses the mapping of a record by its fingerprint."""

    def __init__(self, mappings: list[Mapping] = MAPPINGS):
        self.mappings = mappings
        self.known: dict[str, Mapping | None] = {fingerprint(m.paths()): m for m in reversed(mappings)}

    def mapping(self, record) -> tuple[str, Mapping | None]:
        paths = set(field_paths(record))
        print_ = fingerprint(paths)
        if print_ not in self.known:
            if len(self.known) > 10_000:
                self.known = {fingerprint(m.paths()): m for m in reversed(self.mappings)}
            self.known[print_] = next((m for m in self.mappings if m.paths() <= paths), None)
        return print_, self.known[print_]

    def turns(self, record) -> tuple[str, list[tuple[str, str]] | None]:
        """(fingerprint, turns); None where no mapping fits."""
        print_, mapping = self.mapping(record)
        if mapping is None:
            return print_, None
        if mapping.turns is not None:
            items = _get(record, mapping.turns) or []
            return print_, [
                (mapping.roles.get(role, role), _text(item.get(mapping.text)))
                for item in items if isinstance(item, dict) for role in [_text(item.get(mapping.role))]]
        found: list[tuple[str, str]] = []
        for path, role in mapping.single:
            text = _text(_get(record, path))
            if found and found[-1][0] == role:  # an instruction and its input are one turn
                found[-1] = (role, f"{found[-1][1]}\n\n{text}" if text else found[-1][1])
            elif text or role != "system":
                found.append((role, text))
        return print_, found


def _get(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(records: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``conv_id, turn, role, text, fingerprint`` of ``records (conv_id, turn, record)``, JSON texts.

    A record's turns are numbered from its ``turn`` on.  A record that is null, no JSON object
    or of an unknown layout gives one row without role and text, so that nothing vanishes unseen.
    """
    def run(batches):
        mapper = Mapper(mappings)
        for batch in batches:
            out: list[tuple] = []
            for conv, first, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                print_, turns = mapper.turns(record) if isinstance(record, dict) else (None, None)
                if not turns:
                    out.append((conv, first, None, None, print_))
                else:
                    out.extend((conv, first if first is None else first + i, role, text, print_) for i, (role, text) in enumerate(turns))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "role", "text", "fingerprint"])

    return records.select("conv_id", "turn", "record").mapInArrow(run, "conv_id long, turn long, role string, text string, fingerprint string")


# -- template -------------------------------------------------------------------

def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and begin and end of its text in it."""
    head = BEGIN + role.replace("\\", "\\\\").replace("\n", "\\n") + LINE  # a role is one line
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    return [(_ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, formatted, loss_begin, loss_end`` of ``turns (conv_id, turn, role, text)``.

    One row for each turn: a conversation of any length is the concatenation of its rows
    by ``turn``.  The loss span is empty unless the role is ``assistant``.  A null text is an
    empty one, a null role an empty one; rows that repeat are turns that repeat.
    """
    def run(batches):
        for batch in batches:
            parts, begins, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                part, begin, end = format_turn(role or "", text or "")
                parts.append(part)
                begins.append(begin if role == "assistant" else 0)
                ends.append(end if role == "assistant" else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                ["conv_id", "turn", "formatted", "loss_begin", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, turn long, formatted string, loss_begin int, loss_end int")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation says, read back from it.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.  A digest of a
    whole conversation has to see its turns in order; they pass by one at a time, sorted, so
    memory does not follow a conversation's length.  Rows without ``conv_id`` are one
    conversation; rows without ``turn`` come first; equal turns come in the order of their text.
    """
    def run(batches):
        current, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, part, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(_closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(part)
                masked = unescape(part[begin:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
            yield _digest_rows(done)
        yield _digest_rows([_closed(current, state)] if state is not None else [])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return (
        formatted.select("conv_id", "turn", "formatted", "loss_begin", "loss_end")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema)
    )


def _closed(conv, state) -> tuple:
    n, turns, chars, loss, formatted = state
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def as_records(turns: DataFrame) -> DataFrame:
    """Each row of ``turns`` as a JSON record of one of three layouts, by its conversation.

    One record for each turn keeps records small however long a conversation is.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit(""))
    layouts = [
        F.struct(F.array(F.struct(role, text.alias("content"))).alias("messages")),
        F.struct(F.array(F.struct(role, text.alias("text"))).alias("turns")),
        F.struct(F.array(F.struct(role.alias("from"), text.alias("value"))).alias("conversations")),
    ]
    which = F.pmod(F.col("conv_id"), F.lit(len(layouts)))
    record = F.to_json(layouts[0])
    for i, layout in enumerate(layouts[1:], 1):
        record = F.when(which == i, F.to_json(layout)).otherwise(record)
    return turns.select("conv_id", "turn", record.alias("record"))
