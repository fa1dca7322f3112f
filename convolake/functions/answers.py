"""Read structured items out of free-form model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V
from .text import FENCE

# The observation types a skill may have.
OBS_TYPES = ["workflow", "bugfix", "feature", "decision", "discovery"]

_NO_MAP = "cast(map() as map<string,array<string>>)"
_NO_TEMPLATES = "cast(array() as array<struct<name:string,template:string,description:string>>)"


def _without_fences(raw: str) -> str:
    def kept(text: str) -> str:
        lines = V.keep(f"split({text}, chr(10), -1)", lambda l: f"not startswith({V.stripped(l)}, '{FENCE}')")
        return f"case when startswith({text}, '{FENCE}') then array_join({lines}, chr(10)) else {text} end"

    return V.bind(V.stripped(raw), kept)


def _between(text: str, opening: str, closing: str) -> str:
    """From the first ``opening`` to the last ``closing``; NULL when there is no such span."""
    start = f"instr({text}, '{opening}')"
    end = f"length({text}) - instr(reverse({text}), '{closing}') + 1"
    return V.bind(f"named_struct('a', {start}, 'z', {end})", lambda at: (
        f"case when {at}.a > 0 and {at}.z <= length({text}) and {at}.z >= {at}.a"
        f" then substr({text}, {at}.a, {at}.z - {at}.a + 1) end"))


def _parsed(json: str, objects: bool, arrays: bool) -> str:
    def items(value: str) -> str:
        return V.bind(V.kind_of(value), lambda kind: (
            f"case when {arrays} and {kind} = 'array' then {V.items_of(value)}"
            f" when {objects} and {kind} = 'object' then array({value}) end"))

    return V.bind(f"try_parse_json({json})", items)


def _answer_items(raw: str) -> str:
    found = V.bind(_without_fences(raw), lambda text: (
        f"coalesce({_parsed(text, True, True)}, {_parsed(_between(text, '[', ']'), False, True)},"
        f" {_parsed(_between(text, '{', '}'), True, False)})"))
    return f"coalesce({found}, cast(array() as array<variant>))"


def answer_items(raw: str) -> Column:
    """Items of an answer as ``array<variant>``: the whole text, else the span in
    square brackets, else the span in braces; an empty array when none parses."""
    return F.expr(_answer_items(raw))


def answer_objects(raw: str) -> Column:
    """The items of an answer that are JSON objects."""
    return F.expr(V.keep(_answer_items(raw), lambda item: V.is_kind(item, "object")))


def _json_list(text: str, on_scalar: str, on_invalid: str) -> str:
    invalid = V.NO_STRINGS if on_invalid == "empty" else f"array({text})"

    def items(value: str) -> str:
        scalar = {"wrap": f"array({V.as_text(value)})", "empty": V.NO_STRINGS, "text": f"array({text})"}[on_scalar]
        return V.bind(V.kind_of(value), lambda kind: (
            f"case when {kind} = 'array' then {V.each(V.items_of(value), V.as_text)}"
            f" when {kind} is not null then {scalar} else {invalid} end"))

    return f"case when coalesce({text}, '') = '' then {V.NO_STRINGS} else {V.bind(f'try_parse_json({text})', items)} end"


def json_list(text: str, on_scalar: str = "wrap", on_invalid: str = "wrap") -> Column:
    """JSON list text to ``array<string>``.

    ``on_scalar`` says what a valid value that is no list gives and ``on_invalid``
    what text that is no JSON gives: ``wrap`` keeps it as the only item, ``empty``
    gives no items, ``text`` gives the text as the only item.
    """
    return F.expr(_json_list(text, on_scalar, on_invalid))


def _symbol_map(value: str) -> str:
    entries = f"try_variant_get({value}, '$', 'map<string,variant>')"
    listed = (
        f"transform_values({entries}, (mk, mv) -> coalesce({V.each(V.items_of('mv'), V.as_text)},"
        f" case when {V.is_kind('mv', 'string')} then array({V.as_text('mv')}) end, {V.NO_STRINGS}))")
    return f"coalesce({listed}, {_NO_MAP})"


def json_map(text: str) -> Column:
    """JSON object text to ``map<string, array<string>>``; anything else is empty.

    A bare string stands for a list of one.
    """
    return F.expr(_symbol_map(f"try_parse_json({text})"))


def _joined(item: str, name: str, separator: str) -> str:
    """A field as text: a list joined, a missing value or null empty."""
    return V.bind(V.child(item, f"$.{name}"), lambda value: V.bind(V.kind_of(value), lambda kind: (
        f"case when {kind} = 'array' then array_join({V.each(V.items_of(value), V.as_text)}, {separator})"
        f" when {kind} is null or {kind} = 'null' then '' else {V.as_text(value)} end")))


def _list_field(item: str, name: str) -> str:
    return V.bind(V.child(item, f"$.{name}"), lambda value: V.bind(V.kind_of(value), lambda kind: (
        f"case when {kind} = 'array' then {V.each(V.items_of(value), V.as_text)}"
        f" when {kind} = 'string' then {V.bind(V.as_text(value), lambda text: _json_list(text, 'wrap', 'wrap'))}"
        f" else {V.NO_STRINGS} end")))


def _templates(item: str) -> str:
    def template(t: str) -> str:
        return (f"named_struct('name', {V.as_text(V.child(t, '$.name'))},"
                f" 'template', {V.truthy_text_at(t, '$.template')},"
                f" 'description', {V.truthy_text_at(t, '$.description')})")

    def listed(value: str) -> str:
        inner = f"try_parse_json({V.string_at(value, '$')})"
        objects = V.keep(f"coalesce({V.items_of(value)}, {V.items_of(inner)})", lambda t: V.is_kind(t, "object"))
        return f"coalesce({V.each(objects, template)}, {_NO_TEMPLATES})"

    return V.bind(V.child(item, "$.command_templates"), listed)


def _known_type(item: str) -> str:
    named = f"coalesce({V.child(item, '$.type')}, {V.child(item, '$.obs_type')})"
    known = ", ".join(f"'{t}'" for t in OBS_TYPES)
    return V.bind(V.string_at(named, "$"), lambda name: (
        f"case when {name} in ({known}) then {name} else 'workflow' end"))


def _file_map(item: str) -> str:
    return V.bind(V.child(item, "$.file_map"), lambda value: (
        f"case when {V.is_kind(value, 'string')} then {_symbol_map(f'try_parse_json({V.as_text(value)})')}"
        f" else {_symbol_map(value)} end"))


def skill_fields(item: str) -> list[Column]:
    """The columns of one skill, normalised to the table's types, from a JSON object.

    ``files`` stands in for a missing ``files_read``.
    """
    fields = {
        "skill_id": f"coalesce({V.as_text(V.child(item, '$.skill_id'))}, 'new')",
        # a title of false, 0, {} or [] is none
        "title": f"case when {V.is_truthy(V.child(item, '$.title'))} then {_joined(item, 'title', 'chr(10)')} else '' end",
        **{name: _joined(item, name, "chr(10)") for name in ("description", "steps")},
        "tags": _joined(item, "tags", "','"),
        "obs_type": _known_type(item),
        "facts": _list_field(item, "facts"),
        "concepts": _list_field(item, "concepts"),
        "files_read": f"case when {V.child(item, '$.files_read')} is null then {_list_field(item, 'files')}"
                      f" else {_list_field(item, 'files_read')} end",
        "files_modified": _list_field(item, "files_modified"),
        "narrative": _joined(item, "narrative", "chr(10)"),
        "recurring": f"coalesce({V.is_truthy(V.child(item, '$.recurring'))}, true)",
        "file_map": _file_map(item),
        "command_templates": _templates(item),
    }
    return [F.expr(text).alias(name) for name, text in fields.items()]


def rule_text(item: str) -> Column:
    """The non-empty string under ``rule``; NULL otherwise."""
    return F.expr(f"nullif({V.string_at(item, '$.rule')}, '')")
