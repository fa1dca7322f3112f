"""``answers`` for one answer at a time in plain Python, for tasks that need an answer before they ask the next.

Gives what the expressions of ``answers`` and ``variants`` give for the same text: the rules of
VARIANT (sorted keys, no key twice, numbers as decimals where they are written so, what follows
the first value is not looked at) are kept.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from .answers import OBS_TYPES
from .text import FENCE

# white space of ``(?U)\s``
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?=[ \t\n\r]|\Z)")
_WORD = re.compile(r"true|false|null")
_DIGITS = 38  # of a decimal
_LONGEST_NUMBER = 1000
_DEEPEST = 1000
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPED = re.compile(r'["\\\x00-\x1f]')
_MISSING = object()


class _Number(str):
    """A number as its text."""

    def is_zero(self) -> bool:
        return float(self) == 0


def _java_double(value: float) -> str:
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "-0.0" if math.copysign(1, value) < 0 else "0.0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text = "".join(map(str, digits))
    at = len(text) + exponent  # place of the point
    if -3 < at <= 7:
        whole, part = (text[:at].ljust(at, "0"), text[at:]) if at > 0 else ("0", "0" * -at + text)
        out = f"{whole}.{part or '0'}"
    else:
        out = f"{text[0]}.{text[1:] or '0'}E{at - 1}"
    return f"-{out}" if sign else out


def _number(text: str) -> _Number:
    if len(text) > _LONGEST_NUMBER:
        raise ValueError("number too long")
    if not re.search("[eE]", text):
        value = Decimal(text)
        _, digits, exponent = value.as_tuple()
        if -exponent <= _DIGITS and len(digits) <= _DIGITS:
            plain = format(value, "f")
            if "." in plain:
                plain = plain.rstrip("0").rstrip(".")
            return _Number("0" if plain in ("-0", "0") else plain)
    return _Number(_java_double(float(text)))


def _well_formed(text: str) -> str:
    """Half characters as the question marks that Java writes for them."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _no_constant(name: str):
    raise ValueError(name)


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return {_well_formed(k): out[k] for k in sorted(out, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}


_decoder = json.JSONDecoder(
    object_pairs_hook=_object, parse_float=_number, parse_int=_number, parse_constant=_no_constant)


def _too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= _DEEPEST:
        return False
    depth = most = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S):
        depth += (c in "[{") - (c in "]}")
        most = max(most, depth)
    return most > _DEEPEST


def parsed(text: str | None):
    """The first JSON value of a text; ``_MISSING`` when there is none."""
    if text is None:
        return _MISSING
    start = _WHITE.match(text).end()
    if text[start:start + 1] in ("[", "{", '"'):
        try:
            value, end = _decoder.raw_decode(text, start)
        except (ValueError, RecursionError):
            return _MISSING
        return _MISSING if _too_deep(text[start:end]) else value
    found = _NUMBER.match(text, start)
    if found:
        try:
            return _number(found[0])
        except ValueError:
            return _MISSING
    found = _WORD.match(text, start)
    after = text[found.end():found.end() + 1] if found else ""
    if not found or after >= "0" and (after.isidentifier() or after.isdigit() or after in "$_"):
        return _MISSING
    return {"true": True, "false": False, "null": None}[found[0]]


def _quoted(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04X}", _well_formed(text)) + '"'


def to_json(value) -> str:
    """JSON as Spark writes it: no blanks, no escapes but those that have to be."""
    if isinstance(value, _Number):
        return _quoted(value) if value.endswith("y") else str(value)
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, list):
        return "[" + ",".join(map(to_json, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{to_json(v)}" for k, v in value.items()) + "}"
    return {True: "true", False: "false", None: "null"}[value]


def _as_text(value) -> str | None:
    if value is _MISSING:
        return None
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return _well_formed(value)
    return to_json(value) if isinstance(value, (list, dict)) else str(value)


def _is_truthy(value) -> bool | None:
    if value is _MISSING:
        return None
    return not value.is_zero() if isinstance(value, _Number) else bool(value)


def _is_text(value) -> bool:
    return isinstance(value, str) and not isinstance(value, _Number)


def _stripped(text: str) -> str:
    return text.strip(_SPACE)


def _between(text: str, opening: str, closing: str) -> str | None:
    a, z = text.find(opening), text.rfind(closing)
    return text[a:z + 1] if 0 <= a <= z else None


def answer_items(raw: str | None) -> list:
    """Items of an answer; see ``answers.answer_items``."""
    if raw is None:
        return []
    text = _stripped(_well_formed(raw))
    if text.startswith(FENCE):
        text = "\n".join(line for line in text.split("\n") if not _stripped(line).startswith(FENCE))
    for part, kinds in ((text, (list, dict)), (_between(text, "[", "]"), list), (_between(text, "{", "}"), dict)):
        value = parsed(part)
        if isinstance(value, kinds):
            return value if isinstance(value, list) else [value]
    return []


def _joined(item: dict, name: str, separator: str) -> str:
    value = item.get(name)
    if isinstance(value, list):
        return separator.join(map(_as_text, value))
    return "" if value is None else _as_text(value)


def _list_field(item: dict, name: str) -> list[str]:
    value = item.get(name)
    if isinstance(value, list):
        return [_as_text(v) for v in value]
    if not _is_text(value) or value == "":
        return []
    value, text = parsed(_well_formed(value)), _well_formed(value)
    if isinstance(value, list):
        return [_as_text(v) for v in value]
    return [text if value is _MISSING else _as_text(value)]


def _templates(item: dict) -> list[dict]:
    value = item.get("command_templates")
    if _is_text(value):
        value = parsed(_well_formed(value))
    out = []
    for t in value if isinstance(value, list) else []:
        if isinstance(t, dict):
            fields = {"name": t.get("name", _MISSING), **{
                k: t[k] for k in ("template", "description") if k in t and _is_truthy(t[k])}}
            out.append({k: _as_text(v) for k, v in fields.items() if v is not _MISSING})
    return out


def _file_map(item: dict) -> dict[str, list[str]]:
    value = item.get("file_map")
    if _is_text(value):
        value = parsed(_well_formed(value))
    return {
        k: [_as_text(x) for x in v] if isinstance(v, list) else [_as_text(v)] if _is_text(v) else []
        for k, v in value.items()} if isinstance(value, dict) else {}


def shown_fields(item: dict) -> dict:
    """The fields of ``answers.skill_fields`` that a prompt shows of a skill."""
    named = item["type"] if "type" in item else item.get("obs_type")
    return {
        "skill_id": _as_text(item["skill_id"]) if "skill_id" in item else "new",
        "title": _joined(item, "title", "\n") if _is_truthy(item.get("title", _MISSING)) else "",
        "description": _joined(item, "description", "\n"), "steps": _joined(item, "steps", "\n"),
        "tags": _joined(item, "tags", ","),
        "obs_type": named if _is_text(named) and named in OBS_TYPES else "workflow",
        "facts": _list_field(item, "facts"), "concepts": _list_field(item, "concepts"),
        "file_map": _file_map(item), "command_templates": _templates(item),
    }
