"""Reading loosely typed JSON held as VARIANT.

These functions build SQL text from SQL text.  A value is bound once (``bind``) and
its type looked up once: written out in full, nested lookups would make generated
code too large to compile.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count()

NO_STRINGS = "cast(array() as array<string>)"


def bind(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a name that stands for ``value``, which is computed once."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def each(items: str, body: Callable[[str], str]) -> str:
    name = f"e{next(_names)}"
    return f"transform({items}, {name} -> {body(name)})"


def keep(items: str, test: Callable[[str], str]) -> str:
    name = f"f{next(_names)}"
    return f"filter({items}, {name} -> {test(name)})"


def _by_schema(v: str, body: Callable[[str, str], str]) -> str:
    return bind(v, lambda x: bind(f"schema_of_variant({x})", lambda schema: body(x, schema)))


def _nested(schema: str) -> str:
    return f"({schema} like 'OBJECT%' or {schema} like 'ARRAY%')"


def _text(x: str) -> str:
    return f"try_variant_get({x}, '$', 'string')"


def kind_of(v: str) -> str:
    """One of object, array, string, boolean, number, null; NULL where there is no value."""
    return bind(f"schema_of_variant({v})", lambda schema: (
        f"case when {schema} like 'OBJECT%' then 'object' when {schema} like 'ARRAY%' then 'array'"
        f" when {schema} = 'STRING' then 'string' when {schema} = 'BOOLEAN' then 'boolean'"
        f" when {schema} = 'VOID' then 'null' when {schema} is not null then 'number' end"))


def is_kind(v: str, kind: str) -> str:
    return f"coalesce({kind_of(v)} = '{kind}', false)"


def child(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def items_of(v: str, path: str = "$") -> str:
    """The array at ``path``; NULL when the value there is not an array."""
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def _as_text(x: str, schema: str) -> str:
    return (
        f"case when {schema} = 'STRING' then {_text(x)} when {schema} = 'BOOLEAN' then initcap({_text(x)})"
        f" when {schema} = 'VOID' then 'None' when {_nested(schema)} then to_json({x}) else {_text(x)} end")


def _is_truthy(x: str, schema: str) -> str:
    return (
        f"case when {schema} = 'STRING' then {_text(x)} <> ''"
        f" when {schema} = 'BOOLEAN' then try_variant_get({x}, '$', 'boolean') when {schema} = 'VOID' then false"
        f" when {_nested(schema)} then to_json({x}) not in ('[]', '{{}}')"
        f" else try_variant_get({x}, '$', 'double') <> 0 end")


def as_text(v: str) -> str:
    """Scalars as text (true and false spelled True and False), the rest as JSON."""
    return _by_schema(v, _as_text)


def string_at(v: str, path: str) -> str:
    """The string at ``path``; NULL when the value there has another type."""
    return _by_schema(child(v, path), lambda x, schema: f"case when {schema} = 'STRING' then {_text(x)} end")


def truthy_text_at(v: str, path: str) -> str:
    """Value at ``path`` as text, NULL when missing or empty in any sense."""
    return _by_schema(child(v, path), lambda x, schema: (
        f"case when {_is_truthy(x, schema)} then {_as_text(x, schema)} end"))


def is_truthy(v: str) -> str:
    """Truth of a JSON value: false, 0, null, "", [] and {} are false; missing is NULL."""
    return _by_schema(v, _is_truthy)


def stripped(text: str) -> str:
    """White space of every kind removed at both ends."""
    return rf"regexp_replace({text}, r'(?U)\A\s+|\s+\z', '')"
