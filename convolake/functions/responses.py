"""Flatten the nested items of an assistant response into text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V


@dataclass(frozen=True)
class ResponseCaps:
    """Characters kept of the parts of a response; ``None`` keeps all of a part.

    A thought of ``thinking`` characters or more is left out; ``response`` is the whole text
    that is stored.
    """

    # Fixed values.
    output: int | None = 500
    tool_output: int | None = 300
    thinking: int | None = 500
    response: int | None = 5000


CAPS = ResponseCaps()
WHOLE = ResponseCaps(None, None, None, None)


def _cut(text: str, chars: int | None) -> str:
    return text if chars is None else f"substring({text}, 1, {int(chars)})"


def _present(*parts: str) -> str:
    return V.keep(f"array({', '.join(parts)})", lambda p: f"{p} is not null")


def _terminal(item: str, caps: ResponseCaps) -> str:
    def lines(data: str) -> str:
        code = V.as_text(V.child(data, "$.terminalCommandState.exitCode"))
        shown = f"coalesce(concat(' exit=', nullif({code}, '')), '')"
        output = V.truthy_text_at(data, "$.terminalCommandOutput.text")
        plain = rf"replace(regexp_replace({output}, r'\x1b\[[0-9;]*m', ''), chr(13), '')"
        return _present(
            f"concat('[cmd] ', {V.truthy_text_at(data, '$.commandLine.original')})",
            f"concat('[output', {shown}, '] ', {_cut(V.stripped(plain), caps.output)})")

    return V.bind(V.child(item, "$.toolSpecificData"), lines)


def _tool_output(text: str, caps: ResponseCaps) -> str:
    return f"concat('[tool-output] ', {_cut(V.stripped(text), caps.tool_output)})"


def _details(item: str, caps: ResponseCaps) -> str:
    given = f"coalesce(concat(' input: ', {V.truthy_text_at(item, '$.resultDetails.input')}), '')"
    head = f"concat('[tool:', {V.truthy_text_at(item, '$.toolId')}, ']', {given})"
    listed = V.each(V.items_of(item, "$.resultDetails.output"), lambda e: (
        f"case when {V.is_kind(e, 'object')} then {_tool_output(V.truthy_text_at(e, '$.value'), caps)} end"))
    single = _tool_output(f"nullif({V.string_at(item, '$.resultDetails.output')}, '')", caps)
    return V.keep(f"concat(array({head}), coalesce({listed}, array({single})))", lambda p: f"{p} is not null")


def _message(item: str) -> str:
    past = V.truthy_text_at(item, "$.pastTenseMessage.value")
    running = V.truthy_text_at(item, "$.invocationMessage")
    return _present(f"concat('[tool] ', coalesce({past}, {running}))")


def _tool_result(item: str, caps: ResponseCaps) -> str:
    """Lines for one tool call: terminal data, else result details, else its message."""
    details = f"case when {V.is_kind(V.child(item, '$.resultDetails'), 'object')} then {_details(item, caps)} else {V.NO_STRINGS} end"
    other = V.bind(details, lambda d: f"case when size({d}) > 0 then {d} else {_message(item)} end")
    terminal = V.string_at(item, "$.toolSpecificData.kind")
    return f"case when coalesce({terminal} = 'terminal', false) then {_terminal(item, caps)} else {other} end"


def _markdown(item: str) -> str:
    direct = f"nullif({V.string_at(item, '$.value')}, '')"
    return _present(f"coalesce({direct}, nullif({V.string_at(item, '$.content.value')}, ''))")


def _thinking(item: str, caps: ResponseCaps) -> str:
    short = "" if caps.thinking is None else " and length({0}) < " + str(int(caps.thinking))
    return V.bind(V.stripped(V.truthy_text_at(item, "$.value")), lambda text: _present(
        f"case when length({text}) > 0{short.format(text)} then concat('[thinking] ', {text}) end"))


def _edit(item: str) -> str:
    def lines(place: str) -> str:
        count = f"concat(cast({place}.edits as string), ' change(s)')"
        return _present(
            f"case when {place}.file is not null then concat('[edit] ', {place}.file, ' (', {count}, ')')"
            f" when {place}.edits > 0 then concat('[edit] ', {count}) end")

    file = V.truthy_text_at(item, "$.uri.path")
    edits = f"coalesce(array_size({V.items_of(item, '$.edits')}), 0)"
    return V.bind(f"named_struct('file', {file}, 'edits', {edits})", lines)


def _response_item(item: str, caps: ResponseCaps) -> str:
    """Lines for one response item; other kinds and non-objects give none."""
    return V.bind(V.string_at(item, "$.kind"), lambda kind: (
        f"case {kind} when 'markdownContent' then {_markdown(item)} when 'thinking' then {_thinking(item, caps)}"
        f" when 'toolInvocationSerialized' then {_tool_result(item, caps)} when 'textEditGroup' then {_edit(item)}"
        f" else {V.NO_STRINGS} end"))


def response_text(request: str, caps: ResponseCaps = CAPS) -> Column:
    """All parts of a request's response in order, one per line; NULL when there are none."""
    parts = V.each(V.items_of(request, "$.response"), lambda item: _response_item(item, caps))
    return F.expr(V.bind(f"array_join(flatten({parts}), chr(10))", lambda text: f"nullif({text}, '')"))


def user_text(request: str) -> Column:
    """``message.text`` of an object, a scalar as text; NULL for anything absent."""
    return F.expr(V.bind(V.child(request, "$.message"), lambda message: V.bind(
        V.kind_of(message), lambda kind: (
            f"case when {kind} = 'object' then {V.truthy_text_at(message, '$.text')}"
            f" when {kind} <> 'null' then {V.as_text(message)} end"))))
