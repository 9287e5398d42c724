"""Reading of JSON texts in Python workers."""

from __future__ import annotations

import json
import re

_DECODE = json.JSONDecoder().decode
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))')


class Incomplete(ValueError):
    """The text is not complete JSON."""


def parse(text: str):
    """The value of a text that is complete JSON as a whole, else Incomplete. Depth is not limited; of repeated keys the last holds."""
    try:
        return _DECODE(text)
    except RecursionError:
        return _deep(text)
    except ValueError:
        raise Incomplete from None


def _deep(text: str):
    """parse without recursion, for texts nested deeper than the interpreter's stack."""
    out: list = []
    stack: list[list] = [["top", out, None]]  # kind, container, key that waits for its value
    pos, want, n = 0, "value", len(text.rstrip(" \t\r\n"))
    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            raise Incomplete
        pos = m.end()
        mark, string, other = m.groups()
        kind, box, key = stack[-1]
        if mark in ("]", "}"):
            if kind != {"]": "list", "}": "dict"}[mark] or want not in ("comma", "first"):
                raise Incomplete
            stack.pop()
            want = "comma"
            continue
        if mark == ",":
            if want != "comma" or kind == "top":
                raise Incomplete
            want = "value" if kind == "list" else "key"
            continue
        if mark == ":":
            if want != "colon":
                raise Incomplete
            want = "value"
            continue
        if kind == "dict" and want in ("key", "first"):
            if string is None:
                raise Incomplete
            stack[-1][2] = _DECODE(string)
            want = "colon"
            continue
        if want not in ("value", "first"):
            raise Incomplete
        new = {} if mark == "{" else [] if mark == "[" else _DECODE(string or other)
        if kind == "dict":
            box[key] = new
        else:
            box.append(new)
        if mark:
            stack.append(["dict" if mark == "{" else "list", new, None])
            want = "first"
        else:
            want = "comma"
    if len(stack) != 1 or len(out) != 1:
        raise Incomplete
    return out[0]


def opened(value):
    """A text that is complete JSON of an object or list stands for it, however often it is wrapped; other values for themselves."""
    while isinstance(value, str):
        head = value.lstrip(" \t\r\n")[:1]
        if not head or head not in '{["':
            return value
        try:
            inner = parse(value)
        except Incomplete:
            return value
        if isinstance(inner, str):
            deep = opened(inner)
            return value if isinstance(deep, str) else deep
        return inner if isinstance(inner, (dict, list)) else value
    return value
