"""A reader of the YAML that configurations, romaji tables and keymaps are written in.

Block mappings and lists by indentation, flow lists and mappings, quoted and plain scalars,
comments. No anchors, tags, multi-line scalars or several documents.
"""

from __future__ import annotations

import json
import re
from typing import Any

_SCALAR = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'")
_KEY = re.compile(rf"({_SCALAR.pattern}|[^\s#\[{{\"'-][^#]*?|-[^\s#][^#]*?|[^\w\s#]):(?:\s+|$)")


def load(text: str) -> Any:
    """The value of a document; null for an empty one. What can't be read is a ValueError."""
    stripped = text.lstrip()
    if stripped[:1] in ("{", "["):
        return json.loads(stripped)
    rows = []
    for raw in text.splitlines():
        line = _uncommented(raw).rstrip()
        if line.strip() and line.strip() not in ("---", "..."):
            rows.append((len(line) - len(line.lstrip(" ")), line.strip()))
    if not rows:
        return None
    value, end = _block(rows, 0, rows[0][0])
    if end < len(rows):
        raise ValueError(f"unexpected line: {rows[end][1]}")
    return value


def _uncommented(line: str) -> str:
    at = 0
    while at < len(line):
        if line[at] in "\"'" and (at == 0 or line[at - 1] in " [{,:-") and (m := _SCALAR.match(line, at)):
            at = m.end()
        elif line[at] == "#" and (at == 0 or line[at - 1] in " \t"):
            return line[:at]
        else:
            at += 1
    return line


def _block(rows: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    if rows[at][1] == "-" or rows[at][1].startswith("- "):
        items = []
        while at < len(rows) and rows[at][0] == indent and (rows[at][1] == "-" or rows[at][1].startswith("- ")):
            rest = rows[at][1][1:].lstrip()
            if rest and _KEY.match(rest):  # a mapping that begins on the line of its dash
                inner = indent + len(rows[at][1]) - len(rest)
                rows[at] = (inner, rest)
                value, at = _block(rows, at, inner)
            elif rest:
                value, at = scalar(rest), at + 1
            else:
                value, at = _nested(rows, at, indent)
            items.append(value)
        return items, at
    mapping = {}
    while at < len(rows) and rows[at][0] == indent:
        m = _KEY.match(rows[at][1])
        if not m:
            raise ValueError(f"no key: {rows[at][1]}")
        rest = rows[at][1][m.end() :].strip()
        if rest:
            value, at = scalar(rest), at + 1
        else:
            value, at = _nested(rows, at, indent)
        mapping[scalar(m[1]) if _SCALAR.fullmatch(m[1]) else m[1].strip()] = value
    return mapping, at


def _nested(rows: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    """What stands below a key or dash; null for nothing. A list may stand at the key's own indentation."""
    after = at + 1
    if after < len(rows) and (rows[after][0] > indent or (rows[after][0] == indent and rows[after][1].startswith("- ") and not rows[at][1].startswith("-"))):
        return _block(rows, after, rows[after][0])
    return None, after


def scalar(text: str) -> Any:
    if text[0] == "[" and text[-1] == "]":
        return [scalar(x) for x in _parts(text[1:-1])]
    if text[0] == "{" and text[-1] == "}":
        return {str(scalar(m[1].strip())): scalar(x[m.end() :].strip()) for x in _parts(text[1:-1]) if (m := re.match(rf"({_SCALAR.pattern}|[^:]+):\s*", x))}
    if text[0] == '"' and _SCALAR.fullmatch(text):
        return json.loads(text)
    if text[0] == "'" and _SCALAR.fullmatch(text):
        return text[1:-1].replace("''", "'")
    fixed = {"null": None, "~": None, "true": True, "false": False}
    if text.lower() in fixed:
        return fixed[text.lower()]
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def _parts(text: str) -> list[str]:
    """What commas outside quotes and inner brackets part."""
    out, at, begin, depth = [], 0, 0, 0
    while at < len(text):
        if m := _SCALAR.match(text, at):
            at = m.end()
            continue
        depth += (text[at] in "[{") - (text[at] in "]}")
        if text[at] == "," and not depth:
            out.append(text[begin:at].strip())
            begin = at + 1
        at += 1
    return [x for x in [*out, text[begin:].strip()] if x]
