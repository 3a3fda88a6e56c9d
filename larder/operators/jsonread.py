"""JSON texts to Python values with an explicit stack: any depth, no character that UTF-8 lacks."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

SKIP = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?")
WORDS = {"true": True, "false": False, "null": None}
LONE = re.compile("[\ud800-\udfff]")
#: Keys that a script lists first, in order of their number: those below this.
INDEXES = 2**32 - 1
#: Digits of an integer that is kept exact; longer ones become floats, as all are in scripts.
EXACT = 300


def _after_space(text: str, at: int) -> int:
    return SKIP.match(text, at).end()


def _string(text: str, at: int) -> tuple[str, int]:
    """The string whose quote stands at a place; halves of surrogate pairs become U+FFFD."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no string at {at}")
    value, end = scanstring(text, at + 1, True)
    return LONE.sub("\ufffd", value), end


def _key(text: str, at: int) -> tuple[str, int]:
    key, at = _string(text, at)
    at = _after_space(text, at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _after_space(text, at + 1)


def _scalar(text: str, at: int) -> tuple[object, int]:
    if text[at : at + 1] == '"':
        return _string(text, at)
    if m := NUMBER.match(text, at):
        exact = not m[2] and not m[3] and len(m[1]) <= EXACT
        return int(m[1]) if exact else float(m[0]), m.end()
    for word, value in WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    raise ValueError(f"no value at {at}")


def _is_index(key: str) -> bool:
    return key.isascii() and key.isdigit() and len(key) <= 10 and str(int(key)) == key and int(key) < INDEXES


def _as_scripts_do(box: dict[str, object]) -> dict[str, object]:
    """An object's keys as scripts list them: indexes by number, then the others as they came."""
    numbers = sorted(filter(_is_index, box), key=int)
    return {k: box[k] for k in [*numbers, *(k for k in box if not _is_index(k))]} if numbers else box


def parse(text: str) -> object:
    """The value of a JSON text; ValueError where it is none. A repeated key's last value counts."""
    open_: list[tuple[dict | list, str | None]] = []
    at = _after_space(text, 0)
    while True:
        kind = text[at : at + 1]
        if kind in ("{", "["):
            value: object = {} if kind == "{" else []
            at = _after_space(text, at + 1)
            if text[at : at + 1] != ("}" if kind == "{" else "]"):
                key, at = _key(text, at) if kind == "{" else (None, at)
                open_.append((value, key))
                continue
            at += 1
        else:
            value, at = _scalar(text, at)
        while open_:  # put the value into what holds it, and end what ends here
            box, key = open_.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            at = _after_space(text, at)
            if text[at : at + 1] == ",":
                at = _after_space(text, at + 1)
                key, at = (None, at) if key is None else _key(text, at)
                open_.append((box, key))
                break
            if text[at : at + 1] != ("]" if key is None else "}"):
                raise ValueError(f"neither comma nor end at {at}")
            value, at = box if key is None else _as_scripts_do(box), at + 1
        else:
            if _after_space(text, at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def told(value: object) -> str:
    """A value as JSON again; empty if it is too deep for that."""
    try:
        return json.dumps(value)
    except RecursionError:
        return ""
