"""JSON parsing shared by the Arrow stages: strict documents of any depth, kept entry order, kept repeated keys,
numbers as they are written."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.encoder import encode_basestring

#: Digits up to which a whole number becomes an int.
INT_DIGITS = 4000


class Repeated(dict):
    """An object whose text repeats a key: the last value counts, `entries` has them all."""

    entries: list


class Literal(float):
    """A number whose text says more than its value: fractions and very long integers."""

    __slots__ = ("text",)

    def __new__(cls, text):
        found = float.__new__(cls, text)
        found.text = text
        return found


def _object(pairs):
    found = dict(pairs)
    if len(found) == len(pairs):
        return found
    found = Repeated(found)
    found.entries = pairs
    return found


def _integer(text):
    return int(text) if len(text) < INT_DIGITS and text != "-0" else Literal(text)


def _constant(text):
    raise ValueError(f"{text} is no JSON")


_decoder = json.JSONDecoder(object_pairs_hook=_object, parse_int=_integer, parse_float=Literal, parse_constant=_constant)
_fast = json.JSONDecoder(parse_int=_integer, parse_float=Literal, parse_constant=_constant)

_blank = re.compile(r"[ \t\n\r]*")
_number = re.compile(r"(-?(?:0|[1-9][0-9]*))((?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)")
_WORDS = {"true": True, "false": False, "null": None}
_word = re.compile("true|false|null")


def _scalar(text, at):
    if text.startswith('"', at):
        return scanstring(text, at + 1, True)
    if found := _word.match(text, at):
        return _WORDS[found[0]], found.end()
    found = _number.match(text, at)
    if not found:
        raise ValueError("no value")
    return (Literal(found[0]) if found[2] else _integer(found[0])), found.end()


def _key(text, at):
    if not text.startswith('"', at):
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = _blank.match(text, at).end()
    if not text.startswith(":", at):
        raise ValueError("no colon")
    return key, _blank.match(text, at + 1).end()


def decode_deep(text):
    """The value of a text of any depth: open containers wait in a list, not on the interpreter's stack."""
    open_, at = [], _blank.match(text).end()
    while True:
        bracket = text[at : at + 1]
        if bracket in ("{", "["):
            at = _blank.match(text, at + 1).end()
            closing = "}" if bracket == "{" else "]"
            keys, items = [], []
            if not text.startswith(closing, at):
                open_.append((closing, keys, items))
                if bracket == "{":
                    key, at = _key(text, at)
                    keys.append(key)
                continue
            value, at = ({} if bracket == "{" else []), at + 1
        else:
            value, at = _scalar(text, at)
        while open_:  # the value is complete: it may complete what encloses it
            closing, keys, items = open_[-1]
            items.append(value)
            at = _blank.match(text, at).end()
            if text.startswith(",", at):
                at = _blank.match(text, at + 1).end()
                if closing == "}":
                    key, at = _key(text, at)
                    keys.append(key)
                break
            if not text.startswith(closing, at):
                raise ValueError("no end")
            open_.pop()
            value, at = (_object(list(zip(keys, items))) if closing == "}" else items), at + 1
        else:
            if _blank.match(text, at).end() != len(text):
                raise ValueError("text after the value")
            return value


def parse_object(text, keep_entries=True):
    """The object that a text holds; None for null, broken and non-object documents."""
    if text is None:
        return None
    try:
        found = (_decoder if keep_entries else _fast).decode(text)
    except RecursionError:
        try:
            found = decode_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def entries(value: dict):
    return value.entries if isinstance(value, Repeated) else value.items()


def clean(text: str) -> str:
    """Text that UTF-8 can hold: a lone surrogate becomes '?'."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


class _Written(str):
    """A part of a JSON text that is already as it must be."""


def written(value) -> str:
    """A value of any depth as compact JSON, numbers as they were written."""
    out, due = [], [value]
    while due:
        x = due.pop()
        if isinstance(x, _Written):
            out.append(x)
        elif isinstance(x, str):
            out.append(encode_basestring(x))
        elif x is None or isinstance(x, bool):
            out.append({None: "null", True: "true", False: "false"}[x])
        elif isinstance(x, Literal):
            out.append(x.text)
        elif isinstance(x, dict):
            parts = [_Written("{")]
            for i, (key, below) in enumerate(x.items()):
                parts += [_Written(("," if i else "") + encode_basestring(key) + ":"), below]
            due += reversed([*parts, _Written("}")])
        elif isinstance(x, list):
            parts = [_Written("[")]
            for i, below in enumerate(x):
                parts += [_Written(","), below] if i else [below]
            due += reversed([*parts, _Written("]")])
        else:
            out.append(repr(x))
    return "".join(out)


def as_text(value):
    """A leaf as text: strings and numbers as they are, everything else as compact JSON; None for null."""
    if value is None:
        return None
    return clean(value if isinstance(value, str) else written(value))


def type_of(value):
    """string, integer, fraction, boolean, object or array; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, Literal):
        return "integer" if value.text.lstrip("-").isdigit() else "fraction"
    return "object" if isinstance(value, dict) else "array"


#: How deep pruned() keeps containers, and how many characters it keeps of a number.
KEPT_DEPTH, KEPT_DIGITS = 32, 30


def pruned(document: dict, fields, depth: int = KEPT_DEPTH):
    """A document with some of its fields, for parsers with limits: containers below `depth` are empty, and a longer
    number is only a fraction. Types stay as they are."""

    def cut(value, left):
        if isinstance(value, dict):
            return {k: cut(v, left - 1) for k, v in value.items()} if left else {}
        if isinstance(value, list):
            return [cut(v, left - 1) for v in value] if left else []
        if isinstance(value, Literal) and len(value.text) > KEPT_DIGITS or isinstance(value, int) and abs(value) >= 10**KEPT_DIGITS:
            return 0.5
        return value

    return {k: cut(v, depth) for k, v in document.items() if k in fields}
