"""JSON text that keeps every byte but the string tokens that change.

``scan`` reads strict JSON into a plain value (numbers become 0, as only strings matter) and the places of
its string tokens in document order; ``splice`` writes new tokens into those places.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import NamedTuple

from ..functions.redact import units
from ..options import Limits, Refused

_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_LONE = re.compile("[\ud800-\udfff]")


class Malformed(Exception):
    """Not JSON."""


class Token(NamedTuple):
    start: int
    end: int
    value: str


class _Reader:
    def __init__(self, text: str, limits: Limits) -> None:
        self.text, self.limits, self.at, self.nodes = text, limits, 0, 0
        self.tokens: list[Token] = []

    def peek(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def want(self, mark: str) -> None:
        if self.peek() != mark:
            raise Malformed
        self.at += 1

    def string(self) -> Token:
        start = self.at
        if self.text[start : start + 1] != '"':
            raise Malformed
        try:
            value, self.at = scanstring(self.text, start + 1, True)
        except ValueError:
            raise Malformed from None
        return Token(start, self.at, value)

    def limit(self, count: int, name: str, message: str) -> None:
        if count > self.limits.get(name):
            raise Refused(f"{name}_exceeded", message=f"Tool argument JSON exceeded the configured {message} limit.")

    def value(self, depth: int) -> object:
        self.limit(depth, "max_object_depth", "object depth")
        self.nodes += 1
        self.limit(self.nodes, "max_total_nodes", "node count")
        first = self.peek()
        if first == '"':
            token = self.string()
            self.tokens.append(token)
            return token.value
        if first == "{":
            return self.members(depth)
        if first == "[":
            return self.items(depth)
        if first in _WORDS:
            word, value = _WORDS[first]
            if not self.text.startswith(word, self.at):
                raise Malformed
            self.at += len(word)
            return value
        number = _NUMBER.match(self.text, self.at)
        if not number:
            raise Malformed
        self.at = number.end()
        return 0

    def members(self, depth: int) -> dict:
        self.at += 1
        found: dict[str, object] = {}
        if self.peek() == "}":
            self.at += 1
            return found
        while True:
            self.peek()
            key = self.string().value
            if key in found:
                raise Refused("unsupported_json_like", message="Tool argument JSON cannot contain duplicate object keys.")
            self.limit(len(found) + 1, "max_object_keys", "object key")
            found[key] = None
            self.want(":")
            found[key] = self.value(depth + 1)
            if self.peek() == "}":
                self.at += 1
                return found
            self.want(",")

    def items(self, depth: int) -> list:
        self.at += 1
        found: list = []
        if self.peek() == "]":
            self.at += 1
            return found
        while True:
            self.limit(len(found) + 1, "max_array_length", "array length")
            found.append(self.value(depth + 1))
            if self.peek() == "]":
                self.at += 1
                return found
            self.want(",")


def scan(text: str, limits: Limits) -> tuple[object, list[Token]]:
    """The value with numbers as 0, and its string tokens (not keys) in order. Raises Malformed or Refused."""
    reader = _Reader(text, limits)
    reader.limit(units(text), "max_string_length", "string length")
    try:
        value = reader.value(0)
    except RecursionError:
        raise Refused("max_object_depth_exceeded") from None
    if reader.peek():
        raise Malformed
    return value, reader.tokens


def quoted(text: str) -> str:
    """A JSON string token; lone surrogates are escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def strings(value: object) -> list[str]:
    """The strings of a value (not keys) in document order."""
    found: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, dict):
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return found


def splice(text: str, tokens: list[Token], value: object) -> str:
    """The text with the tokens whose string changed in ``value``."""
    parts, at = [], 0
    for token, new in zip(tokens, strings(value), strict=True):
        if new != token.value:
            parts += [text[at : token.start], quoted(new)]
            at = token.end
    return "".join(parts) + text[at:]
