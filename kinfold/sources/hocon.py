"""Project files: the relaxed superset of JSON in which configurations are written.

Comments (# and //), root braces left out, `=` or `:` or nothing before `{`, dotted and quoted keys, unquoted and
triple-quoted strings, newlines for commas, trailing commas, repeated objects that merge, `+=`, values beside each
other that are joined, and references ${path} and ${?path}, which fall back on the environment. `include` and a
reference to the very value it stands in are errors.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """A text that can't be read, with its line, or a reference without a value."""


@dataclass(frozen=True)
class Reference:
    path: tuple[str, ...]
    optional: bool


@dataclass(frozen=True)
class Joined:
    """Parts beside each other, with the blanks before each, or (merge) an older and a newer value of one key."""

    parts: tuple
    blanks: tuple = ()
    merge: bool = False


class Bare(str):
    """Unquoted text: a number, true, false or null if it stands alone."""

    def value(self):
        if re.fullmatch(r"-?\d+", self):
            return int(self)
        if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", self):
            return float(self)
        return {"true": True, "false": False, "null": None}.get(str(self), str(self))


MISSING = object()
NEVER_BARE = set('$"{}[]:=,+#`^?!@*&\\')


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text.removeprefix("﻿"), 0

    def fail(self, what: str):
        raise SyntaxProblem(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def sees(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def blanks(self) -> str:
        start = self.at
        while self.peek() and self.peek() != "\n" and self.peek().isspace():
            self.at += 1
        return self.text[start : self.at]

    def gap(self, commas: bool = False) -> None:
        """Blanks, newlines and comments, and commas between members."""
        while True:
            self.blanks()
            if self.peek() == "#" or self.sees("//"):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif self.peek() == "\n" or commas and self.peek() == ",":
                self.at += 1
            else:
                return

    def ends_value(self) -> bool:
        return self.peek() in ("", "\n", ",", "}", "]", "#") or self.sees("//")

    def quoted(self) -> str:
        if self.sees('"""'):
            end = self.text.find('"""', self.at + 3)
            if end < 0:
                self.fail("a string without an end")
            while self.text.startswith('"', end + 3):  # quotes before the last three belong to the text
                end += 1
            out, self.at = self.text[self.at + 3 : end], end + 3
            return out
        found = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(self.text, self.at)
        if not found:
            self.fail("a string without an end")
        self.at = found.end()
        try:
            return json.loads(found.group())
        except ValueError:
            self.fail("a wrong escape")

    def bare(self, more_stops: str = "") -> str:
        start = self.at
        while self.peek() and not self.peek().isspace() and self.peek() not in NEVER_BARE and self.peek() not in more_stops and not self.sees("//"):
            self.at += 1
        if start == self.at:
            self.fail(f"unexpected {self.peek()!r}")
        return self.text[start : self.at]

    def path(self, closing: str = "") -> tuple[str, ...]:
        """A key: parts with dots between; blanks inside a part stay, those around the key go."""
        parts: list[str] = []
        part, given = "", False
        while True:
            before = self.blanks()
            c = self.peek()
            if c == "" or c in ":={\n" or self.sees("+=") or closing and c in closing:
                break
            if c == ".":
                if not given:
                    self.fail("an empty part of a key")
                self.at += 1
                parts.append(part)
                part, given = "", False
                continue
            part += (before if given else "") + (self.quoted() if c == '"' else self.bare("."))
            given = True
        if not given:
            self.fail("a key is missing")
        return (*parts, part)

    def reference(self) -> Reference:
        self.at += 2
        optional = self.peek() == "?"
        self.at += optional
        path = self.path("}")
        if self.peek() != "}":
            self.fail("a reference without an end")
        self.at += 1
        return Reference(path, optional)

    def value(self):
        parts, blanks = [], []
        while True:
            before = self.blanks()
            if self.ends_value():
                break
            c = self.peek()
            blanks.append(before)
            if c == "{":
                parts.append(self.object())
            elif c == "[":
                parts.append(self.array())
            elif c == '"':
                parts.append(self.quoted())
            elif self.sees("${"):
                parts.append(self.reference())
            else:
                parts.append(Bare(self.bare()))
        if not parts:
            self.fail("a value is missing")
        if len(parts) == 1:
            return parts[0].value() if isinstance(parts[0], Bare) else parts[0]
        return Joined(tuple(parts), tuple(blanks))

    def array(self) -> list:
        self.at += 1
        out = []
        while True:
            self.gap(commas=True)
            if self.peek() == "]":
                self.at += 1
                return out
            if not self.peek():
                self.fail("a list without an end")
            out.append(self.value())

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        self.members(out)
        if self.peek() != "}":
            self.fail("an object without an end")
        self.at += 1
        return out

    def members(self, out: dict) -> None:
        while True:
            self.gap(commas=True)
            if self.peek() in ("", "}"):
                return
            if re.compile(r'include\s*("|url\(|file\(|classpath\(|required\()').match(self.text, self.at):
                self.fail("include isn't supported")
            path = self.path()
            if self.sees("+="):
                self.at += 2
                self.gap()
                put(out, path, [self.value()], append=True)
            else:
                if self.peek() and self.peek() in ":=":
                    self.at += 1
                    self.gap()
                elif self.peek() != "{":
                    self.fail(f"no value for {'.'.join(path)}")
                put(out, path, self.value())
            self.blanks()
            if not self.ends_value():
                self.fail(f"unexpected {self.peek()!r}")

    def document(self) -> dict:
        self.gap()
        if self.peek() == "{":
            out = self.object()
        else:
            out = {}
            self.members(out)
        self.gap()
        if self.peek():
            self.fail(f"unexpected {self.peek()!r}")
        return out


def put(tree: dict, path: tuple[str, ...], value, append: bool = False) -> None:
    key, rest = path[0], path[1:]
    if rest:
        inner: dict = {}
        put(inner, rest, value, append)
        if append and isinstance(tree.get(key), dict):
            put(tree[key], rest, value, True)
            return
        value = inner
    old = tree.get(key, MISSING)
    if append and not rest and old is not MISSING:
        tree[key] = old + value if isinstance(old, list) else Joined((old, value), ("", ""))
    elif isinstance(old, dict) and isinstance(value, dict):
        for k, v in value.items():
            put(old, (k,), v)
    elif old is not MISSING and isinstance(value, (dict, Reference, Joined)) and isinstance(old, (dict, Reference, Joined)):
        tree[key] = Joined((old, value), merge=True)
    else:
        tree[key] = value


def text_of(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


class Resolver:
    def __init__(self, root: dict) -> None:
        self.root, self.open = root, []

    def find(self, ref: Reference):
        if ref in self.open:
            raise SyntaxProblem(f"${{{'.'.join(ref.path)}}} stands in its own value")
        self.open.append(ref)
        try:
            at = self.root
            for k, part in enumerate(ref.path):
                at = at if isinstance(at, dict) else self.solve(at)
                if not isinstance(at, dict) or part not in at:
                    at = os.environ.get(".".join(ref.path), MISSING) if k == 0 else MISSING
                    break
                at = at[part]
            out = at if at is MISSING else self.solve(at)
        finally:
            self.open.pop()
        if out is MISSING and not ref.optional:
            raise SyntaxProblem(f"${{{'.'.join(ref.path)}}} has no value")
        return out

    def solve(self, x):
        if isinstance(x, dict):
            own = {k: self.solve(v) for k, v in x.items()}
            return {k: v for k, v in own.items() if v is not MISSING}
        if isinstance(x, list):
            return [v for v in map(self.solve, x) if v is not MISSING]
        if isinstance(x, Reference):
            return self.find(x)
        if not isinstance(x, Joined):
            return x
        parts = [(b, self.solve(p)) for b, p in zip(x.blanks or ("",) * len(x.parts), x.parts, strict=True)]
        parts = [(b, p) for b, p in parts if p is not MISSING]
        if not parts:
            return MISSING
        values = [p for _, p in parts]
        if all(isinstance(v, dict) for v in values):
            out: dict = {}
            for v in values:
                for k, w in json.loads(json.dumps(v)).items():
                    put(out, (k,), w)
            return out
        if x.merge or len(values) == 1:
            return values[-1]
        if all(isinstance(v, list) for v in values):
            return [w for v in values for w in v]
        if any(isinstance(v, (dict, list)) for v in values):
            raise SyntaxProblem("texts, lists and objects can't be joined with each other")
        return "".join((b if k else "") + text_of(v) for k, (b, v) in enumerate(parts))


def parse(text: str) -> dict:
    """The tree of a configuration text, references resolved."""
    root = Reader(text).document()
    return Resolver(root).solve(root)
