"""The template language: a recursive-descent parser and the analysis that turns clauses into match settings.

A template is a list of elements, ``Name(attribute = value, ...) { children }``, and of named definitions,
``Match<Type> Name { clauses }``, that the attributes ``match`` and ``end_match`` may name. Fractions are kept
as thousandths, so 0.85 and 850 are one number, and a threshold of 1 is a thousandth: both are kept as they
are known to users, the second with a warning.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

TYPES = ("Section", "TextChunk", "Table", "Image", "ImageSummary", "ImageBytes", "ImageCaption", "ImageEmbedding", "Paragraph")


class TemplateError(ValueError):
    """The text is not a template."""


@dataclass(frozen=True)
class Name:
    """A bare word used as a value."""

    text: str


Value = str | int | bool | Name | list


@dataclass
class MatchConfig:
    kind: str
    pattern: str
    threshold: float = 0.6
    options: dict[str, Value] = field(default_factory=dict)


@dataclass
class Comparison:
    left: str
    operator: str
    right: Value


@dataclass
class Call:
    name: str
    positional: list[Any] = field(default_factory=list)
    named: dict[str, Any] = field(default_factory=dict)


@dataclass
class Definition:
    name: str
    target: str
    clauses: list[MatchConfig | Call | Value]


@dataclass(eq=False)
class Element:
    name: str
    type: str
    attributes: dict[str, Value] = field(default_factory=dict)
    children: list[Element] = field(default_factory=list)
    match: MatchConfig | None = None
    end_match: MatchConfig | None = None
    position: int = 0
    number: int = 0  # in the whole tree, in writing order
    siblings: list[Element] = field(default_factory=list, repr=False)

    def before(self) -> Element | None:
        return self.siblings[self.position - 1] if self.position > 0 else None

    def after(self) -> Element | None:
        return self.siblings[self.position + 1] if self.position + 1 < len(self.siblings) else None


@dataclass
class Template:
    elements: list[Element]
    definitions: dict[str, Definition]

    def walk(self) -> Iterator[Element]:
        todo = list(reversed(self.elements))
        while todo:
            e = todo.pop()
            yield e
            todo += reversed(e.children)


def as_string(v: Value | None) -> str | None:
    return v.text if isinstance(v, Name) else v if isinstance(v, str) else None


def as_number(v: Value | None) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def as_boolean(v: Value | None) -> bool | None:
    return v if isinstance(v, bool) else None


def as_array(v: Value | None) -> list | None:
    return v if isinstance(v, list) else None


TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][-+]?\d+)?)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<sign>>=|<=|==|!=|[(){}\[\]<>,=]))""",
    re.ASCII,
)


class Parser:
    def __init__(self, text: str, empty_arrays: bool = False):
        self.text, self.at, self.empty_arrays = text, 0, empty_arrays
        self.tokens: list[tuple[str, str, int]] = []
        end = len(text.rstrip(" \t\r\n"))
        while self.at < end:
            m = TOKEN.match(text, self.at)
            if not m:
                raise TemplateError(f"unexpected character at {self.at}: {text[self.at : self.at + 20]!r}")
            self.tokens.append((m.lastgroup or "", m.group(m.lastgroup or 0), m.start(m.lastgroup or 0)))
            self.at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.i + ahead
        return self.tokens[k][:2] if k < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        kind, text = self.peek()
        if text not in wanted and kind not in wanted:
            place = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
            raise TemplateError(f"expected {' or '.join(wanted)} at {place}, found {text or 'the end'!r}")
        self.i += 1
        return text

    def have(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] != "string":
            self.i += 1
            return True
        return False

    def listed(self, close: str, one) -> list:
        out = []
        while not self.have(close):
            out.append(one())
            if not self.have(","):
                self.take(close)
                break
        return out

    def template(self) -> Template:
        elements, definitions = [], {}
        while self.i < len(self.tokens):
            if self.peek()[1] == "Match" and self.peek(1)[1] == "<":
                d = self.definition()
                definitions[d.name] = d
            else:
                elements.append(self.element())
        link(elements)
        return Template(elements, definitions)

    def definition(self) -> Definition:
        self.take("Match"), self.take("<")
        target = self.take("name")
        self.take(">")
        name = self.take("name")
        self.take("{")
        clauses: list = []
        while not self.have("}"):
            if self.peek()[0] == "name" and self.peek(1)[1] == "(":
                call = self.call()
                clauses.append(config_of(call) or call)
            else:
                clauses.append(self.value())
        return Definition(name, target, clauses)

    def call(self) -> Call:
        call = Call(self.take("name"))
        self.take("(")

        def argument() -> None:
            if self.peek()[0] == "name" and self.peek(1)[1] == "=":
                key = self.take("name")
                self.take("=")
                call.named[key] = self.argument_value()
            else:
                call.positional.append(self.argument_value())

        self.listed(")", argument)
        return call

    def argument_value(self) -> Any:
        if self.peek()[0] == "name":
            if self.peek(1)[1] in (">=", "<=", "==", "!=", ">", "<") and self.peek(1)[0] == "sign":
                left, operator = self.take("name"), self.take("sign")
                right = self.value()
                if isinstance(right, list):
                    raise TemplateError("a list can't be compared")
                return Comparison(left, operator, right)
            if self.peek(1)[1] == "(":
                return self.call()
        return self.value()

    def element(self) -> Element:
        name = self.take("name")
        attributes: dict[str, Value] = {}
        if self.have("("):

            def attribute() -> None:
                key = self.take("name")
                self.take("=")
                attributes[key] = self.value()

            self.listed(")", attribute)
        children: list[Element] = []
        if self.have("{"):
            while not self.have("}"):
                children.append(self.element())
        link(children)
        return Element(name, name if name in TYPES else "Unknown", attributes, children)

    def value(self) -> Value:
        kind, text = self.peek()
        if kind == "string":
            self.i += 1
            return text[1:-1]
        if kind == "number":
            self.i += 1
            return int(text) if re.fullmatch(r"-?\d+", text) else int(float(text) * 1000)
        if kind == "name":
            self.i += 1
            return text == "true" if text in ("true", "false") else Name(text)
        self.take("[")
        out = self.listed("]", self.value)
        return [] if self.empty_arrays else out


def link(elements: list[Element]) -> None:
    for k, e in enumerate(elements):
        e.position, e.siblings = k, elements


def config_of(call: Call) -> MatchConfig | None:
    """The settings that a clause stands for, if it is one of the matching functions with a text."""
    if call.name not in ("Text", "Cosine", "Semantic", "Regex") or not call.positional or not isinstance(call.positional[0], str):
        return None
    threshold = {"Text": 0.8, "Regex": 1.0}.get(call.name, 0.7)
    options = {}
    if call.name != "Regex":
        for v in call.positional[1:]:
            if as_number(v) is not None:
                threshold = v / 1000
    for key, v in call.named.items():
        if key == "threshold" and call.name != "Regex":
            threshold = v / 1000 if as_number(v) is not None else threshold
        elif not isinstance(v, (Call, Comparison)):
            options[key] = v
    if call.name != "Regex" and threshold == 0.001:
        warnings.warn("a threshold of 1 means a thousandth; write 0.999 for almost equal", stacklevel=2)
    return MatchConfig(call.name.lower(), call.positional[0], threshold, options)


def literal_config(v: Value | None) -> MatchConfig | None:
    """A text, or a list of pattern, thousandths, type and options."""
    if isinstance(v, str):
        return MatchConfig("text", v, 0.6)
    if not isinstance(v, list) or not v or as_string(v[0]) is None:
        return None
    threshold = as_number(v[1]) if len(v) > 1 else None
    kind = (as_string(v[2]) or "text").lower() if len(v) > 2 else "text"
    extra = as_array(v[3]) or [] if len(v) > 3 else []
    return MatchConfig(kind if kind in ("text", "semantic", "regex", "cosine") else f"custom:{kind}", as_string(v[0]), 0.6 if threshold is None else threshold / 1000, {as_string(k): x for k, x in zip(extra[::2], extra[1::2], strict=False) if as_string(k)})


def resolve(template: Template) -> Template:
    """Gives each element the settings of its match and end_match: of a definition's first matching clause, or of a literal."""
    for number, e in enumerate(template.walk()):
        e.number = number
        for key in ("match", "end_match"):
            v = e.attributes.get(key)
            if isinstance(v, Name):
                d = template.definitions.get(v.text)
                found = next((c for c in d.clauses if isinstance(c, MatchConfig)), None) if d else None
            else:
                found = literal_config(v)
            setattr(e, key, found)
    return template


def parse_template(text: str, empty_arrays: bool = False) -> Template:
    """empty_arrays: lists lose their content, as some users' templates rely on."""
    return resolve(Parser(text, empty_arrays).template())
