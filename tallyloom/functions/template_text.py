"""Chat templates written as text, as configurations hold them, turned to column expressions.

The subset of the template language that such texts use: one loop over
``messages``, ``if``/``elif``/``else``, ``set`` of a fixed value, output of
expressions, comments. Expressions know strings, ``true``/``false``/``none``,
numbers, fields of the message (``message['role']``, ``message.content``),
``loop.first``/``last``/``index``/``index0``, ``add_generation_prompt``, ``+`` and
``~``, ``==`` and ``!=``, ``and``/``or``/``not``, ``is defined`` and the filter
``trim``. All else raises a ``ValueError`` when the text is compiled, before any
row is read.

What does not depend on a row is worked out while compiling, so a text without
the generation prompt leaves no trace of it in the plan. A line break behind a
statement goes, and so does white space in front of one that begins a line.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, strip

_PIECE = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+~()\[\].|=:]))", re.S)
_FIXED = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_UNSET = object()

Value = Any  # a fixed Python value or a Column


class _Unsupported(ValueError):
    def __init__(self, what: str):
        super().__init__(f"a chat template cannot hold {what}")


@dataclass(frozen=True)
class _Row:
    """The message a loop is at."""

    variable: str
    fields: dict[str, Column]
    first: Value
    last: Value
    index0: Value


@dataclass(frozen=True)
class _Scope:
    """What names stand for; ``names`` is shared, so that ``set`` is seen by what follows."""

    names: dict[str, Value]
    row: _Row | None = None
    loop: Callable[[list[_Node], str, _Scope], Value] | None = None
    #: False inside a branch that only some rows take.
    fixed: bool = True


_Node = Callable[[_Scope], Value]


def _col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _true(value: Value, kind: str) -> Value:
    """Whether a value counts as true; texts do unless they are empty."""
    if not isinstance(value, Column):
        return bool(value)
    return value if kind == "bool" else F.length(value) > 0


class _Expression:
    """One expression, read by descent; gives nodes with the kind of their value (``text``, ``bool``, ``int``, ``any``)."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        at = 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if found is None:
                raise _Unsupported(f"{source[at:].strip()!r}")
            self.tokens.append(found[0].strip())
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or (wanted and token not in wanted):
            raise _Unsupported(f"{token!r} where {' or '.join(wanted) or 'a value'} is due")
        self.at += 1
        return token

    def whole(self) -> tuple[_Node, str]:
        found = self.either()
        if self.at < len(self.tokens):
            raise _Unsupported(f"{self.peek()!r} behind an expression")
        return found

    def either(self) -> tuple[_Node, str]:
        return self._logic("or", self.both)

    def both(self) -> tuple[_Node, str]:
        return self._logic("and", self.negated)

    def _logic(self, word: str, part: Callable[[], tuple[_Node, str]]) -> tuple[_Node, str]:
        left, kind = part()
        if self.peek() != word:
            return left, kind
        nodes = [(left, kind)]
        while self.peek() == word:
            self.take()
            nodes.append(part())

        def run(scope: _Scope) -> Value:
            found: Value = word == "and"
            for node, own in nodes:
                value = _true(node(scope), own)
                if not isinstance(value, Column):
                    if value != (word == "and"):
                        return value
                elif not isinstance(found, Column):
                    found = value
                else:
                    found = found & value if word == "and" else found | value
            return found

        return run, "bool"

    def negated(self) -> tuple[_Node, str]:
        if self.peek() != "not":
            return self.compared()
        self.take()
        node, kind = self.negated()

        def run(scope: _Scope) -> Value:
            value = _true(node(scope), kind)
            return ~value if isinstance(value, Column) else not value

        return run, "bool"

    def compared(self) -> tuple[_Node, str]:
        left, kind = self.joined()
        if self.peek() in ("==", "!="):
            wanted = self.take() == "=="
            right, _ = self.joined()

            def run(scope: _Scope) -> Value:
                a, b = left(scope), right(scope)
                if not isinstance(a, Column) and not isinstance(b, Column):
                    return (a == b) == wanted
                same = _col(a).eqNullSafe(_col(b))
                return same if wanted else ~same

            return run, "bool"
        if self.peek() == "is":
            self.take()
            negated = self.peek() == "not"
            if negated:
                self.take()
            self.take("defined")
            return lambda scope: (left(scope) is not _UNSET) != negated, "bool"
        return left, kind

    def joined(self) -> tuple[_Node, str]:
        left, kind = self.filtered()
        if self.peek() not in ("+", "~"):
            return left, kind
        nodes = [left]
        while self.peek() in ("+", "~"):
            self.take()
            nodes.append(self.filtered()[0])

        def run(scope: _Scope) -> Value:
            values = [node(scope) for node in nodes]
            if any(value is _UNSET or value is None or isinstance(value, (bool, int)) for value in values):
                raise _Unsupported("a sum of anything but texts")
            if not any(isinstance(value, Column) for value in values):
                return "".join(values)
            return F.concat(*[_col(value) for value in values])

        return run, "text"

    def filtered(self) -> tuple[_Node, str]:
        node, kind = self.single()
        while self.peek() == "|":
            self.take()
            self.take("trim")
            node = (lambda inner: lambda scope: strip(inner(scope)) if isinstance(inner(scope), Column) else inner(scope).strip())(node)
        return node, kind

    def single(self) -> tuple[_Node, str]:
        token = self.take()
        if token == "(":
            found = self.either()
            self.take(")")
            return found
        if token[0] in "'\"":
            text = ast.literal_eval(token.replace("\n", "\\n"))
            return lambda scope: text, "text"
        if token.isdigit():
            number = int(token)
            return lambda scope: number, "int"
        if token in _FIXED:
            return lambda scope: _FIXED[token], "bool"
        if not token.isidentifier() or token in ("and", "or", "not", "is", "if", "else", "in"):
            raise _Unsupported(f"{token!r} as a value")
        if self.peek() in (".", "["):
            return self._field(token)
        return lambda scope: scope.names.get(token, _UNSET), "bool" if token == "add_generation_prompt" else "any"

    def _field(self, name: str) -> tuple[_Node, str]:
        if self.take() == ".":
            key = self.take()
        else:
            key = ast.literal_eval(self.take())
            self.take("]")
        if self.peek() in (".", "["):
            raise _Unsupported("a field of a field")

        def run(scope: _Scope) -> Value:
            row = scope.row
            if row is not None and name == "loop":
                found = {"first": row.first, "last": row.last, "index0": row.index0, "index": row.index0 + 1}
            elif row is not None and name == row.variable:
                found = row.fields
            else:
                raise _Unsupported(f"{name}.{key} there")
            if key not in found:
                raise _Unsupported(f"{name}.{key}")
            return found[key]

        return run, {"first": "bool", "last": "bool", "index": "int", "index0": "int"}.get(key, "text") if name == "loop" else "text"


def _shown(value: Value) -> Value:
    """A value as it is written out."""
    if value is _UNSET:
        return ""
    if isinstance(value, (bool, int)) or value is None:
        return str(value)
    return value


def _joined(values: list[Value]) -> Value:
    """Texts behind one another; fixed ones that meet become one."""
    found: list[Value] = []
    for value in values:
        if not isinstance(value, Column) and found and not isinstance(found[-1], Column):
            found[-1] += value
        elif isinstance(value, Column) or value:
            found.append(value)
    if not found:
        return ""
    if len(found) == 1:
        return found[0]
    return F.concat(*[_col(value) for value in found])


def _pieces(source: str) -> list[tuple[str, str]]:
    """Texts, statements and outputs in order, with the white space around statements settled."""
    found: list[tuple[str, str]] = []
    at = 0
    for piece in _PIECE.finditer(source):
        text, mark = source[at : piece.start()], piece[0]
        if mark.startswith(("{%-", "{{-")):
            text = text.rstrip()
        elif not mark.startswith("{{"):
            line = source[source.rfind("\n", 0, piece.start()) + 1 : piece.start()]
            if not line.strip(" \t"):
                text = text.rstrip(" \t")
        found.append(("text", text))
        at = piece.end()
        if mark.endswith(("-%}", "-}}")):
            at = len(source) - len(source[at:].lstrip())
        elif not mark.startswith("{{") and source.startswith("\n", at):
            at += 1
        if not mark.startswith("{#"):
            found.append(("output" if mark.startswith("{{") else "statement", mark[2:-2].strip("-").strip()))
    rest = source[at:]
    if re.search(r"\{[%{#]", rest):
        raise _Unsupported("a statement that is not closed")
    return [*found, ("text", rest[:-1] if rest.endswith("\n") else rest)]


class _Parser:
    """Nested statements of a template text."""

    def __init__(self, source: str):
        self.pieces = [piece for piece in _pieces(source) if piece != ("text", "")]
        self.at = 0

    def body(self, *ends: str) -> tuple[list[_Node], str]:
        """Nodes up to one of the closing statements, and that statement."""
        nodes: list[_Node] = []
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                nodes.append((lambda fixed: lambda scope: fixed)(text))
            elif kind == "output":
                node, _ = _Expression(text).whole()
                nodes.append((lambda inner: lambda scope: _shown(inner(scope)))(node))
            else:
                word, _, rest = text.partition(" ")
                word, rest = (text.split("(")[0], text[text.index("(") :]) if "(" in word else (word, rest)
                if word in ends:
                    return nodes, text
                nodes.append(self._statement(word, rest))
        if ends:
            raise _Unsupported(f"a statement without {' or '.join(ends)}")
        return nodes, ""

    def _statement(self, word: str, rest: str) -> _Node:
        if word == "if":
            return self._if(rest)
        if word == "for":
            match = re.match(r"(\w+)\s+in\s+messages\Z", rest.strip())
            if match is None:
                raise _Unsupported(f"a loop {rest!r}")
            nodes, _ = self.body("endfor")
            return lambda scope: self._each(nodes, match[1], scope)
        if word == "set":
            match = re.match(r"(\w+)\s*=\s*(.*)", rest.strip(), re.S)
            if match is None:
                raise _Unsupported(f"set {rest!r}")
            node, _ = _Expression(match[2]).whole()

            def run(scope: _Scope) -> Value:
                value = node(scope)
                if isinstance(value, Column) or not scope.fixed or scope.row is not None:
                    raise _Unsupported(f"{match[1]} set to what depends on a row")
                scope.names[match[1]] = value
                return ""

            return run
        raise _Unsupported(f"the statement {word!r}")

    @staticmethod
    def _each(nodes: list[_Node], variable: str, scope: _Scope) -> Value:
        if scope.loop is None or scope.row is not None or not scope.fixed:
            raise _Unsupported("a loop inside another statement")
        return scope.loop(nodes, variable, scope)

    def _if(self, rest: str) -> _Node:
        branches: list[tuple[tuple[_Node, str], list[_Node]]] = []
        condition, last = _Expression(rest).whole(), None
        while True:
            nodes, end = self.body("elif", "else", "endif")
            if condition is not None:
                branches.append((condition, nodes))
            else:
                last = nodes
            if end.startswith("elif"):
                condition = _Expression(end[4:]).whole()
            elif end == "else":
                condition = None
            else:
                break

        def run(scope: _Scope) -> Value:
            inner = _Scope(scope.names, scope.row, scope.loop, False)
            chosen: list[tuple[Column, Value]] = []
            rest_of: Value = ""
            for (node, kind), nodes in branches:
                test = _true(node(scope), kind)
                if isinstance(test, Column):
                    chosen.append((test, _joined([n(inner) for n in nodes])))
                elif test:
                    rest_of = _joined([n(inner if chosen else scope) for n in nodes])
                    break
            else:
                if last is not None:
                    rest_of = _joined([n(inner if chosen else scope) for n in last])
            if not chosen:
                return rest_of
            out = F.when(chosen[0][0], _col(chosen[0][1]))
            for test, text in chosen[1:]:
                out = out.when(test, _col(text))
            return out.otherwise(_col(rest_of))

        return run


def _row(variable: str, role: Column, content: Column, first: Value, last: Value, index0: Value) -> _Row:
    texts = {"role": F.coalesce(role, F.lit("")), "content": F.coalesce(content, F.lit(""))}
    return _Row(variable, texts, first, last, index0)


@dataclass(frozen=True)
class TextTemplate:
    """A compiled template text; ``text`` renders arrays of turns, ``turn_text`` rows of turn tables."""

    source: str
    nodes: list[_Node] = field(compare=False, repr=False)

    def _scope(self, generation: bool, loop: Callable[[list[_Node], str, _Scope], Value]) -> _Scope:
        return _Scope({"add_generation_prompt": generation}, None, loop)

    def text(self, messages: Column | str, generation: bool = False) -> Column:
        """The text of an array of {role, content}; null fields are empty, a null array gives null."""
        messages = as_column(messages)
        size = F.array_size(messages)

        def loop(nodes: list[_Node], variable: str, scope: _Scope) -> Value:
            def one(message: Column, index: Column) -> Column:
                row = _row(variable, message["role"], message["content"], index == 0, index == size - 1, index)
                return _col(_joined([node(_Scope(scope.names, row)) for node in nodes]))

            return F.array_join(F.transform(messages, one), "")

        scope = self._scope(generation, loop)
        text = _col(_joined([node(scope) for node in self.nodes]))
        return F.when(messages.isNotNull(), text)

    def turn_text(self, role: Column, content: Column, first: Column, last: Column, generation: bool = False) -> Column:
        """The part of a conversation's text that one of its turns makes.

        What stands before the loop goes with the first turn, what stands
        behind it with the last one. Numbers of turns (``loop.index``) are not known here and raise.
        """
        parts: list[list[Value]] = [[], [], []]

        class _NoNumber:
            def __add__(self, other: int) -> _NoNumber:
                return self

        def loop(nodes: list[_Node], variable: str, scope: _Scope) -> Value:
            if parts[1]:
                raise _Unsupported("two loops where turns are rows")
            row = _row(variable, role, content, first, last, _NoNumber())
            values = [node(_Scope(scope.names, row)) for node in nodes]
            if any(isinstance(value, _NoNumber) for value in values):
                raise _Unsupported("loop.index where turns are rows")
            parts[1].append(_joined(values))
            return ""

        scope = self._scope(generation, loop)
        for node in self.nodes:
            value = node(scope)
            parts[2 if parts[1] else 0].append(value)
        before, behind = _joined(parts[0]), _joined(parts[2])
        text = [F.when(first, before).otherwise(F.lit(""))] if isinstance(before, Column) or before else []
        text += [_col(_joined(parts[1]))]
        text += [F.when(last, behind).otherwise(F.lit(""))] if isinstance(behind, Column) or behind else []
        return F.concat(*text)


def compile_template(source: str) -> TextTemplate:
    """Compile a template text; what the subset does not have raises here, with and without the generation prompt."""
    nodes, _ = _Parser(source).body()
    found = TextTemplate(source, nodes)
    array = F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("content")))
    for generation in (False, True):
        found.text(array, generation)
    return found
