"""Structure of a source text: its units, its declarations, where they lie.

Python is parsed by its own parser; no grammar of another language is at hand, so their units are lines.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of declarations that are functions, and kinds that are classes; others are neither.
FUNCTION_KINDS = (
    "function_definition", "function_declaration", "function_item", "function_signature", "generator_function_declaration", "arrow_function", "method_definition",
    "method_declaration", "method_signature", "method", "singleton_method", "constructor_declaration",
)
CLASS_KINDS = (
    "class_definition", "class_declaration", "class_specifier", "class", "record_declaration", "interface_declaration", "protocol_declaration", "trait_item", "enum_declaration",
    "enum_item", "enum_specifier", "struct_declaration", "struct_item", "struct_specifier", "object_declaration",
)


def bucket(kind: Column) -> Column:
    """functions, classes or null for the kind of a declaration."""
    low = F.lower(F.trim(kind))
    return F.when(low.isin(*FUNCTION_KINDS), "functions").when(low.isin(*CLASS_KINDS), "classes")


class Index:
    """Bytes, lines and signs of a text: lines count from 1, columns are bytes from 0."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines(keepends=True)
        self.data = text.encode()
        self.signs = np.cumsum([0, *map(len, self.lines)])
        self.bytes = np.cumsum([0, *(len(line.encode()) for line in self.lines)])

    def place(self, at: int) -> tuple[int, int]:
        """(line, column) of a byte; the end of the text lies behind its last sign. Inside a sign there is no place."""
        if not 0 <= at <= len(self.data) or (at < len(self.data) and self.data[at] & 0xC0 == 0x80):
            raise ValueError(f"{at} is no place between two signs")
        line = int(np.searchsorted(self.bytes, at, side="right"))
        if line > len(self.lines) and self.lines and not self.lines[-1].endswith(("\n", "\r")):
            line = len(self.lines)
        return (line, at - int(self.bytes[line - 1]))

    def byte(self, line: int, column: int) -> int:
        return int(self.bytes[line - 1]) + column

    def sign(self, at: int) -> int:
        """Signs before a byte."""
        line, column = self.place(at)
        row = self.lines[line - 1] if line <= len(self.lines) else ""
        return int(self.signs[line - 1]) + len(row.encode()[:column].decode())


@dataclass(frozen=True)
class Declared:
    kind: str
    name: str
    start: int  # bytes
    end: int
    signature: str


@dataclass(frozen=True)
class Structure:
    """``units`` are (start, end) in bytes and cover the text; ``declared`` come in the order of their start."""

    mode: str
    units: list[tuple[int, int]]
    declared: list[Declared]


def _declared(tree: ast.AST, index: Index) -> list[Declared]:
    found, todo = [], [(tree, "")]
    while todo:
        node, inside = todo.pop()
        for child in ast.iter_child_nodes(node):
            within = inside
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                within = f"{inside}.{child.name}" if inside else child.name
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                head = index.byte(first, 0) if first < child.lineno else index.byte(child.lineno, child.col_offset)
                start, end = head, index.byte(child.end_lineno, child.end_col_offset)
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                last = child.body[0]
                signature = index.data[index.byte(child.lineno, child.col_offset) : index.byte(last.lineno, last.col_offset)].decode().split("\n")[0].strip()
                found.append(Declared(kind, within, start, end, signature))
            todo.append((child, within))
    return sorted(found, key=lambda d: (d.start, -d.end))


def structure(text: str, language: str | None) -> Structure:
    """Declarations of the top and the gaps between them where the text parses, else its lines.

    A unit of a declaration goes from the start of its first line to the end of its last.
    """
    index = Index(text)
    lines = [(int(a), int(b)) for a, b in zip(index.bytes, index.bytes[1:], strict=False)]
    # the parser counts lines by line feeds alone
    if (language or "").lower() != "python" or any(not line.endswith("\n") for line in index.lines[:-1]):
        return Structure("lexical", lines, [])
    try:
        declared = _declared(ast.parse(text), index)
    except (SyntaxError, ValueError, RecursionError):
        return Structure("lexical", lines, [])
    cuts, end = {0, len(index.data)}, -1
    for d in declared:
        if d.start >= end:
            first, last = index.place(d.start)[0], index.place(d.end)[0]
            end = int(index.bytes[min(last, len(lines))])
            if int(index.bytes[first - 1]) >= max(cuts - {len(index.data)}):
                cuts |= {int(index.bytes[first - 1]), end}
    marks = sorted(cuts)
    return Structure("syntax", [(a, b) for a, b in zip(marks, marks[1:], strict=False) if a < b], declared)
