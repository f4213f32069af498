"""Syntax chunks: Python by its own parser, other languages by a scanner for top-level braces.

The scanner is approximate: it finds declarations by their leading keywords and matching
braces outside strings and comments. Anything it can't place is left to what follows (merging and line windows).
"""

from __future__ import annotations

import ast
import re
from .chunk import CAP, OVERLAP, WINDOW

SYNTAX_LANGUAGES = ("rust", "python", "typescript", "tsx", "javascript", "go", "java", "c", "cpp")
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
#: For each language what a declaration's first line looks like, its category, and whether it holds members.
_FORMS = {
    "rust": [(rf"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+{_NAME}", "function", False), (rf"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+{_NAME}", "struct", False), (rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}", "enum", False), (rf"(?:pub(?:\([^)]*\))?\s+)?type\s+{_NAME}", "type", False), (rf"(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?:[^{{]*\bfor\s+)?{_NAME}", "impl", True), (rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_NAME}", "trait", True), (rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+{_NAME}", "module", True), (rf"(?:macro_rules!\s*|(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?){_NAME}", "block", False)],
    "typescript": [(rf"(?:async\s+)?function\s+{_NAME}", "function", False), (rf"abstract\s+class\s+{_NAME}", "class", False), (rf"class\s+{_NAME}", "class", True), (rf"interface\s+{_NAME}", "trait", False), (rf"(?:const\s+)?enum\s+{_NAME}", "enum", False), (rf"(?:namespace|module)\s+{_NAME}", "module", True)],
    "javascript": [(rf"(?:async\s+)?function\s*\*?\s*{_NAME}", "function", False), (rf"class\s+{_NAME}", "class", True)],
    "go": [(rf"func\s+\([^)]*\)\s*{_NAME}", "method", False), (rf"func\s+{_NAME}", "function", False), (rf"type\s+{_NAME}", "type", False)],
    "java": [(rf"(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*class\s+{_NAME}", "class", True), (rf"(?:(?:public|protected|private|abstract|static)\s+)*interface\s+{_NAME}", "trait", True), (rf"(?:(?:public|protected|private|static)\s+)*enum\s+{_NAME}", "enum", True)],
    "c": [(rf"(?:typedef\s+)?struct\s+{_NAME}\s*\{{", "struct", False), (rf"enum\s+{_NAME}\s*\{{", "enum", False), (rf"typedef\b[^;{{]*?{_NAME}\s*;", "type", False), (rf"[A-Za-z_][\w\s\*]*?\b{_NAME}\s*\([^;{{]*\)\s*\{{", "function", False)],
    "cpp": [(rf"class\s+{_NAME}[^;{{]*\{{", "class", True), (rf"struct\s+{_NAME}[^;{{]*\{{", "struct", True), (rf"namespace\s+{_NAME}\s*\{{", "module", True), (rf"enum\s+(?:class\s+)?{_NAME}[^;{{]*\{{", "enum", False), (rf"(?:template\s*<[^>]*>\s*)?[A-Za-z_][\w\s\*&:<>,]*?\b{_NAME}\s*\([^;{{]*\)[^;{{]*\{{", "function", False)],
}
_FORMS["tsx"] = _FORMS["typescript"]
#: Members of an oversized container.
_MEMBER = re.compile(rf"(?:(?:public|protected|private|static|async|final|override|get|set|abstract)\s+)*(?:[\w<>\[\],\.\s\*&:]*?\b)?{_NAME}\s*\([^;{{}}]*\)[^;{{}}]*\{{")
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)


_BEFORE = re.compile(r"(?:export\s+(?:default\s+)?|declare\s+)*")
#: A line as Python's parser counts them: form feeds and Unicode's line ends don't end one.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")


def _blank(source: str) -> str:
    """Comments and strings as spaces, so that offsets stay."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _end(blank: str, at: int) -> int:
    """Where the declaration that begins at ``at`` ends: its closing brace, or a semicolon before any brace."""
    depth = 0
    for k in range(at, len(blank)):
        c = blank[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + 1
        elif c == ";" and depth == 0:
            return k + 1
    return len(blank)


def _scan(blank: str, language: str) -> list[tuple[int, int, str, str | None, bool]]:
    """Top-level declarations; what an ``export`` or ``declare`` stands before begins after it."""
    out, at = [], 0
    forms = [(re.compile(p), kind, holds) for p, kind, holds in _FORMS[language]]
    for m in re.finditer(r"^[^\s#}]", blank, re.M):
        if m.start() < at:
            continue
        start = _BEFORE.match(blank, m.start()).end() if language in ("typescript", "tsx", "javascript") else m.start()
        for form, kind, holds in forms:
            found = form.match(blank, start)
            if found:
                end = _end(blank, start)
                out.append((start, end, kind, found[1], holds))
                at = end
                break
    return out


def _members(blank: str, start: int, end: int, language: str) -> list[tuple[int, int, str, str | None]]:
    out = []
    at = blank.find("{", start, end) + 1
    form = re.compile(_FORMS["rust"][0][0]) if language == "rust" else _MEMBER
    kind = {"rust": "function", "cpp": "function"}.get(language, "method")
    space = re.compile(r"\s*")
    while at:
        at = space.match(blank, at, end).end()
        if at >= end - 1:
            break
        found, stop = form.match(blank, at, end), _end(blank, at)
        if found:
            out.append((at, stop, kind, found[1]))
        at = stop
    return out


def _python(source: str) -> list[tuple[int, int, str, str | None, list]]:
    """Top-level functions and classes; of a class, its members too. Offsets are in characters."""
    lines, starts = _LINE.findall(source), [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def at(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="ignore"))

    def spans(body: list) -> list:
        out = []
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                end = at(node.end_lineno, node.end_col_offset)
                if node.decorator_list:
                    first = node.decorator_list[0]
                    out.append((source.rfind("@", 0, at(first.lineno, first.col_offset)), end, "block", node.name, []))
                else:
                    kind = "class" if isinstance(node, ast.ClassDef) else "function"
                    out.append((at(node.lineno, node.col_offset), end, kind, node.name, spans(node.body) if kind == "class" else []))
        return out

    try:
        return spans(ast.parse(source).body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def chunks_of(source: str, language: str, cap: int = CAP) -> list[tuple[int, int, str, str | None]]:
    """Declarations of a source as (start byte, end byte, category, symbol), in order.

    One that fits the cap is a chunk; a larger one gives its members, or else line windows of its kind.
    """
    offsets: list[int] = [0]
    for c in source:
        offsets.append(offsets[-1] + len(c.encode("utf-8", "surrogatepass")))
    out: list[tuple[int, int, str, str | None]] = []

    def by_lines(start: int, end: int, kind: str) -> None:
        lines, at = [], start
        for line in re.findall(r"[^\n]*\n|[^\n]+$", source[start:end]):
            lines.append(at)
            at += len(line)
        lines.append(end)
        n, i = len(lines) - 1, 0
        while n:
            out.append((offsets[lines[i]], offsets[lines[min(i + WINDOW, n)]], kind, None))
            if i + WINDOW >= n:
                break
            i += WINDOW - OVERLAP

    def add(start: int, end: int, kind: str, symbol: str | None, members) -> None:
        if offsets[end] - offsets[start] <= cap:
            out.append((offsets[start], offsets[end], kind, symbol))
            return
        inside = members()
        for m in inside:
            add(*m)
        if not inside:
            by_lines(start, end, kind)

    def of_python(node):
        a, b, kind, name, inner = node
        return a, b, kind, name, lambda: [of_python(x) for x in inner]

    if language == "python":
        for node in _python(source):
            add(*of_python(node))
    else:
        blank = _blank(source)
        for a, b, kind, name, holds in _scan(blank, language):
            add(a, b, kind, name, (lambda a=a, b=b: [(*m, list) for m in _members(blank, a, b, language)]) if holds else list)
    return out
