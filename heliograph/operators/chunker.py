"""Source code into chunks along its declarations, and hard caps on their size.

Python is read with the standard library's ``ast``; other languages by a scanner that knows
their declaration keywords and follows braces or ends of lines. The sizes are the policy:
a declaration above ``TARGET`` bytes that holds others is replaced by them, a larger one without
is cut at lines, one of at most ``MERGE`` bytes is joined with its neighbours while the span
stays within TARGET. A file without declarations is one chunk of kind ``file``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TARGET, MERGE = 1500, 400


@dataclass
class Span:
    first: int
    last: int
    kind: str
    name: str
    inner: list[Span] = field(default_factory=list)


#: Declaration keywords and the kinds they make.
DECLARATIONS = {
    "rust": [(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)", "function_item"), (r"(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*([\w:<>, &']+?)\s*(?:\{|where|$)", "impl_item"), (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct_item"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum_item"), (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait_item"), (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "mod_item"), (r"(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type_item"), (r"macro_rules!\s*(\w+)", "macro_definition"), (r"(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)", "const_item"), (r"(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(\w+)", "static_item")],
    "typescript": [(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)", "function_declaration"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class_declaration"), (r"(?:export\s+)?interface\s+(\w+)", "interface_declaration"), (r"(?:export\s+)?type\s+(\w+)", "type_alias_declaration"), (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum_declaration"), (r"(?:export\s+)?(?:const|let)\s+(\w+)", "lexical_declaration"), (r"(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!(?:if|for|while|switch|catch|return)\b)(\w+)\s*\([^)]*\)[^;{]*\{", "method_definition")],
    "go": [(r"func\s+\([^)]*\)\s*(\w+)", "method_declaration"), (r"func\s+(\w+)", "function_declaration"), (r"type\s+(\w+)", "type_declaration"), (r"var\s+(\w+)", "var_declaration"), (r"const\s+(\w+)", "const_declaration")],
    "bash": [(r"(?:function\s+)?(\w+)\s*\(\)", "function_definition")],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]


def _python_spans(source: str) -> list[Span]:
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.Import: "import_statement", ast.ImportFrom: "import_from_statement", ast.Assign: "assignment", ast.AnnAssign: "assignment"}

    def of(body: list) -> list[Span]:
        out = []
        for node in body:
            kind = kinds.get(type(node))
            if kind:
                decorators = getattr(node, "decorator_list", [])
                first = min([node.lineno, *(d.lineno for d in decorators)])
                out.append(Span(first, node.end_lineno, "decorated_definition" if decorators else kind, getattr(node, "name", ""), of(getattr(node, "body", []))))
        return out

    return of(ast.parse(source).body)


def _brace_spans(lines: list[str], language: str) -> list[Span]:
    rules = [(re.compile(r"\s*" + p), k) for p, k in DECLARATIONS.get(language, [])]

    def scan(lo: int, hi: int, within: int) -> list[Span]:
        out, i = [], lo
        while i <= hi:
            found = next(((m, k) for r, k in rules if (m := r.match(lines[i - 1])) and (within or k != "method_definition")), None)
            if not found:
                i += 1
                continue
            depth, opened, j = 0, False, i
            while j <= hi:
                code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[j - 1])
                depth += code.count("{") - code.count("}")
                opened = opened or "{" in code
                if (opened and depth <= 0) or (not opened and (code.rstrip().endswith(";") or (j > i and not code.strip()))):
                    break
                j += 1
            j = min(j, hi)
            m, kind = found
            out.append(Span(i, j, kind, (m.group(1) or "").strip(), scan(i + 1, j - 1, within + 1) if j > i + 1 else []))
            i = j + 1
        return out

    return scan(1, len(lines), 0)


def spans_of(source: str, language: str) -> list[Span]:
    if language == "python":
        try:
            return _python_spans(source)
        except (SyntaxError, ValueError, RecursionError):
            return []
    return _brace_spans(source.split("\n"), language)


def _part(chunk: dict, body: str, first: int, last: int, i: int, n: int) -> dict:
    name = f"{chunk['qualified']}#" if chunk["qualified"] else ""
    return chunk | {"body": body, "line_start": first, "line_end": last, "qualified": f"{name}part-{i}/{n}"}


def hard_cap(chunk: dict, cap: int = TARGET) -> list[dict]:
    """Pieces of whole lines, as many as fit ``cap`` bytes; a longer line is a piece of its own. Names get #part-i/N, N being the guess from the size."""
    size = len(chunk["body"].encode())
    if size <= cap:
        return [chunk]
    groups: list[list[str]] = []
    held = 0
    for line in chunk["body"].split("\n"):
        n = len(line.encode()) + 1
        # the line break after the last line counts in all pieces but the first
        if not groups or held + n > cap + (len(groups) == 1):
            groups.append([])
            held = 0
        groups[-1].append(line)
        held += n
    out, first = [], chunk["line_start"]
    for i, lines in enumerate(groups, 1):
        out.append(_part(chunk, "\n".join(lines), first, first + len(lines) - 1, i, -(-size // cap)))
        first += len(lines)
    return out


def split_tokens(text: str, count: Callable[[str], int], cap: int) -> list[str]:
    """Pieces of at most ``cap`` tokens: lines greedily; a longer line in equal parts by its bytes, each halved until it fits or has 16 bytes."""
    if cap < 1:
        raise ValueError("a piece has at least one token")
    if count(text) <= cap:
        return [text]
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (piece := "\n".join(held)):
            out.append(piece)
        held.clear()

    for line in text.split("\n"):
        if count("\n".join([*held, line])) <= cap:
            held.append(line)
            continue
        close()
        if count(line) > cap:
            out += _split_line(line.encode(), count, cap)
        else:
            held.append(line)
    close()
    return out


def _split_line(raw: bytes, count: Callable[[str], int], cap: int) -> list[str]:
    share = max(1, len(raw) // -(-count(raw.decode()) // cap))
    out, at = [], 0

    def whole(end: int) -> int:
        """The next end of a character."""
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return end

    while at < len(raw):
        end = whole(min(at + share, len(raw)))
        while count(raw[at:end].decode()) > cap and end - at > 16:
            end = whole(at + (end - at) // 2)
        out.append(raw[at:end].decode())
        at = end
    return out


def token_cap(chunk: dict, count: Callable[[str], int], cap: int) -> list[dict]:
    """Pieces of at most ``cap`` tokens, each with the lines of the whole chunk; bodies are stored, so a piece keeps its own."""
    pieces = split_tokens(chunk["body"], count, cap)
    if len(pieces) == 1:
        return [chunk]
    return [_part(chunk, p, chunk["line_start"], chunk["line_end"], i, len(pieces)) for i, p in enumerate(pieces, 1)]


def chunk_source(source: str, language: str) -> list[dict]:
    if not source.strip():
        return []
    lines = source.split("\n")
    body = lambda a, z: "\n".join(lines[a - 1 : z])
    chunk = lambda a, z, kind, name: {"kind": kind, "qualified": name, "line_start": a, "line_end": z, "body": body(a, z)}
    flat: list[Span] = []

    def visit(spans: list[Span]) -> None:
        for s in spans:
            if len(body(s.first, s.last).encode()) > TARGET and s.inner:
                visit(s.inner)
            else:
                flat.append(Span(s.first, s.last, s.kind, s.name))

    visit(spans_of(source, language))
    if not flat:
        return hard_cap(chunk(1, len(lines), "file", ""))
    out, small = [], []

    def close() -> None:
        if small:
            names = ",".join(s.name for s in small if s.name)
            out.append(chunk(small[0].first, small[-1].last, small[0].kind + ("+" if len(small) > 1 else ""), names))
            small.clear()

    for s in flat:
        size = len(body(s.first, s.last).encode())
        if size > MERGE:
            close()
            out += hard_cap(chunk(s.first, s.last, s.kind, s.name))
            continue
        if small and len(body(small[0].first, s.last).encode()) > TARGET:
            close()
        small.append(s)
    close()
    return out


def chunks(files: DataFrame, count: Callable[[str], int] | None = None, max_tokens: int = 512) -> DataFrame:
    """(path, language, chunk, kind, qualified, line_start, line_end, body) of files (path, language, source).

    With a token counter no piece has more than ``max_tokens`` less 8 tokens.
    """

    def pieces(source: str, language: str) -> list[dict]:
        made = chunk_source(source, language)
        return made if count is None else [p for c in made for p in token_cap(c, count, max(1, max_tokens - 8))]

    def run(it):
        for pdf in it:
            rows = [{"path": p, "language": g, "chunk": i, **c} for p, g, s in zip(pdf["path"], pdf["language"], pdf["source"], strict=True) if s for i, c in enumerate(pieces(s, g))]
            yield pd.DataFrame(rows, columns=["path", "language", "chunk", "kind", "qualified", "line_start", "line_end", "body"])

    return files.select("path", "language", "source").mapInPandas(run, "path string, language string, chunk int, kind string, qualified string, line_start int, line_end int, body string")
