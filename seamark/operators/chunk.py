"""Chunkers: one row a file in, one row a chunk out, with byte offsets.

Each is a kernel over the bytes of one text, linear in its length, and a column function that runs it on Arrow batches.
``files`` has path and text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language

WINDOW, OVERLAP = 100, 20
CAP, LEAST_CAP = 2048, 256
WHOLE_BELOW = 2048  # bytes under which a structured file is one chunk
CHUNK = "struct<start_byte:bigint,end_byte:bigint,node_type:string,symbol:string>"
Span = tuple[int, int, str, str | None]
_KIND = pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64()), ("node_type", pa.string()), ("symbol", pa.string())]))
_HEADING = re.compile(r"\s*#{1,3} ")


def _arrow(lists: Iterable[list[Span]]) -> pa.Array:
    return pa.array([[dict(zip(("start_byte", "end_byte", "node_type", "symbol"), c, strict=True)) for c in spans] for spans in lists], _KIND)


def _column(kernel: Callable[[bytes], list[Span]]) -> Callable[[Column], Column]:
    @F.arrow_udf(f"array<{CHUNK}>")
    def run(texts: pa.Array) -> pa.Array:
        return _arrow(kernel((t or "").encode()) for t in texts.to_pylist())

    return run


def line_starts(raw: bytes) -> list[int]:
    """Where each line begins, and the end: one more than lines."""
    starts = [0, *(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1).tolist()]
    return starts if starts[-1] == len(raw) else [*starts, len(raw)]


def windows(raw: bytes, kind: str = "lines") -> list[Span]:
    """Windows of WINDOW lines that overlap by OVERLAP, up to the one that reaches the end."""
    starts, step = line_starts(raw), WINDOW - OVERLAP
    n = len(starts) - 1
    return [(starts[i], starts[min(i + WINDOW, n)], kind, None) for i in range(0, n, step) if i == 0 or i - step + WINDOW < n]


def sections(raw: bytes, cuts: Callable[[str], object], kind: str) -> list[Span]:
    """Spans that begin at the first line and at each line for which ``cuts`` holds."""
    starts = line_starts(raw)
    firsts = [a for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if k == 0 or cuts(raw[a:b].decode(errors="replace"))]
    return [(a, b, kind, None) for a, b in zip(firsts, [*firsts[1:], len(raw)], strict=False)]


def headings(raw: bytes) -> list[Span]:
    """Sections that begin at headings of one to three #; also within fenced code."""
    return sections(raw, _HEADING.match, "heading")


def keys(raw: bytes, kind: str) -> list[Span]:
    """Keys of yaml, toml or json: whole when small, else cut at top-level keys (json: line windows)."""
    if len(raw) < WHOLE_BELOW:
        return [(0, len(raw), f"{kind}_key", None)]
    if kind == "json":
        return windows(raw)
    if kind == "toml":
        return sections(raw, lambda line: line.startswith("["), "toml_key")
    return sections(raw, lambda line: ":" in line and not line[0].isspace() and line[0] != "#", "yaml_key")


def joined(spans: list[Span], cap: int = CAP) -> list[Span]:
    """Greedily join following chunks while their span fits the cap; gaps between them are kept.

    A joined chunk has no symbol, and is a ``block`` if kinds differ.
    """
    target, out = max(cap, LEAST_CAP), []
    for start, end, kind, symbol in sorted(spans, key=lambda c: (c[0], c[1], c[2], c[3] is None, c[3] or "")):
        if out and start >= out[-1][1] and end - out[-1][0] <= target:
            first, _, was, _ = out[-1]
            out[-1] = (first, end, kind if kind == was else "block", None)
        else:
            out.append((start, end, kind, symbol))
    return out


def pieces(raw: bytes, spans: list[Span], cap: int = CAP) -> list[Span]:
    """Cut chunks of more than the cap's bytes, back to where a character begins."""
    cap, out = max(cap, LEAST_CAP), []
    for start, end, kind, symbol in spans:
        while end - start > cap:
            at = start + cap
            while at > start + cap - 3 and raw[at] & 0xC0 == 0x80:
                at -= 1
            out.append((start, at, kind, symbol))
            start = at
        out.append((start, end, kind, symbol))
    return out


def chunked(text: str, lang: str, cap: int = CAP) -> list[Span]:
    """The chunks of one text by its language; what a syntax chunker finds nothing in goes by line windows."""
    from .syntax import SYNTAX_LANGUAGES, chunks_of

    raw = text.encode()
    if lang in SYNTAX_LANGUAGES:
        found = joined(chunks_of(text, lang, cap), cap) or windows(raw)
    elif lang == "markdown":
        found = headings(raw)
    elif lang in ("yaml", "toml", "json"):
        found = keys(raw, lang)
    else:
        found = windows(raw)
    return pieces(raw, found, cap) if raw else []


def line_windows(text: Column, kind: str = "lines") -> Column:
    return _column(lambda raw: windows(raw, kind))(text)


def markdown_sections(text: Column) -> Column:
    return _column(headings)(text)


def structured(text: Column, kind: str) -> Column:
    return _column(lambda raw: keys(raw, kind))(text)


def merge_small(chunks: Column, cap: int = CAP) -> Column:
    @F.arrow_udf(f"array<{CHUNK}>")
    def run(lists: pa.Array) -> pa.Array:
        return _arrow(joined([tuple(c.values()) for c in x or []], cap) for x in lists.to_pylist())

    return run(chunks)


def capped(text: Column, chunks: Column, cap: int = CAP) -> Column:
    """``chunks`` of ``text`` cut to the cap; null and empty texts have none, as in ``chunk_files``."""

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return _arrow(pieces(t.encode(), [tuple(c.values()) for c in x or []], cap) if t else [] for t, x in zip(texts.to_pylist(), lists.to_pylist(), strict=True))

    return run(text, chunks)


def chunk_files(files: DataFrame, cap: int = CAP) -> DataFrame:
    """Chunk every text of ``files`` (path, text) by its language.

    Returns path, language, chunk_index, start_byte, end_byte, node_type, symbol and content.
    Null and empty texts have no chunk. Languages with a syntax chunker use that; what it finds
    nothing in, and every other file, goes by line windows.
    """

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return _arrow(chunked(t, x, cap) for t, x in zip(texts.to_pylist(), langs.to_pylist(), strict=True))

    files = files.select("path", "text").where("text <> ''").withColumn("language", language(F.col("path")))
    rows = files.withColumn("chunks", run("text", "language")).select("path", "language", "text", F.posexplode("chunks").alias("chunk_index", "c"))
    content = F.decode(F.substring(F.encode("text", "utf-8"), (F.col("c.start_byte") + 1).cast("int"), (F.col("c.end_byte") - F.col("c.start_byte")).cast("int")), "utf-8")
    return rows.select("path", "language", "chunk_index", "c.start_byte", "c.end_byte", "c.node_type", "c.symbol", content.alias("content"))
