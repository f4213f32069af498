import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamark.operators import chunk, syntax


def windows(text):
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode()))
    out, i = [], 0
    while lines:
        out.append((at[i], at[min(i + 100, len(lines))]))
        if i + 100 >= len(lines):
            break
        i += 80
    return out


def spans(spark, column, text):
    found = spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]
    return [(c.start_byte, c.end_byte) for c in found]


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 180, 181, 400])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_windows(spark, n, end):
    text = "".join(f"строка {i}{end}" for i in range(n))
    assert spans(spark, chunk.line_windows, text) == windows(text)


def test_line_windows_without_last_newline(spark):
    assert spans(spark, chunk.line_windows, "a\nb") == [(0, 3)]


def test_markdown(spark):
    assert spans(spark, chunk.markdown_sections, "pre\n# A\nx\n  ## B\n#### no\n#no\n### C\n") == [(0, 4), (4, 10), (10, 29), (29, 35)]


@pytest.mark.parametrize(("kind", "line", "n"), [("toml", "[a]\nk = 1\n", 300), ("yaml", "key:\n  x: 1\n# c: d\n", 200)])
def test_structured(spark, kind, line, n):
    assert spans(spark, lambda t: chunk.structured(t, kind), line) == [(0, len(line))]
    assert spans(spark, lambda t: chunk.structured(t, kind), line * n) == [(len(line) * i, len(line) * (i + 1)) for i in range(n)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé€😀\n", max_size=700), min_size=1, max_size=8))
def test_cap(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("t").cast("bigint").alias("end_byte"), F.lit("lines").alias("node_type"), F.lit(None).cast("string").alias("symbol")))
    for r in rows.select("t", chunk.capped(F.col("t"), whole, 256).alias("c")).collect():
        raw, at = r.t.encode(), 0
        for c in r.c:
            assert c.start_byte == at and c.end_byte - c.start_byte <= 256
            raw[c.start_byte : c.end_byte].decode()
            at = c.end_byte
        assert at == len(raw)
        assert all(c.end_byte - c.start_byte >= 253 for c in r.c[:-1])


def test_merge_small(spark):
    rows = [(0, 100, "function", "a"), (120, 200, "function", "b"), (200, 260, "struct", "c"), (300, 900, "impl", "d"), (900, 910, "impl", "e")]
    made = spark.createDataFrame([([dict(zip(("start_byte", "end_byte", "node_type", "symbol"), r, strict=True)) for r in rows],)], f"c array<{chunk.CHUNK}>")
    got = made.select(chunk.merge_small(F.col("c"), 256)).first()[0]
    assert [tuple(x) for x in got] == [(0, 200, "function", None), (200, 260, "struct", "c"), (300, 900, "impl", "d"), (900, 910, "impl", "e")]


def test_python_syntax():
    source = "import os\n\ndef é():\n    pass\n\n@d\nclass A:\n    pass\n\nclass B:\n    def m(self): pass\n"
    got = [(source.encode()[a:b].decode().split("\n")[0], kind, name) for a, b, kind, name in syntax.chunks_of(source, "python")]
    assert got == [("def é():", "function", "é"), ("@d", "block", "A"), ("class B:", "class", "B")]


def test_oversized_container_gives_members():
    source = "class B:\n" + "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(30))
    assert [(k, n) for _, _, k, n in syntax.chunks_of(source, "python", 256)] == [("function", f"m{i}") for i in range(30)]


@pytest.mark.parametrize(("language", "source", "want"), [
    ("rust", "use x;\npub fn alpha() { \"}\" }\nstruct Point { x: u8 }\nimpl Point { fn f() {} }\n", [("function", "alpha"), ("struct", "Point"), ("impl", "Point")]),
    ("go", "package m\nfunc F() {\n}\nfunc (t *T) M() {}\ntype T struct {\n}\n", [("function", "F"), ("method", "M"), ("type", "T")]),
    ("javascript", "function f() { /* } */ }\nclass A { m() {} }\n", [("function", "f"), ("class", "A")]),
    ("java", "public class A {\n void f() {}\n}\ninterface B {}\n", [("class", "A"), ("trait", "B")]),
    ("c", "#include <x>\nint main(void) {\n  return 0;\n}\nstruct S { int a; };\n", [("function", "main"), ("struct", "S")]),
])
def test_scanned_syntax(language, source, want):
    assert [(k, n) for _, _, k, n in syntax.chunks_of(source, language)] == want


def test_chunk_files(spark):
    files = [("a.py", "def f():\n    pass\n\ndef g():\n    pass\n"), ("b.js", "x" * 200_000), ("c.txt", ""), ("d.md", None), ("e.rs", "// only words\n")]
    got = chunk.chunk_files(spark.createDataFrame(files, "path string, text string")).collect()
    by = {p: [r for r in got if r.path == p] for p, _ in files}
    assert [(r.node_type, r.symbol, r.content) for r in by["a.py"]] == [("function", None, "def f():\n    pass\n\ndef g():\n    pass")]
    assert "".join(r.content for r in sorted(by["b.js"], key=lambda r: r.chunk_index)) == "x" * 200_000 and max(len(r.content) for r in by["b.js"]) == 2048
    assert not by["c.txt"] and not by["d.md"] and by["e.rs"][0].node_type == "lines"


@pytest.mark.parametrize("odd", ["\f", "\x0b", "\x85", "\u2028", "\x1c", "\r", "\r\n"])
def test_python_lines(odd):
    source = f"x = 1\n{odd if odd in '\f\r\r\n' else '# ' + odd}\ndef alpha():\n    return 'body of alpha'\n\ndef beta():\n    return 2\n"
    got = [(source.encode()[a:b].decode(), name) for a, b, _, name in syntax.chunks_of(source, "python")]
    assert got == [("def alpha():\n    return 'body of alpha'", "alpha"), ("def beta():\n    return 2", "beta")]


@pytest.mark.parametrize(("language", "source", "want"), [
    ("rust", "const A: u8 = 1;\npub static B: &str = \"{\";\nmacro_rules! m { () => {} }\n", [("block", "A"), ("block", "B"), ("block", "m")]),
    ("typescript", "export default class A { m() {} }\nexport async function f() {}\ndeclare enum E { X }\nexport interface I { a: 1 }\n", [("class", "A"), ("function", "f"), ("enum", "E"), ("trait", "I")]),
])
def test_consts_and_exports(language, source, want):
    got = syntax.chunks_of(source, language)
    assert [(k, n) for _, _, k, n in got] == want
    assert not any(source.encode()[a:].startswith(b"export") for a, *_ in got)


def test_long_files_are_cut_in_linear_time():
    import time

    raw, began = b"key: value of a line\n" * 400_000, time.time()
    assert len(chunk.windows(raw)) == 5000 and len(chunk.keys(raw, "yaml")) == 400_000
    assert len(chunk.joined([(10 * k, 10 * k + 10, "x", None) for k in range(400_000)])) == 1961
    assert b"".join(raw[a:b] for a, b, *_ in chunk.pieces(raw, [(0, len(raw), "lines", None)])) == raw
    assert time.time() - began < 20


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["a.md", "a.yaml", "a.toml", "a.json", "a.py", "a.rs", "a.txt"]), st.lists(st.sampled_from(["# h\n", "k: v\n", "[t]\n", "def f():\n    pass\n", "fn f() {}\n", "é" * 300, "\r\n", "\n", " x\n"]), max_size=60))
def test_every_byte_of_text_formats_is_in_a_chunk(path, parts):
    text = "".join(parts)
    raw, lang = text.encode(), {"md": "markdown", "txt": "text", "py": "python", "rs": "rust"}.get(path[2:], path[2:])
    spans, reached = chunk.chunked(text, lang, 256), 0
    for a, b, *_ in sorted(spans):
        raw[a:b].decode()
        assert b - a <= 256 and (lang in ("python", "rust") or a <= reached)
        reached = max(reached, b)
    assert lang in ("python", "rust") or reached == len(raw)
