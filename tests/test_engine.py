import io
import json
import os

import pytest

from seamark.cli import Server, main
from seamark.engine import STUB, Engine
from seamark.operators import inspect
from seamark.sources import corpora, settings, tree
from seamark.tables import durable


@pytest.fixture
def project(tmp_path):
    for path, text in {
        "auth.py": "def check_password(user):\n    return user.digest\n",
        "cache.rs": "/// Evict the oldest entry.\npub fn evict() {}\n",
        "geo/dist.py": "def haversine(a, b):\n    return a - b\n",
        "bin.dat": None,
        "target/x.py": "x = 1\n",
    }.items():
        f = tmp_path / path
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"\0\1" if text is None else text.encode())
    return tmp_path


def test_sync_cycle(spark, project):
    e = Engine(spark, str(project))
    first = e.sync()
    assert (first["files_indexed"], first["files_skipped"], first["files_deleted"]) == (3, 1, 0)
    before = {r.vector_id: list(r.embedding) for r in e.store.read("vectors").collect()}
    assert e.sync()["files_indexed"] == 0
    os.utime(project / "auth.py", (1, 1))
    assert e.sync()["files_indexed"] == 0
    assert {r.path: r.last_modified for r in e.store.read("files").collect()}["auth.py"] == 1
    forced = e.sync(force=True)
    assert forced["files_indexed"] == 3
    assert {r.vector_id: list(r.embedding) for r in e.store.read("vectors").collect()} == before  # all reused
    os.rename(project / "auth.py", project / "login.py")
    moved = e.sync()
    assert (moved["files_indexed"], moved["files_deleted"]) == (1, 1)
    ids = {r.path: r.vector_id for r in e.store.read("chunks").join(e.store.read("files"), "file_id").collect()}
    assert ids["login.py"] > max(before)  # ids are never given again
    assert all(r.rows == 0 for r in inspect.violations(*(e.store.read(x) for x in ("files", "chunks", "vectors"))).collect())
    # first by words and at worst last by meaning: of three, second at least
    assert "login.py" in [h["file_path"] for h in e.search("check_password digest", 2)]
    assert {h["file_path"] for h in e.search("haversine", 5, scope="geo/")} == {"geo/dist.py"}
    assert e.search("::", 2)
    assert e.status()["files"] == 3 and not e.is_due()
    assert [r.path for r in e.list_files().collect()] == ["cache.rs", "geo/dist.py", "login.py"]


def test_versions(spark, project, monkeypatch):
    e = Engine(spark, str(project))
    e.sync()
    one = e.store.manifest(e.store.version())
    e.sync()  # nothing changed: only the meta is written
    two = e.store.manifest(e.store.version())
    assert {k for k in one if one[k] != two[k]} == {"meta"}
    (project / "auth.py").write_text("def other():\n    return 1\n")
    before = e.store.version(), {r.path for r in e.store.read("files").collect()}, e.store.read("chunks").count()
    with monkeypatch.context() as m:  # a crash before the manifest has its name
        m.setattr(e.store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            e.sync()
    assert before == (e.store.version(), {r.path for r in e.store.read("files").collect()}, e.store.read("chunks").count())
    assert e.sync()["files_indexed"] == 1
    with pytest.raises(OSError):  # another writer was first
        e.store._publish(e.store.version(), {})
    folders = {x.getPath().getName() for x in e.store._fs.listStatus(e.store._path(f"{e.store.root}/data"))}
    named = {x.split("/")[1] for v in e.store._versions() for x in e.store.folders(v)}
    assert folders == named and len(e.store._versions()) == 2  # what the crash left is gone


def rows_of(store):
    """All tables but the meta, in an order."""
    return {t: sorted(map(repr, store.read(t).drop("cell").collect())) for t in ("files", "chunks", "vectors")}


def test_parts_say_what_a_whole_write_says(spark, project, monkeypatch):
    from seamark.sources import store

    monkeypatch.setattr(store, "SHARE", 100.0)
    e = Engine(spark, str(project))
    e.sync()
    first = e.store.manifest(e.store.version())
    (project / "auth.py").write_text("def other():\n    return 1\n")
    os.utime(project / "cache.rs", (1, 1))
    e.sync()
    os.remove(project / "geo/dist.py")
    (project / "new.py").write_text("def haversine(a, b):\n    return a - b\n")
    e.sync()
    parts = e.store.manifest(e.store.version())
    assert [len(parts[t]) for t in ("files", "chunks", "vectors")] == [3, 3, 3] and parts["chunks"][0] == first["chunks"][0]
    assert [p["n"] for p in parts["chunks"]] == [3, 1, 1]  # a changed file's rows and no others
    assert {r.path: r.last_modified for r in e.store.read("files").collect()}["cache.rs"] == 1
    assert sorted(r.file_path for r in e._index()[0].collect()) == ["auth.py", "cache.rs", "new.py"]
    assert [e.store.count(t) for t in ("files", "chunks", "vectors")] == [3, 3, 3]
    assert all(r.rows == 0 for r in inspect.violations(*(e.store.read(x) for x in ("files", "chunks", "vectors"))).collect())
    before = rows_of(e.store)
    monkeypatch.setattr(store, "SHARE", 0.0)
    none = e.store.read("files").where("false")
    e.store.change({t: (e.store.read(t).where("false"), none if t != "vectors" else none.selectExpr("file_id as vector_id")) for t in ("files", "chunks", "vectors")})
    assert rows_of(e.store) == before and {len(x) for x in e.store.manifest(e.store.version()).values()} == {1}


def test_search_by_cells(spark, tmp_path):
    from pyspark.sql import functions as F

    from seamark.operators import ann, search

    for i in range(60):
        (tmp_path / f"f{i}.md").write_text(f"# part {i}\nword{i} word{i % 7} common text\n")
    exact = Engine(spark, str(tmp_path), str(tmp_path / ".other"))
    settings_low = settings.merged(settings.DEFAULTS, {"search": {"exact_below": 50}})
    e = Engine(spark, str(tmp_path), settings=settings_low)
    e.sync()
    assert e.status()["search_backend"] == "cells" and exact.status()["search_backend"] == "exact"
    centres, probes = e._cells()
    assert len(centres) == ann.LEAST_CELLS and e.store.read("vectors").where(F.col("cell") < 0).count() == 0
    (tmp_path / "late.md").write_text("# late\nzebra crossing\n")
    e.sync()
    late = e._index()[0].where("file_path = 'late.md'").join(e.store.read("vectors"), "vector_id").select(F.col("vector_id").alias("qid"), F.col("embedding").alias("vector"), "cell")
    assert e.store.count("vectors") == 61 and ann.probed(late, centres, 1) == [late.first().cell]  # filed like the others
    assert len(e.search("# late zebra crossing", 5)) == 5
    # every vector whose number twenty divides asks all others
    vectors = e.store.read("vectors")
    asked = durable(vectors.where("vector_id % 20 = 0").select(F.col("vector_id").alias("qid"), F.col("embedding").alias("vector")))
    found = None
    for r in asked.select("qid").collect():
        own = asked.where(F.col("qid") == r.qid)
        got = search.knn_batch(vectors.where(F.col("cell").isin(ann.probed(own, centres, probes))), own, 10)
        found = got if found is None else found.unionByName(got)
    assert ann.recall(found, search.knn_batch(vectors, asked, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    for i in range(30):
        os.remove(tmp_path / f"f{i}.md")
    e.sync()
    assert e.status()["search_backend"] == "exact" and e.search("common text", 3)


def test_another_model_rebuilds(spark, project):
    from dataclasses import replace

    assert Engine(spark, str(project)).sync()["files_indexed"] == 3
    wider = Engine(spark, str(project), spec=replace(STUB, dimensions=128))
    assert wider.store.version() == 0
    wider.sync()
    assert wider.store.dims() == 128


def test_command_line_and_server(spark, project, capsys):
    assert main(["--root", str(project), "sync"], spark) == 0
    assert main(["--root", str(project), "search", "evict oldest", "--json", "-n", "2"], spark) == 0
    hit = next(h for h in json.loads(capsys.readouterr().out.strip().split("\n")[-1]) if h["file_path"] == "cache.rs")
    assert hit["file_path"] == "cache.rs" and "parent" not in hit and hit["start_line"] >= 1
    asks = [{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "get_index_status"}}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "set_model", "arguments": {"model": "none"}}}]
    out = io.StringIO()
    Server(Engine(spark, str(project))).serve(io.StringIO("".join(json.dumps(a) + "\n" for a in asks)), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(said[0]["result"]["tools"]) == 4 and json.loads(said[1]["result"]["content"][0]["text"])["files"] == 3 and "no model" in said[2]["error"]["message"]


def test_ignore_rules(tmp_path):
    for path in ("a.txt", "secret.txt", "ignored_dir/x.txt", "sub/keep.log", "sub/drop.log", "deep/er/b.tmp", ".hidden", "x.lock", "node_modules/y.js"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text("secret.txt\nignored_dir/\n*.tmp\n")
    (tmp_path / "sub/.gitignore").write_text("*.log\n!keep.log\n")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    assert tree.collect_files(tmp_path) == [".gitignore", ".hidden", "a.txt", "sub/.gitignore", "sub/keep.log"]


def test_store_scan(spark, project):
    got = {r.path: r for r in tree.scan_store(spark, str(project)).collect()}
    assert set(got) == {"auth.py", "cache.rs", "geo/dist.py", "bin.dat"} and got["bin.dat"].text is None and got["auth.py"].size == (project / "auth.py").stat().st_size


def test_texts_of_named_files(spark, project, monkeypatch):
    (project / "a[1].md").write_text("é")
    asked = durable(spark.createDataFrame([("auth.py", 2**60 + 1), ("a[1].md", None), ("bin.dat", 3), ("gone.py", 4)], "path string, n bigint"))
    want = {"auth.py": (2**60 + 1, (project / "auth.py").read_text()), "a[1].md": (None, "é"), "bin.dat": (3, None)}
    got = lambda df: {r.path: (r.n, r.text) for r in df.collect()}
    assert got(tree.with_tree_texts(asked, project)) == want | {"gone.py": (4, None)}
    assert got(tree.with_store_texts(asked, str(project))) == want  # by a scan, as one is gone
    there = durable(asked.where("path <> 'gone.py'"))
    assert got(tree.with_store_texts(there, str(project))) == want
    monkeypatch.setattr(tree, "NAMED", 1)
    assert got(tree.with_store_texts(there, str(project))) == want
    assert tree.with_store_texts(durable(there.where("false")), str(project)).count() == 0


def test_unchanged_files_are_not_read(spark, project, monkeypatch):
    e = Engine(spark, str(project))
    e.sync()
    (project / "auth.py").write_text("def other():\n    pass\n")
    asked, read = [], e.with_texts
    monkeypatch.setattr(e, "with_texts", lambda rows: asked.extend(r.path for r in rows.collect()) or read(rows))
    assert e.sync()["files_indexed"] == 1
    assert sorted(asked) == ["auth.py", "bin.dat"]  # what isn't text is not in the snapshot


def test_project_root(tmp_path):
    none = lambda _: None
    home = tmp_path / "home"
    (home / "p").mkdir(parents=True)
    ask = lambda r, lookup=none, h=str(home): tree.project_root(r, None, str(home / "p"), h, lookup)
    assert ask(str(home / "p")) == home / "p" and ask(None) == home / "p" and ask(None, lambda _: home / "p") == home / "p"
    for bad in ("/", str(home), str(tmp_path)):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(ValueError):
        ask(str(home / "p"), none, None)
    assert ask(str(home / "p"), lambda x: x, None) == home / "p"


def test_settings(tmp_path):
    base = settings.merged(settings.DEFAULTS, {"sync": {"max_chunk_bytes": 1024}})
    assert base["sync"]["max_chunk_bytes"] == 1024 and base["sync"]["scan_window"] == 128
    settings.save_override(base, settings.DEFAULTS, tmp_path / "c.toml")
    assert settings.load(tmp_path / "c.toml") == base and (tmp_path / "c.toml").read_text().count("\n") == 2
    for text in ("https://huggingface.co/a/b/tree/main", "@a/b/", "hf.co/a/b", "www.huggingface.co/a/b/c"):
        assert settings.normalized_repo(text) == "a/b"
    assert (settings.expanded("$K", {"K": "v"}), settings.expanded("${K}", {}), settings.expanded("key", {})) == ("v", "", "key")
    assert settings.model("minishlab/potion-base-32M").ram_mb() == 158 and settings.model("nomic-ai/CodeRankEmbed").ram_mb() == 487
    assert (settings.batch_size(0, settings.MODELS[0]), settings.batch_size(99, settings.MODELS[0]), settings.batch_size(99, settings.MODELS[2])) == (4, 4, 99)
    with pytest.raises(ValueError):
        settings.check_encoder({"architectures": ["XForCausalLM"]})
    r = settings.Registry()
    with pytest.raises(ValueError):
        r.select("none")
    assert r.select("minishlab/potion-base-32M").static and settings.rerank_enabled(r.settings, settings.model("minishlab/potion-base-32M"))


def test_models_are_kept(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "home").mkdir()
    (tmp_path / "p").mkdir()
    run = lambda *args: main(["--root", str(tmp_path / "p"), "models", *args]) or capsys.readouterr().out
    assert run("add", "https://huggingface.co/a/b", "--dimensions", "32", "--static") == "added a/b\n"
    assert "added far" in run("add-remote", "far", "--dimensions", "8", "--url", "https://x.example/v1", "--key", "$K")
    assert "a/b 32 dims" in run("list") and "far 8 dims" in run("list")
    run("set", "a/b")
    assert "* a/b" in run("list")
    with pytest.raises(ValueError):
        run("remove", "a/b")  # in use
    run("set-default", "minishlab/potion-base-32M")
    assert "* a/b" in run("list")  # the project's own choice lies over it
    run("set", "far")
    assert run("remove", "a/b") == "removed\n" and run("remove", "a/b") == "not an added model\n" and "a/b" not in run("list")
    for bad in (("remove", settings.DEFAULT_MODEL), ("add", settings.DEFAULT_MODEL, "--dimensions", "3"), ("add", "c/d", "--dimensions", "0"), ("add-remote", "x", "--dimensions", "3", "--url", "ftp://x"), ("set", "none")):
        with pytest.raises(ValueError):
            run(*bad)
    assert settings.load(settings.global_config())["model"]["name"] == "minishlab/potion-base-32M"


def test_a_service_embeds(spark, project, monkeypatch, tmp_path_factory):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(self.headers["Authorization"])
            busy = len(seen) == 1  # asked again
            rows = [{"index": i, "embedding": [1.0, float("evict" in t), float("haversine" in t)]} for i, t in enumerate(ask["input"])]
            self.send_response(503 if busy else 200)
            self.end_headers()
            self.wfile.write(b"" if busy else json.dumps({"data": rows}).encode())

        def log_message(self, *_):
            pass

    service = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    monkeypatch.setenv("HOME", str(tmp_path_factory.mktemp("home")))
    monkeypatch.setenv("SERVICE_KEY", "secret")
    url = f"http://127.0.0.1:{service.server_port}"
    assert main(["--root", str(project), "models", "add-remote", "far", "--dimensions", "3", "--url", url, "--key", "$SERVICE_KEY"]) == 0
    server = Server(Engine(spark, str(project)))
    said = server.call("set_model", {"model": "far"})
    assert (said["dimensions"], said["files_indexed"]) == (3, 3) and set(seen) == {"Bearer secret"} and len(seen) > 1
    assert sorted(r.embedding for r in server.engine.store.read("vectors").collect()) == [[1, 0, 0], [1, 0, 1], [1, 1, 0]]
    assert server.call("search_code", {"query": "evict"})[0]["file_path"] == "cache.rs"
    assert settings.load(project / tree.INDEX_DIR / "config.toml")["model"]["name"] == "far"  # and the next start keeps the index
    service.shutdown()


def test_corpora(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"q": "a", "c": "b"}\n{"q": " ", "c": "b"}\n')
    assert corpora.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "g.toml").write_text('[[query]]\ntext = "t"\nexpected = "f"\n')
    assert corpora.read_golden(spark, str(tmp_path / "g.toml")).first().expected == "f"
    a, b = corpora.generated(spark, 20).collect(), corpora.generated(spark, 20).collect()
    assert a == b and len({r.path for r in a}) == 20
    text = corpora.report([{"model": "a|b", "mrr_10": 0.1, "recall_1": 0.1, "recall_5": 0.1, "ndcg_10": 0.1}, {"model": "c", "mrr_10": 0.9, "recall_1": 0.1, "recall_5": 0.1, "ndcg_10": 0.1}, {"model": "d", "error": "x\ny"}], "T")
    assert text.index("| c |") < text.index("a\\|b") < text.index("- d: x y")


def test_stream_triggers_one_sync(spark, project, tmp_path):
    from seamark.streaming.resync import SingleFlight, resync_on_change

    calls = []
    resync_on_change(spark, SingleFlight(lambda: calls.append(1)), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert len(calls) >= 1
    flight = SingleFlight(lambda: flight.run() is None)
    assert flight.run() is True


def test_embedding_backends(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from seamark.operators import embed

    m = embed.StaticModel(lambda ts: [[len(t), 99] if t else [] for t in ts], np.eye(4, dtype=np.float32)[:, :3] * 2)
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id bigint, t string")
    got = {r.id: list(r.v) for r in embed.embedded(rows, "t", "v", lambda: m, 2).collect()}
    assert got == {1: [0, 1, 0], 2: [0, 0, 1], 3: [0, 0, 0]}
    assert embed.seq_buckets(448) == [64, 128, 256, 448]
    ids, mask = embed.padded([[1, 2], [3]], 0, [4])
    assert ids.tolist() == [[1, 2, 0, 0], [3, 0, 0, 0]] and mask.sum() == 3
    assert embed.RemoteEncoder.parsed({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1], [2]]
    with pytest.raises(ValueError):
        embed.RemoteEncoder.parsed({"data": []}, 1)
    assert embed.with_stub(rows, "t", "v", 8).where(F.size("v") == 8).count() == 3
