"""Command line and a server of JSON-RPC tools on standard input and output."""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from pathlib import Path
from typing import IO, Any

from pyspark.sql.streaming import StreamingQuery

from .engine import Engine
from .operators.embed import RemoteEncoder
from .operators.inspect import large_hint
from .operators.search import server_limit
from .session import local_session
from .sources import settings as cfg
from .sources.tree import INDEX_DIR, project_root
from .streaming.resync import SingleFlight, resync_on_change
from .tables import shared_folder

HIT_CHARS, NEAR_CHARS = 240, 200
TOOLS = [
    {"name": "search_code", "description": "Search the project by meaning and words", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "path": {"type": "string"}}, "required": ["query"]}},
    {"name": "sync_codebase", "description": "Bring the index in step with the files", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "get_index_status", "description": "Counts and freshness of the index", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "set_model", "description": "Use another embedding model", "inputSchema": {"type": "object", "properties": {"model": {"type": "string"}}, "required": ["model"]}},
]


def public(hit: dict) -> dict:
    """A result as it goes out: without what isn't there, and without internal numbers."""
    return {k: v for k, v in hit.items() if v is not None and k not in ("qid", "ord", "vector_id")}


def rendered(hits: list[dict]) -> str:
    lines = []
    for i, h in enumerate(hits, 1):
        lines.append(f"{i}. {h['file_path']}:{h['start_line']}-{h['end_line']} ({h['node_type']}) {h['score']:.4f}")
        lines.append("   " + h["content"][:HIT_CHARS].replace("\n", "\n   "))
        for name in ("parent", "prev", "next"):
            if h.get(name):
                lines.append(f"   {name}: {h[name]['signature'][:NEAR_CHARS]} ({h[name]['start_line']}-{h[name]['end_line']})")
    return "\n".join(lines) or "nothing found"


class Server:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.flight = SingleFlight(lambda: self.engine.sync())

    def watch(self) -> StreamingQuery:
        """Sync at once and then periodically, beside the tools; a call of sync_codebase waits for it, and it skips a turn during one."""
        minutes = self.engine.settings["sync"]["resync_interval_minutes"]
        checkpoint = f"{shared_folder(self.engine.spark)}/{uuid.uuid4().hex}-clock"
        return resync_on_change(self.engine.spark, self.flight, checkpoint, f"{minutes} minutes")

    def call(self, name: str, args: dict[str, Any]) -> Any:
        if name == "search_code":
            return [public(h) for h in self.engine.search(args["query"], server_limit(args.get("limit")), args.get("path"))]
        if name == "sync_codebase":
            return self.flight.run(wait=True)
        if name == "get_index_status":
            said = self.engine.status()
            return said | {"hint": "a static model is faster here"} if large_hint(said["files"], self.engine.spec.static) else said
        if name == "set_model":
            config = Path(self.engine.root) / INDEX_DIR / "config.toml"
            registry = _registry(config)
            spec = registry.select(args["model"])  # an unknown name is an error before anything is touched
            if spec.url is None:
                raise ValueError(f"{spec.name} needs weights, which this installation doesn't have")
            self.engine = _engine(self.engine.spark, self.engine.root, registry)
            cfg.save_override(registry.settings, cfg.load(cfg.global_config(os.environ.get("HOME"))), config)
            return {"model": spec.name, "dimensions": spec.dimensions} | (self.flight.run(wait=True) or {})
        raise ValueError(f"no tool {name!r}")

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for line in lines:
            if not line.strip():
                continue
            ask = json.loads(line)
            if "id" not in ask:
                continue
            try:
                if ask["method"] == "initialize":
                    said: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "seamark", "version": "1"}}
                elif ask["method"] == "tools/list":
                    said = {"tools": TOOLS}
                elif ask["method"] == "tools/call":
                    p = ask["params"]
                    said = {"content": [{"type": "text", "text": json.dumps(self.call(p["name"], p.get("arguments", {})), ensure_ascii=False, default=str)}]}
                else:
                    raise ValueError(f"no method {ask['method']!r}")
                answer = {"jsonrpc": "2.0", "id": ask["id"], "result": said}
            except Exception as e:  # the caller gets it
                answer = {"jsonrpc": "2.0", "id": ask["id"], "error": {"code": -32000, "message": str(e)}}
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seamark", description=__doc__)
    p.add_argument("--root", help="project folder; else SEAMARK_PROJECT_DIR, the repository's top, or here")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("init")
    sub.add_parser("sync").add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-n", type=int, default=10)
    s.add_argument("--json", action="store_true")
    s.add_argument("--no-sync", action="store_true")
    s.add_argument("--in", dest="scope")
    for name in ("status", "clear", "serve"):
        sub.add_parser(name)
    d = sub.add_parser("debug").add_subparsers(dest="what", required=True)
    d.add_parser("files")
    d.add_parser("chunks").add_argument("path")
    m = sub.add_parser("models").add_subparsers(dest="what", required=True)
    m.add_parser("list")
    for name in ("set", "set-default", "remove", "add", "add-remote"):
        x = m.add_parser(name)
        x.add_argument("name")
        if name.startswith("add"):
            x.add_argument("--dimensions", type=int, required=True)
            x.add_argument("--max-length", type=int, default=448)
            x.add_argument("--query-prefix")
            x.add_argument("--doc-prefix")
            x.add_argument("--note", default="added")
        if name == "add":
            x.add_argument("--pooling", choices=("mean", "cls"), default="mean")
            x.add_argument("--static", action="store_true")
            x.add_argument("--params-m", type=int, default=0, help="millions of parameters, for the estimate of memory")
        if name == "add-remote":
            x.add_argument("--url", required=True)
            x.add_argument("--key", help="the service's key, better $NAME for the environment's")
    return p


def _registry(config: Path) -> cfg.Registry:
    return cfg.Registry(cfg.load(cfg.global_config(os.environ.get("HOME")), config), config.with_name("models.json"))


def _engine(spark, root: str, registry: cfg.Registry) -> Engine:
    """An engine with the selected model if a service has it, else with stub vectors."""
    spec = registry.added.get(registry.settings["model"]["name"])
    if spec is None or spec.url is None:
        return Engine(spark, root)
    key = cfg.expanded(spec.key or "")
    return Engine(spark, root, settings=registry.settings, spec=spec, embed=lambda: RemoteEncoder(spec.url, spec.name, key, dimensions=spec.dimensions))


def _models(args: argparse.Namespace, config: Path) -> int:
    """Added models are the project's; ``set`` selects one for the project and ``set-default`` for all projects."""
    shared, registry = cfg.global_config(os.environ.get("HOME")), _registry(config)
    if args.what == "list":
        for r in registry.rows():
            print(f"{'*' if r['active'] else ' '} {r['name']} {r['dimensions']} dims, {r['ram_mb']} MB: {r['note']}")
    elif args.what == "remove":
        print("removed" if registry.remove(args.name) else "not an added model")
    elif args.what in ("add", "add-remote"):
        remote = args.what == "add-remote"
        spec = cfg.ModelSpec(args.name, args.dimensions, 0, 0, 0 if remote else args.params_m, args.query_prefix, args.doc_prefix, "mean" if remote else args.pooling, not remote and args.static, 4, args.max_length, False, args.note, args.url if remote else None, args.key if remote else None)
        print(f"added {registry.add(spec).name}")
    elif args.what == "set":
        registry.select(args.name)
        cfg.save_override(registry.settings, cfg.load(shared), config)
    else:
        every = cfg.Registry(cfg.load(shared))
        every.added = registry.added
        every.select(args.name)
        cfg.save_override(every.settings, cfg.DEFAULTS, shared)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    root = project_root(args.root, os.environ.get("SEAMARK_PROJECT_DIR"), home=os.environ.get("HOME"))
    config = root / INDEX_DIR / "config.toml"
    if args.command == "models":
        return _models(args, config)
    engine = _engine(spark or local_session(), str(root), _registry(config))
    if args.command in ("init", "sync"):
        print(json.dumps(engine.sync(force=args.command == "init" or args.force)))
    elif args.command == "search":
        if not args.no_sync and engine.is_due():
            engine.sync()
        hits = engine.search(args.query, args.n, args.scope)
        print(json.dumps([public(h) for h in hits], ensure_ascii=False) if args.json else rendered(hits))
    elif args.command == "status":
        print(json.dumps(engine.status(), default=str))
    elif args.command == "clear":
        engine.store.wipe()
    elif args.command == "debug":
        rows = engine.list_files() if args.what == "files" else engine.chunks_for_file(args.path)
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        server = Server(engine)
        clock = server.watch()
        try:
            server.serve()
        finally:
            clock.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
