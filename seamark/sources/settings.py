"""Settings, the model registry and checks of model files: plain driver functions."""

from __future__ import annotations

import copy
import json
import os
import re
import tomllib
from dataclasses import asdict, dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class ModelSpec:
    name: str
    dimensions: int
    code: int
    multilingual: int
    params_m: int
    query_prefix: str | None
    doc_prefix: str | None
    pooling: str
    static: bool
    rec_batch: int
    max_length: int
    rerank: bool
    note: str
    url: str | None = None  # of a service; None for a model of one's own
    key: str | None = None  # its key, or $NAME for the environment's

    def ram_mb(self) -> int:
        """A rough estimate: four bytes a parameter for static tables, one for quantised encoders."""
        return int(self.params_m * 4 + 30) if self.static else self.params_m + 350

    def contract(self) -> str:
        return f"{self.query_prefix or ''}|{self.doc_prefix or ''}|{self.pooling}"


# Public embedding models and how they are to be used.
MODELS = (
    ModelSpec("nomic-ai/CodeRankEmbed", 768, 5, 2, 137, "Represent this query for searching relevant code: ", None, "cls", False, 4, 448, False, "code, English"),
    ModelSpec("jinaai/jina-embeddings-v2-base-code", 768, 5, 2, 161, None, None, "mean", False, 4, 448, False, "code, 30 languages"),
    ModelSpec("minishlab/potion-multilingual-128M", 256, 3, 5, 128, None, None, "mean", True, 64, 448, True, "static, multilingual"),
    ModelSpec("minishlab/potion-base-32M", 512, 3, 2, 32, None, None, "mean", True, 64, 448, True, "static, English"),
    ModelSpec("google/embeddinggemma-300m", 768, 4, 5, 308, "task: code retrieval | query: ", "title: none | text: ", "mean", False, 4, 448, False, "multilingual"),
)
DEFAULT_MODEL = MODELS[0].name
DEFAULTS: dict[str, Any] = {
    "model": {"name": DEFAULT_MODEL, "max_length": 448},
    "sync": {"max_chunk_bytes": 2048, "embed_batch_size": 0, "embed_batch_bytes": 262144, "scan_window": 128, "resync_interval_minutes": 10, "exclude": []},
    "search": {"exact_below": 50000, "limit": 10},
    "rerank": {"enabled": None, "top_n": 50},
}


def merged(base: dict, over: dict) -> dict:
    """Tables are merged in depth; any other value of ``over`` replaces that of ``base``."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def minimal(settings: dict, base: dict) -> dict:
    """What of ``settings`` differs from ``base``."""
    out = {}
    for k, v in settings.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if own := minimal(v, base[k]):
                out[k] = own
        elif k not in base or base[k] != v:
            out[k] = v
    return out


def load(*paths: str | Path) -> dict:
    """Defaults under the given TOML files, later ones over earlier; missing files are empty."""
    out = DEFAULTS
    for p in paths:
        if Path(p).is_file():
            with open(p, "rb") as f:
                out = merged(out, tomllib.load(f))
    return out


def dumped(settings: dict, at: str = "") -> str:
    """TOML of nested tables of strings, numbers, booleans and lists."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        return str(v)

    plain = "".join(f"{k} = {value(v)}\n" for k, v in settings.items() if not isinstance(v, dict) and v is not None)
    out = (f"[{at}]\n" if at and plain else "") + plain
    for k, v in settings.items():
        if isinstance(v, dict):
            out += ("\n" if out else "") + dumped(v, f"{at}.{k}" if at else k)
    return out


def save_override(settings: dict, base: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dumped(minimal(settings, base)))


def model(name: str, extra: tuple[ModelSpec, ...] = ()) -> ModelSpec:
    for m in (*extra, *MODELS):
        if m.name == name:
            return m
    raise ValueError(f"no model {name!r}; known: {', '.join(m.name for m in (*MODELS, *extra))}")


def global_config(home: str | None = None) -> Path:
    """Settings of all projects; a project's own lie over them."""
    return Path(home or os.path.expanduser("~")) / ".config" / "seamark" / "config.toml"


class Registry:
    """Built-in models and added ones, with the selected one; ``path`` is the file that keeps the added ones."""

    def __init__(self, settings: dict | None = None, path: str | Path | None = None) -> None:
        self.settings = copy.deepcopy(settings or DEFAULTS)
        self.path = Path(path) if path else None
        said = json.loads(self.path.read_text()) if self.path and self.path.is_file() else []
        self.added: dict[str, ModelSpec] = {m["name"]: ModelSpec(**m) for m in said}

    def _keep(self) -> None:
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            new = self.path.with_suffix(".new")
            new.write_text(json.dumps([asdict(m) for m in self.added.values()], indent=1))
            new.replace(self.path)

    def select(self, name: str) -> ModelSpec:
        spec = model(name, tuple(self.added.values()))
        self.settings = merged(self.settings, {"model": {"name": name, "max_length": spec.max_length}})
        return spec

    def add(self, spec: ModelSpec) -> ModelSpec:
        """Add a model, or replace an added one of that name; a service keeps its name as given."""
        if spec.dimensions <= 0 or spec.max_length <= 0:
            raise ValueError("dimensions and length must be positive")
        if spec.url is not None and not re.match(r"https?://", spec.url):
            raise ValueError(f"{spec.url!r} is no address of a service")
        spec = spec if spec.url else replace(spec, name=normalized_repo(spec.name))
        if any(m.name == spec.name for m in MODELS):
            raise ValueError(f"{spec.name} is built in")
        self.added[spec.name] = spec
        self._keep()
        return spec

    def remove(self, name: str) -> bool:
        """Forget an added model; the selected one and the built-in ones stay."""
        if self.settings["model"]["name"] == name:
            raise ValueError(f"{name} is in use")
        if any(m.name == name for m in MODELS):
            raise ValueError(f"{name} is built in")
        found = self.added.pop(name, None) is not None
        if found:
            self._keep()
        return found

    def rows(self) -> list[dict]:
        now = self.settings["model"]["name"]
        return [{"name": m.name, "active": m.name == now, "dimensions": m.dimensions, "ram_mb": m.ram_mb(), "note": m.note} for m in (*MODELS, *self.added.values())]


def batch_size(explicit: int, spec: ModelSpec) -> int:
    """0: the model's own; an encoder's is never exceeded, a static table takes any."""
    if explicit <= 0:
        return spec.rec_batch
    return explicit if spec.static else min(explicit, spec.rec_batch)


def rerank_enabled(settings: dict, spec: ModelSpec) -> bool:
    said = settings.get("rerank", {}).get("enabled")
    return spec.rerank if said is None else bool(said)


def expanded(value: str, env: dict[str, str] | None = None) -> str:
    """``$NAME`` and ``${NAME}`` stand for the environment's value, empty if unset; else the text itself."""
    env = dict(os.environ) if env is None else env
    m = re.fullmatch(r"\$(?:\{(\w+)\}|(\w+))", value.strip())
    return env.get(m[1] or m[2], "") if m else value


def normalized_repo(text: str) -> str:
    """owner/name of a model repository's name or address."""
    s = re.sub(r"^https?://", "", text.strip())
    s = s.removeprefix("www.")
    s = re.sub(r"^(huggingface\.co|hf\.co)/", "", s).lstrip("@").strip("/")
    parts = []
    for part in s.split("/"):
        if part in ("tree", "blob", "resolve") or len(parts) == 2:
            break
        if part:
            parts.append(part)
    return "/".join(parts) or s


def weight_files(explicit: str | None = None) -> list[str]:
    """Where an encoder's weights may lie in a repository, in order."""
    return [explicit] if explicit else ["onnx/model.onnx", "model.onnx", "onnx/model_quantized.onnx", "model_quantized.onnx"]


def sidecars(weights: str) -> list[str]:
    """Files that may hold large weights beside ``weights``."""
    return [f"{weights}_data", f"{weights}.data"]


def check_encoder(config: dict, weights: bytes = b"") -> None:
    """Refuse models that generate text instead of encoding it."""
    kinds = config.get("architectures") or []
    if any(re.search(r"ForCausalLM|LMHead|ForConditionalGeneration", k) for k in kinds):
        raise ValueError(f"{', '.join(kinds)} generates text; an encoder is needed")
    if b"past_key_values" in weights:
        raise ValueError("the weights are a decoder's with cached keys; an encoder is needed")
