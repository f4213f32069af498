"""Evaluation corpora and generated ones, and where evaluation records go."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("rs", "py", "ts", "md", "json")


def read_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Query and code pairs (q, c) of a JSONL file; pairs with a blank side are dropped."""
    rows = spark.read.schema("q string, c string").json(path).where("trim(coalesce(q, '')) <> '' and trim(coalesce(c, '')) <> ''")
    return rows.limit(limit) if limit is not None else rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Queries and the files expected for them: qid, text, expected."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("query", [])
    return spark.createDataFrame([(i, q["text"], q["expected"]) for i, q in enumerate(found)], "qid bigint, text string, expected string")


def generated(spark: SparkSession, files: int, seed: int = 42) -> DataFrame:
    """``files`` deterministic small sources in five languages, none to three folders deep: path, text."""
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    lang = F.get(F.array(*(F.lit(x) for x in LANGUAGES)), (F.col("id") % len(LANGUAGES)).cast("int"))
    folder = F.array_join(F.transform(F.sequence(F.lit(0), draw(1, 4)), lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("d"), (draw(2, 9) + i).cast("string"), F.lit("/")))), "")
    name = F.concat(folder, F.lit("file_"), F.col("id").cast("string"), F.lit("."), lang)
    n = F.concat(F.col("id").cast("string"), F.lit("_"))
    bodies = {
        "rs": lambda i: F.concat(F.lit("/// Computes value "), i, F.lit(".\npub fn compute_"), n, i, F.lit("(x: u64) -> u64 {\n    x + "), i, F.lit("\n}\n\n")),
        "py": lambda i: F.concat(F.lit("def compute_"), n, i, F.lit("(x):\n    return x + "), i, F.lit("\n\n\n")),
        "ts": lambda i: F.concat(F.lit("export function compute_"), n, i, F.lit("(x: number) {\n  return x + "), i, F.lit(";\n}\n\n")),
        "md": lambda i: F.concat(F.lit("## Section "), n, i, F.lit("\n\nText about part "), i, F.lit(".\n\n")),
        "json": lambda i: F.concat(F.lit('{"name": "item_'), n, i, F.lit('", "value": '), i, F.lit("}\n")),
    }
    body = F.lit("")

    def repeated(make):
        return F.array_join(F.transform(F.sequence(F.lit(1), draw(3, 8) + 1), lambda i: make(i.cast("string"))), "")

    for x, make in bodies.items():
        body = F.when(lang == x, repeated(make)).otherwise(body)
    return spark.range(files).select(name.alias("path"), body.alias("text"))


def append_records(records: DataFrame, path: str) -> None:
    """Append one JSON line a record."""
    records.write.mode("append").json(path)


def report(records: list[dict], title: str) -> str:
    """A Markdown table of records by falling mrr_10; records with an error are listed after it."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    good = sorted((r for r in records if not r.get("error")), key=lambda r: (-r["mrr_10"], r["model"]))
    lines = [f"# {cell(title)}", "", "| model | mrr_10 | recall_1 | recall_5 | ndcg_10 |", "|-|-|-|-|-|"]
    lines += [f"| {cell(r['model'])} | " + " | ".join(f"{r[k]:.4f}" for k in ("mrr_10", "recall_1", "recall_5", "ndcg_10")) + " |" for r in good]
    if bad := [r for r in records if r.get("error")]:
        lines += ["", "## Errors", "", *(f"- {cell(r['model'])}: {cell(r['error'])}" for r in bad)]
    return "\n".join(lines) + "\n"


def write_report(records: list[dict], title: str, path: str) -> None:
    Path(path).write_text(report(records, title))


def pick_models(selector: str | None, known: list[str], default: str) -> list[str]:
    """``all``, names by comma, or the default."""
    if not selector:
        return [default]
    return list(known) if selector == "all" else [x.strip() for x in selector.split(",") if x.strip()]


def to_json(row: dict) -> str:
    return json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False)
