"""Chat formatting with typed content parts.

A visitor flattens each turn's parts in order: adjacent texts are joined and escaped as one, so that no control string
forms where two of them meet; other kinds become placeholders that carry the number of tokens they expand to, and
their references are recorded. The output is
one segment a turn; the segments of a conversation, in order, are its formatted text. Reading it
back streams over sorted rows, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of one image tile of PATCH x PATCH pixels, an audio second and a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"


def escaped(text: Column) -> Column:
    """No ``<|`` is left: one backslash more stands between ``<`` and ``|``; ``unescape`` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, and on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def expanded(part: Column) -> Column:
    """Tokens that a part other than text stands for, at least one."""
    image = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    audio, pages = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS
    return F.greatest(F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).when(part["kind"] == "document", pages).otherwise(F.lit(1)), F.lit(1)).cast("bigint")


def is_text(part: Column) -> Column:
    return part.isNull() | (F.coalesce(part["kind"], F.lit("text")) == "text")


def placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), F.regexp_replace(part["kind"], "[^a-z0-9_]", "_"), F.lit(":"), expanded(part).cast("string"), F.lit("|>"))


def flattened(parts: Column) -> Column:
    """The escaped content of ``parts`` in order: runs of texts, and a placeholder after each but the last."""

    def of(at: Column) -> Column:  # where the parts other than text stand
        n = F.size(at)

        def run(k: Column) -> Column:
            low, high = F.when(k > 0, F.get(at, k - 1) + 1).otherwise(0), F.when(k < n, F.get(at, k)).otherwise(F.size(parts))
            texts = F.transform(F.slice(parts, low + 1, high - low), lambda p: F.coalesce(p["text"], F.lit("")))
            return F.concat(escaped(F.array_join(texts, "")), F.when(k < n, placeholder(F.get(parts, F.get(at, k)))).otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), n), run), "")

    places = F.filter(F.transform(parts, lambda p, i: F.when(~is_text(p), i)), lambda i: i.isNotNull())
    return F.transform(F.array(places), of)[0]


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` has conv_id, turn, role and parts (array of PART); one row a turn.

    Returns conv_id, turn, role, segment, loss_start and loss_length (code points of the segment
    under the loss mask: the whole content of an assistant turn, else length 0), attachments (array of
    ordinal, kind, ref, tokens) and attachment_tokens. Null roles, parts and texts are empty; an
    unknown kind is kept as a placeholder of one token. Repeated rows are each formatted; a very long text is
    handled in its own row; an empty table gives no rows. Other columns are ignored.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    content = flattened(parts)
    others = F.filter(parts, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    return turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), content.alias("content"), attachments.alias("attachments")).select(
        "conv_id", "turn", "role", F.concat("head", "content", F.lit(END + "\n")).alias("segment"),
        F.length("head").alias("loss_start"), F.when(F.col("role") == "assistant", F.length("content")).otherwise(0).alias("loss_length"),
        "attachments", F.aggregate(F.col("attachments"), F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and contents, unescaped, of formatted text that comes in any chunks."""
    rest, mark = "", END + "\n"
    for chunk in chunks:
        rest += chunk
        while (end := rest.find(mark)) >= 0:
            turn, rest = rest[:end], rest[end + len(mark) :]
            head, _, content = turn.partition("\n")
            if not head.startswith(START):
                raise ValueError("a turn doesn't begin with its mark")
            yield unescape_role(head[len(START) :]), unescape(content)
    if rest:
        raise ValueError("the last turn doesn't end")


def read_parts(escaped_content: str) -> list[tuple[str, str | int]]:
    """The parts of a turn's content as it stands in the formatted text: ("text", text) and (kind, tokens), in order.

    Adjacent texts are one, and empty ones are left out.
    """
    out, at = [], 0
    for m in re.finditer(r"<\|([a-z0-9_]*):(\d+)\|>", escaped_content):
        out += [("text", unescape(escaped_content[at : m.start()])), (m[1], int(m[2]))]
        at = m.end()
    out.append(("text", unescape(escaped_content[at:])))
    return [x for x in out if x[0] != "text" or x[1]]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    now, turns, loss, n, chars, total, held, tokens = None, None, None, 0, 0, 0, 0, 0

    def close() -> None:
        if turns is not None:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total, held, tokens))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in DIGEST.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        done.clear()
        return out

    for batch in batches:
        for conv, segment, start, length, attached, expands in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if turns is None or conv != now:
                close()
                now, turns, loss, n, chars, total, held, tokens = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
            for role, content in read_turns([segment]):
                turns.update(f"{role}\n{content}\n".encode())
                n += 1
            masked = unescape(segment[start : start + length])
            loss.update(masked.encode())
            chars += len(masked)
            total += len(segment)
            held += attached
            tokens += expands
        if len(done) >= 1000:
            yield flush()
    close()
    yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from what ``format_turns`` made.

    Turns are in order of turn (null first), role and segment; rows whose conv_id is null are one conversation.
    Repeated rows are turns like others; a very long conversation takes the memory of one turn; an empty table gives no rows.
    """
    columns = ["segment", "loss_start", "loss_length", F.size("attachments").cast("bigint").alias("held"), "attachment_tokens"]
    rows = formatted.select(F.col("conv_id").cast("bigint").alias("conv_id"), *columns, "turn", "role")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment").drop("turn", "role")
    return rows.mapInArrow(_digests, DIGEST)


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")))).cast(f"array<{PART}>")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = told.unionByName(probe).withColumn("parts", text_parts(F.coalesce("text", F.lit(""))))
    return read_back(format_turns(turns))


ORACLE = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
    e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS x, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS r FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(START) + len(END) + 2} + length(r) + length(x))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
    FROM e GROUP BY conv_id"""
