"""Chat formatting with typed content parts.

A message has a role and parts: text, image, audio, document. A visitor per kind flattens a part: text is
escaped, anything else becomes one placeholder, in order, and is recorded as an attachment with its
reference and the tokens it expands to. A turn is written as

    <|turn|>role<|body|>parts</s>

Control strings are ``<s>``, ``</s>``, ``[INST]``, ``[/INST]`` and whatever begins with ``<|``. Where a
text or a role holds one, a backslash is put behind its first character, and backslashes are
doubled, so no control string is left in the text and ``unescape`` gives back the exact text.

The loss mask is a list of stretches of code points: the bodies of assistant turns. A
conversation is one row of the result, as its format demands; turns are escaped and measured
before they are grouped, and running lengths are a streaming window.

Defined results: turns go by number, equal numbers by role and parts; a null turn number comes first;
null text, role or parts are empty; a null conversation id is a conversation; repeated rows are
turns of their own; an unknown kind is a placeholder of its own name without tokens
(``turn`` and ``body``, which name markers, become ``part_turn`` and ``part_body``); an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

TURN, BODY, END = "<|turn|>", "<|body|>", "</s>"
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
#: Tokens per unit: an image's tiles, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
_CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def visit(part: Column) -> Column:
    """What stands for a part in the text."""
    kind = F.coalesce(part["kind"], F.lit("unknown"))
    name = F.regexp_replace(kind, r"[^A-Za-z0-9_]", "_")
    name = F.when(name.isin("turn", "body"), F.concat(F.lit("part_"), name)).otherwise(name)
    return F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))


def part_tokens(part: Column) -> Column:
    """Tokens of a part in the model's context: text by its words, attachments by their units."""
    words = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), r"\s+"), lambda w: w != ""))
    tokens = F.when(part["kind"] == "text", words.cast("bigint"))
    for kind, per_unit in TOKENS_PER_UNIT.items():
        tokens = tokens.when(
            part["kind"] == kind, per_unit * F.coalesce(part["units"], F.lit(1).cast("bigint")))
    return tokens.otherwise(F.lit(0).cast("bigint"))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its message."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    ).cast(PARTS)


def format_chats(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts"
) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_spans``, ``attachments``, ``n_tokens``: one row per conversation."""
    own = F.coalesce(F.col(parts), F.array().cast(PARTS))
    attachments = F.filter(
        F.transform(
            own,
            lambda p, i: F.struct(
                i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda a: ~a["kind"].eqNullSafe("text"),
    )
    tokens = F.aggregate(F.transform(own, part_tokens), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.array_join(F.transform(own, visit), "").alias("body"),
        attachments.alias("attachments"),
        tokens.alias("tokens"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("head", head).withColumn("written", F.concat("head", "body", F.lit(END)))
    window = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.sum(F.length("written").cast("bigint")).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0).cast("bigint"))).withColumn(
        "no", F.row_number().over(window))
    loss = F.when(
        F.col("role") == "assistant",
        F.struct(
            (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length")))
    attached = F.transform("attachments", lambda a: F.struct(F.col("no").alias("turn"), a["part"].alias("part"),
                           a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("no", "written"))).alias("turns"),
        F.sort_array(F.collect_list(loss)).alias("loss_spans"),
        F.flatten(F.sort_array(F.collect_list(attached))).alias("attachments"),
        F.sum("tokens").alias("n_tokens"),
    )
    return grouped.select(
        "conv_id", F.array_join(F.col("turns.written"), "").alias("formatted"),
        "loss_spans", "attachments", "n_tokens")


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation as (role, text), attachments as their placeholders."""
    out = []
    for written in formatted.split(TURN)[1:]:
        role, body = written.removesuffix(END).split(BODY, 1)
        out.append((unescape(role), unescape(body)))
    return out


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> list[str]:
    return [unescape(formatted[a : a + n]) for a, n in spans]


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the formatted conversations."""
    chats = chats.select("conv_id", "formatted", "loss_spans", "n_tokens")
    kind = chats.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, n_tokens long"
    )

    def digest(row: dict) -> dict:
        turns = parse_chat(row["formatted"])
        loss = loss_text(row["formatted"], [(s["start"], s["length"]) for s in row["loss_spans"]])
        said, learned = hashlib.sha256(), hashlib.sha256()
        for role, text in turns:
            said.update(f"{role}\n{text}\n".encode())
        for text in loss:
            learned.update(text.encode())
        return {
            "conv_id": row["conv_id"],
            "n_turns": len(turns),
            "turns_sha256": said.hexdigest(),
            "loss_chars": sum(map(len, loss)),
            "loss_sha256": learned.hexdigest(),
            "formatted_chars": len(row["formatted"]),
            "n_tokens": row["n_tokens"],
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema(
                [
                    ("conv_id", batch.schema.field("conv_id").type),
                    ("n_turns", pa.int64()),
                    ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()),
                    ("n_tokens", pa.int64()),
                ]
            )
            yield pa.RecordBatch.from_pylist([digest(r) for r in batch.to_pylist()], schema=kinds)

    return chats.mapInArrow(read, schema)
