"""Chat formatting: typed content parts become one marked-up text with a loss mask.

A turn is written as ``<|turn|>role\\ntext<|end|>\\n``. In roles and texts, ``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;`` and ``&#91;``, so that no
control string of this template, nor the usual ``</s>`` and ``[INST]``, can come from a text; line ends in roles become ``&#10;``. Undoing
these in reverse gives the text back exactly.

A visitor goes over a turn's parts in order: text parts are escaped; image, audio and document parts become numbered placeholders such as
``<|image:1|>``, with the attachment they refer to and the number of tokens the placeholder stands for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Escapes in the order they are made. Fixed values of the template.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Pixels of a patch's side, tokens per second of sound, tokens per page: what a placeholder expands to.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
#: What a ``parts`` column holds.
PARTS = "array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>"
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: str) -> str:
    for plain, code in reversed(ESCAPES):
        text = text.replace(code, plain)
    return text


class Visitor:
    """What each kind of part becomes: its text and the tokens it expands to. A part of an unknown kind is kept as a placeholder of none."""

    def __init__(self, patch: int = PATCH, audio_rate: int = AUDIO_RATE, page_tokens: int = PAGE_TOKENS):
        whole = lambda c: F.coalesce(F.ceil(c), F.lit(0)).cast("long")
        self.tokens = {
            "image": lambda p: whole(p["width"] / patch) * whole(p["height"] / patch),
            "audio": lambda p: whole(p["seconds"] * audio_rate),
            "document": lambda p: whole(p["pages"] * page_tokens),
        }

    def kind(self, part: Column) -> Column:
        return F.when(part["type"].isin("text", *self.tokens), part["type"]).otherwise("other")

    def expanded(self, part: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, tokens in self.tokens.items():
            out = F.when(part["type"] == kind, tokens(part)).otherwise(out)
        return out

    def text(self, part: Column, number: Column) -> Column:
        mark = F.concat(F.lit("<|"), self.kind(part), F.lit(":"), number.cast("string"), F.lit("|>"))
        return F.when(part["type"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def formatted(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_chars, attachments, expanded_tokens for every row of ``turns``.

    The formatted texts of a conversation, in the order of turn (then role and text), make up its document. loss_start (from 0) and loss_chars are
    the span of a learned role's text within the row's piece, null and 0 for other roles. With a column ``parts`` (see PARTS) its parts are
    flattened in order; a row without it, or where it is null, has its text as only part. Null texts and roles are empty, and so is an empty
    list of parts. attachments lists number, kind, ref and tokens of the placeholders; other columns are ignored.
    """
    visitor = visitor or Visitor()
    own = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                           *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    parts = F.coalesce(F.col("parts").cast(PARTS), own) if "parts" in turns.columns else own
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    number = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: p["type"] != "text"))
    body = F.array_join(F.transform("parts", lambda p, i: visitor.text(p, number(i))), "")
    placed = F.filter(F.transform("parts", lambda p, i: F.struct(
        number(i).alias("number"), visitor.kind(p).alias("kind"), p["ref"].alias("ref"), visitor.expanded(p).alias("tokens"))), lambda a: a["kind"] != "text")
    rows = rows.withColumn("body", body).withColumn("attachments", placed)
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    learned = F.col("role").isin(*LEARNED)
    return rows.select(
        "conv_id", "turn", "role", F.concat(head, F.col("body"), F.lit(END)).alias("formatted"),
        F.when(learned, F.length(head)).cast("long").alias("loss_start"), F.when(learned, F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, body = _TURN.fullmatch(piece).groups()
    return unescape(role.replace("&#10;", "\n")), unescape(body)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars per conversation, read back from ``formatted``'s rows.

    A conversation's rows stream in order through running digests: a digest of a sequence cannot be split, but nothing of the
    conversation is held in memory.
    """

    def run(batches) -> Iterable[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        now: list | None = None

        def closed(rows: list) -> pa.RecordBatch:
            rows = [(c, n, a.hexdigest(), k, b.hexdigest(), f) for c, n, a, k, b, f in rows]
            return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

        for batch in batches:
            done = []
            for conv, piece, start, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_chars"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(piece)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(piece[start : start + size])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(piece)
            yield closed(done)
        if now is not None:
            yield closed([now])

    rows = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "formatted", "loss_start", "loss_chars")
    text = F.left("formatted", F.length("formatted") - len(END))  # rows of one turn and role stand in the order of their unescaped texts
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    rows = rows.withColumn("text", text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
