"""Token counts by section, from one encoding of the whole document.

A document is encoded once, so that its sections' counts add up to the document's. Byte-level tokens spell the text exactly, so the lengths of
their bytes give their offsets. The spans of tokens are joined with the spans of sections by binary search; a token that crosses a
boundary goes, whole, to one section by the rule asked for.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.rows import map_batches, utf8

#: To whom a token that crosses a boundary goes: the section with most of its bytes (the earlier one of equals), the one where it
#: starts, or the one where it ends.
RULES = ("most", "first", "last")
_BREAK = re.compile(rb"\n(?:[ \t\r]*\n)*")


def paragraphs(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of lines that touch: line ends and the blank lines after them belong to the line they end. An empty text has none."""
    ends = [m.end() for m in _BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For tokens with byte spans [start, end): the section each goes to, and whether it crosses a boundary.

    ``bounds`` are the sections' boundaries, ascending, from 0 to the length of the text.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    crosses = last > first
    if rule == "first" or not crosses.any():
        return first, crosses
    if rule == "last":
        return last, crosses
    at = first.copy()
    for i in np.flatnonzero(crosses):
        inner = np.concatenate([[starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
        at[i] = first[i] + int(np.diff(inner).argmax())  # argmax takes the first of equals
    return at, crosses


class Counter:
    """An encoder of one rank file (base64 token and rank a line), with the byte length of every token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.encoding = ranks, pattern, None
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def __getstate__(self):
        return self.__dict__ | {"encoding": None}

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; strings that look like special tokens are ordinary text."""
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding("section-counts", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # the library's pattern matcher ran out of stack in a very long run of white space: split by another one
            return self.encode_pieces(text)

    def encode_pieces(self, text: str) -> np.ndarray:
        """The same ids, with the pattern matched outside the library."""
        return np.fromiter(chain.from_iterable(map(self.encoding._encode_single_piece, regex.findall(self.pattern, text))), np.int64)

    def count(self, text: bytes, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each section, and how many of them cross one of its boundaries."""
        ends = np.cumsum(self.sizes[self.encode(text.decode("utf-8", "replace"))])
        at, crosses = allocate(np.concatenate([[0], ends[:-1]]), ends, bounds, rule)
        many = len(bounds) - 1
        return np.bincount(at, minlength=many), np.bincount(at[crosses], minlength=many)


def read_ranks(path: str | None = None, pattern: str | None = None) -> Counter:
    """Read on the driver: about a MB whatever the data, and broadcast. Files and patterns of public tokenizers are the defaults."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as file:
        return Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def section_tokens(docs: DataFrame, rule: str = "most", path: str | None = None, pattern: str | None = None,
                   sections: Callable[[bytes], list[tuple[int, int]]] = paragraphs) -> DataFrame:
    """doc_id, section (from 0), start_char, n_chars, n_tokens, n_crossing, doc_tokens for every section of every row's text.

    ``sections`` names byte spans that follow one another from the text's start to its end. Null and empty texts give one row, section 0
    without characters and tokens. Repeated rows give their sections again; other columns are never read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path, pattern))

    def make():
        counter = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                spans = sections(text) if text else []
                if spans:
                    bounds = np.array([0, *(b for _, b in spans)])
                    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[bounds[1:] - 1]
                    tokens, crossing = counter.count(text, bounds, rule)
                else:
                    chars = tokens = crossing = np.zeros(1, np.int64)
                before = np.concatenate([[0], chars[:-1]])
                many = len(chars)
                for column, values in zip(out, ([doc] * many, range(many), before, chars - before, tokens, crossing, [tokens.sum()] * many)):
                    column.extend(values)
            names = ("doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing", "doc_tokens")
            return {n: pa.array(c, pa.int32() if n == "section" else pa.int64()) for n, c in zip(names, out)}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, section int, start_char long, n_chars long, n_tokens long, n_crossing long, doc_tokens long")
