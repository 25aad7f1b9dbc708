"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. In each round the adjacent pairs of all words are looked up by binary search
in the sorted pair keys, every word's lowest-ranked pair is merged wherever it occurs in that word, and words without a known
pair leave the array. Only words not met lately are encoded; a bounded memo holds the others.

The vocabulary file is a ``tokenizers`` JSON of this kind: NFC, white space to spaces, lower case; words by the file's pattern;
byte-level symbols; an end-of-word suffix; added tokens matched in the raw text; no decoder, so decoding joins tokens by a space.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.rows import map_batches

#: Pieces between white space whose ids a task remembers; the memo starts anew when it is full.
MEMO = 180_000
#: Characters of unseen words that are merged in one flat array.
FLAT = 1 << 20
#: Control characters that str.split() takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file (the text of the JSON)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in (vocab | self.added).items():
            self.tokens[i] = token
        self.inside = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self._ready()

    def _ready(self) -> None:
        self.word = regex.compile(self.pattern)
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.pieces.clear()
        self.words.clear()
        self.words.update((t, np.int32(i).tobytes()) for t, i in self.added.items())  # no word of the pattern is equal to one

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("word", "mark", "digits", "pieces", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words (not empty) given as UTF-8 bytes; the ids of a word as little-endian 32-bit numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inside[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done = [b""] * len(words)
        none = len(self.merged)
        while len(symbols):
            ranks = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                pair = symbols[:-1] << 32 | symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
                known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
                ranks[:-1][known] = self.rank[at[known]]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(ranks, starts)
            over, ids = np.flatnonzero(lowest == none), symbols.astype("<i4").tobytes()
            for w, a, b in zip(owner[starts[over]].tolist(), (4 * starts[over]).tolist(), (4 * (starts + counts)[over]).tolist()):
                done[w] = ids[a:b]
            here = np.repeat(lowest, counts)
            hit = np.flatnonzero((ranks == here) & (ranks < none))
            if len(hit):  # of overlapping equal pairs (a a a), the first, third ... of each run are merged
                run = np.concatenate([[True], np.diff(hit) != 1])
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
                symbols[hit] = self.merged[ranks[hit]]
            stay = here < none
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return done

    def _learn_words(self, words: list[str]) -> None:
        part, size = [], 0
        for k, w in enumerate(words):
            part.append(w)
            size += len(w)
            if size >= FLAT or k == len(words) - 1:
                self.words.update(zip(part, self.merge([x.encode() for x in part])))
                part, size = [], 0

    def split(self, piece: str) -> list[str]:
        """Words of a text without white space, and the added tokens in it."""
        if piece.isalpha() and piece.isascii():
            return [piece.lower()]
        out: list[str] = []
        for k, part in enumerate(self.mark.split(piece) if self.mark else [piece]):
            if k % 2:
                out.append(part)
            elif part:
                # lower case goes by character: a capital sigma is never taken for a final one
                out += self.word.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def learn(self, pieces: list[str]) -> None:
        """Put unseen pieces into the memo."""
        if len(self.pieces) + len(pieces) > MEMO:
            self._forget()
        split = list(map(self.split, pieces))
        self._learn_words([w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.words])
        for piece, parts in zip(pieces, split):
            self.pieces[piece] = self.words[parts[0]] if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and blank texts have none."""
        pieces = [[p for p in _SPACE.split(t) if p] if t and _NOT_SPACE.search(t) else (t or "").split() for t in texts]
        known = self.pieces
        self.learn([p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in known])
        try:
            return [np.frombuffer(b"".join(map(known.__getitem__, ps)), "<i4").tolist() for ps in pieces]
        except KeyError:  # the memo started anew and lost what it knew before
            known.clear()
            self.learn(list(dict.fromkeys(chain.from_iterable(pieces))))
            return [np.frombuffer(b"".join(map(known.__getitem__, ps)), "<i4").tolist() for ps in pieces]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def spelled(self, ids: list[int]) -> str:
        """The ids in decimal, joined by a space."""
        return " ".join(map(self.digits.__getitem__, ids))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_vocabulary(path: str | None = None) -> Bpe:
    """Read on the driver: the file is a few MB whatever the data, and its tables are broadcast."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return Bpe(file.read())


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids (array<int>) for every row.

    The ids are decoded again; the digests are of the ids in decimal joined by a space and of the decoded text. Null, empty and
    blank texts have no tokens. Repeated rows are encoded each; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        bpe, sha = shared.value, lambda s: hashlib.sha256(s.encode()).hexdigest()

        def step(batch: pa.RecordBatch) -> dict:
            n, first, second, lists = [], [], [], []
            for found in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(found))
                first.append(sha(bpe.spelled(found)))
                second.append(sha(bpe.decode(found)))
                if ids:
                    lists.append(found)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": first, "decoded_sha256": second}
            return out | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if ids else {})

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(rows, make, schema)
