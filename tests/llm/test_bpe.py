"""Ids against the tokenizers library and against merging one pair at a time."""

import hashlib
import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from pricetrail.llm import bpe  # noqa: E402
from pricetrail.llm.queries import QUERIES  # noqa: E402

PATH = public.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "Hello World's don't I'LL 'S 's're", "aaa aaaa aaaaa aaaaaa", "x" * 5000, "ΣΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ẞ ﬁ Å",
    "a<|endoftext|>b<|startoftext|> c <|ENDOFTEXT|> <|endoftext|><|endoftext|>", "tab\x1cx\x1f y\x85z\xa0q w​v　", "é ạ́",
    "½ ² Ⅷ ٣ 12345", "日本語テキスト漢字", "😀👍🏽 👨‍👩‍👧", "\x00\x01\x7f", "mississippi" * 50, "w0rd_under-score...?!", "the same words " * 2000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_odd_texts(library):
    own = bpe.read_vocabulary(PATH)
    for text, found in zip(ODD, own.encode(ODD)):
        assert found == ids_of(library, text), text
        assert own.decode(found) == library.decode(found, skip_special_tokens=False)


def test_a_full_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 30)
    monkeypatch.setattr(bpe, "FLAT", 40)
    own, pick = bpe.read_vocabulary(PATH), random.Random(0)
    for _ in range(40):
        texts = [" ".join(pick.choice(["some", "Words", "x%d," % pick.randrange(40), "<|endoftext|>"]) for _ in range(12)) for _ in range(3)]
        assert own.encode(texts) == [ids_of(library, t) for t in texts]


def test_merge_rounds_are_one_pair_at_a_time():
    own, spec = bpe.read_vocabulary(PATH), json.load(open(PATH, encoding="utf-8"))["model"]
    rank = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in enumerate(spec["merges"])}
    letters, pick = bpe.byte_symbols(), random.Random(3)
    words = [bytes(pick.choice(b"abeinorst") for _ in range(pick.randint(1, 25))) for _ in range(500)]
    for word, found in zip(words, own.merge(words)):
        symbols = [letters[b] for b in word]
        symbols[-1] += spec["end_of_word_suffix"]
        while len(symbols) > 1:
            least, at = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if least == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        assert [own.tokens[int.from_bytes(found[i : i + 4], "little")] for i in range(0, len(found), 4)] == symbols


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(library, i, text):
    ids = ids_of(library, text)
    return i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_table(spark, library):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([row(library, i, t) for i, t in rows], key=repr)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode(docs.limit(0), PATH).collect() == []


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_bpe"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(row(library, i, t) for i, t in rows)
