"""Section counts against the offsets of another library's encoder."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from pricetrail.llm import token_counts  # noqa: E402
from pricetrail.llm.queries import QUERIES  # noqa: E402
from pricetrail.llm.token_counts import allocate, paragraphs, read_ranks, section_tokens  # noqa: E402

ODD = [None, "", "\n", "\n\n \n", "one", "one\ntwo\n", " a\r\n\r\n\t\n b\n\n\nc", "é😀\n日本語\n\n" * 20, "x" * 4000, "a <|endoftext|> b\n<|endoftext|>", "   \n   x", "tail  \n"]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_paragraphs_cover_the_text():
    for text in ODD:
        raw = (text or "").encode()
        spans = paragraphs(raw)
        assert b"".join(raw[a:b] for a, b in spans) == raw and all(b > a for a, b in spans)
        assert all(raw[b - 1 : b] in b"\n\t\r " or b == len(raw) for _, b in spans)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_by_definition(rule):
    pick = random.Random(1)
    for _ in range(300):
        n = pick.randint(1, 40)
        cuts = sorted({0, n, *(pick.randrange(n + 1) for _ in range(pick.randint(0, 8)))})
        ends = sorted({n, *(pick.randint(1, n) for _ in range(pick.randint(0, 10)))})
        starts = [0, *ends[:-1]]
        at, crosses = allocate(np.array(starts), np.array(ends), np.array(cuts), rule)
        for a, b, got, crossing in zip(starts, ends, at, crosses):
            share = [max(0, min(b, cuts[s + 1]) - max(a, cuts[s])) for s in range(len(cuts) - 1)]
            held = [s for s, k in enumerate(share) if k]
            want = {"first": held[0], "last": held[-1], "most": share.index(max(share))}[rule]
            assert got == want and crossing == (len(held) > 1)


def expected(library, rows):
    out, ranks = [], read_ranks()
    for doc, text in rows:
        raw = (text or "").encode()
        spans = paragraphs(raw) or [(0, 0)]
        tokens = library.encode(text or "", add_special_tokens=False).ids
        at = 0
        counts = [[0, 0] for _ in spans]
        for t in tokens:
            end = at + int(ranks.sizes[t])
            first = next(s for s, (_, b) in enumerate(spans) if b > at)
            share = [0] * first + [max(0, min(end, b) - max(at, a)) for a, b in spans[first : first + 9]]
            s = share.index(max(share))
            counts[s][0] += 1
            counts[s][1] += sum(map(bool, share)) > 1
            at = end
        assert at == len(raw)
        for s, ((a, b), (n, c)) in enumerate(zip(spans, counts)):
            out.append((doc, s, len(raw[:a].decode()), len(raw[a:b].decode()), n, c, len(tokens)))
    return sorted(out, key=repr)


def test_table(spark, library):
    rows = [*enumerate(ODD), (4, "one"), (None, "no\nid")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, section int")
    assert sorted(map(tuple, section_tokens(docs).collect()), key=repr) == expected(library, rows)
    assert section_tokens(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        section_tokens(docs, rule="half")


def test_crossing_tokens_by_rule(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    at = lambda raw: [(0, 2), (2, len(raw))]  # noqa: E731  a boundary inside the first token
    got = {rule: [(r.n_tokens, r.n_crossing) for r in section_tokens(docs, rule, sections=at).orderBy("section").collect()] for rule in token_counts.RULES}
    assert got == {"most": [(0, 0), (2, 1)], "first": [(1, 1), (1, 0)], "last": [(0, 0), (2, 1)]}


def test_very_long_runs_of_white_space(library):
    counter, text = read_ranks(), "a" + " " * 1_000_000 + "b"
    assert len(counter.encode(text)) > 1000
    for text in ODD:
        assert counter.encode_pieces(text or "").tolist() == counter.encode(text or "").tolist()


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_token_counts"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, rows)
