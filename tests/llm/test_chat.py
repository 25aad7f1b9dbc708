"""Formatted conversations read back to what went in."""

import hashlib

from pyspark.sql import functions as F

from pricetrail.llm import chat

SAID = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a &amp; <|end|>\n<|turn|>assistant\nx"), (1, 2, "assistant", "&#91;[[&lt;<|image:1|>"),
    (1, 3, "assistant", ""), (2, 1, "assistant", None), (2, 0, None, "no role"), (3, 5, "us\ner&#10;", "é😀\r\n\n"), (3, 5, "assistant", "tie"),
    (-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (4, None, "user", "no turn"), (4, 0, "assistant", "x" * 50_000), (None, 0, "user", "no id"),
    (1, 2, "assistant", "&#91;[[&lt;<|image:1|>"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for *_, r, x in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{x}\n" for *_, r, x in own)), len(learned), sha(learned)))
    return sorted(out, key=repr)


def test_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "body": F.lit("z")})
    pieces = chat.formatted(turns)
    got = chat.digests(pieces).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(TURNS)
    rows = pieces.collect()
    assert {r.conv_id: sum(len(x.formatted) for x in rows if x.conv_id == r.conv_id) for r in got} == {r.conv_id: r.formatted_chars for r in got}
    for r in rows:
        assert r.formatted.count(chat.TURN) == 1 and r.formatted.count("<|end|>") == 1
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
        assert (r.loss_start is not None) == (r.role == "assistant")
    assert sorted((r.role, chat.read_turn(r.formatted)[1]) for r in rows) == sorted((r or "", x or "") for _, _, r, x in TURNS)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    rows = [
        (1, 0, "user", "unread", [part("text", "see <this>: "), part("image", ref="a.png", w=29, h=14), part("text", " and "), part("audio", ref="b.wav", s=1.5),
                                  part("document", ref="c.pdf", n=3), part("video", ref="d"), part("image", ref="e.png"), part("text")]),
        (1, 1, "assistant", "plain", None), (1, 2, "assistant", "plain", []),
    ]
    got = {r.turn: r for r in chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")).collect()}
    assert got[0].formatted == "<|turn|>user\nsee &lt;this>: <|image:1|> and <|audio:2|><|document:3|><|other:4|><|image:5|><|end|>\n"
    assert [tuple(a) for a in got[0].attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 768), (4, "other", "d", 0), (5, "image", "e.png", 0)]
    assert got[0].expanded_tokens == 809 and got[0].loss_chars == 0
    assert chat.read_turn(got[1].formatted) == ("assistant", "plain") and chat.read_turn(got[2].formatted) == ("assistant", "")
    assert got[1].formatted[got[1].loss_start : got[1].loss_start + got[1].loss_chars] == "plain"


def test_no_turns(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_rows_of_one_turn_stand_in_the_order_of_their_texts(spark):
    texts = ["<", "'", "[", "a<", "a", "ab", "a!", "&", "é", ""]
    turns = spark.createDataFrame([(1, 1, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.formatted(turns)).first()
    in_order = sorted(texts, key=str.encode)
    assert found.turns_sha256 == hashlib.sha256("".join(f"assistant\n{t}\n" for t in in_order).encode()).hexdigest()
    assert found.loss_sha256 == hashlib.sha256("".join(in_order).encode()).hexdigest()
