"""The pipeline's stages against plain versions of them, each on its own input."""

import hashlib

import pytest

import corpus_pipeline
from pricetrail.llm import toxicity
from pricetrail.llm.quality import judged
from pricetrail.llm.toxicity import scored, train
from test_decontamination import by_definition
from test_simhash import expected

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(train, "__defaults__", (toxicity.SAMPLE, ((40, 0.01), (20, 0.006))))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "near_dedup", "decontamination", "bpe"]
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        if name == "toxicity":
            want = {r.doc_id for r in scored(docs, labels).collect() if not r.predicted}
        elif name == "quality_rules":
            want = {r.doc_id for r in judged(docs, labels).collect() if r.kept}
        elif name == "near_dedup":
            want = {i for i, _, first in expected([(r.doc_id, r.text) for r in before.values()]) if i == first}
        elif name == "decontamination":
            found = {i: by_definition(r.text, items) for i, r in before.items()}
            want = {i for i, f in found.items() if not f[4]}
            assert all(after[i].n_chars == len(after[i].text) and by_definition(after[i].text, items)[0] == found[i][0] - found[i][1] for i in want if found[i][1])
        else:
            want = set(before)
            for i, r in after.items():
                ids = library.encode(before[i].text, add_special_tokens=False).ids
                assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), sha(" ".join(map(str, ids))))
                assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
        assert set(after) == want, name
        if name in ("toxicity", "quality_rules", "near_dedup"):
            assert all(after[i] == before[i] for i in want)
        docs = out


def test_run_is_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


def test_null_ids_and_odd_rows_pass(spark):
    """Rows without id, empty texts and further columns come through every stage that has no reason to drop them."""
    good = " ".join(f"word{i} goes on" for i in range(60))
    rows = [(1, good, "en", "s", len(good), 5), (None, good + " end", "en", "s", 0, 6), (2, None, None, None, None, 7), (3, "", "en", "s", 0, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ws long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert {5, 6} <= {r.ws for r in out.collect()} or name == "toxicity"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 4
    assert corpus_pipeline.STAGES[2][1](spark, docs.limit(0), FOLDER).count() == 0
