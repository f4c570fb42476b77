import hashlib
import os

import brute
import pytest

import corpus_pipeline
from terrazzo.llm import decontaminate, language
from terrazzo.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = {r.doc_id for r in language.identify(spark.read.parquet(f"{SF}/documents.parquet")).where("lang_pred <> 'und' AND score >= 0.4").collect()}
    assert known <= {i for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    left = {i: t for i, t in docs.items() if i in known}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if last[t] == i}
    component = brute.jaccard_components(list(left.items()))
    left = {i: t for i, t in left.items() if component[i][1] == i}
    items = [decontaminate.cut_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(decontaminate._best_share(w, decontaminate.cut_words(t)) for w in items)}
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
    got = {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) < len(docs)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id long, _sha string, row long, id string, hash long, digest string, n_rows long, kept boolean, known string, score double, lang_pred string, text_hash long, share int"
EXTRA = (5, "x", 1, "y", 2, "z", 7, None, "k", 0.5, "l", 3, 4)


def test_stages_with_clashing_columns_nulls_and_repeated_rows(spark):
    some = [(1, "one two three", "en", "s", 13), (2, "12 34", None, None, None), (3, None, "en", "s", 0), (None, "null id", "en", "s", 7), (4, "", None, "s", 0)]
    some += [(5, "one two three", None, None, 1), (6, "one two threes", "en", "s", 1), (7, "one of a row", "en", "s", 1), (7, "one of a row", "en", "s", 1), (7, "two of a row", "en", "s", 1), (7, "two of a row", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in some], COLUMNS)
    left = {"language": [0, 1, 5, 6, 7, 7, 7, 7], "exact": [0, 2, 4, 5, 6, 7, 7], "near": [0, 1, 2, 3, 4, 6, 7, 7, 7, 7], "benchmark": [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7]}
    for name, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, SF)
        assert out.schema == docs.schema, name
        got = out.collect()
        assert sorted(r.doc_id or 0 for r in got) == left[name], name
        assert all(tuple(r)[5:] == EXTRA for r in got), name
        if name == "exact":
            assert {r.text for r in got if r.doc_id == 7} == {"one of a row", "two of a row"}
    out = corpus_pipeline.encode(spark, docs, SF).collect()
    assert len(out) == len(some) and {len(r.ids) == r.n_tokens for r in out} == {True} and {r.n_tokens for r in out if r.doc_id in (3, 4)} == {0}


def test_stages_of_empty_and_unlabelled_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", None), (2, "12 34", None)], "doc_id long, text string, lang string")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs.where("doc_id < 0"), SF)
        assert out.count() == 0, name
        assert name == "encode" or out.columns == docs.columns
    assert [r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()] == [1]
