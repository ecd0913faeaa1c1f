"""Stages of the pipeline on small tables."""

import re

import corpus_pipeline as C
import public_tokenizers
import pytest
from test_text_operators import ODD, SCHEMA, brute_components, brute_sets
from tokenizers import Tokenizer

from trendmill.llm import pii
from trendmill.llm.mixing import in_mixed_order, mix_sources, root_weights
from trendmill.llm.storage import stored


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_stages_keep_columns_and_clean_rows(spark, odd):
    for docs in (odd, odd.where("false")):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
    assert C.mixing(spark, odd, "").count() == len(ODD)
    assert C.personal_data(spark, odd, "").count() == len(ODD)


def test_one_document_of_each_group_stays(spark, odd):
    kept = C.near_duplicates(spark, odd, "").collect()
    groups = brute_components([r[0] for r in ODD], brute_sets([r[1] for r in ODD]))
    named = {c for k, _, c in groups if c is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(named)


def test_unique_texts_of_repeated_and_missing_ids_stay(spark):
    base, other = (" ".join(f"{c}{k}" for k in range(90)) for c in "ab")
    near = base.replace("a80", "end")
    rows = [(1, base, "en", "a", 1), (7, near, "en", "a", 2), (7, other, "en", "a", 3), (None, near, "en", "b", 4), (None, near, "en", "b", 5), (None, "five words of its own", "en", "b", 6), (8, other, "en", "a", 7), (8, other, "en", "a", 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in C.near_duplicates(spark, docs, "").collect())
    assert kept == [(False, 1, 1), (False, 7, 3), (True, 0, 6)]
    kept = C.near_duplicates(spark, docs.where("doc_id = 8 OR doc_id IS NULL"), "").collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in kept) == [(0, 4), (0, 6), (8, 6)]


def test_every_step_of_a_small_run(spark, tmp_path):
    """The stages one by one against brute force, each on what the one before wrote."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    kept = stored(C.language_id(spark, docs, ""))
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= letters and len(ids) >= 0.98 * len(letters)
    rows = kept.select("doc_id", "text").collect()
    unique = stored(C.near_duplicates(spark, kept, ""))
    groups = brute_components([r[0] for r in rows], brute_sets([r[1] for r in rows]))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, _, c in groups})
    clean = stored(C.personal_data(spark, unique, ""))
    was = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        parts = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r["text"])
        assert all(p in was[r["doc_id"]] for p in parts) and len(r["text"]) == r["n_chars"]
        assert len(parts) > 1 or r["text"] == was[r["doc_id"]]
        assert len(parts) > 1 or not pii.pattern_spans(r["text"])
    mixed = stored(C.mixing(spark, clean, ""))
    last = {r["doc_id"]: r for r in C.encoding(spark, mixed, "").collect()}
    order = [r["doc_id"] for r in in_mixed_order(mix_sources(clean, root_weights(clean))).collect()]
    assert sorted(order, key=lambda d: last[d]["position"]) == order and sorted(r["position"] for r in last.values()) == list(range(len(order)))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in clean.collect():
        assert last[r["doc_id"]]["ids"] == " ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids))


def test_run_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"] for r in C.run(spark, folder).collect()}
    groups = brute_components([r["doc_id"] for r in docs], brute_sets([r["text"] for r in docs]))
    lettered = {r["doc_id"] for r in docs if any(c.isalpha() for c in r["text"] or "")}
    assert got <= {c for _, _, c in groups} and len(got) >= 0.98 * len({c for _, _, c in groups} & lettered)


def test_redacted_texts_hold_no_pattern(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = C.personal_data(spark, docs, "").collect()
    assert len(out) == docs.count() and all(len(r["text"]) == r["n_chars"] for r in out)
    assert not any(s[2] == "email" for r in out for s in pii.pattern_spans(r["text"]))


def test_texts_are_shuffled_once_to_drop_near_copies(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (None, "p q r s t u", "x"), (None, "p q r s t u", "y"), (3, None, "x")], "doc_id long, text string, source string")
    got = P.near_duplicates(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"], r["source"]) for r in got.collect()) == [("1", "a b c d e f g", "x"), ("3", None, "x"), ("None", "p q r s t u", "x")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    window = plan[plan.index("row_number") : plan.index("ShuffledHashJoin")]
    assert "Exchange" not in window


def test_texts_without_copies_stay_where_they_are(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(9)), "x") for k in range(60)]
    docs = spark.createDataFrame(rows + [(60, rows[7][1], "x"), (8, rows[8][1], "y"), (9, "other", "x"), (None, None, "x")], "doc_id long, text string, source string")
    sides, split = [], C.split_by_keys
    monkeypatch.setattr(C, "split_by_keys", lambda *given: sides.append(split(*given)) or sides[-1])
    got = C.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["source"]) for r in got) == sorted([(str(a), b, c) for a, b, c in rows] + [("9", "other", "x"), ("None", "", "x")])
    some, alone = sides[0]
    assert [some.count(), alone.count()] == [4, 60]
