"""The registered queries: their columns, folds and cuts, and scores against plain scorers, one text after the other."""

import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendmill.llm import language, models, quality, queries, samples, toxicity
from trendmill.llm import text as tx

FOLDER = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1
BYTES = [int(v) for v in tx.BYTE_VALUE]


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def hashed(data):
    total, power = 0, 1
    for b in data:
        total, power = total + BYTES[b] * power & M64, power * tx.BASE & M64
    return mixed(total)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def toxic_score(model, text):
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    one = [hashed(w) for w in words]
    found = {*one, *(mixed((a + 2) * tx.BASE + b & M64) for a, b in zip(one, one[1:])), *(mixed(a * tx.BASE + mixed(c) & M64) for a, c in zip(one, one[2:]))}
    weight = dict(zip(model["at"].tolist(), model["weight"].tolist()))
    total = sum(weight.get(f, 0.0) for f in {h >> 64 - toxicity.FEATURE_BITS for h in found})
    return 1 / (1 + math.exp(-(total + model["bias"][0] - model["shift"][0])))


def shape(word):
    kinds = [3 if 48 <= b < 58 else 2 if 65 <= b < 91 else 1 if 97 <= b < 123 or b >= 128 else 4 for b in word]
    return bytes(k for k, before in zip(kinds, [0, *kinds]) if k != before)


def quality_score(model, text):
    vectors = model["vectors"].astype(np.float64)
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    width = quality.DIMENSIONS
    row = np.zeros(quality.INPUTS)
    if words:
        own = [vectors[hashed(w) >> 64 - quality.TOKEN_BITS] for w in words]
        shapes = [vectors[hashed(shape(w)) >> 64 - quality.TOKEN_BITS] for w in words]
        for k, kind in enumerate((own, shapes)):
            mean = sum(kind) / len(words)
            row[k * width : (k + 1) * width] = mean
            row[2 * width + k] = math.sqrt(sum(x * x for x in mean))
        row[-2] = sum(float(a @ b) for a, b in zip(own, own[1:])) / len(words)
    row[-1] = math.log(1 + len(words))
    hidden = np.tanh((row - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return 1 / (1 + math.exp(-(float(hidden @ model["w2"]) + model["b2"][0]) / model["temperature"][0] + model["shift"][0]))


@pytest.mark.parametrize("name,label,learn,limit,cut,plain", [("op3_quality_classifier", "quality", quality.learn_quality, 3000, 0.7, quality_score), ("op5_toxicity", "toxic", toxicity.learn_toxicity, 4000, 0.3, toxic_score)])
def test_classifier_queries_equal_plain_scorers(spark, tables, name, label, learn, limit, cut, plain):
    docs, labels, texts = tables
    sample = samples.labelled_texts(docs.select("doc_id", "text"), labels, label, limit)
    assert {crc(r["doc_id"], 4) for r in sample.collect()} == {0, 1, 3}
    model = models.load(learn(sample))
    got = queries.QUERIES[name](spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= cut)
        assert r["score"] == pytest.approx(plain(model, texts[r["doc_id"]]), abs=1e-4)


def test_classifier_queries_learn_nothing_from_the_fold(spark, tables, tmp_path):
    docs, labels, _ = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = samples.fold("doc_id", 4) == 2
    labels.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op3_quality_classifier", "op5_toxicity"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, FOLDER).collect())) == sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))


def language_score(profiles, letters, text):
    symbols = [0, *(0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in text.lower()), 0]
    bundle = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            bundle += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    if not any(symbols) or not bundle.any():
        return "und", 0.0
    cosine = {n: float(bundle @ np.array(v)) / math.sqrt(float(bundle @ bundle) * float(np.array(v) @ np.array(v))) for n, v in profiles.items()}
    best = max(sorted(cosine), key=cosine.get)
    return best, 1 / sum(math.exp(language.SHARPNESS * (v - cosine[best])) for v in cosine.values())


def test_language_query_equals_a_plain_scorer(spark, tables):
    docs, _, texts = tables
    profiles = language.learn_profiles(docs)
    letters = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), (language.SYMBOLS, language.DIMENSIONS)).astype(float)
    got = queries.QUERIES["op6_language_id"](spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    short = 0
    for r in got.collect():
        text = texts[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        if len(text) < 3000:
            lang, score = language_score(profiles, letters, text)
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
            short += 1
    assert short > 100 and unicodedata.category("a") == "Ll"


def test_the_other_queries_keep_their_contract(spark, tables):
    docs, _, texts = tables
    columns = {
        "op1_mix_sources": ["doc_id"], "op2_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"], "op4_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"], "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op10_bpe_encode_decode": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, first in columns.items():
        got = queries.QUERIES[name](spark, FOLDER)
        assert got.columns[: len(first)] == first, name
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(texts), name
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_token_store"](spark, FOLDER).collect()}
    start = 0
    for k in sorted(rows):
        assert rows[k]["start"] == start
        start += rows[k]["n_tokens"]
    for r in queries.QUERIES["op8_quality_rules"](spark, FOLDER).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_the_neighbour_query_finds_what_brute_force_finds(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, rows = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], dtype=np.float64)
    want = {}
    for q in ids[ids % 20 == 0]:
        score = rows @ rows[ids == q][0]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        want[int(q)] = [int(ids[k]) for k in order]
    got = {}
    for r in sorted(queries.QUERIES["op7_nearest_neighbours"](spark, FOLDER).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
        assert r["score"] == pytest.approx(float(rows[ids == r["vec_id"]][0] @ rows[ids == r["query_id"]][0]), abs=1e-9)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
