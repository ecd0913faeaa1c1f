"""The numbered queries over the driver's tables, with their SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode_decode
from .fim import fill_in_middle, restored
from .language import identify_language, learn_profiles
from .mixing import mix_sources, root_weights
from .neighbours import nearest
from .ngram_join import ngram_components
from .pii import find_pii, learn_tagger
from .quality import learn_quality, score_quality
from .samples import fold, labelled_texts
from .rules import choose_cutoffs, count_texts, judge
from .secrets import common_words, find_secrets
from .spelling import spelling_variants
from .storage import shared_folder, stored
from .token_store import read_tokens, write_tokens
from .toxicity import learn_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_token_store")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op10_bpe_encode_decode")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe_encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    named = identify_language(docs.select("doc_id", "text"), learn_profiles(docs))
    return named.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def _scored(spark: SparkSession, folder: str, label: str, learn, score, threshold: float, limit: int) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learn(labelled_texts(docs, table(spark, folder, "labels"), label, limit))
    done = score(docs, model)
    return done.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, "quality", learn_quality, score_quality, 0.7, 3000)


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, "toxic", learn_toxicity, score_toxicity, 0.3, 4000)


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    counted = stored(count_texts(table(spark, folder, "documents").select("doc_id", "text")))
    judged = judge(counted, choose_cutoffs(counted, table(spark, folder, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_pii")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_pii(docs, learn_tagger(docs)).drop("text")


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


OP1_SQL = """
WITH RECURSIVE c AS (SELECT coalesce(source, '(none)') AS source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, greatest(1, CAST(round(100 * sqrt(n) / (SELECT sum(sqrt(n)) FROM c)) AS BIGINT)) AS weight FROM c),
s AS (SELECT list(source ORDER BY source) AS src, list(weight ORDER BY source) AS w, CAST(sum(weight) AS BIGINT) AS n FROM w),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM s
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(w) + 1), lambda i: done[i] + CASE WHEN i = p.i THEN 1 ELSE 0 END), p.i
  FROM (SELECT sim.t, sim.done, s.w, s.n, list_min(list_transform(list_filter(range(1, len(s.w) + 1),
          lambda i: sim.done[i] < s.w[i] AND (sim.done[i] * s.n) // s.w[i] <= sim.t + 1),
          lambda i: {'due': ((sim.done[i] + 1) * s.n + s.w[i] - 1) // s.w[i], 'i': i})) AS p
        FROM sim, s WHERE sim.t + 1 < s.n)),
plan AS (SELECT s.src[pick] AS source, s.w[pick] AS weight, s.n AS period, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sim, s WHERE t >= 0),
r AS (SELECT doc_id, source, coalesce(source, '(none)') AS k, row_number() OVER (PARTITION BY coalesce(source, '(none)') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk FROM documents),
b AS (SELECT r.*, rk // 64 AS block, weight FROM r JOIN w ON r.k = w.source)
SELECT b.doc_id, b.source, b.block, (b.block // b.weight) * plan.period + plan.slot AS slot,
       ((b.block // b.weight) * plan.period + plan.slot) * 64 + b.rk % 64 AS position
FROM b JOIN plan ON plan.source = b.k AND plan.turn = b.block % b.weight
"""


@query("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mix_sources(docs, root_weights(docs))


#: checksums by a table of 256 entries; near words by what is left after one deletion
OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT))) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS k, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
dealt AS (SELECT k, w, count(*) AS n, hex(encode(k || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY 1, 2),
sums AS (SELECT w, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM dealt, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS form, max(w.n) AS form_n FROM near JOIN (SELECT word AS other, n FROM words) w USING (other) GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.at WHERE e.form IS NULL
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_secret_scan")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_secrets(docs, common_words(docs)).drop("text")


OP13_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(table(spark, folder, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
