"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import feeds as D
from .operators import search as J
from .operators import vectors as V
from .operators.rules import CATEGORIES
from .queries import FLOORS, query, run_tables
from .sources import model as M

_NOUN = "split_part(p_name, ' ', 2)"


@query("j1_singulars", f"SELECT p_partkey AS id, {_NOUN} || 's' AS word, list_sort(list_distinct([{_NOUN} || 's', {_NOUN}] || CASE WHEN right({_NOUN}, 1) = 'e' THEN [left({_NOUN}, len({_NOUN}) - 1)] ELSE [] END)) AS terms FROM part")
def j1(spark, folder):
    word = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s"))
    return M.read(spark, folder, "part").select(F.col("p_partkey").alias("id"), word.alias("word"), X.singulars(word).alias("terms"))


@query("j2_plural_variants", f"SELECT p_partkey AS id, CASE WHEN len({_NOUN}) <= 3 THEN [{_NOUN}] ELSE list_sort([{_NOUN}, {_NOUN} || 's', {_NOUN} || 'es']) END AS variants FROM part")
def j2(spark, folder):
    return M.read(spark, folder, "part").select(F.col("p_partkey").alias("id"), X.plural_variants(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("variants"))


_CATS = ", ".join(f"('{c}', '{p}')" for c, p, _ in CATEGORIES)
_VARIANTS = "CASE WHEN len({w}) <= 3 THEN [{w}] WHEN {w} LIKE '%ies' THEN [{w}, left({w}, len({w}) - 3) || 'y'] WHEN {w} LIKE '%es' AND {w} NOT LIKE '%oes' THEN [{w}, left({w}, len({w}) - 2), left({w}, len({w}) - 1)] WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN [{w}, left({w}, len({w}) - 1)] ELSE [{w}, {w} || 's', {w} || 'es'] END"
_INDEX = f"""cat(category, parent) AS (VALUES {_CATS}), spelled AS (SELECT category, unnest([category, replace(category, '-', ' '), replace(category, '-', '')]) AS word FROM cat),
idx AS (SELECT unnest({_VARIANTS.format(w='word')}) AS token, category FROM spelled UNION SELECT parent, category FROM cat UNION SELECT unnest({_VARIANTS.format(w='parent')}), parent FROM cat)"""


def words_of(spark, folder):
    """Words of the catalog, singular and plural."""
    noun, color = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    return M.read(spark, folder, "part").select(F.explode(F.array(noun, F.concat(noun, F.lit("s")), color)).alias("word")).distinct()


_WORDS = f"words AS (SELECT DISTINCT unnest([{_NOUN}, {_NOUN} || 's', split_part(p_name, ' ', 1)]) AS word FROM part)"


@query("j3_c11_token_lookup", f"WITH {_INDEX}, {_WORDS} SELECT DISTINCT word, category FROM words JOIN idx ON token = word UNION SELECT word, category FROM (SELECT word, unnest({_VARIANTS.format(w='word')}) AS v FROM words WHERE word NOT IN (SELECT token FROM idx)) JOIN idx ON token = v")
def j3(spark, folder):
    return J.lookup_tokens(words_of(spark, folder), J.token_index(spark))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_SPELLED = "[word] || CASE WHEN len(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN [left(word, len(word) - 1)] ELSE [] END || CASE WHEN len(word) > 4 AND word LIKE '%es' THEN [left(word, len(word) - 2)] ELSE [] END"


@query("j4_category_aliases", f"""WITH RECURSIVE {_WORDS}, al(token, canonical) AS (VALUES {_values(J.ALIASES)}), nn(canonical, noun) AS (VALUES {_values(J.NOUNS)}),
 known AS (SELECT token FROM al UNION SELECT canonical FROM nn),
 tried AS (SELECT word, unnest(spelled) AS token, generate_subscripts(spelled, 1) AS place FROM (SELECT word, {_SPELLED} AS spelled FROM words)),
 start AS (SELECT word, arg_min(token, place) AS token FROM tried WHERE token IN (SELECT token FROM known) GROUP BY 1),
 walk AS (SELECT word, token, 0 AS steps FROM start UNION ALL SELECT word, al.canonical, steps + 1 FROM walk JOIN al USING (token) WHERE walk.token NOT IN (SELECT canonical FROM nn) AND steps < 20)
 SELECT word, canonical, noun FROM walk JOIN nn ON canonical = token""")
def j4(spark, folder):
    return J.resolve_aliases(words_of(spark, folder))


_PAIRS = _values([p for t in (J.TRANSLATIONS, J.SYNONYMS) for a, b in t for p in ((a, b), (b, a))])
_SINGULAR = "list_distinct([word] || CASE WHEN len(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN [left(word, len(word) - 1)] ELSE [] END || CASE WHEN len(word) > 4 AND word LIKE '%es' THEN [left(word, len(word) - 2)] ELSE [] END)"


@query("j5_term_expansion", f"WITH {_WORDS}, b AS (SELECT word, unnest({_SINGULAR}) AS base FROM words), pr(base, term) AS (VALUES {_PAIRS}) SELECT word, base AS term FROM b UNION SELECT word, term FROM b JOIN pr USING (base)")
def j5(spark, folder):
    return J.expand_terms(words_of(spark, folder))


_ALL = "lower(title || '|' || coalesce(ai_tags, '') || '|' || subniche || '|' || product_type)"
_PLATE = "(product_category = 'plate' OR regexp_matches(title || ' | ' || handle || ' | ' || product_type, '\\b(plate|dish|plates|assiette|teller|home)\\b', 'i') OR regexp_matches(lower(coalesce(ai_tags, '') || '|' || subniche), 'plate|dish|assiette|teller|home'))"


@query("j6_category_word", f"SELECT id, title FROM products WHERE {_PLATE}")
def j6(spark, folder):
    p = M.products(spark, folder)
    return p.where(J.word_condition(p, "plates")).select("id", "title")


@query("j6_plain_word", f"SELECT id, title FROM products WHERE {_ALL} LIKE '%widget%' OR {_ALL} LIKE '%dings%'")
def j6p(spark, folder):
    p = M.products(spark, folder)
    return p.where(J.word_condition(p, "widget")).select("id", "title")


@query("j7_strict_words", f"SELECT id FROM products WHERE {_PLATE} AND {_ALL} LIKE '%blue%'")
def j7s(spark, folder):
    p = M.products(spark, folder)
    return p.where(J.strict_match(p, "plates blue")).select("id")


@query("j7_loose_words", f"SELECT id FROM products WHERE {_ALL} LIKE '%widget%' OR {_ALL} LIKE '%dings%' OR {_ALL} LIKE '%blue%'")
def j7l(spark, folder):
    p = M.products(spark, folder)
    return p.where(J.loose_match(p, "widget blue")).select("id")


@query("j7_cascade", f"SELECT id FROM products WHERE {_PLATE} AND {_ALL} LIKE '%men%'")
def j7c(spark, folder):
    return J.cascade(M.products(spark, folder), "plates men").select("id")


_STRATEGIES = {"tag": "lower(coalesce(ai_tags, '')) LIKE '%plates%' AND lower(coalesce(ai_tags, '')) LIKE '%blue%'", "strict": f"{_PLATE} AND {_ALL} LIKE '%blue%'", "loose": f"({_PLATE} OR {_ALL} LIKE '%blue%')"}


@query("d14_strategy_counts", " UNION ALL ".join(f"SELECT '{name}' AS strategy, (SELECT count(*) FROM products WHERE {hit}) AS matches, (SELECT coalesce(list(id ORDER BY id), CAST([] AS BIGINT[])) FROM (SELECT id FROM products WHERE {hit} ORDER BY id LIMIT 5)) AS sample" for name, hit in _STRATEGIES.items()))
def d14(spark, folder):
    return J.strategy_counts(M.products(spark, folder), "plates blue")


def query_set(spark, folder):
    """The titles of every fiftieth product are the queries."""
    return M.products(spark, folder).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("Hot "), "title").alias("text"))


_I, _V = _values(J.INTENTS), _values([(t,) for _, t in J.VOCABULARY])
_Q = f"""q AS (SELECT id AS query_id, 'Hot ' || title AS text FROM products WHERE id % 50 = 0),
qt AS (SELECT query_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM q),
it(type, keyword) AS (VALUES {_I}), voc(tag) AS (VALUES {_V}),
hit AS (SELECT DISTINCT query_id, type FROM (SELECT query_id, unnest({_SINGULAR}) AS keyword FROM qt) JOIN it USING (keyword)),
qx AS (SELECT query_id, text, (SELECT list_sort(list(word)) FROM qt WHERE qt.query_id = q.query_id) AS tokens,
  coalesce((SELECT list_sort(list_distinct(list(keyword))) FROM hit JOIN it USING (type) WHERE hit.query_id = q.query_id), CAST([] AS VARCHAR[])) AS keywords,
  coalesce((SELECT list_sort(list(type)) FROM hit WHERE hit.query_id = q.query_id), CAST([] AS VARCHAR[])) AS intents,
  coalesce((SELECT list_sort(list(word)) FROM qt JOIN voc ON tag = word WHERE qt.query_id = q.query_id), CAST([] AS VARCHAR[])) AS tags FROM q),
qe AS (SELECT *, list_sort(list_distinct(tokens || keywords)) AS terms, list_sort(CASE WHEN len(list_filter(list_distinct(keywords || tags), lambda x: x NOT IN ('hot', 'new'))) > 0 THEN list_filter(list_distinct(keywords || tags), lambda x: x NOT IN ('hot', 'new')) ELSE tokens END) AS strong FROM qx)"""


@query("j8_query_expansion", f"WITH {_Q} SELECT query_id, tokens, intents, terms, tags, strong FROM qe")
def j8(spark, folder):
    return J.expand_queries(query_set(spark, folder)).select("query_id", "tokens", "intents", "terms", "tags", "strong")


@query("j8b_normalised_lists", "SELECT id, list_filter([split_part(title, ' ', 1)], lambda x: x IN ('red', 'blue', 'green')) AS colors FROM products")
def j8b(spark, folder):
    color = F.split_part("title", F.lit(" "), F.lit(1))
    raw = F.array(F.concat(F.lit(" "), F.upper(color)), color, F.lit("green"))
    return M.products(spark, folder).select("id", J.normalise_list(raw, F.array(F.lit("red"), F.lit("blue"), F.lit("green")), 2).alias("colors"))


def _tok(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


_IMG = "(CASE WHEN len(t) < 3 THEN 0 ELSE CASE WHEN contains(tg, 'img:type:' || t) THEN 10 WHEN contains(tg, 'img:' || t) THEN 6 ELSE 0 END + CASE WHEN contains(tg, 'img:color:' || t) THEN 3 ELSE 0 END END)"
_KW = f"""sc AS (SELECT query_id, id, current_position, qtext, title, ai_tags, tg, strong, intents, keywords, ti, kt, CASE WHEN contains(lower(title), lower(qtext)) THEN 15 ELSE 0 END
 + CAST(coalesce(list_sum(list_transform(qtags, lambda t: CASE WHEN list_contains(kt, t) THEN 4 ELSE 0 END + CASE WHEN list_contains(ti, t) THEN 2 ELSE 0 END)), 0) AS INT)
 + CAST(coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN len(t) < 3 THEN 0 ELSE CASE WHEN list_contains(ti, t) THEN 3 ELSE 0 END + CASE WHEN list_contains(kt, t) THEN 2 ELSE 0 END + CASE WHEN list_contains(ca, t) THEN 1 ELSE 0 END + CASE WHEN list_contains(su, t) THEN 1 ELSE 0 END + CASE WHEN list_contains(ty, t) THEN 1 ELSE 0 END + CASE WHEN list_contains(ha, t) THEN 1 ELSE 0 END END)), 0) AS INT)
 + CASE WHEN contains(tg, 'img:') THEN CAST(coalesce(list_sum(list_transform(terms || qtags, lambda t: {_IMG})), 0) AS INT) - CASE WHEN list_contains(terms, 'ring') AND contains(tg, 'img:type:rod') THEN 8 ELSE 0 END - CASE WHEN list_contains(terms, 'plate') AND contains(tg, 'img:type:widget') THEN 8 ELSE 0 END ELSE 0 END AS kw
 FROM (SELECT q.query_id, q.text AS qtext, q.terms, q.tags AS qtags, q.strong, q.intents, q.keywords, p.id, p.current_position, p.title, p.ai_tags, lower(coalesce(ai_tags, '')) AS tg, {_tok('title')} AS ti, {_tok('ai_tags')} AS kt, {_tok('product_category')} AS ca, {_tok('subniche')} AS su, {_tok('product_type')} AS ty, {_tok('handle')} AS ha FROM products p, qe q))"""


@query("j10_c12_lexical_scores", f"WITH {_Q}, {_KW} SELECT query_id, id, kw FROM sc")
def j10(spark, folder):
    return J.score_products(M.saved(M.products(spark, folder)), M.saved(J.expand_queries(query_set(spark, folder))))


@query("j10_best_scores", f"WITH {_Q}, {_KW} SELECT query_id, id, kw, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, id) AS rank FROM sc WHERE kw > 0 QUALIFY rank <= 20")
def j10b(spark, folder):
    return J.best_scores(M.saved(M.products(spark, folder)), M.saved(J.expand_queries(query_set(spark, folder))))


_GRAMS = "t AS (SELECT DISTINCT unnest(string_split(title, ' ')) || CASE WHEN id % 3 = 0 THEN '' ELSE ' ' || left(split_part(title, ' ', 2), 2) END AS term FROM products UNION SELECT 'o' UNION SELECT 'zq')"


@query("j6_rows_with_terms", f"WITH {_GRAMS} SELECT id, term FROM products, t WHERE contains(lower(title || ' ' || coalesce(ai_tags, '')), term)")
def j6t(spark, folder):
    """Every word of every title, some with the beginning of another, sought in titles and tags."""
    p = M.saved(M.products(spark, folder))
    words = p.select("id", "title", F.explode(F.split("title", " ")).alias("w"))
    more = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.left(F.split_part("title", F.lit(" "), F.lit(2)), F.lit(2))))
    terms = words.select(F.concat("w", more).alias("term")).unionByName(spark.createDataFrame([("o",), ("zq",)], "term string"))
    return J.rows_with_terms(p, terms, F.concat_ws(" ", "title", X.text_or_empty(F.col("ai_tags"))))


@query("j12_intent_gate", f"WITH {_Q} SELECT query_id, id FROM products p, qe q WHERE list_has_any({_tok('title')} || {_tok('ai_tags')}, keywords)")
def j12(spark, folder):
    return J.intent_gate(M.saved(J.expand_queries(query_set(spark, folder))), M.saved(M.products(spark, folder).select("id", "title", "ai_tags")))


_HYBRID = f"""{_Q}, {_KW}, near AS (SELECT * FROM (SELECT q.query_id, e.id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.id) AS rn FROM q JOIN products v ON v.id = q.query_id, products e WHERE v.embedding IS NOT NULL AND e.embedding IS NOT NULL) WHERE rn <= 200),
named AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM sc WHERE len(list_filter(strong, lambda t: contains(lower(title || ' ' || coalesce(ai_tags, '')), t))) > 0) WHERE rn <= 200),
cand AS (SELECT query_id, id FROM near UNION SELECT query_id, id FROM named),
fin AS (SELECT c.query_id, c.id, CASE WHEN sim IS NOT NULL THEN round(100.0 * sim, 4) ELSE least(59.0, CAST(kw AS DOUBLE)) END AS score, CASE WHEN coalesce(current_position, 0) = 0 THEN 999999 ELSE current_position END AS place, len(intents) = 0 OR list_has_any(ti || kt, keywords) AS gated
 FROM cand c JOIN sc USING (query_id, id) LEFT JOIN near n ON n.query_id = c.query_id AND n.id = c.id WHERE NOT ((qtext LIKE '%for women' AND title LIKE '%for men') OR (qtext LIKE '%for men' AND title LIKE '%for women'))),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, id) AS rank FROM fin)"""


def search_tables(spark, folder):
    """Products, their unit vectors, and the queries with theirs; the catalog is derived once."""
    p = M.saved(M.products(spark, folder, True))
    index = p.where("embedding IS NOT NULL").select("id", V.normalised(F.col("embedding")).alias("unit"))
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("Hot "), "title").alias("text"))
    vectors = index.join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), "unit")
    return p.drop("embedding"), index, M.saved(J.expand_queries(asked)), vectors


@query("j9_g1_f3_hybrid_search", f"WITH {_HYBRID} SELECT query_id, id, score, rank FROM ranked WHERE rank <= 20")
def j9(spark, folder):
    return J.hybrid_search(*search_tables(spark, folder))


@query("j11_judged_search", f"WITH {_HYBRID} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, (rank - 1) // 25 AS batch FROM ranked WHERE rank <= 150) WHERE batch = 1 OR id % 3 <> 0 AND NOT (batch = 0 AND rank = 25) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 20")
def j11(spark, folder):
    def judge(rows: list[dict]) -> list:
        if rows[0]["rank"] == 26:
            raise ValueError("a failing batch")
        found = [{"match": r["id"] % 3 != 0} if r["rank"] % 2 else {"score": 70 if r["id"] % 3 else 69, "drop": False} for r in rows]
        return found[:-1] if rows[0]["rank"] == 1 and len(rows) == 25 else found

    tables_ = search_tables(spark, folder)
    return J.judged_search(J.hybrid_search(*tables_, limit=150), tables_[0], judge)


@query("j13_search_explain", f"WITH {_HYBRID} SELECT query_id, (SELECT count(*) FROM cand c WHERE c.query_id = q.query_id) AS candidates, (SELECT count(*) FROM near n WHERE n.query_id = q.query_id) AS by_vector, (SELECT count(*) FROM fin f WHERE f.query_id = q.query_id) AS kept, (SELECT count(*) FROM fin f WHERE f.query_id = q.query_id AND gated) AS gated, (SELECT coalesce(list(id ORDER BY rank), CAST([] AS BIGINT[])) FROM ranked r WHERE r.query_id = q.query_id AND rank <= 15) AS best FROM q")
def j13(spark, folder):
    return J.explain_search(*search_tables(spark, folder))


@query("f5_i1_searched_feed", f"SELECT p.id, label FROM labels_now p WHERE is_fashion AND regexp_matches(title, '\\bring\\b') ORDER BY current_position, id LIMIT 25")
def f5(spark, folder):
    stores, products, history, events = run_tables(spark, folder)
    hits = products.where(X.whole_word(F.col("title"), "ring")).select("id")
    return D.feed(stores, products, history, events, is_fashion=True, label=None, sort="high-low", limit=25, matching=hits, **FLOORS).select("id", "label")
