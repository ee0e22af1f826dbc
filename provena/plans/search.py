"""Search, ranking and text primitives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.functions import text as T
from provena.operators import dedup, index, search
from provena.plans.adapters import ACL_SQL, PASSAGES_SQL, acl, passages, table
from provena.plans.registry import query
from provena.session import shared_folder
from provena.sources import units

W3, W2, W1 = (r"[\p{L}\p{N}_×÷]{%d,}" % n for n in (3, 2, 1))
STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)
RSTOP = ", ".join(f"'{w}'" for w in T.RERANK_STOPWORDS)
STEM = "CASE WHEN length(w) > 4 AND right(w, 1) IN ('a', 'e') THEN left(w, length(w) - 1) ELSE w END"


def tokens_sql(text: str) -> str:
    long = f"list_transform(list_filter(regexp_extract_all(lower({text}), '{W3}'), lambda w: w NOT IN ({STOP})), lambda w: {STEM})"
    short = f"list_filter(regexp_extract_all(lower({text}), '{W2}'), lambda w: w NOT IN ({STOP}))"
    return f"CASE WHEN len({long}) > 0 THEN {long} ELSE {short} END"


ONE = "hand reon thing heed tionher ering the onthan"


def search_sql(asked: str, source: str = PASSAGES_SQL, limit: int = 20, more: str = "") -> str:
    """CTEs up to ``ranked`` (query_id, library, chunk, score, rank) for queries (query_id, library, query); ``more`` adds candidates (query_id, chunk)."""
    return f"""p AS (SELECT *, lower(filename || ' ' || text) AS hay, list_distinct(regexp_extract_all(lower(filename || ' ' || text), '{W3}')) AS words FROM ({source})),
asked AS (SELECT *, lower(trim(query)) AS phrase, {tokens_sql('query')} AS tokens FROM ({asked})),
opened AS (SELECT query_id, library, unnest(list_distinct(tokens)) AS token FROM asked),
cand AS (SELECT DISTINCT query_id, chunk FROM opened JOIN p USING (library) WHERE length(token) >= 3 AND len(list_filter(words, lambda w: starts_with(w, token))) > 0 {more}),
loaded AS (SELECT c.query_id, p.*, a.phrase, a.tokens FROM cand c JOIN p USING (chunk) JOIN asked a USING (query_id)),
df AS (SELECT query_id, token, count(*) AS n, count(*) FILTER (contains(hay, token)) AS df FROM (SELECT query_id, hay, unnest(list_distinct(tokens)) AS token FROM loaded) GROUP BY ALL),
w AS (SELECT query_id, token, CASE WHEN df <= 0 THEN 0.0 WHEN n <= 1 THEN 1.0 ELSE ln(1 + n / df) / ln(1 + n) END AS weight FROM df),
lex AS (SELECT o.query_id, o.chunk, sum(CASE WHEN contains(hay, o.token) THEN weight ELSE 0 END) AS lexical FROM (SELECT query_id, chunk, hay, unnest(tokens) AS token FROM loaded) o JOIN w USING (query_id, token) GROUP BY ALL),
scored AS (SELECT l.query_id, l.library, l.chunk, l.filename, l.text, 100 * CAST(contains(hay, phrase) AS INT) + 10 * lexical AS score FROM loaded l JOIN lex USING (query_id, chunk) WHERE contains(hay, phrase) OR lexical > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk) AS INT) AS rank FROM scored QUALIFY rank <= {limit})"""


def _one(spark, library="src3"):
    return spark.createDataFrame([(1, library, ONE)], "query_id int, library string, query string")


ONE_SQL = f"SELECT 1 AS query_id, 'src3' AS library, '{ONE}' AS query"


@query("search_topk", f"WITH {search_sql(ONE_SQL)} SELECT query_id, chunk, round(score, 6) AS score, rank FROM ranked")
def search_topk(spark, sf_dir):
    found = search.search(passages(spark, sf_dir), _one(spark))
    return found.select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


BATCH_SQL = "SELECT item_id AS query_id, 'src' || (item_id % 20) AS library, text AS query FROM benchmark"


def batch(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("library"), F.col("text").alias("query"))


@query("search_batch_queries", f"WITH {search_sql(BATCH_SQL, limit=5)} SELECT query_id, chunk, round(score, 6) AS score, rank FROM ranked")
def search_batch_queries(spark, sf_dir):
    found = search.search(passages(spark, sf_dir), batch(spark, sf_dir), 5)
    return found.select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


@query("index_build", f"""WITH p AS (SELECT library, chunk, unnest(list_distinct(regexp_extract_all(lower(filename || ' ' || text), '{W3}'))) AS word FROM ({PASSAGES_SQL}))
SELECT library, count(*) AS postings, count(DISTINCT word) AS words, count(DISTINCT chunk) AS passages FROM p GROUP BY library""")
def index_build(spark, sf_dir):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(passages(spark, sf_dir), folder)
    return index.Index(spark, folder).counts()


_built: dict[str, str] = {}


def stored(spark, sf_dir) -> str:
    """The folder of an index of the documents table, built once an application for each state of the table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    times = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = repr([spark.sparkContext.applicationId, sf_dir, found.getLength(), [(s.getPath().getName(), s.getModificationTime()) for s in times]])
    if key not in _built:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        index.build(passages(spark, sf_dir), folder)
        _built[key] = folder
    return _built[key]


@query("search_indexed", f"WITH {search_sql(BATCH_SQL, limit=5)} SELECT query_id, chunk, round(score, 6) AS score, rank FROM ranked")
def search_indexed(spark, sf_dir):
    """search_batch_queries over a stored index, which the first call of an application over a table builds."""
    return index.lookup(spark, stored(spark, sf_dir), batch(spark, sf_dir), 5).select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


BM25_SQL = f"""bp AS (SELECT library, chunk, regexp_extract_all(lower(filename || ' ' || text), '{W1}') AS w FROM ({PASSAGES_SQL})),
size AS (SELECT library, count(*) AS n, avg(len(w)) AS mean FROM bp GROUP BY library),
btf AS (SELECT query_id, library, chunk, len(w) AS length, token, len(list_filter(w, lambda x: starts_with(x, token))) AS tf FROM bp JOIN (SELECT query_id, library, unnest(list_distinct({tokens_sql('query')})) AS token FROM ({BATCH_SQL})) USING (library) WHERE length(token) >= 3),
bdf AS (SELECT query_id, token, count(*) AS df FROM btf WHERE tf > 0 GROUP BY ALL),
scores AS (SELECT query_id, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS bm25
  FROM btf JOIN bdf USING (query_id, token) JOIN size USING (library) WHERE tf > 0 GROUP BY ALL),
best AS (SELECT query_id, chunk FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk) <= 10)"""


@query("search_capped", f"WITH {BM25_SQL}, {search_sql(BATCH_SQL, limit=5, more='INTERSECT SELECT query_id, chunk FROM best')} SELECT query_id, chunk, round(score, 6) AS score, rank FROM ranked")
def search_capped(spark, sf_dir):
    """search_indexed, over the ten best full-text candidates of each question."""
    return index.lookup(spark, stored(spark, sf_dir), batch(spark, sf_dir), 5, cap=10).select("query_id", "chunk", F.round("score", 6).alias("score"), "rank")


@query("search_chunks")
def search_chunks(spark, sf_dir):
    """Files to units to chunks to search: each document a text file, its chunks the passages."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").cast("binary").alias("content"))
    parts = units.chunked(units.units(d).where("error IS NULL"), ["path", "ordinal"])
    p = parts.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("library"), F.split_part("path", F.lit("/"), F.lit(2)).alias("filename"), F.col("path").alias("document"), "text", F.col("ordinal"), F.concat_ws("#", "path", F.col("ordinal").cast("string"), F.col("chunk").cast("string")).alias("chunk"))
    return search.search(p, batch(spark, sf_dir), 5).select("query_id", "document", "chunk", F.round("score", 6).alias("score"), "rank")


@query("search_idf_weights", f"WITH {search_sql(BATCH_SQL)} SELECT query_id, token, df, round(weight, 6) AS weight FROM w JOIN df USING (query_id, token)")
def search_idf_weights(spark, sf_dir):
    asked = search.prepared(batch(spark, sf_dir))
    p = passages(spark, sf_dir)
    return search.document_frequency(search.scanned(p, asked), asked).select("query_id", "token", "df", F.round("weight", 6).alias("weight"))


@query("search_visible_only", f"""WITH acl AS ({ACL_SQL}), hidden AS (SELECT document FROM acl GROUP BY document HAVING count(*) FILTER (username = 'u1') = 0),
{search_sql(ONE_SQL, f"SELECT * FROM ({PASSAGES_SQL}) WHERE chunk NOT IN (SELECT document FROM hidden)", 10)} SELECT chunk, round(score, 6) AS score, rank FROM ranked""")
def search_visible_only(spark, sf_dir):
    seen = search.visible(passages(spark, sf_dir), acl(spark, sf_dir), "u1")
    return search.search(seen, _one(spark), 10).select("chunk", F.round("score", 6).alias("score"), "rank")


LIBS = "('src0'), ('src1'), ('src2'), ('src3')"


@query("search_federated", f"""WITH {search_sql(f"SELECT '1|' || l AS query_id, l AS library, '{ONE}' AS query FROM (VALUES {LIBS}) v(l)", limit=8)}
SELECT library, chunk, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, library, rank) AS INT) AS rank FROM ranked QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, library, rank) <= 8""")
def search_federated(spark, sf_dir):
    libraries = spark.createDataFrame([(f"src{i}",) for i in range(4)], "library string")
    found = search.federated(passages(spark, sf_dir), _one(spark).drop("library"), libraries, 8)
    return found.select("library", "chunk", F.round("score", 6).alias("score"), "rank")


PHRASE = "all rights reserved"


@query("search_phrase", f"SELECT source AS library, count(*) AS n FROM documents WHERE contains(lower(text), '{PHRASE}') GROUP BY ALL")
def search_phrase(spark, sf_dir):
    return passages(spark, sf_dir).where(F.contains(F.lower("text"), F.lit(PHRASE))).groupBy("library").agg(F.count("*").alias("n"))


@query("search_candidate_cap", f"""WITH p AS (SELECT library, chunk, regexp_extract_all(lower(filename || ' ' || text), '{W1}') AS w FROM ({PASSAGES_SQL})),
size AS (SELECT library, count(*) AS n, avg(len(w)) AS mean FROM p GROUP BY library),
asked AS (SELECT query_id, library, unnest(list_distinct({tokens_sql('query')})) AS token FROM ({BATCH_SQL})),
tf AS (SELECT query_id, library, chunk, len(w) AS length, token, len(list_filter(w, lambda x: starts_with(x, token))) AS tf FROM p JOIN asked USING (library) WHERE length(token) >= 3),
hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT query_id, token, count(*) AS df FROM hit GROUP BY ALL),
s AS (SELECT query_id, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS bm25 FROM hit JOIN df USING (query_id, token) JOIN size USING (library) GROUP BY ALL)
SELECT query_id, chunk, round(bm25, 5) AS bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk) <= 10""")
def search_candidate_cap(spark, sf_dir):
    return search.bm25(passages(spark, sf_dir), batch(spark, sf_dir), 10).select("query_id", "chunk", F.round("bm25", 5).alias("bm25"))


@query("search_reranked")
def search_reranked(spark, sf_dir):
    asked = batch(spark, sf_dir)
    found = search.search(passages(spark, sf_dir), asked, 20).join(asked.select("query_id", "query"), "query_id")
    return search.rerank(found, "query", 5).select("query_id", "chunk", "rerank", "place")


SYNONYMS = {"the": ["of them", "thing"], "ing": ["inging"], "nicht": ["kein"], "de": ["del", "des"]}


def expanded_sql(query: str) -> str:
    """The wording with synonyms, or null."""
    bounded = lambda t: f"regexp_matches(lower(trim({query})), '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])')"
    offered = " || ".join(f"CASE WHEN {bounded(t)} THEN {SYNONYMS[t]} ELSE [] END" for t in sorted(SYNONYMS, key=lambda t: -len(t)))
    added = f"list_filter({offered}, lambda s: NOT contains(lower(trim({query})), s))[1:3]"
    return f"CASE WHEN len({added}) > 0 THEN trim({query}) || ' ' || array_to_string({added}, ' ') END"


WORDINGS_SQL = f"""SELECT query_id || '|' || variant AS query_id, library, query, query_id AS own, variant FROM (SELECT query_id, library, trim(query) AS query, 0 AS variant FROM ({BATCH_SQL})
UNION ALL SELECT query_id, library, {expanded_sql('query')}, 1 FROM ({BATCH_SQL})) WHERE query IS NOT NULL"""
OTHERS_SQL = f"""SELECT query_id, library, unnest(list_distinct({tokens_sql('other')})) AS token FROM (SELECT query_id, library, {expanded_sql('query')} AS other FROM ({WORDINGS_SQL})) WHERE other IS NOT NULL"""


@query("search_expanded", f"""WITH {search_sql(WORDINGS_SQL, limit=3, more=f"UNION SELECT query_id, chunk FROM ({OTHERS_SQL}) JOIN p USING (library) WHERE length(token) >= 3 AND len(list_filter(words, lambda w: starts_with(w, token))) > 0")}
SELECT own AS query_id, CAST(variant AS INT) AS variant, chunk, round(score, 6) AS score, rank FROM ranked JOIN ({WORDINGS_SQL}) v USING (query_id) QUALIFY variant = min(variant) OVER (PARTITION BY own)""")
def search_expanded(spark, sf_dir):
    """Each question's first wording that finds anything; the candidates of a wording are joined by those of its synonyms."""
    asked = search.expand(batch(spark, sf_dir), SYNONYMS)
    opened = asked.select("query_id", "library", F.posexplode("variants").alias("variant", "query"))
    each = opened.withColumn("own", F.col("query_id")).withColumn("query_id", F.concat_ws("|", F.col("own").cast("string"), F.col("variant").cast("string")))
    wordings = each.select("query_id", "library", "query")
    found = search.search(passages(spark, sf_dir), wordings, 3, expansions=search.expansions(wordings, SYNONYMS)).join(each.select("query_id", "own", "variant"), "query_id")
    return search.first_answering(found.withColumn("query_id", F.col("own")).select("query_id", "variant", "chunk", F.round("score", 6).alias("score"), "rank"))


@query("tokenize_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{W3}')) AS INT) AS n, CAST(len(list_distinct(regexp_extract_all(lower(text), '{W3}'))) AS INT) AS distinct_n FROM documents")
def tokenize_counts(spark, sf_dir):
    w = T.words(F.col("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct_n"))


@query("stem_counts", f"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{W3}')) AS w FROM documents) SELECT {STEM} AS stem, count(*) AS n FROM w GROUP BY ALL")
def stem_counts(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"), 3)).alias("w"))
    return w.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@query("stopword_filter", f"SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM benchmark")
def stopword_filter(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_×÷\s\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))"


@query("fingerprint", f"SELECT doc_id, sha256({NORM}) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


SHINGLES = "list_distinct(w || list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))"
WORDS_CTE = f"w AS (SELECT doc_id, source, {NORM} AS n, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS w FROM documents)"


@query("shingle_counts", f"WITH {WORDS_CTE} SELECT doc_id, CAST(len({SHINGLES}) AS INT) AS n FROM w")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).alias("n"))


@query("dedup_exact", f"SELECT source AS library, sha256({NORM}) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def dedup_exact(spark, sf_dir):
    return dedup.exact(passages(spark, sf_dir))


@query("dedup_near_jaccard", f"""WITH {WORDS_CTE}, r AS (SELECT source AS library, min(doc_id) AS doc, any_value({SHINGLES}) AS s FROM w WHERE len(w) > 0 GROUP BY source, n),
o AS (SELECT library, doc, len(s) AS n, unnest(s) AS t FROM r),
c AS (SELECT a.library, a.doc AS a, b.doc AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM o a JOIN o b ON a.library = b.library AND a.t = b.t AND a.doc < b.doc AND b.n >= 0.85 * a.n AND a.n >= 0.85 * b.n GROUP BY ALL)
SELECT library, a, b, round(k / (na + nb - k), 6) AS jaccard FROM c WHERE k / (na + nb - k) >= 0.85""")
def dedup_near_jaccard(spark, sf_dir):
    return dedup.near(passages(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


@query("vector_cosine_topk", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) DESC, vec_id) <= 10""")
def vector_cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.cosine_top(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10).select("query_id", "vec_id", "cosine")


CLOSE_SQL = """close AS (SELECT r.vec_id AS chunk, round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings r, embeddings q WHERE q.vec_id = 0 AND r.vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3'))"""


@query("hybrid_score", f"""WITH {CLOSE_SQL}, {search_sql(ONE_SQL, more="UNION SELECT 1, chunk FROM close JOIN p USING (chunk) WHERE cosine >= 0.35 AND library = 'src3'")},
s AS (SELECT l.chunk, 100 * CAST(contains(hay, phrase) AS INT) + 10 * lexical + 40 * greatest(0, coalesce(cosine, 0)) AS score
  FROM loaded l JOIN lex USING (query_id, chunk) LEFT JOIN close ON close.chunk = l.chunk WHERE contains(hay, phrase) OR lexical > 0 OR cosine >= 0.35)
SELECT chunk, round(score, 4) AS score FROM s QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, chunk) <= 20""")
def hybrid_score(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = _one(spark).join(v.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("q")), "query_id")
    near = search.library_cosines(passages(spark, sf_dir), v.withColumnRenamed("vec_id", "chunk"), asked)
    found = search.search(passages(spark, sf_dir), _one(spark), 20, near)
    return found.select("chunk", F.round("score", 4).alias("score"))


SHORT_SQL = "SELECT item_id AS query_id, 'src' || (item_id % 20) AS library, CASE item_id % 3 WHEN 0 THEN 'of the' WHEN 1 THEN 'is' ELSE 'to be' END AS query FROM benchmark"


@query("search_stopwords", f"""WITH a AS (SELECT query_id, library, lower(query) AS phrase FROM ({SHORT_SQL})), p AS (SELECT *, lower(filename || ' ' || text) AS hay FROM ({PASSAGES_SQL}))
SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk) AS INT) AS rank FROM a JOIN p USING (library) WHERE contains(hay, phrase) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk) <= 5""")
def search_stopwords(spark, sf_dir):
    """Questions of stopwords alone, or of one short word beside them, find the passages that spell them."""
    text = F.when(F.col("query_id") % 3 == 0, "of the").when(F.col("query_id") % 3 == 1, "is").otherwise("to be")
    asked = batch(spark, sf_dir).withColumn("query", text)
    return search.search(passages(spark, sf_dir), asked, 5).select("query_id", "chunk", "rank")


@query("cache_keys", r"SELECT item_id, left(sha256('lib:u1:' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 32) AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.cache_key(F.lit("lib"), F.lit("u1"), F.col("text")).alias("key"))


@query("top_terms_by_language", f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{W3}')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, w, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 10""")
def top_terms_by_language(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.col("text"), 3)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where("rank <= 10")
