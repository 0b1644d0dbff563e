"""Retrieval queries: cleaning, chunking, keyword and vector search, fusion, context, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.functions.vectors import cosine, dot, l2
from loamstone.operators import chunking, lexical, ranking, vectors
from loamstone.plans import retrieval as plans
from loamstone.sources.tables import broadcast_if_small, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Cleaning.
_SPACE = r"'[ \t\n\r\f\v]+', ' ', 'g'"
_HTML = "html"
for _tag in ("script", "style", "nav", "footer"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def _unescaped(sql: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{plain}')"
    return sql


@query("html_to_text", f"SELECT page_id, trim(regexp_replace({_unescaped(_HTML)}, {_SPACE})) AS text FROM pages")
def html_to_text(spark, d):
    return load(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("html_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def html_title(spark, d):
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("h1"))


@query("html_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links(spark, d):
    links = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)<a\\b[^>]*?href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("html_unescape", f"SELECT page_id, {_unescaped('html')} AS html FROM pages")
def html_unescape(spark, d):
    return load(spark, d, "pages").select("page_id", T.unescape(F.col("html")).alias("html"))


@query("html_unescape_all", """SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS html FROM pages""")
def html_unescape_all(spark, d):
    """All character references of HTML; those that the pages hold are spelled out in the SQL."""
    return load(spark, d, "pages").select("page_id", T.unescape_all("html").alias("html"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(spark, d):
    """Parts by pattern rather than parse_url, which raises on malformed addresses."""
    at = lambda p: F.regexp_extract("url", p, 1)
    return load(spark, d, "pages").select("page_id", at(r"^([^:/?#]+)://").alias("scheme"), at(r"^[^:/?#]+://([^/?#:]*)").alias("host"), at(r"^[^:/?#]+://[^/?#]*([^?#]*)").alias("path"), F.nullif(at(r"\?([^#]*)"), F.lit("")).alias("query"))


@query("url_canonical", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:utm_[^=&]*|gclid|fbclid)=[^&]*', '\1', 'g') AS u FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', '') AS u FROM a)
SELECT page_id, lower(regexp_extract(u, '^[^:/?#]+://[^/?#]*')) || substr(u, length(regexp_extract(u, '^[^:/?#]+://[^/?#]*')) + 1) AS url FROM b""")
def url_canonical(spark, d):
    return load(spark, d, "pages").select("page_id", T.url_canonical("url").alias("url"))


@query("normalize_ws", f"SELECT doc_id, trim(regexp_replace(lower(text), {_SPACE})) AS text FROM documents")
def normalize_ws(spark, d):
    return load(spark, d, "documents").select("doc_id", T.normalize_ws("text").alias("text"))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("tokenize", f"SELECT doc_id, {_TOK} AS words FROM documents")
def tokenize(spark, d):
    return load(spark, d, "documents").select("doc_id", T.tokenize("text").alias("words"))


@query("lang_filter", "SELECT doc_id, source FROM documents WHERE lang = 'fr' AND n_chars > 200")
def lang_filter(spark, d):
    return load(spark, d, "documents").where("lang = 'fr' and n_chars > 200").select("doc_id", "source")


@query("quality_join", "SELECT d.doc_id, d.lang, q.quality, q.toxic FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id WHERE coalesce(q.quality, 1) = 1 AND coalesce(q.toxic, 0) = 0")
def quality_join(spark, d):
    q = load(spark, d, "labels")
    return load(spark, d, "documents").select("doc_id", "lang").join(q, "doc_id", "left").where("coalesce(quality, 1) = 1 and coalesce(toxic, 0) = 0")


# Chunks.
@query("chunk_chars", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 400 AS INTEGER) AS start, CAST(least(i * 400 + 500, length(text)) AS INTEGER) AS "end", substring(text, i * 400 + 1, 500) AS chunk_text
FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_chars(spark, d):
    return chunking.chunk_chars(load(spark, d, "documents"))


@query("chunk_tokens", f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(w[i * 96 + 1:i * 96 + 128], ' ') AS chunk_text
FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 32) / 96.0) AS BIGINT)))) AS i FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE len(w) > 0)""")
def chunk_tokens(spark, d):
    return chunking.chunk_tokens(load(spark, d, "documents"))


@query("chunk_sentences", r"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS p FROM documents),
r AS (SELECT doc_id, 1 AS i, 0 AS chunk_no, p[1] AS open FROM s WHERE len(p) > 0
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN length(open) + 1 + length(p[i + 1]) > 400 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN length(open) + 1 + length(p[i + 1]) > 400 THEN p[i + 1] ELSE open || ' ' || p[i + 1] END
  FROM r JOIN s ON s.doc_id = r.doc_id WHERE i < len(p))
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, arg_max(open, i) AS chunk_text FROM r GROUP BY doc_id, chunk_no""")
def chunk_sentences(spark, d):
    return chunking.chunk_sentences(load(spark, d, "documents"))


@query("split_sentences", r"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?][ \n]+'), lambda x: length(x) > 0) AS s FROM documents)")
def split_sentences(spark, d):
    return chunking.sentences(load(spark, d, "documents"))


@query("chunk_paragraphs", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, p[i] AS chunk_text FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(p[i]) <> ''")
def chunk_paragraphs(spark, d):
    return chunking.chunk_paragraphs(load(spark, d, "documents"))


@query("chunk_neighbors", """
WITH c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 400 + 1, 500) AS chunk_text FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0))
SELECT doc_id, chunk_no, md5(lag(chunk_text) OVER w) AS previous, md5(lead(chunk_text) OVER w) AS next FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)""")
def chunk_neighbors(spark, d):
    near = chunking.chunk_neighbors(chunking.chunk_chars(load(spark, d, "documents")).select("doc_id", "chunk_no", "chunk_text"))
    return near.select("doc_id", "chunk_no", F.md5("previous").alias("previous"), F.md5("next").alias("next"))


@query("chunk_udtf", "SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 500 + 1, 500) AS chunk_text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents)")
def chunk_udtf(spark, d):
    return chunking.chunk_udtf(spark, load(spark, d, "documents"))


# Keyword search.
_POST = f"p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL)"
_BASE = f"""{_POST}, df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
l AS (SELECT doc_id, len({_TOK}) AS len FROM documents WHERE len({_TOK}) > 0), s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark)"""
_BM25 = f"""{_BASE}, hits AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term JOIN l ON l.doc_id = p.doc_id, s GROUP BY query_id, p.doc_id)"""
_RANKED = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= {k}"


@query("build_postings", f"WITH {_POST} SELECT * FROM p")
def build_postings(spark, d):
    return lexical.postings(load(spark, d, "documents"))


@query("doc_freq", f"WITH {_POST} SELECT term, count(*) AS df FROM p GROUP BY term")
def doc_freq(spark, d):
    """Distinct words are counted a document at a time in its own row, so only (term, 1) is summed."""
    words = load(spark, d, "documents").select(F.explode(F.array_distinct(T.tokenize("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query("bm25_topk", f"WITH {_BM25} " + _RANKED.format(k=5))
def bm25_topk(spark, d):
    return lexical.bm25_topk(load(spark, d, "documents"), load(spark, d, "benchmark"), 5)


@query("tfidf_topk", f"WITH {_BASE}, hits AS (SELECT query_id, p.doc_id, round(sum((1 + ln(tf)) * ln(n / df)), 6) AS score FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term, s GROUP BY query_id, p.doc_id) " + _RANKED.format(k=5))
def tfidf_topk(spark, d):
    return lexical.tfidf_topk(load(spark, d, "documents"), load(spark, d, "benchmark"), 5)


@query("boolean_match", f"SELECT doc_id FROM documents WHERE list_has_all({_TOK}, ['the', 'and', 'of']) AND NOT list_has_any({_TOK}, ['license', 'token'])")
def boolean_match(spark, d):
    return lexical.boolean_match(load(spark, d, "documents"), ["the", "and", "of"], ["license", "token"]).select("doc_id")


@query("phrase_match", f"SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS n FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
def phrase_match(spark, d):
    return lexical.phrase_match(load(spark, d, "documents"), "of the")


@query("prefix_fuzzy", f"WITH {_POST} SELECT DISTINCT term FROM p WHERE starts_with(term, 'licen') OR levenshtein(term, 'other') <= 1")
def prefix_fuzzy(spark, d):
    terms = load(spark, d, "documents").select(F.explode(F.array_distinct(T.tokenize("text"))).alias("term")).distinct()
    return lexical.prefix_fuzzy(terms, "licen", "other", 1)


@query("highlight", """SELECT doc_id, CAST(p AS INTEGER) AS "at", substring(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + 37) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0""")
def highlight(spark, d):
    return lexical.highlight(load(spark, d, "documents"), "license")


@query("ml_tfidf")
def ml_tfidf(spark, d):
    return vectors.embed_text(load(spark, d, "documents"))


# Vectors.
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("vector_scalars", f"""
WITH v AS (SELECT vec_id, label, {_V} AS e FROM embeddings), c AS (SELECT label, min(vec_id) AS first FROM v GROUP BY label)
SELECT v.vec_id, round(list_dot_product(v.e, f.e), 6) AS dot, round(list_cosine_similarity(v.e, f.e), 6) AS cosine, round(list_distance(v.e, f.e), 5) AS l2
FROM v JOIN c ON v.label = c.label JOIN v f ON f.vec_id = c.first""")
def vector_scalars(spark, d):
    """Each vector against the first of its label."""
    v = load(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    a, b = F.col("embedding"), F.col("f")
    return v.join(broadcast_if_small(first, 10_000), "label").select("vec_id", F.round(dot(a, b), 6).alias("dot"), F.round(cosine(a, b), 6).alias("cosine"), F.round(l2(a, b), 5).alias("l2"))


def _knn(where: str = "true", k: int = 10) -> str:
    return f"""WITH v AS (SELECT vec_id, label, {_V} AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS sim FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 AND {where})
SELECT query_id, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


@query("knn_cosine", _knn())
def knn_cosine(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.knn_cosine(v, vectors.query_set(v))


@query("knn_sql", _knn(k=5))
def knn_sql(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.knn_sql(v, vectors.query_set(v), 5)


@query("knn_filtered", _knn("v.label IN (1, 3, 5)"))
def knn_filtered(spark, d):
    """The filter goes to the scan, before any vector is compared."""
    v = load(spark, d, "embeddings")
    return vectors.knn_cosine(v.where(F.col("label").isin(1, 3, 5)), vectors.query_set(v))


@query("knn_threshold", f"""WITH v AS (SELECT vec_id, {_V} AS e FROM embeddings)
SELECT query_id, vec_id, sim FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS sim FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE sim >= 0.3""")
def knn_threshold(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.knn_threshold(v, vectors.query_set(v), 0.3)


@query("ann_lsh")
def ann_lsh(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.ann_lsh(v, vectors.query_set(v))


@query("ann_ivf")
def ann_ivf(spark, d):
    v = load(spark, d, "embeddings")
    return vectors.IvfIndex(v).search(vectors.query_set(v))


@query("ann_recall")
def ann_recall(spark, d):
    v = load(spark, d, "embeddings")
    q = vectors.query_set(v)
    return vectors.recall(vectors.IvfIndex(v).search(q), vectors.knn_cosine(v, q))


@query("centroid", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS value FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def centroid(spark, d):
    return vectors.centroids(load(spark, d, "embeddings"))


@query("embed_text")
def embed_text(spark, d):
    return vectors.embed_text(load(spark, d, "documents"), 64)


def _make_predict():
    """Stand-in for a model: shares of the letters a to z."""
    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 26), np.float32)
        for i, t in enumerate(texts):
            b = np.frombuffer((t or "").lower().encode(), np.uint8)
            out[i] = np.bincount(b[(b >= 97) & (b <= 122)] - 97, minlength=26) / max(len(b), 1)
        return out

    return predict


@query("embed_model")
def embed_model(spark, d):
    return vectors.embed_model(load(spark, d, "documents"), _make_predict)


# Fusion, context, evaluation. Words of documents and queries fall to 256 dimensions by the first two digits of their MD5.
_DIGIT = "strpos('0123456789abcdef', md5(term)[{}]) - 1"
_DIM = f"({_DIGIT.format(1)}) * 16 + {_DIGIT.format(2)}"
_EMBEDDED = f"""qp AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
xd AS (SELECT doc_id AS id, {_DIM} AS dim, CAST(sum(tf) AS DOUBLE) AS x FROM p GROUP BY ALL), xq AS (SELECT id, {_DIM} AS dim, CAST(sum(tf) AS DOUBLE) AS x FROM qp GROUP BY ALL),
nd AS (SELECT id, sqrt(sum(x * x)) AS n FROM xd GROUP BY id), nq AS (SELECT id, sqrt(sum(x * x)) AS n FROM xq GROUP BY id),
t0 AS (SELECT xq.id AS query_id, xd.id AS doc_id, round(sum(xq.x * xd.x) / any_value(nq.n) / any_value(nd.n), 6) AS score FROM xq JOIN xd ON xq.dim = xd.dim JOIN nq ON nq.id = xq.id JOIN nd ON nd.id = xd.id GROUP BY ALL)"""


def _two(k: int) -> str:
    r = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {}"
    return f"WITH {_BM25}, {_EMBEDDED}, a AS (SELECT * FROM ({r.format('hits')}) WHERE rank <= {k}), b AS (SELECT * FROM ({r.format('t0')}) WHERE rank <= {k})"


def _rankings(spark, d, k):
    """A keyword ranking, and one by cosine of embeddings."""
    docs, bench = load(spark, d, "documents"), load(spark, d, "benchmark")
    near = vectors.knn_cosine(vectors.embed_words(docs), vectors.embed_words(bench, "item_id"), k, skip_self=False)
    return lexical.bm25_topk(docs, bench, k), near.select("query_id", F.col("vec_id").alias("doc_id"), F.col("sim").alias("score"), "rank")


_FUSED = "f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM u GROUP BY ALL) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"


@query("hybrid_rrf", _two(20) + ", u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM b), " + _FUSED)
def hybrid_rrf(spark, d):
    return ranking.hybrid_rrf(list(_rankings(spark, d, 20)))


_MM = "SELECT query_id, doc_id, {w}::DOUBLE * CASE WHEN max(score) OVER x > min(score) OVER x THEN (score - min(score) OVER x) / (max(score) OVER x - min(score) OVER x) ELSE 1.0 END AS s FROM {t} WINDOW x AS (PARTITION BY query_id)"


@query("hybrid_weighted", _two(20) + ", u AS (" + _MM.format(w=0.7, t="a") + " UNION ALL " + _MM.format(w=0.3, t="b") + "), " + _FUSED)
def hybrid_weighted(spark, d):
    a, b = _rankings(spark, d, 20)
    return ranking.hybrid_weighted([(a, 0.7), (b, 0.3)])


@query("rerank_mmr")
def rerank_mmr(spark, d):
    docs = load(spark, d, "documents")
    hits = lexical.bm25_topk(docs, load(spark, d, "benchmark"), 20)
    vec = vectors.embed_text(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), 64)
    return ranking.rerank_mmr(ranking.minmax(hits).withColumnRenamed("s", "score").join(vec, "doc_id"))


_CHUNKS = "c AS (SELECT doc_id, i AS chunk_no, substring(text, i * 400 + 1, 500) AS chunk_text FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0))"
_CTOK = _TOK.replace("lower(text)", "lower(chunk_text)")
_BEST = f"""h AS ({_RANKED.format(k=5)}), {_CHUNKS}, w AS (SELECT DISTINCT doc_id, chunk_no, unnest({_CTOK}) AS term FROM c WHERE doc_id IN (SELECT doc_id FROM h)),
sc AS (SELECT h.query_id, h.doc_id, w.chunk_no, count(*) AS score FROM h JOIN q ON q.query_id = h.query_id JOIN w ON w.doc_id = h.doc_id AND w.term = q.term GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_no) AS rn FROM sc) WHERE rn = 1)"""


def _scored_chunks(spark, d):
    docs, bench = load(spark, d, "documents"), load(spark, d, "benchmark")
    hits = lexical.bm25_topk(docs, bench, 5)
    chunks = chunking.chunk_chars(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    words = chunks.select("doc_id", "chunk_no", F.explode(F.array_distinct(T.tokenize("chunk_text"))).alias("term"))
    scored = hits.select("query_id", "doc_id").join(lexical.query_terms(bench), "query_id").join(words, ["doc_id", "term"]).groupBy("query_id", "doc_id", "chunk_no").agg(F.count("*").alias("score"))
    return hits, chunks, scored


@query("collapse_by_doc", f"WITH {_BM25}, {_BEST} SELECT query_id, doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, score FROM best")
def collapse_by_doc(spark, d):
    return ranking.collapse_by_doc(_scored_chunks(spark, d)[2]).select("query_id", "doc_id", "chunk_no", "score")


_PACKED = f"{_BM25}, {_BEST}, pk AS (SELECT h.query_id, h.rank, c.chunk_text AS passage, sum(length(c.chunk_text)) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS used FROM h JOIN best ON best.query_id = h.query_id AND best.doc_id = h.doc_id JOIN c ON c.doc_id = h.doc_id AND c.chunk_no = best.chunk_no)"


@query("context_pack", f"WITH {_PACKED} SELECT query_id, rank, md5(passage) AS passage, CAST(used AS BIGINT) AS used FROM pk WHERE used <= 1200")
def context_pack(spark, d):
    hits, chunks, scored = _scored_chunks(spark, d)
    best = ranking.collapse_by_doc(scored).select("query_id", "doc_id", "chunk_no")
    placed = hits.join(best, ["query_id", "doc_id"]).join(chunks, ["doc_id", "chunk_no"]).select("query_id", "rank", F.col("chunk_text").alias("passage"), F.length("chunk_text").alias("size"))
    return ranking.context_pack(placed, 1200).select("query_id", "rank", F.md5("passage").alias("passage"), "used")


@query("prompt_assemble", f"WITH {_PACKED} SELECT query_id, string_agg('[' || rank || '] ' || passage, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) AS prompt FROM pk JOIN benchmark b ON b.item_id = query_id WHERE used <= 4000 GROUP BY query_id")
def prompt_assemble(spark, d):
    return plans.retrieve(load(spark, d, "documents"), load(spark, d, "benchmark"))


@query("chat_history", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY rn DESC) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn <= 4 GROUP BY conv_id")
def chat_history(spark, d):
    return ranking.chat_history(load(spark, d, "conversations"))


@query("eval_ranking")
def eval_ranking(spark, d):
    """Neighbours of each query vector judged by label: precision, recall, MRR, hit and NDCG at 10."""
    v = load(spark, d, "embeddings")
    near = vectors.knn_cosine(v, vectors.query_set(v), 10)
    label = v.select("vec_id", "label")
    size = label.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    mine = label.join(broadcast_if_small(size, 10_000), "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("mine"), "n_relevant")
    judged = near.join(label, "vec_id").join(mine, "query_id").withColumn("rel", (F.col("label") == F.col("mine")).cast("int"))
    return ranking.evaluate(judged, 10)


SQL["eval_ranking"] = f"""WITH v AS (SELECT vec_id, label, {_V} AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS sim, CAST(q.label = v.label AS INTEGER) AS rel, q.label AS mine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10),
n AS (SELECT label, count(*) - 1 AS n FROM v GROUP BY label)
SELECT query_id, round(sum(rel) / 10.0::DOUBLE, 9) AS precision, round(sum(rel) / any_value(n)::DOUBLE, 9) AS recall, round(coalesce(max(CASE WHEN rel > 0 THEN 1.0::DOUBLE / rank END), 0), 9) AS mrr, CAST(max(rel) AS INTEGER) AS hit,
       round(sum(rel / log2(rank + 1)) / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i))), 9) AS ndcg
FROM r JOIN n ON n.label = r.mine GROUP BY query_id"""


@query("faithfulness_overlap", f"""
WITH a AS (SELECT conv_id, turn, role, list_distinct({_TOK}) AS w, lag(list_distinct({_TOK})) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations)
SELECT conv_id * 1000 + turn AS id, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, coalesce(c, []))) / len(w)::DOUBLE, 9) ELSE 0.0 END AS overlap FROM a WHERE role = 'assistant'""")
def faithfulness_overlap(spark, d):
    """Each assistant turn against the turn before it."""
    t = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("answer"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("context")).where("role = 'assistant'")
    return ranking.faithfulness(pairs)


_CANONICAL = SQL["url_canonical"].replace("WITH a AS", "a AS").replace("\nSELECT page_id, lower", ",\nu AS (SELECT page_id, lower") + ")"


@query("ingest_pages", rf"""WITH {_CANONICAL.strip()},
t AS (SELECT page_id, trim(regexp_replace(lower(trim(regexp_replace({_unescaped(_HTML)}, {_SPACE}))), {_SPACE})) AS text FROM pages)
SELECT doc_id, url, CAST(i AS INTEGER) AS chunk_no, CAST(i * 400 AS INTEGER) AS start, CAST(least(i * 400 + 500, length(text)) AS INTEGER) AS "end", substring(text, i * 400 + 1, 500) AS chunk_text
FROM (SELECT t.page_id AS doc_id, u.url, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS i FROM t JOIN u ON u.page_id = t.page_id WHERE length(text) > 0)""")
def ingest_pages(spark, d):
    return plans.ingest_pages(load(spark, d, "pages"))
