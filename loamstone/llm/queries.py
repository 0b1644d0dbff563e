"""Queries op1_ to op10_ over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import collocations, decontam, langid, lm, lz, minhash, pii, quality, spm, token_counts, toxicity, url_rules, whitening
from loamstone.llm.common import shared_dir, stored
from loamstone.llm.samples import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizers_dir(spark: SparkSession) -> str:
    """Where the public vocabulary files lie on every executor: the setting spark.loamstone.tokenizers."""
    return spark.conf.get("spark.loamstone.tokenizers", TOKENIZERS)


#: The folder where that isn't set.
TOKENIZERS = "/opt/tokenizers"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    kinds = F.transform("base_spans", lambda z: z["kind"])
    count = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in pii.BASE}
    texts = {"base_sha256": F.sha2(pii.spans_text("base_spans"), 256), "spans": pii.spans_text(F.concat("base_spans", "more_spans"))}
    every = {"n_spans": (F.size("base_spans") + F.size("more_spans")).cast("long")}
    return found.withColumns(count | texts | every).select("doc_id", *count, *texts, *every)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return spm.round_trip(_table(spark, sf_dir, "documents"), f"{tokenizers or tokenizers_dir(spark)}/piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    """Totals after a load of half texts, its replay (which changes nothing), a revision to whole texts, a load of all once more, its withdrawal, and compaction: those of the whole texts."""
    kinds = [token_counts.ByteBpe("byte_bpe_50k", f"{tokenizers or tokenizers_dir(spark)}/byte_bpe_50k.tiktoken"), token_counts.Words()]
    ledger = token_counts.TokenLedger(spark, shared_dir(spark, "token-ledger"))
    docs = _table(spark, sf_dir, "documents")
    half = docs.withColumn("text", F.expr("left(text, int(length(text) / 2))"))
    before, after = (stored(token_counts.count_tokens(d, kinds), "token-counts") for d in (half, docs))
    for _ in range(2):
        ledger.commit("load", token_counts.inserts(before))
    ledger.commit("revise", token_counts.changes(before, after))
    ledger.commit("again", token_counts.inserts(after))
    ledger.commit("withdraw", token_counts.deletes(after))
    ledger.compact()
    return ledger.totals()


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edit_likeness(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs.where(~lm.held_out_tenth()), order=3), held_out=lm.held_out_tenth())


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.digest(decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    spans = scored.withColumn("spans", toxicity_text("toxic_spans"))
    return spans.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "spans")


def toxicity_text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(*whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.contract_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_token_counts, op4_document_fingerprints, op5_lm_scoring, op6_benchmark_decontamination, op7_quality_classifier, op8_language_id, op9_minhash_near_dedup, op10_toxicity, op11_embedding_whitening, op12_url_filters, op13_phrase_collocations)}


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, win.n AS n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.s = win.s),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""

_OP9 = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.k + ny.k - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, m.component_id, m.component_id = dw.doc_id AS kept
FROM dw JOIN m ON m.a = dw.doc_id LEFT JOIN n ON n.doc_id = dw.doc_id
"""


_OP12 = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, (SELECT max(struct_pack(n := length(rh || rp), rule := rh || rp, verdict := rv)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM h)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, w[i:i + k - 1] AS g, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k))),
f AS (SELECT lang, g, k, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL), n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE a >= 10),
s AS (SELECT c.lang, c.g, c.k, c.a, j, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c WHERE k > 1) AS c JOIN c x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN c y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS t FROM s) WHERE t = 1),
d AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE k = 3), dm AS (SELECT lang, g, max(a) AS longer FROM d GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN dm ON dm.lang = b.lang AND dm.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": _OP6, "op9_minhash_near_dedup": _OP9, "op12_url_filters": _OP12, "op13_phrase_collocations": _OP13}
