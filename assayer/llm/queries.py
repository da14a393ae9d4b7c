"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import urlfilter, wavelet
from assayer.llm.itq import op7_embedding_near_dedup
from assayer.llm.langid import op5_language_id
from assayer.llm.masked_lm import op2_masked_lm
from assayer.llm.middle import op11_fill_in_middle
from assayer.llm.ngram_join import op3_ngram_jaccard_join
from assayer.llm.packing import op9_best_fit_packing
from assayer.llm.quality import op8_quality_rules
from assayer.llm.sentencepiece_codec import op1_sentencepiece
from assayer.llm.transcripts import op4_chat_formatting
from assayer.llm.urlfilter import op10_url_filters
from assayer.llm.wavelet import op12_ranked_search
from assayer.llm.windows import op13_order_packing
from assayer.llm.wrappers import op6_html_extraction


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8 what SQL can express: the base statistics and rules."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10 what SQL can express: host, path, rule, and the verdict where a rule fits."""
    return op10_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_masked_lm,
        op3_ngram_jaccard_join,
        op4_chat_formatting,
        op5_language_id,
        op6_html_extraction,
        op7_embedding_near_dedup,
        op8_quality_rules,
        op9_best_fit_packing,
        op10_url_filters,
        op11_fill_in_middle,
        op12_ranked_search,
        op13_order_packing,
        quality_base,
        url_rules,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
#: The smallest id reachable over the links ``l`` (x, y), for all ids of ``ids`` (v).
_REACHED = "linked AS (SELECT x, y FROM l UNION SELECT y, x FROM l), reach(v, c) AS (SELECT v, v FROM ids UNION SELECT r.v, b.y FROM reach r JOIN linked b ON r.c = b.x), least AS (SELECT v, min(c) AS c FROM reach GROUP BY v)"
_RULES = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in urlfilter.RULES)

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * k >= 90 * (n - k)), ids AS (SELECT doc_id AS v FROM documents), {_REACHED}
SELECT doc_id, len(g) AS n_shingles, c AS component_id FROM s JOIN least ON v = doc_id""",
    "op7_embedding_near_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
ids AS (SELECT vec_id AS v FROM embeddings), {_REACHED},
n AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
SELECT v AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, v = c AS kept FROM least LEFT JOIN n ON x = v""",
    "quality_base": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY 1),
d AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{_WORDS}') GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "op11_fill_in_middle": r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(l) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM l),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_ranked_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{wavelet.TERM}')) AS t FROM documents),
f AS (SELECT doc_id, t, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY 1),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d), m AS (SELECT doc_id, 100 - 75 + ((75 * n * n_docs) // total) AS m FROM d, c),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{wavelet.TERM}')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "url_rules": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule, h, p) AS (VALUES {_RULES}),
m AS (SELECT page_id, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS verdict FROM h JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN m ON m.page_id = h.page_id""",
}
