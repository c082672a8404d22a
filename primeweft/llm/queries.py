"""The thin queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import spread, texts
from .op1_shards import shard_rows
from .op2_quality import quality
from .op10_url_templates import judge_urls
from .op11_winnowing import winnow
from .op12_collocations import collocations
from .op3_jaccard import jaccard_components
from .op4_substrings import remove_repeats
from .op5_warc import archive_and_read
from .op6_packing import pack_documents
from .op7_brown import score_documents
from .op8_byte_bpe import encode_documents
from .op9_chunks import media_documents


#: The stated rules of op10: (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(texts(spark, sf_dir, "documents", "doc_id", "text"), 40)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spread(texts(spark, sf_dir, "documents", "doc_id", "text", "lang")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(texts(spark, sf_dir, "documents", "doc_id", "text")), k=4, percent=85)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(texts(spark, sf_dir, "documents", "doc_id", "text")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(spread(texts(spark, sf_dir, "pages", "page_id", "url", "html")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(texts(spark, sf_dir, "documents", "doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spread(texts(spark, sf_dir, "documents", "doc_id", "text")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(spread(texts(spark, sf_dir, "documents", "doc_id", "text")))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(texts(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow(spread(texts(spark, sf_dir, "documents", "doc_id", "text")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(texts(spark, sf_dir, "documents", "lang", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shards, op2_quality, op3_jaccard, op4_substrings, op5_warc, op6_packing, op7_brown, op8_byte_bpe, op9_chunks, op10_url_templates, op11_winnowing, op12_collocations)}


# ---------------------------------------------------------------- the same in SQL
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_sql(text: str) -> str:
    """CTEs w (doc_id, n_words) and tok (doc_id, pos, word) of a table of unique ids."""
    return f"""
split AS (SELECT doc_id, list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws)::BIGINT AS n_words FROM split),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split)"""


_JACCARD_SQL = f"""WITH RECURSIVE {_words_sql(_LOWER.format("text"))},
grams AS (SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM tok),
sets AS (SELECT DISTINCT doc_id, g FROM grams JOIN w USING (doc_id) WHERE pos <= greatest(n_words - 3, 1)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, either.b FROM reach JOIN either ON either.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id"""

_SUBSTRING_SQL = f"""WITH {_words_sql("text")},
windows AS (SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM tok),
again AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1 AS r FROM windows JOIN w USING (doc_id) WHERE pos <= n_words - 19),
marked AS (SELECT tok.doc_id, tok.pos, word, coalesce(bool_or(r) OVER (PARTITION BY tok.doc_id ORDER BY tok.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM tok LEFT JOIN again USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_HEX = "(instr('0123456789abcdef', substr(h, {0}, 1)) - 1)"
_WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((({_HEX.format("(5 * i) // 4 + 1")} * 16 + (CASE WHEN (5 * i) // 4 + 2 > 40 THEN 0 ELSE {_HEX.format("(5 * i) // 4 + 2")} END)) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM d"""

_COLLOCATION_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
tok AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM split),
runs AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM tok WINDOW s AS (PARTITION BY id ORDER BY pos)),
one AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cut2 AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 WHERE coalesce(100 * g.m < 50 * t.f, TRUE)),
cut3 AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2 FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM (SELECT * FROM cut2 UNION ALL SELECT * FROM cut3)),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; tests hold the others against brute force.

    The others hang on hashes and samples (1), trained references (2), the packing
    plan (6), the model (7), merges (8), stored media (9), learnt templates (10) and
    hashes (11).
    """
    return {"op12_collocations": _COLLOCATION_SQL, "op3_jaccard": _JACCARD_SQL, "op4_substrings": _SUBSTRING_SQL, "op5_warc": _WARC_SQL}
