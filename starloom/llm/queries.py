"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.exact_dedup import exact_duplicates
from starloom.llm.html_text import extract_main_text
from starloom.llm.language import identify_languages
from starloom.llm.mixing import mix_documents
from starloom.llm.near_dedup import near_duplicates
from starloom.llm.nearest import nearest
from starloom.llm.packing import pack_documents
from starloom.llm.substring_dedup import remove_repeated_substrings
from starloom.llm.suffix_dedup import repeated_passages
from starloom.llm.url_filter import filter_urls, rule_table

#: Rules of the url query: verdict, host and beginning of the path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, URL_RULES)).drop("url")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=1024)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_substrings(_table(spark, sf_dir, "documents"), window=13)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), length=5, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), words=50)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_nearest_neighbours, op2_url_filter, op3_best_fit_packing, op4_substring_dedup, op5_minhash_near_dedup, op6_exact_dedup, op7_suffix_dedup, op8_html_extraction, op9_language_id, op10_source_mixing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in URL_RULES)
    return {
        "op1_nearest_neighbours": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings WHERE embedding IS NOT NULL),
            s AS (SELECT q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e) score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
            SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20""",
        "op2_url_filter": f"""
            WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
            r AS (SELECT v, rule, split_part(rule, '/', 1) h, substr(rule, instr(rule, '/')) b FROM (VALUES {rules}) t(v, rule)),
            f AS (SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule DESC) AS n
                FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b))
            SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE n = 1""",
        "op6_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ 	-
]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
        "op4_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
            s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
            h AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
            m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
            x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (k) WHERE doc_id > first),
            gone AS (SELECT doc_id, list(i) AS places FROM x GROUP BY doc_id),
            o AS (SELECT doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (doc_id)),
            y AS (SELECT doc_id, len(w) AS n, len(places) AS r, w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)) AS keep FROM o)
            SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(list_where(w, keep), ' ')) AS kept_sha256 FROM y""",
        "op5_minhash_near_dedup": r"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
            m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
        "op7_suffix_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
            h AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
            m AS (SELECT k, min(doc_id * 4294967296 + i) AS first FROM h GROUP BY k HAVING count(*) > 1),
            x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN m USING (k) WHERE doc_id * 4294967296 + i > first),
            g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x)
            SELECT doc_id, min(i) - 1 AS start_word, count(*) AS n_words, CAST(any_value(len(w)) AS BIGINT) AS text_words FROM g JOIN d USING (doc_id) GROUP BY doc_id, run""",
        "op10_source_mixing": r"""
            WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
                (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
            k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
            f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open FROM k
                WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            l AS (SELECT rest, open FROM f WHERE rest * w <= cap * open ORDER BY cap / w, source NULLS LAST LIMIT 1),
            t AS (SELECT source, source_size, least(cap::DOUBLE, l.rest::DOUBLE * w / l.open) AS target FROM f, l),
            v AS (SELECT doc_id, size, source_size, target, u, d.source, length(bin(size)) AS g, CAST(pow(2, length(bin(size)) - 1) AS BIGINT) AS p FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            e AS (SELECT *, CASE WHEN size > 0 THEN 64 * (8 + g) + CAST(floor((size - p) * 64 / p) AS BIGINT) ELSE 0 END AS w, CASE WHEN size > 0 THEN 4 * g + CAST(floor((size - p) * 4 / p) AS BIGINT) ELSE 0 END AS z FROM v),
            kind AS (SELECT source, w, max(target) AS target, CAST(sum(size) AS BIGINT) AS words FROM e WHERE w > 0 GROUP BY ALL),
            rising AS (SELECT source, w, (target - 3 * coalesce(sum(words) OVER more, 0)) / sum(words * w) OVER upto AS rate FROM kind
                WINDOW more AS (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
            r AS (SELECT source, max_by(rate, w) AS rate FROM rising WHERE rate * w < 3 GROUP BY source),
            c AS (SELECT e.*, CASE WHEN w > 0 THEN least(3.0::DOUBLE, coalesce(rate * w, 3.0::DOUBLE)) ELSE 0::DOUBLE END AS copies FROM e LEFT JOIN r ON e.source IS NOT DISTINCT FROM r.source),
            q AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS chance FROM c),
            st AS (SELECT source, z, sum(chance * size) AS words, sum(chance) AS chances, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY z DESC) AS i FROM q WHERE chance > 0 GROUP BY source, z),
            fold AS (SELECT source, z, i, words / chances AS mean, words AS due, least(n, greatest(0, floor(words / (words / chances) + 0.5))) AS take FROM st WHERE i = 1
                UNION ALL SELECT st.source, st.z, st.i, st.words / st.chances, due - take * mean + st.words, least(st.n, greatest(0, floor((due - take * mean + st.words) / (st.words / st.chances) + 0.5)))
                FROM fold JOIN st ON st.source IS NOT DISTINCT FROM fold.source AND st.i = fold.i + 1),
            o AS (SELECT *, u / (1 - u) / (chance / (1 - chance)) AS odds FROM q),
            k2 AS (SELECT o.*, row_number() OVER (PARTITION BY o.source, o.z, chance > 0 ORDER BY odds / (1 + odds), CAST(doc_id AS VARCHAR), size) AS nth, take FROM o LEFT JOIN fold ON o.source IS NOT DISTINCT FROM fold.source AND o.z = fold.z)
            SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN chance > 0 AND nth <= take THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k2""",
    }
