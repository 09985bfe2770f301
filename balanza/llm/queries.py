"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.html import main_text

    return main_text(table(spark, folder, "pages"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.mixing import mix

    return mix(table(spark, folder, "documents")).drop("passes", "spans")


def op5_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.suffix import repeated_spans

    return repeated_spans(table(spark, folder, "documents")).drop("spans", "kept")


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from balanza.llm.pieces import encoded

    return encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.topk import top_k

    return top_k(table(spark, folder, "embeddings"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from balanza.llm.tokens import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.dedup import exact_dedup

    return exact_dedup(table(spark, folder, "documents"))


def op10_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings with the loss mask as a list "start-end" for each learnt span, which both engines can show."""
    from pyspark.sql import functions as F

    from balanza.llm.chat import perspectives

    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return perspectives(table(spark, folder, "conversations")).withColumn("mask", shown).drop("spans", "carried")


def op11_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.subtrees import repeated_windows

    return repeated_windows(table(spark, folder, "documents")).drop("spans", "kept")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.dualtree import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from balanza.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_main_text,
        op3_toxicity,
        op4_mixing,
        op5_repeated_spans,
        op6_pieces,
        op7_exact_top_k,
        op8_token_counts,
        op9_exact_dedup,
        op10_chat_perspectives,
        op11_repeated_windows,
        op12_ranked_search,
        op13_collocations,
    )
}

#: The same results in DuckDB's SQL, where SQL can express them.
ORACLES: dict[str, str] = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 5
    """,
    "op10_chat_perspectives": """
        WITH n AS (
            SELECT conv_id, turn,
                   replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS role,
                   replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text
            FROM conversations
        ), t AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, place // 1024 AS part FROM n
        ), q AS (
            SELECT DISTINCT conv_id AS of, part AS of_part FROM t
        ), p AS (
            SELECT DISTINCT conv_id AS of, role AS perspective FROM t WHERE role <> 'system'
        ), r AS (
            SELECT conv_id, perspective, of_part AS part, place, role = perspective AS own, t.part = of_part AS here,
                   '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
                                          ELSE 'user name=' || role END || chr(10) AS head,
                   text || '<|im_end|>' || chr(10) AS body
            FROM t JOIN q ON conv_id IS NOT DISTINCT FROM q.of AND (t.part = of_part OR (role = 'system' AND t.part < of_part))
            JOIN p ON conv_id IS NOT DISTINCT FROM p.of
        ), o AS (
            SELECT *, sum(length(head) + length(body)) OVER w AS stop
            FROM r WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY place ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, perspective, part, CAST(count(*) FILTER (here) AS INTEGER) AS n_turns,
               string_agg(head || body, '' ORDER BY place) AS text,
               coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY stop) FILTER (own), '') AS mask
        FROM o GROUP BY ALL
    """,
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op11_repeated_windows": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), w AS (
            SELECT r, doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS win
            FROM (SELECT r, doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM t)
        ), first AS (
            SELECT win, min(doc_id) AS least FROM w GROUP BY win
        ), gone AS (
            SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS k FROM w JOIN first USING (win) WHERE least < doc_id
        ), each AS (
            SELECT r, unnest(generate_series(1, len(words))) AS k, unnest(words) AS word FROM t
        ), kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM each ANTI JOIN gone USING (r, k) GROUP BY r
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (r)
    """,
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), i AS (
            SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), c AS (
            SELECT count(*) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d WHERE len(terms) > 0
        ), m AS (
            SELECT r, doc_id, 75 + ((25 * len(terms) * big_n) // big_l) AS m FROM d, c WHERE len(terms) > 0
        ), tf AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term
        ), s AS (
            SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op13_collocations": r"""
        WITH p AS (
            SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), total AS (
            SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY lang
        ), grams AS (
            SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i + k - 1] AS words
            FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))
        ), f AS (
            SELECT lang, k, phrase, any_value(words) AS words, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, k, phrase
        ), cand AS (
            SELECT * FROM f WHERE k > 1 AND a >= 10
        ), cuts AS (
            SELECT c.lang, c.phrase, c.k, c.words, c.a, h AS cut, x.a AS l, y.a AS r,
                   CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM (SELECT *, unnest(generate_series(1, k - 1)) AS h FROM cand) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:h], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[h + 1:c.k], ' ')
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inside AS (
            SELECT lang, array_to_string(words[1:2], ' ') AS phrase, a AS longer FROM cand WHERE k = 3
            UNION ALL SELECT lang, array_to_string(words[2:3], ' '), a FROM cand WHERE k = 3
        ), kept AS (
            SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 50 * b.a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
    """,
}
