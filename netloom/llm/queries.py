"""The queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, chat, decontam, fingerprint, html, langid, lexical, mixing, quality, spelling, substrings, urls
from netloom.llm.minhash import NearDedup, near_duplicates
from netloom.llm.store import documents

#: host, path prefix, allowed
URL_RULES = [
    ("com", "/", True),
    ("example.com", "/en/", False),
    ("www.example.com", "/en/", True),
    ("net", "/es/", False),
    ("net", "/fr/", False),
]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir), NearDedup(words=3, percent=85, bands=25, rows=5))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(spark, docs, labels.where(_remainder(3) != 1))
    out = quality.score(spark, docs, model)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.train(docs.where(_remainder(5) != 0))
    out = langid.identify(spark, docs, profiles)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.tokenize(spark, documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, documents(spark, sf_dir), words=35, with_text=False)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(spark, documents(spark, sf_dir))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "'</s>[INST] ok [/INST]' text")
    out = chat.read_back(chat.format_chats(spark, chat.turns_as_tree(own.unionByName(extra))))
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spark, spelling.count_words(spark, documents(spark, sf_dir)))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir), (5, 2, 1), epochs=3).select("doc_id", "source", "size", "source_size", "target", "taken")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(spark, documents(spark, sf_dir))
    return lexical.search(spark, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_html_text, op4_url_rules, op5_language, op6_decontaminate, op7_byte_bpe, op8_substring_dedup, op9_fingerprint, op10_chat_format, op11_spelling, op12_mix, op13_search, pipeline)}


ORACLE = {
    "op1_near_dedup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
        sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        walk AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT b, r FROM walk JOIN both_ways ON a = walk.doc_id WHERE r < b),
        comp AS (SELECT doc_id, min(r) AS component_id FROM walk GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN sz ON sz.doc_id = d.doc_id""",
    "op8_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM d, unnest(range(1, len(w) - 33)) t(i)),
        again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS k FROM win SEMI JOIN again USING (s), range(0, 35) r(j)),
        word AS (SELECT doc_id, k, w[k] AS x FROM d, unnest(range(1, len(w) + 1)) t(k)),
        mark AS (SELECT word.doc_id, word.k, x, gone.k IS NOT NULL AS g FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k),
        kept AS (SELECT doc_id, count(*) FILTER (g) AS n, string_agg(x, ' ' ORDER BY k) FILTER (NOT g) AS t FROM mark GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_mix": """
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                          substr(md5('mix:' || coalesce(doc_id::TEXT, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS k FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        -- rounds: what is left to share and the weights that share it, until both stay
        share AS (SELECT 0 AS r, sum(source_size)::BIGINT AS t, sum(source_size)::BIGINT AS l, sum(w)::BIGINT AS u FROM src
                  UNION ALL
                  SELECT r + 1, t, new_l, new_u FROM (
                      SELECT r, t, l, u, t - coalesce(sum(3 * source_size) FILTER (f), 0)::BIGINT AS new_l, coalesce(sum(w) FILTER (NOT f), 0)::BIGINT AS new_u
                      FROM (SELECT *, (3 * source_size)::DOUBLE * u <= w::DOUBLE * l AS f FROM share, src) GROUP BY r, t, l, u)
                  WHERE u > 0 AND (new_l <> l OR new_u <> u)),
        goal AS (SELECT source, source_size, CASE WHEN u > 0 THEN least(w::DOUBLE * l::DOUBLE / u::DOUBLE, (3 * source_size)::DOUBLE) ELSE (3 * source_size)::DOUBLE END AS target
                 FROM src, (SELECT arg_max(l, r) AS l, arg_max(u, r) AS u FROM share)),
        placed AS (SELECT d.doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
                          floor(target)::BIGINT AS words
                   FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
        SELECT doc_id, source, size, source_size, target,
               (CASE WHEN source_size > 0 THEN words // source_size * size + greatest(0, least(size, words % source_size - start)) ELSE 0 END)::BIGINT AS taken FROM placed""",
    "op13_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
        ask AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        times AS (SELECT item_id, term, count(*) AS times FROM ask GROUP BY item_id, term),
        score AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
                  FROM times JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0
        QUALIFY rank <= 10""",
    "op4_url_rules": """
        WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                       ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) OVER w AS rule, arg_max(v, length(h || p)) OVER w AS said
                 FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                 WINDOW w AS (PARTITION BY host, path))
        SELECT page_id, parts.host, parts.path, rule, coalesce(said, 'allow') AS verdict
        FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""",
    "op10_chat_format": """
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) x(a, b, c, d)),
        esc AS (SELECT *, 20 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
                       + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n FROM rows)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM esc GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
