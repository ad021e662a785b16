"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import byte_bpe, common, dart_minhash, exact_dedup, hard_negatives, html_extract, importance, language_id, mixing, shards, spelling, toxicity, transport_stream, url_rules

#: The rules that every URL is judged by first. Fixed values.
HOST_RULES = [
    url_rules.HostRule("org/", "allow"),
    url_rules.HostRule("example.org/es/", "block"),
    url_rules.HostRule("example.org/en/1", "block"),
    url_rules.HostRule("com/fr/", "allow"),
    url_rules.HostRule("com/de/", "block"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mixture(common.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", F.octet_length(common.text_or_empty()).cast("long").alias("n_bytes"), transport_stream.padded().alias("payload"))
    read = transport_stream.with_stream_read(transport_stream.with_stream(docs).drop("payload"))
    data = F.col("stream.data")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(data).cast("long").alias("payload_bytes"),
        F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -transport_stream.PAD, transport_stream.PAD)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        transport_stream.stream_feature().alias("feature"),
    )


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return importance.resample(docs.select("doc_id", "text"), labels).select("doc_id", "log_ratio", "gumbel_score", "kept")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = language_id.with_language(docs.select("doc_id", "text"), language_id.fit_languages(docs))
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    store = shards.load_in_waves(spark, root, common.read_table(spark, sf_dir, "documents"))
    return shards.shard_rows(store)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_extract.with_main_text(pages, html_extract.fit_weights(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.token_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, bad): the pages on which a host rule decides; what it blocks is bad. The rules mined from them judge the others."""
    _, verdict = url_rules.match_rule(HOST_RULES, url_rules.url_host(), url_rules.url_path())
    return pages.select("url", (verdict == "block").alias("bad")).filter("bad is not null")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine_rules(labelled_urls(pages))
    return url_rules.judge_urls(pages, HOST_RULES, mined).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, common.read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = common.read_table(spark, sf_dir, "embeddings"), F.col("embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.filter(hard_negatives.usable(vector)).select("vec_id", label.alias("label"), hard_negatives.floored(vector).alias("embedding"))
    return hard_negatives.hard_negatives(whole, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_media, op3_importance, op4_language, op5_shards, op6_exact_dedup, op7_dart_minhash, op8_html, op9_byte_bpe, op10_url_rules, op11_spelling, op12_toxicity, op13_hard_negatives)
}

ORACLE_SQL = {
    "op1_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::HUGEINT AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::HUGEINT AS w FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY s::DOUBLE / w::DOUBLE, source NULLS LAST) AS n FROM s),
        f AS (SELECT a.*, (SELECT sum(s) FROM s) - 3 * coalesce((SELECT sum(b.s) FROM r b WHERE b.n < a.n), 0) AS words, (SELECT sum(b.w) FROM r b WHERE b.n >= a.n) AS weights FROM r a),
        g AS (SELECT *, w * words >= 3 * s * weights AS filled FROM f),
        o AS (SELECT words, weights FROM g WHERE NOT filled ORDER BY n LIMIT 1),
        t AS (SELECT source, s::BIGINT AS source_size, CASE WHEN filled THEN (3 * s)::DOUBLE ELSE (w * (SELECT words FROM o))::DOUBLE / (SELECT weights FROM o)::DOUBLE END AS target FROM g),
        p AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
            ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS h
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT p.*, j, (size * (floor(rate)::BIGINT + CASE WHEN (h * ((2 * j + 1) * 97612893 % 268435456) % 268435456)::DOUBLE / 268435456.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p, range(128) g(j)),
        n AS (SELECT source, j, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::DOUBLE - any_value(target)), j) AS place FROM c GROUP BY source, j)
        SELECT doc_id, size, source_size, target, taken FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source AND c.j = n.j AND place = 1""",
    "op6_exact_dedup": """
        WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)""",
    "op11_spelling": """
        WITH bits AS (SELECT i, list_reduce([i] || list_transform(range(8), lambda k: 0), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)),
        codes AS (SELECT list(c ORDER BY i) AS t FROM bits),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        own AS (SELECT k, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
        coded AS (SELECT run, n, hex(encode(k || ':' || run)) AS x FROM own),
        hashed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM coded, codes),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        holes AS (SELECT DISTINCT word, n, i, word[: i - 1] || word[i + 1 :] AS short FROM v, unnest(range(1, length(word) + 1)) p(i)),
        pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.short = b.short AND a.i = b.i AND a.word != b.word
            UNION SELECT a.word, b.word, b.n FROM holes a JOIN v b ON a.short = b.word
            UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON a.short = b.word),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
        first AS (SELECT word, min(near) AS near FROM pairs JOIN best USING (word) WHERE near_n = top GROUP BY word),
        told AS (SELECT v.word, CASE WHEN top >= 2 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
        walk AS (WITH RECURSIVE w AS (SELECT word, form AS root, 1 AS step FROM told WHERE form IS NOT NULL UNION ALL SELECT w.word, t.form, step + 1 FROM w JOIN told t ON w.root = t.word WHERE t.form IS NOT NULL) SELECT word, arg_max(root, step) AS root FROM w GROUP BY word)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM told LEFT JOIN walk USING (word)""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
