"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_transport_streams, to_transport_streams

    return read_transport_streams(to_transport_streams(_documents(spark, sf_dir)))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    return encode_pieces(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(_documents(spark, sf_dir), n_shards=40)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import section_token_counts

    return section_token_counts(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op6_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    return secret_spans(_documents(spark, sf_dir))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, learned_lines

    docs = _documents(spark, sf_dir)
    return judge(docs, learned=learned_lines(docs)).drop("clean_text")


def op8_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_documents(spark, sf_dir))


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_components

    return similarity_components(_documents(spark, sf_dir))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_automaton_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    out = fill_in_middle(_documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op13_sorted_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


_OPERATORS = (
    op1_transport_streams, op2_piece_encoding, op3_feistel_shards, op4_section_tokens, op5_large_item_packing, op6_secret_randomness, op7_line_rules,
    op8_language_bigru, op9_partenum_join, op10_recompression, op11_automaton_infill, op12_gray_simhash, op13_sorted_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: SQL forms of what SQL can say in full; quadratic or without bounds, for small tables. The others are tested against brute force.
SQL: dict[str, str] = {
    "op9_partenum_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.seen = edges.a)
SELECT reach.doc_id, coalesce(max(n), 0) AS n_shingles, min(seen) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY 1""",
    "op10_recompression": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
ex AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT ex.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY ex.p) FILTER (WHERE gone.p IS NULL) AS t FROM ex LEFT JOIN gone ON gone.doc_id = ex.doc_id AND gone.p = ex.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_automaton_infill": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, [CAST('0x' || substr(x, 8 * k + 1, 8) AS UBIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS lo, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS hi FROM h),
p AS (SELECT doc_id, n, t, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_sorted_negatives": """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5""",
}
