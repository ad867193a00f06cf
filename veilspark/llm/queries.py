"""The queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_encode_decode
from .chat import format_chats
from .common import read_table
from .exact_dedup import exact_dedup
from .ngram import lm_score
from .packing import best_fit_pack
from .secrets import scan_secrets
from .simhash import simhash_components
from .topk import EACH, K, top_k
from .toxicity import score_toxicity
from .urls import BINS, HELD, LIMIT, ORDER, SYMBOLS, WEIGHT, filter_urls


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer file; the operators take it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("found")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages")).drop("figure")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_chats(table.unionByName(extra)).drop("shared_chars", "intervals")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(read_table(spark, sf_dir, "documents"), tokenizer())


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"), tokenizer())


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP7_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id AS id,
  list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS low,
  list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS high
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, c.id AS neighbor_id, min(bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)))::INT AS distance
  FROM c q JOIN c ON q.id % {EACH} = 0 AND q.id <> c.id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM d)
SELECT * FROM r WHERE rank <= {K}
"""

OP5_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length(text) + length(role) + 11
  + (2 * length(text) - length(replace(text, chr(92), '')) - length(replace(replace(text, '<', ''), '[', '')))
  + (2 * length(role) - length(replace(role, chr(92), '')) - length(replace(replace(replace(role, '<', ''), '[', ''), '|', ''))) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256, sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op4_sql() -> str:
    levels = ""
    for n in range(1, ORDER + 1):
        low = f"(SELECT 1.0 / {len(SYMBOLS)} AS pa, 1.0 / {len(SYMBOLS)} AS pr, '' AS gram)" if n == 1 else f"l{n - 1}"
        levels += f"""
c{n} AS (SELECT right(gram, {n}) AS gram, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
x{n} AS (SELECT left(gram, {n - 1}) AS context, sum(a) AS ca, sum(r) AS cr FROM c{n} GROUP BY 1),
l{n} AS (SELECT c.gram, (c.a + {WEIGHT} * w.pa) / (x.ca + {WEIGHT}) AS pa, (c.r + {WEIGHT} * w.pr) / (x.cr + {WEIGHT}) AS pr
  FROM c{n} c JOIN x{n} x ON left(c.gram, {n - 1}) = x.context JOIN {low} w ON right(c.gram, {n - 1}) = w.gram),"""
    joins = " ".join(f"LEFT JOIN l{n} ON right(g.gram, {n}) = l{n}.gram" for n in range(ORDER, 0, -1))
    ratio = "coalesce(" + ", ".join(f"ln(l{n}.pa / l{n}.pr)" for n in range(ORDER, 0, -1)) + ", 0.0)"
    return f"""
WITH u AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT row, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT row, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
s AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  repeat('^', {ORDER - 1}) || regexp_replace(regexp_replace(translate(url, {_AZ}), '[0-9]', '0', 'g'), '[^a-z0./\\-_?=&%:]', '*', 'g') AS symbols,
  substr(md5(url), 1, 1) IN {HELD} AS held FROM h),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM s),
g AS (SELECT row, ruled, held, substr(symbols, i, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(symbols) - {ORDER} + 2)) AS i FROM v)),
counts AS (SELECT gram, sum((ruled = 'allow')::INT) AS a, sum((ruled = 'block')::INT) AS r FROM g WHERE ruled IS NOT NULL AND NOT held GROUP BY 1),{levels}
f AS (SELECT row, sum({ratio}) / count(*) AS mean FROM g {joins} GROUP BY 1),
b AS (SELECT v.*, least(greatest(floor(round(coalesce(mean, 0), 6) * {BINS}), {-LIMIT * BINS}), {LIMIT * BINS})::INT AS bin FROM v LEFT JOIN f USING (row)),
k AS (SELECT bin, sum((ruled = 'allow')::INT) AS a, sum((ruled = 'block')::INT) AS r FROM b WHERE ruled IS NOT NULL AND held GROUP BY 1),
w AS (SELECT floor((coalesce(lag(bin) OVER (ORDER BY bin), bin) + bin + 1) / 2)::INT AS bin, round(coalesce(sum(a) OVER below, 0) / greatest(sum(a) OVER (), 1) + 1 - coalesce(sum(r) OVER below, 0) / greatest(sum(r) OVER (), 1), 9) AS wrong
  FROM k WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin FROM w ORDER BY wrong, abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bin >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM b, cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_lm_score": op2_lm_score,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_chat_format": op5_chat_format,
        "op6_simhash": op6_simhash,
        "op7_top_k": op7_top_k,
        "op8_toxicity": op8_toxicity,
        "op9_bpe": op9_bpe,
        "op10_best_fit_pack": op10_best_fit_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_url_filter": _op4_sql(), "op5_chat_format": OP5_SQL, "op7_top_k": OP7_SQL}
