"""Queries of this subpackage: one ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat_tree, fair_mix, line_crf, minhash, ogg, runs, scaled_sketch, secrets, simhash, token_spans, vbyte
from .common import documents


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_digest(documents(spark, sf_dir))


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.chat_report(chat_tree.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op4_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.tokens_by_section(documents(spark, sf_dir))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.corpus_words(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return secrets.secret_report(documents(spark, sf_dir), model=secrets.train(spark, words=words))


def op6_vbyte_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vbyte.id_report(documents(spark, sf_dir))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.sketch_neighbours(documents(spark, sf_dir))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_report(documents(spark, sf_dir))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(documents(spark, sf_dir))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(documents(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_chat_tree": op2_chat_tree,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_token_spans": op4_token_spans,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_vbyte_ids": op6_vbyte_ids,
    "op7_line_crf": op7_line_crf,
    "op8_scaled_sketch": op8_scaled_sketch,
    "op9_fair_mix": op9_fair_mix,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_runs": op11_runs,
    "op12_simhash": op12_simhash,
    "op13_token_alignment": op13_token_alignment,
}

#: A-Z to lower case and nothing else, as the near-duplicates do.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op2_chat_tree": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*\|)', '<\\\1', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS x
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT doc_id, list(DISTINCT x ORDER BY x) AS s FROM g WHERE x IS NOT NULL GROUP BY 1
  UNION ALL SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END FROM w WHERE len(w) < 5),
classes AS (SELECT s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT node, hash(unnest(s)) AS x, len(s) AS n FROM classes),
shared AS (SELECT x FROM items GROUP BY 1 HAVING count(*) > 1),
few AS (SELECT items.* FROM items JOIN shared USING (x)),
pairs AS (SELECT a.node AS u, b.node AS v, a.n AS na, b.n AS nb, count(*) AS c FROM few a JOIN few b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2, 3, 4),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(node, root) AS (SELECT node, node FROM classes UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
named AS (SELECT c.s, min(r.root) AS component_id FROM classes c JOIN reach r USING (node) GROUP BY 1)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN named USING (s)""",
    "op9_fair_mix": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, CAST('0x' || substr(md5(doc_id || '|1'), 1, 12) AS BIGINT) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY 1),
w AS (SELECT *, (k - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS place FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, place) FROM l WHERE ratio >= level)) AS target FROM l),
e0 AS (SELECT d.*, source_size, target, CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT) AS lap,
  sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size) AS e, e AS late FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c1 AS (SELECT source, min(struct_pack(late := late, size := size, move := target - lap * source_size - (late - size) > 0.01 * target)) AS c
  FROM e0 WHERE size > 0 AND late > target - lap * source_size GROUP BY 1),
e1 AS (SELECT a.* EXCLUDE (late), CASE WHEN NOT coalesce(c.move, false) THEN late WHEN late = c.late AND size > 0 THEN source_size WHEN late > c.late THEN late - c.size ELSE late END AS late
  FROM e0 a LEFT JOIN c1 ON a.source IS NOT DISTINCT FROM c1.source),
c2 AS (SELECT source, min(struct_pack(late := late, size := size, move := target - lap * source_size - (late - size) > 0.01 * target)) AS c
  FROM e1 WHERE size > 0 AND late > target - lap * source_size GROUP BY 1),
e2 AS (SELECT a.* EXCLUDE (late), CASE WHEN NOT coalesce(c.move, false) THEN late WHEN late = c.late AND size > 0 THEN source_size WHEN late > c.late THEN late - c.size ELSE late END AS late
  FROM e1 a LEFT JOIN c2 ON a.source IS NOT DISTINCT FROM c2.source),
e AS (SELECT * RENAME (lap AS last) FROM e2),
o AS (SELECT *, (lap * source_size + CASE WHEN lap = last THEN late ELSE e END) / target AS finish FROM e, range(3) l(lap) WHERE size > 0),
g AS (SELECT source, target, sum(size) FILTER (finish <= 1) AS got FROM o GROUP BY 1, 2),
x AS (SELECT o.source, max(struct_pack(size := size, e := e, lap := -lap, f := (coalesce(got, 0) + size) / o.target)) AS x
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source WHERE finish > 1 AND coalesce(got, 0) + size <= o.target GROUP BY 1),
q AS (SELECT doc_id, o.source, o.e, o.lap, size, CASE WHEN x.x.e = o.e AND -x.x.lap = o.lap THEN x.x.f ELSE finish END AS finish FROM o LEFT JOIN x ON o.source IS NOT DISTINCT FROM x.source),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, e, lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM q),
k AS (SELECT source, e, count(*) AS copies FROM u WHERE used <= (SELECT sum(size) FROM d) GROUP BY 1, 2)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(CASE WHEN size > 0 THEN coalesce(copies, 0) ELSE 0 END * size AS BIGINT) AS taken
FROM e LEFT JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.e = k.e""",
}
