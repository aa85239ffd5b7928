"""Registered queries of this package and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stutter.operators.blocks import div

from .decontamination import contamination
from .jaccard_join import jaccard_join
from .language_id import language_id
from .line_chunks import line_dedup
from .near_vectors import near_vectors
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import quality_scores
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .topk import top_k
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"


@_query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
m AS (SELECT win, min(doc_id) AS lo FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT s.doc_id, list(DISTINCT c) AS gone FROM s JOIN m USING (win), unnest(range(s.i, s.i + 50)) AS t(c)
      WHERE m.lo < s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM d, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


@_query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


@_query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_TOKENS = (rf"[x FOR x IN regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '{_UNSPACED}', ' \1 ', 'g'), "
           r"'[^\p{L}\p{N}]+') IF x <> '']")
_FOUR = "SELECT {id}, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM {t}, unnest(range(1, len(w) - 2)) AS u(i)"


# an allowed overlap has four equal tokens in a row somewhere; items of fewer than eight tokens are held whole
@_query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
a AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)),
b AS (SELECT * FROM a WHERE len(w) >= 8),
h AS (SELECT DISTINCT x.doc_id, y.item_id, x.i - y.i AS shift
      FROM ({_FOUR.format(id='doc_id', t='d')}) x JOIN ({_FOUR.format(id='item_id', t='b')}) y USING (g)),
s AS (SELECT doc_id, item_id, shift, p, least(13, len(b.w)) AS size, len(b.w) AS n,
             CASE WHEN shift + p >= 1 AND d.w[shift + p] = b.w[p] THEN 1 ELSE 0 END AS same
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.w) + 1)) AS u(p)),
o AS (SELECT x.doc_id, x.item_id FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.shift = y.shift
        AND y.p BETWEEN x.p AND x.p + x.size - 1
      WHERE x.p <= x.n - x.size + 1 GROUP BY x.doc_id, x.item_id, x.shift, x.p, x.size
      HAVING sum(y.same) >= x.size - CASE WHEN x.size = 13 THEN 2 ELSE 1 END),
z AS (SELECT x.doc_id, y.item_id FROM (SELECT doc_id, i, w[i] AS g FROM d, unnest(range(1, len(w) + 1)) AS u(i)) x
      JOIN (SELECT * FROM a WHERE len(w) BETWEEN 1 AND 7) y ON x.g = y.w[1] JOIN d USING (doc_id) WHERE d.w[x.i:x.i + len(y.w) - 1] = y.w),
i AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids
      FROM (SELECT doc_id, item_id FROM o UNION ALL SELECT doc_id, item_id FROM z) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, item_ids IS NOT NULL AS contaminated, item_ids FROM d LEFT JOIN i USING (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_tokens", "contaminated", F.array_join("item_ids", ",").alias("item_ids"))


@_query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


@_query("""WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


@_query()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), whole=True).select(
        "doc_id", "n_lines", "n_removed", "n_chunks_removed", "kept_sha256"
    )


@_query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


@_query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# crc32 of the digits of doc_id, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [j::BIGINT FOR j IN range(8)]), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


@_query(f"""WITH v AS (SELECT doc_id, {_WORDS} AS v, {_CRC} AS h FROM documents),
t AS (SELECT doc_id, v, len(v) AS n, h % 10 = 0 AND len(v) > 0 AS again, (h // 10) % greatest(len(v), 1) AS a, 3 + (h // 10) % 8 AS parts FROM v),
d AS (SELECT doc_id, CASE WHEN again THEN list_concat(v[:a], [v[1 + a + j % (1 + (n - a) // parts)] FOR j IN range(n - a)]) ELSE v END AS w FROM t),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 15], ' ') AS g FROM d, unnest(range(1, len(w) - 14)) AS u(i)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
m AS (SELECT doc_id, min(i) - 1 AS start, count(*) + 15 + q AS length, q FROM k GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
             list(DISTINCT c) AS gone FROM r, unnest(range(start + period + 1, start + length + 1)) AS u(c) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
      OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))
SELECT d.doc_id, coalesce(c.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(c.runs, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)] END, ' '))
         AS collapsed_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id)""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in ten has its words from a place of its own on replaced by copies of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("w"), div("h", 10)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, split))
    placed = docs.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    rest = n - F.col("a")
    placed = placed.withColumn("p", (1 + div(rest, 3 + g % 8)).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, rest)), " ")
    found = periodic_runs(placed.select("doc_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(text).alias("text")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  the first of equals stays
    best = F.aggregate("runs", F.get("runs", 0), lambda x, y: F.when(more(y, x), y).otherwise(x))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        div(1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@_query("""WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS lo FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.lo, vec_id)) AS component_id,
       vec_id <= coalesce(c.lo, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


@_query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
