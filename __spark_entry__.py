
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as o  # noqa: E402
from stutter import find_repeats, get_repeats, single_k_repeats  # noqa: E402
from stutter.functions import udtf  # noqa: E402
from stutter.functions.scalars import match_count, midpoint, primitive_motif, units_match  # noqa: E402
from stutter.functions.scan import Rule  # noqa: E402
from stutter.operators import bitmaps, exact, intervals, relations, segments, tolerant  # noqa: E402
from stutter.operators.blocks import number_rows, scratch  # noqa: E402
from stutter.operators.linked import read_linked  # noqa: E402
from stutter.sources import lines, sinks  # noqa: E402
from stutter.sources.chunks import as_sequences, chunk_sequences  # noqa: E402
from stutter.sources.tables import read_table  # noqa: E402

K = [2, 3, 4, 5, 6]
K1 = [1, 2, 3, 4, 5, 6]
RANKED = [6, 5, 4, 3, 2]
SEGMENT = 64  # small segments, so that many repeats meet their borders


# -- inputs -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return as_sequences(table(spark, sf_dir, "documents"), "doc_id", "text")


def events(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    symbols = lines.symbols_of(rows, "event_type")
    return lines.symbol_pieces(rows, "user_id", ["ts", "event_id"], F.col("event_type"), symbols=symbols)


def html_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.posexplode(F.split("html", "\n")).alias("i", "value")
    ).withColumn("i", F.col("i").cast("long"))


def fasta_lines(spark, sf_dir) -> DataFrame:
    head = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.concat(F.array(head), F.split("text", "\n"))).alias("i", "value")
    )


def fasta_files(spark, sf_dir) -> str:
    """The documents as text files in the shared folder, in line order."""
    folder = scratch(spark, "fasta")
    ordered = fasta_lines(spark, sf_dir).repartitionByRange("doc_id", "i").sortWithinPartitions("doc_id", "i")
    ordered.select("value").write.text(folder)
    return folder


def numbered_lines(spark, sf_dir) -> DataFrame:
    return number_rows(fasta_lines(spark, sf_dir), [], ["doc_id", "i"], "line_no").select("line_no", "value")


def doc_repeats(spark, sf_dir, ks=K) -> DataFrame:
    return exact.exact_repeats(docs(spark, sf_dir), ks)


def doc_segments(spark, sf_dir, size=SEGMENT) -> DataFrame:
    return segments.segments(docs(spark, sf_dir), size)


def words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))


# -- queries ------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


_R = f"SELECT {o.REPEAT} FROM repeats"
_ONE_LINE = r"replace(replace(replace(motif, '\', '\\'), chr(10), '\n'), chr(13), '\r')"
_LINES = "SELECT (row_number() OVER (ORDER BY doc_id, i) - 1)::BIGINT AS line_no, value FROM fasta"
_BODY = (
    "SELECT n AS seq_id, 'seq' || n AS seq_name, value AS seq FROM ("
    "SELECT (row_number() OVER (ORDER BY {order}) - 1)::BIGINT AS n, value FROM {source} WHERE {keep})"
)


@query(f"WITH {o.repeats(K)} {_R}")
def exact_repeats(spark, sf_dir):
    return doc_repeats(spark, sf_dir)


@query(f"WITH {o.repeats(K1, 2, primitive=False)} {_R}")
def any_motif_pairs(spark, sf_dir):
    """Two units are enough, and motifs may be repeats themselves."""
    return exact.exact_repeats(docs(spark, sf_dir), K1, min_repeat=2, primitive_only=False)


# sources and sinks


@query(f"WITH {o.FASTA} {_LINES}")
def scan_text(spark, sf_dir):
    return lines.read_lines(spark, fasta_files(spark, sf_dir), line_sep="\n")


@query(f"WITH {o.FASTA} {_BODY.format(order='doc_id, i', source='fasta', keep='NOT starts_with(value, chr(62))')}")
def read_records(spark, sf_dir):
    return lines.read_records(spark, fasta_files(spark, sf_dir), line_sep="\n")


@query(f"WITH {o.HTML} SELECT page_id, i, value FROM html_lines WHERE NOT contains(value, '>')")
def drop_headers(spark, sf_dir):
    return lines.drop_headers(html_lines(spark, sf_dir), "contains")


@query(f"WITH {o.HTML} SELECT page_id, i, value FROM html_lines WHERE contains(value, '>')")
def header_lines(spark, sf_dir):
    return lines.header_lines(html_lines(spark, sf_dir), "contains")


@query(f"WITH {o.HTML} {_BODY.format(order='page_id, i', source='html_lines', keep='NOT contains(value, chr(62))')}")
def number_records(spark, sf_dir):
    return lines.number_records(html_lines(spark, sf_dir), ["page_id", "i"], "contains")


@query(
    "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq_id, '>doc' || doc_id AS seq_name, "
    "replace(text, chr(10), ' ') AS seq FROM documents"
)
def name_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    pair = F.array(
        F.concat(F.lit(">doc"), F.col("doc_id").cast("string")), F.regexp_replace("text", "\n", " ")
    )
    two = rows.select("doc_id", F.posexplode(pair).alias("i", "value"))
    names = number_rows(lines.header_lines(two), [], ["doc_id", "i"], "ordinal")
    sequences = lines.number_records(two, ["doc_id", "i"])
    return lines.name_lookup(sequences, names.select("ordinal", F.col("value").alias("name")))


@query(f"""WITH {o.FASTA},
glued AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq_id,
                 '>doc' || doc_id || ' ' || lang AS seq_name, replace(text, chr(10), '') AS seq FROM documents),
cut AS (SELECT *, unnest(range(0, (length(seq) + 4095) // 4096)) AS chunk_id FROM glued)
SELECT seq_id, seq_name, chunk_id::BIGINT AS chunk_id, (chunk_id * 4096)::BIGINT AS chunk_start,
       substr(seq, chunk_id * 4096 + 1, 4096) AS chunk FROM cut""")
def stitch_records(spark, sf_dir):
    return chunk_sequences(lines.stitch_pieces(numbered_lines(spark, sf_dir)), 4096)


@query("""WITH glued AS (SELECT string_agg(replace(text, chr(10), ''), '' ORDER BY doc_id) AS seq FROM documents),
cut AS (SELECT *, unnest(range(0, (length(seq) + 65535) // 65536)) AS chunk_id FROM glued)
SELECT 0::BIGINT AS seq_id, 'seq0' AS seq_name, chunk_id::BIGINT AS chunk_id,
       (chunk_id * 65536)::BIGINT AS chunk_start, substr(seq, chunk_id * 65536 + 1, 65536) AS chunk FROM cut""")
def stitch_everything(spark, sf_dir):
    return chunk_sequences(lines.stitch_pieces(numbered_lines(spark, sf_dir), by=None), 65536)


@query(
    f"WITH {o.repeats(K)} SELECT '(' || seq_id || ',' || seq_name || ',' || {_ONE_LINE} || ',' || cnt || ',' || "
    "start_pos || ',' || end_pos || ')' AS value FROM repeats"
)
def format_repeats(spark, sf_dir):
    return sinks.format_repeats(doc_repeats(spark, sf_dir))


@query(
    f"WITH {o.repeats([6])} SELECT '(' || seq_id || ',' || seq_name || ',' || {_ONE_LINE} || ',' || cnt || ',' || "
    "start_pos || ',' || end_pos || ')' AS value FROM repeats"
)
def mined_text(spark, sf_dir):
    """The default job (motif length 6), written as text and read back."""
    folder = scratch(spark, "mined")
    sinks.write_text(find_repeats(docs(spark, sf_dir)), folder)
    return spark.read.option("lineSep", "\n").text(folder)


# projections and filters


@query(
    f"WITH {o.DOCS} SELECT seq_id, seq_name, seq AS text, 0::BIGINT AS cnt, 0::BIGINT AS start_pos, "
    "(length(seq) - 1)::BIGINT AS end_pos FROM seqs"
)
def work_rows(spark, sf_dir):
    return relations.work_rows(docs(spark, sf_dir))


@query(f"""WITH {o.repeats(K)},
cut AS (SELECT *, unnest(range(0, (length(seq) + 999) // 1000)) AS c FROM seqs)
SELECT 'repeat' AS kind, seq_id, seq_name, motif AS text, cnt, start_pos, end_pos FROM repeats
UNION ALL SELECT 'segment', seq_id, seq_name, substr(seq, c * 1000 + 1, 1000), 0::BIGINT, (c * 1000)::BIGINT, 0::BIGINT
FROM cut""")
def split_tagged(spark, sf_dir):
    both = relations.tagged(chunk_sequences(docs(spark, sf_dir), 1000), doc_repeats(spark, sf_dir))
    return relations.repeats_of(both).withColumn("kind", F.lit("repeat")).unionByName(
        relations.segments_of(both).withColumn("kind", F.lit("segment"))
    )


@query(f"WITH {o.repeats(K)} {_R} WHERE k = 2")
def filter_by_seq_k(spark, sf_dir):
    return relations.filter_by_seq_k(doc_repeats(spark, sf_dir), k=2)


@query(f"WITH {o.repeats(K)} {_R} WHERE cnt >= 4")
def min_repeat_filter(spark, sf_dir):
    return relations.min_repeat_filter(doc_repeats(spark, sf_dir), 4)


# scalar functions

_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS m FROM documents"


@query(
    f"SELECT m, strpos(substr(m || m, 2), m) = length(m) AS is_primitive FROM ({_WORDS}) WHERE m <> ''",
    name="primitive_motif",
)
def primitive_motif_words(spark, sf_dir):
    m = words(spark, sf_dir).select(F.explode("w").alias("m")).where("m <> ''").distinct()
    return m.withColumn("is_primitive", primitive_motif("m"))


@query("""SELECT a, b, len([i FOR i IN range(1, length(a) + 1) IF substr(a, i, 1) = substr(b, i, 1)])::INTEGER AS n,
       len([i FOR i IN range(1, length(a) + 1) IF substr(a, i, 1) = substr(b, i, 1)]) >= length(a) - 1 AS close
FROM (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (
  SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(text, ' ') AS w FROM documents)))
WHERE length(a) = length(b) AND a <> ''""", name="match_count")
def match_count_words(spark, sf_dir):
    w = words(spark, sf_dir).where(F.size("w") > 1)
    pairs = w.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 2),
                lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")),
            )
        ).alias("p")
    ).select("p.a", "p.b")
    same = pairs.where((F.length("a") == F.length("b")) & (F.col("a") != "")).distinct()
    return same.withColumn("n", match_count("a", "b")).withColumn("close", units_match("a", "b", 1))


# repeat detection


@query(o.reading([2, 3], miss=1, policy="separate"))
def mismatch_repeats(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [2, 3], miss=1, policy="separate")


@query(o.reading([3, 2], miss=1, max_gap=1))
def linked_repeats(spark, sf_dir):
    """Ranges of 24 symbols that hand their reading state on, whatever the length of a run."""
    return read_linked(events(spark, sf_dir), Rule((3, 2), miss=1, max_gap=1), 24, 20)


@query(o.reading([1, 2, 3], max_gap=2, policy="separate"))
def gapped_repeats(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [1, 2, 3], max_gap=2, policy="separate")


@query(o.reading([1, 2], max_gap=2, max_gaps=1, policy="separate"))
def gap_limit(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [1, 2], max_gap=2, max_gaps=1, policy="separate")


@query(f"""WITH {o.regions(K)},
windows AS (SELECT *, unnest(range(a, a + len - k + 1)) AS pos FROM regions)
SELECT seq_id, seq_name, k, substr(seq, pos + 1, k) AS motif, pos::BIGINT AS pos, cnt::BIGINT AS cnt,
       (pos - k * ((pos - a) // k))::BIGINT AS start_pos, (pos + k * ((a + len - pos) // k) - 1)::BIGINT AS end_pos
FROM (SELECT *, (pos - a) // k + (a + len - pos) // k AS cnt FROM windows) WHERE cnt >= 3""")
def repeat_at_position(spark, sf_dir):
    d = docs(spark, sf_dir)
    every = d.where(F.length("seq") > 0).select(
        "seq_id", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"),
    ).withColumn("k", F.explode(F.array(*[F.lit(k) for k in K])))
    return exact.repeat_at_position(d, every, k_list=K)


@query(o.around([2, 3], miss=1, max_gap=1))
def tolerant_at_position(spark, sf_dir):
    e = events(spark, sf_dir)
    every = e.select(
        "seq_id", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("at"), "piece_start"
    ).select("seq_id", (F.col("piece_start") + F.col("at")).alias("pos"))
    every = every.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
    return tolerant.tolerant_at_position(e, every, Rule((2, 3), 3, 1, 1))


@query(o.ranked_candidates(RANKED))
def ranked_k_repeats(spark, sf_dir):
    return find_repeats(docs(spark, sf_dir), RANKED)


@query(o.ranked_candidates(K1))
def ranked_k_ascending(spark, sf_dir):
    return find_repeats(docs(spark, sf_dir), K1)


@query(o.reading([3, 2, 1]))
def ranked_k_events(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [3, 2, 1])


@query(o.reading([3, 2, 1], miss=1, max_gap=1))
def ranked_k_tolerant(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [3, 2, 1], miss=1, max_gap=1)


@query(o.reading([3, 2, 1], policy="position"))
def position_first_repeats(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [3, 2, 1], policy="position")


@query(o.reading([2, 1], policy="position", max_gap=1))
def position_first_gapped(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [2, 1], policy="position", max_gap=1)


@query(f"""WITH {o.repeats(K1)}, mask AS (SELECT * FROM repeats WHERE cnt >= 4), {o.merged('mask')}
{_R} r WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.seq_id = r.seq_id
  AND m.start_pos <= r.start_pos AND m.end_pos >= r.end_pos)""")
def uncovered_repeats(spark, sf_dir):
    mask = relations.min_repeat_filter(doc_repeats(spark, sf_dir, K1), 4)
    return exact.uncovered_repeats(docs(spark, sf_dir), mask, K)


@query(f"WITH {o.repeats([2])} SELECT seq_name, motif, cnt, start_pos FROM repeats", name="single_k_repeats")
def single_k_repeats_two(spark, sf_dir):
    return single_k_repeats(docs(spark, sf_dir), 2)


@query(f"""WITH {o.regions(K)}, phases AS (SELECT *, unnest(range(0, len % k + 1)) AS t FROM regions)
SELECT seq_id, seq_name, k, substr(seq, a + t + 1, k) AS motif, (len // k)::BIGINT AS cnt, (a + t)::BIGINT AS start_pos,
       (a + t + (len // k) * k - 1)::BIGINT AS end_pos FROM phases""")
def shifted_repeats(spark, sf_dir):
    return exact.shifted_repeats(docs(spark, sf_dir), K)


@query(o.reading([2, 3], miss=1, policy="separate", every_start=True))
def shifted_tolerant(spark, sf_dir):
    return find_repeats(events(spark, sf_dir), [2, 3], miss=1, policy="separate", every_start=True)


@query(f"WITH {o.repeats(K)} SELECT seq_name, motif, cnt, start_pos FROM repeats", name="get_repeats")
def get_repeats_all(spark, sf_dir):
    return get_repeats(docs(spark, sf_dir), RANKED)


@query(o.reading([2, 1], miss=0, max_gap=1, policy="separate", columns="seq_name, motif, cnt, start_pos"))
def get_repeats_gapped(spark, sf_dir):
    return get_repeats(events(spark, sf_dir), [2, 1], max_gap=1)


# chunks


@query(f"""WITH {o.DOCS}, cut AS (SELECT *, unnest(range(0, (length(seq) + 999) // 1000)) AS c FROM seqs)
SELECT seq_id, seq_name, c::BIGINT AS chunk_id, (c * 1000)::BIGINT AS chunk_start,
       substr(seq, c * 1000 + 1, 1006) AS chunk FROM cut""", name="chunk_sequences")
def chunk_sequences_thousand(spark, sf_dir):
    return chunk_sequences(docs(spark, sf_dir), 1000, halo=6)


_SPANNING = """
windows AS (SELECT r.*, c.cut, unnest(range(greatest(a, c.cut - k + 1), least(c.cut, a + len - k) + 1)) AS pos
            FROM regions r JOIN cuts c ON c.seq_id = r.seq_id AND c.cut >= r.a AND c.cut < r.a + r.len),
spanning AS (SELECT seq_id, seq_name, k, cut::BIGINT AS cut, substr(seq, pos + 1, k) AS motif, n::BIGINT AS cnt,
                    (pos - k * ((pos - a) // k))::BIGINT AS start_pos,
                    (pos + k * ((a + len - pos) // k) - 1)::BIGINT AS end_pos
             FROM (SELECT *, (pos - a) // k + (a + len - pos) // k AS n FROM windows) WHERE n >= 3
             QUALIFY row_number() OVER (PARTITION BY seq_id, cut, k, a ORDER BY pos) = 1)"""
_CUTS = f"cuts AS (SELECT seq_id, unnest(range({SEGMENT}, length(seq), {SEGMENT})) AS cut FROM seqs)"


@query(f"WITH {o.regions(K)}, {_CUTS}, {_SPANNING} SELECT * FROM spanning")
def cut_spanning_repeats(spark, sf_dir):
    d = docs(spark, sf_dir)
    cuts = chunk_sequences(d, SEGMENT).where("chunk_id > 0").select("seq_id", F.col("chunk_start").alias("cut"))
    return exact.cut_spanning_repeats(d, cuts, K)


@query(
    f"WITH {o.regions(K1, seqs=o.EVENTS)}, cuts AS (SELECT seq_id, (length(seq) - 1) // 2 AS cut FROM seqs), "
    f"{_SPANNING} SELECT * FROM spanning"
)
def midpoint_repeats(spark, sf_dir):
    """Repeats through the middle of each event string."""
    e = events(spark, sf_dir)
    last = e.groupBy("seq_id").agg(F.max(F.col("piece_start") + F.length("piece") - 1).alias("last"))
    cuts = last.select("seq_id", midpoint(F.lit(0), "last").alias("cut"))
    return exact.cut_spanning_repeats(e, cuts, K1)


@query(f"WITH {o.repeats(K)} {_R}")
def chunked_repeats(spark, sf_dir):
    return exact.chunked_repeats(docs(spark, sf_dir), K, size=256)


# intervals


@query(f"WITH {o.repeats(K1)}, {o.merged('repeats')} SELECT seq_id, start_pos, end_pos FROM merged")
def merge_intervals(spark, sf_dir):
    return intervals.merge_intervals(doc_repeats(spark, sf_dir, K1))


def _bitmaps(cells: str) -> str:
    return f"""bytes AS (SELECT seq_id, p // 32768 AS block, p % 32768 // 8 AS byte, sum(1 << (p % 8))::INTEGER AS v, count(*) AS n
  FROM ({cells}) GROUP BY ALL),
filled AS (SELECT seq_id, block, unnest(range(0, top + 1)) AS byte FROM (
  SELECT seq_id, block, max(byte) AS top FROM bytes GROUP BY ALL))
SELECT f.seq_id, f.block::BIGINT AS block, sum(coalesce(n, 0))::BIGINT AS covered, (sum(coalesce(n, 0)) / 32768.0)::DOUBLE AS density,
       string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY f.byte) AS bits
FROM filled f LEFT JOIN bytes b ON b.seq_id = f.seq_id AND b.block = f.block AND b.byte = f.byte GROUP BY f.seq_id, f.block"""


_CELLS = "SELECT seq_id, unnest(range(start_pos, end_pos + 1)) AS p FROM repeats"


@query(f"WITH {o.repeats(K1)}, {_bitmaps(f'SELECT DISTINCT * FROM ({_CELLS})')}")
def coverage_bitmaps(spark, sf_dir):
    return bitmaps.described(bitmaps.coverage_bitmaps(doc_repeats(spark, sf_dir, K1)))


@query(f"WITH {o.repeats(K1)}, {_bitmaps(f'{_CELLS} WHERE k > 3 EXCEPT {_CELLS} WHERE k <= 3')}")
def coverage_without(spark, sf_dir):
    long, short = (bitmaps.coverage_bitmaps(doc_repeats(spark, sf_dir, ks)) for ks in ([4, 5, 6], [1, 2, 3]))
    return bitmaps.described(bitmaps.without(long, short))


def _cut(n: int, seqs: str = "seqs") -> str:
    return f"""segs AS (SELECT seq_id, seq_name, c AS chunk_id, c * {n} AS seg_start,
  least(c * {n} + {n - 1}, length(seq) - 1) AS seg_end, substr(seq, c * {n} + 1, {n}) AS chunk
  FROM (SELECT *, unnest(range(0, (length(seq) + {n - 1}) // {n})) AS c FROM {seqs}))"""


_SEGS = _cut(SEGMENT)


@query(f"""WITH {o.repeats(K1)}, {o.merged('repeats')},
parts AS (SELECT seq_id, unnest(range(0, length(seq), 4))::BIGINT AS start_pos, length(seq) AS n FROM seqs)
SELECT seq_id, start_pos, least(start_pos + 3, n - 1)::BIGINT AS end_pos FROM parts p
WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.seq_id = p.seq_id AND m.start_pos <= p.start_pos
                  AND m.end_pos >= least(p.start_pos + 3, n - 1))""")
def uncovered_intervals(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.length("seq") > 0)
    parts = d.select("seq_id", F.length("seq").alias("n"), F.explode(F.expr("sequence(0, length(seq) - 1, 4)")).alias("s"))
    parts = parts.select(
        "seq_id", F.col("s").cast("long").alias("start_pos"),
        F.least(F.col("s") + 3, F.col("n") - 1).cast("long").alias("end_pos"),
    )
    return intervals.uncovered_intervals(parts, doc_repeats(spark, sf_dir, K1))


_PAIR = "s.seq_id = r.seq_id AND r.start_pos <= s.seg_end AND r.end_pos >= s.seg_start"


@query(f"""WITH {o.repeats(K1)}, {_SEGS}
SELECT s.seq_id, s.chunk_id::BIGINT AS chunk_id, r.motif, r.start_pos, r.end_pos,
       greatest(r.start_pos, s.seg_start)::BIGINT AS clip_start, least(r.end_pos, s.seg_end)::BIGINT AS clip_end
FROM segs s JOIN repeats r ON {_PAIR}""")
def clip_intervals(spark, sf_dir):
    r = doc_repeats(spark, sf_dir, K1).select("seq_id", "motif", "start_pos", "end_pos")
    pairs = intervals.overlap_join(doc_segments(spark, sf_dir), r, SEGMENT, "inner")
    return intervals.clip_intervals(pairs).select(
        "seq_id", "chunk_id", "motif", "start_pos", "end_pos", "clip_start", "clip_end"
    )


@query(f"""WITH {o.repeats(K1)}, {_SEGS}
SELECT s.seq_id, s.chunk_id::BIGINT AS chunk_id, s.seg_start::BIGINT AS seg_start, s.seg_end::BIGINT AS seg_end,
       r.motif, r.start_pos, r.end_pos
FROM segs s LEFT JOIN repeats r ON {_PAIR}""")
def segment_overlap_join(spark, sf_dir):
    r = doc_repeats(spark, sf_dir, K1).select("seq_id", "motif", "start_pos", "end_pos")
    segs = doc_segments(spark, sf_dir).select("seq_id", "chunk_id", "seg_start", "seg_end")
    return segments.segment_overlap_join(segs, r, SEGMENT)


_EXTENSIONS = """extensions AS (SELECT seq_id, chunk_id::BIGINT AS chunk_id, seg_start, seg_end, motif, start_pos, end_pos,
  CASE WHEN start_pos <= seg_start AND end_pos >= seg_start THEN
    coalesce(list_max([j FOR j IN range(0, k) IF end_pos - seg_start + j < length(chunk) AND
      substr(chunk, end_pos - seg_start + 2, j) = substr(motif, 1, j)]), 0) ELSE 0 END::BIGINT AS ext_after,
  CASE WHEN end_pos >= seg_end AND start_pos <= seg_end THEN
    coalesce(list_max([j FOR j IN range(0, k) IF start_pos - seg_start - j >= 0 AND
      substr(chunk, start_pos - seg_start - j + 1, j) = substr(motif, k - j + 1, j)]), 0) ELSE 0 END::BIGINT AS ext_before
FROM pairs)"""


def _extensions(cuts: str, segs: str) -> str:
    return f"""{cuts}, {_SPANNING}, {segs},
border AS (SELECT DISTINCT seq_id, motif, start_pos, end_pos FROM spanning),
pairs AS (SELECT s.*, r.motif, r.start_pos, r.end_pos, length(r.motif) AS k FROM segs s JOIN border r ON {_PAIR}),
{_EXTENSIONS}"""


@query(
    f"WITH {o.regions(K)}, {_extensions(_CUTS, _SEGS)} "
    "SELECT seq_id, chunk_id, motif, start_pos, end_pos, ext_after, ext_before FROM extensions"
)
def partial_unit_extension(spark, sf_dir):
    border = segments.border_repeats(docs(spark, sf_dir), SEGMENT, Rule(tuple(K)))
    pairs = intervals.overlap_join(
        doc_segments(spark, sf_dir), border.select("seq_id", "motif", "start_pos", "end_pos"), SEGMENT, "inner"
    )
    return intervals.partial_unit_extension(pairs).select(
        "seq_id", "chunk_id", "motif", "start_pos", "end_pos", "ext_after", "ext_before"
    )


def _masked(ks: list[int], size: int, seqs: str) -> str:
    """CTE ``seqs``: segments as sequences of their own, with the cells the mask covers."""
    cuts = f"cuts AS (SELECT seq_id, unnest(range({size}, length(seq), {size})) AS cut FROM seqs)"
    inner = f"""WITH {o.regions(sorted(ks), seqs=seqs)}, {_extensions(cuts, _cut(size))},
hidden AS (SELECT seq_id, chunk_id, unnest(range(greatest(start_pos - ext_before - seg_start, 0),
                  least(end_pos + ext_after, seg_end) - seg_start + 1))::BIGINT AS cell FROM extensions)
SELECT s.seq_id * 1000000 + s.chunk_id AS seq_id, any_value(s.seq_name) AS seq_name, any_value(chunk) AS seq,
       coalesce(list(DISTINCT cell) FILTER (cell IS NOT NULL), []::BIGINT[]) AS cells
FROM segs s LEFT JOIN hidden h ON h.seq_id = s.seq_id AND h.chunk_id = s.chunk_id GROUP BY s.seq_id, s.chunk_id"""
    return f"seqs AS ({inner})"


def _back(size: int) -> str:
    at = f"{size} * (seq_id % 1000000)"
    return (
        "(seq_id // 1000000)::BIGINT AS seq_id, seq_name, k, motif, cnt, "
        f"(start_pos + {at})::BIGINT AS start_pos, (end_pos + {at})::BIGINT AS end_pos"
    )


@query(
    o.reading(
        [3, 2, 1], seqs=_masked([3, 2, 1], 12, o.EVENTS), columns=_back(12),
        covered="array_to_string([CASE WHEN list_contains(cells, c) THEN '1' ELSE '0' END "
        "FOR c IN range(0, length(seq))], '')",
    )
)
def masked_segment_scan(spark, sf_dir):
    return segments.masked_segment_scan(events(spark, sf_dir), 12, Rule((3, 2, 1)))


@query(
    o.ranked_candidates(
        RANKED, seqs=_masked(RANKED, SEGMENT, o.DOCS), columns=_back(SEGMENT),
        before="SELECT seq_id, cells FROM seqs WHERE seq_id IN (SELECT seq_id FROM queue)",
    )
)
def masked_document_scan(spark, sf_dir):
    return segments.masked_segment_scan(docs(spark, sf_dir), SEGMENT, Rule(tuple(RANKED)))


_TWO = Rule((2, 3), 3, 1, 1)


def _event_cuts(size: int) -> str:
    return f"{o.EVENTS}, cuts AS (SELECT seq_id, unnest(range({size}, length(seq), {size}))::BIGINT AS cut FROM seqs)"


# windows over a cut from left to right; a run within the one before is a rotation of it
_RUNS_OVER_CUTS = f"""runs AS ({o.around([2, 3], miss=1, max_gap=1)}), {_event_cuts(12)},
over_cut AS (SELECT r.*, c.cut, row_number() OVER (PARTITION BY c.seq_id, c.cut, r.k ORDER BY r.pos) AS j
             FROM cuts c JOIN runs r ON r.seq_id = c.seq_id AND r.pos <= c.cut AND r.pos + r.k > c.cut),
left_to_right AS (
  SELECT *, TRUE AS keep, end_pos - k + 1 AS rightmost FROM over_cut WHERE j = 1
  UNION ALL
  SELECT w.*, w.start_pos > f.rightmost,
         CASE WHEN w.start_pos > f.rightmost THEN w.end_pos - w.k + 1 ELSE f.rightmost END
  FROM left_to_right f JOIN over_cut w ON w.seq_id = f.seq_id AND w.cut = f.cut AND w.k = f.k AND w.j = f.j + 1),
spanning AS (SELECT seq_id, seq_name, k, cut, motif, cnt, start_pos, end_pos FROM left_to_right WHERE keep)"""


@query(f"WITH RECURSIVE {_RUNS_OVER_CUTS} SELECT * FROM spanning")
def cut_spanning_tolerant(spark, sf_dir):
    """Repeats over cuts with one mismatch per unit and gaps of one."""
    e = events(spark, sf_dir)
    cuts = chunk_sequences(e, 12).where("chunk_id > 0").select("seq_id", F.col("chunk_start").alias("cut"))
    return tolerant.cut_spanning_runs(e, cuts, _TWO)


_MASKED_TWO = f"""seqs AS (WITH RECURSIVE {_RUNS_OVER_CUTS}, {_cut(12)},
border AS (SELECT DISTINCT seq_id, motif, start_pos, end_pos FROM spanning),
pairs AS (SELECT s.*, r.motif, r.start_pos, r.end_pos, length(r.motif) AS k FROM segs s JOIN border r ON {_PAIR}),
{_EXTENSIONS},
hidden AS (SELECT seq_id, chunk_id, unnest(range(greatest(start_pos - ext_before - seg_start, 0),
                  least(end_pos + ext_after, seg_end) - seg_start + 1))::BIGINT AS cell FROM extensions)
SELECT s.seq_id * 1000000 + s.chunk_id AS seq_id, any_value(s.seq_name) AS seq_name, any_value(chunk) AS seq,
       coalesce(list(DISTINCT cell) FILTER (cell IS NOT NULL), []::BIGINT[]) AS cells
FROM segs s LEFT JOIN hidden h ON h.seq_id = s.seq_id AND h.chunk_id = s.chunk_id GROUP BY s.seq_id, s.chunk_id)"""
_CELLS = (
    "array_to_string([CASE WHEN list_contains(cells, c) THEN '1' ELSE '0' END FOR c IN range(0, length(seq))], '')"
)
_MASKED_TWO_SCAN = o.reading([2, 3], miss=1, max_gap=1, seqs=_MASKED_TWO, columns=_back(12), covered=_CELLS)


@query(_MASKED_TWO_SCAN)
def masked_tolerant_scan(spark, sf_dir):
    """Segments scanned with one mismatch and gap, the repeats over their borders masked."""
    return segments.masked_segment_scan(events(spark, sf_dir), 12, _TWO)


@query(
    f"SELECT {o.REPEAT} FROM ({_MASKED_TWO_SCAN}) UNION ALL "
    f"SELECT DISTINCT {o.REPEAT} FROM (WITH RECURSIVE {_RUNS_OVER_CUTS} SELECT * FROM spanning)"
)
def split_repeats_tolerant(spark, sf_dir):
    return segments.split_repeats(events(spark, sf_dir), 12, _TWO)


@query(
    f"SELECT {o.REPEAT} FROM ({ORACLES['masked_document_scan']}) UNION ALL "
    f"SELECT DISTINCT {o.REPEAT} FROM (WITH {o.regions(sorted(RANKED))}, {_CUTS}, {_SPANNING} SELECT * FROM spanning)"
)
def split_repeats(spark, sf_dir):
    """Documents in segments: border repeats, and what the segments hold beside them."""
    return segments.split_repeats(docs(spark, sf_dir), SEGMENT, Rule(tuple(RANKED)))


@query(f"""WITH found AS ({o.reading([2, 3], miss=1, max_gap=1, policy="separate")}),
{o.repeats(K1, seqs=o.EVENTS)}, mask AS (SELECT * FROM repeats WHERE cnt >= 4), {o.merged('mask')}
SELECT {o.REPEAT} FROM found r WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.seq_id = r.seq_id
  AND m.start_pos <= r.start_pos AND m.end_pos >= r.end_pos)""")
def uncovered_tolerant(spark, sf_dir):
    e = events(spark, sf_dir)
    mask = relations.min_repeat_filter(exact.exact_repeats(e, K1), 4)
    return tolerant.uncovered_runs(e, mask, _TWO)


_ORDER = "start_pos, end_pos DESC, k DESC, motif"


@query(f"""WITH {o.repeats(K1)} SELECT {o.REPEAT} FROM (
SELECT *, lag(end_pos) OVER (PARTITION BY seq_id ORDER BY {_ORDER}) AS prev FROM repeats)
WHERE prev IS NULL OR end_pos > prev""")
def drop_contained(spark, sf_dir):
    return intervals.drop_contained(doc_repeats(spark, sf_dir, K1))


@query(f"""WITH {o.repeats(K1)} SELECT {o.REPEAT} FROM (
SELECT *, max(end_pos) OVER (PARTITION BY seq_id ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS far FROM repeats) WHERE far IS NULL OR end_pos > far""")
def drop_contained_running(spark, sf_dir):
    return intervals.drop_contained(doc_repeats(spark, sf_dir, K1), running=True)


@query(f"""WITH {o.repeats(K1)} SELECT {o.REPEAT} FROM (
SELECT *, lag(end_pos, 1, 0) OVER (ORDER BY seq_id, {_ORDER}) AS prev FROM repeats) WHERE end_pos > prev""")
def drop_contained_global(spark, sf_dir):
    return intervals.drop_contained_global(doc_repeats(spark, sf_dir, K1))


# counts, order, union, SQL function


@query(f"WITH {o.repeats(K)} SELECT count(*)::BIGINT AS n FROM repeats")
def count_repeats(spark, sf_dir):
    return relations.count_repeats(doc_repeats(spark, sf_dir))


@query(f"WITH {o.repeats(K)} SELECT seq_id, count(*)::BIGINT AS n FROM repeats GROUP BY seq_id")
def count_per_seq(spark, sf_dir):
    return relations.count_per_seq(doc_repeats(spark, sf_dir))


@query(
    f"WITH {o.repeats(K1)} SELECT {o.REPEAT}, (row_number() OVER (ORDER BY seq_id, {_ORDER}))::BIGINT AS rank FROM repeats"
)
def sorted_repeats(spark, sf_dir):
    return relations.sorted_repeats(doc_repeats(spark, sf_dir, K1))


@query(f"WITH {o.repeats(K)} {_R} WHERE k = 2 UNION ALL {_R} WHERE k = 3 UNION ALL {_R} WHERE k < 4")
def union_repeats(spark, sf_dir):
    return relations.union_repeats(
        doc_repeats(spark, sf_dir, [2]), doc_repeats(spark, sf_dir, [3]), doc_repeats(spark, sf_dir, [2, 3])
    )


@query(f"WITH {o.repeats(K)} SELECT seq_id, k, motif, cnt, start_pos, end_pos FROM repeats")
def udtf_repeats(spark, sf_dir):
    udtf.register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("stutter_docs")
    return spark.sql(
        "SELECT d.seq_id, r.* FROM stutter_docs d, "
        "LATERAL tandem_repeats(d.seq, array(2, 3, 4, 5, 6), 3, 0, 0, 'separate') r"
    )


# -- contract -----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Exact repeats of the documents, motif lengths 2 to 6."""
    return exact_repeats(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the optional subpackage; none where it has been removed."""
    try:
        import stutter.llm.queries as extra
    except ModuleNotFoundError as e:
        if e.name not in ("stutter.llm", "stutter.llm.queries", "corpus_pipeline"):
            raise
        return {}, {}
    return extra.QUERIES, extra.ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return ORACLES | _training_data()[1]
