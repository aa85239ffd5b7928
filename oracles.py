"""SQL for the driver's check: each query of ``__spark_entry__`` said again for DuckDB.

None of it shares logic with the Spark side: exact repeats come from window
functions over characters, reading rules from recursive queries that move one
unit at a time.
"""

from __future__ import annotations

DOCS = (
    "seqs AS (SELECT doc_id::BIGINT AS seq_id, 'seq' || doc_id AS seq_name, text AS seq "
    "FROM documents WHERE text IS NOT NULL)"
)
EVENTS = (
    "seqs AS (SELECT user_id::BIGINT AS seq_id, 'seq' || user_id AS seq_name, "
    "string_agg(chr(64 + symbol::INTEGER), '' ORDER BY ts, event_id) AS seq FROM ("
    "SELECT *, dense_rank() OVER (ORDER BY event_type) AS symbol FROM events) GROUP BY user_id)"
)
# documents as FASTA lines: a header, then the lines of the text
FASTA = (
    "fasta AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS value FROM ("
    "SELECT doc_id, list_concat(['>doc' || doc_id || ' ' || lang], string_split(text, chr(10))) AS parts "
    "FROM documents))"
)
HTML = (
    "html_lines AS (SELECT page_id::BIGINT AS page_id, unnest(range(0, len(parts)))::BIGINT AS i, "
    "unnest(parts) AS value FROM (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages))"
)
REPEAT = "seq_id, seq_name, k, motif, cnt, start_pos, end_pos"


def regions(ks, min_repeat: int = 3, seqs: str = DOCS, primitive: bool = True) -> str:
    """CTEs ``seqs, chars, steps, islands, regions`` for exact repeats."""
    leads = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in ks)
    same = " UNION ALL ".join(f"SELECT seq_id, {k} AS k, p FROM leads WHERE c = c{k}" for k in ks)
    return f"""{seqs},
chars AS (SELECT seq_id, unnest(string_split(seq, '')) AS c,
                 unnest(range(0, len(string_split(seq, '')))) AS p FROM seqs WHERE seq <> ''),
leads AS (SELECT seq_id, p, c, {leads} FROM chars WINDOW w AS (PARTITION BY seq_id ORDER BY p)),
same AS ({same}),
islands AS (SELECT seq_id, k, min(p) AS a, count(*) AS m FROM (
              SELECT seq_id, k, p, p - row_number() OVER (PARTITION BY seq_id, k ORDER BY p) AS g FROM same)
            GROUP BY seq_id, k, g HAVING count(*) >= {min_repeat - 1} * k),
regions AS (SELECT * FROM (
              SELECT i.seq_id, s.seq_name, i.k::INTEGER AS k, substr(s.seq, i.a + 1, i.k) AS motif, i.a, i.m + i.k AS len, s.seq
              FROM islands i JOIN seqs s USING (seq_id))
            WHERE {"strpos(substr(motif || motif, 2), motif) = length(motif)" if primitive else "TRUE"})"""


def repeats(ks, min_repeat: int = 3, seqs: str = DOCS, primitive: bool = True) -> str:
    return f"""{regions(ks, min_repeat, seqs, primitive)},
repeats AS (SELECT seq_id, seq_name, k, motif, (len // k)::BIGINT AS cnt, a::BIGINT AS start_pos,
                   (a + (len // k) * k - 1)::BIGINT AS end_pos FROM regions)"""


def merged(source: str, name: str = "merged") -> str:
    return f"""{name} AS (SELECT seq_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (
  SELECT *, sum(opens) OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM {source}))
  GROUP BY seq_id, g)"""


def ranked_candidates(
    ks, min_repeat: int = 3, seqs: str = DOCS, before: str = "SELECT DISTINCT seq_id, []::BIGINT[] AS cells FROM queue",
    columns: str = REPEAT,
) -> str:
    """Competing lengths, one candidate at a time, with the covered cells as a list.

    ``before`` gives the cells that are covered from the start.
    """
    rank = " ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(ks))
    phase = "[t FOR t IN range(0, len % k + 1) IF NOT list_has_all(cells, range(a + t, a + t + (len // k) * k))][1]"
    return f"""WITH RECURSIVE {regions(sorted(ks), min_repeat, seqs)},
queue AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY CASE k {rank} END, a) AS i FROM regions),
fold AS (
  SELECT seq_id, 0::BIGINT AS i, NULL::BIGINT AS t, cells FROM ({before})
  UNION ALL
  SELECT seq_id, i, t, CASE WHEN t IS NULL THEN cells
                            ELSE list_concat(cells, range(a + t, a + t + (len // k) * k)) END
  FROM (SELECT q.seq_id, q.i, q.a, q.k, q.len, f.cells, {phase} AS t
        FROM fold f JOIN queue q ON q.seq_id = f.seq_id AND q.i = f.i + 1))
SELECT {columns} FROM (
  SELECT q.seq_id, q.seq_name, q.k, substr(q.seq, q.a + f.t + 1, q.k) AS motif, (q.len // q.k)::BIGINT AS cnt,
         (q.a + f.t)::BIGINT AS start_pos, (q.a + f.t + (q.len // q.k) * q.k - 1)::BIGINT AS end_pos
  FROM fold f JOIN queue q USING (seq_id, i) WHERE f.t IS NOT NULL)"""


def _fits(at: str, miss: int) -> str:
    return (
        f"(CASE WHEN {at} >= 0 AND {at} + k <= n "
        f"THEN hamming(substr(s, {at} + 1, k), substr(s, pos + 1, k)) <= {miss} ELSE FALSE END)"
    )


def _jump(miss: int, max_gap: int, max_gaps: int) -> str:
    """Gap before the next unit to the right of ``cur``; null when there is none."""
    first = "".join(
        f" WHEN gap = 0 AND used < {max_gaps} AND {_fits(f'cur + {g}', miss)} THEN {g}"
        for g in range(1, max_gap + 1)
    )
    later = f" WHEN gap > 0 AND used < {max_gaps} AND cur + gap + k < n AND {_fits('cur + gap', miss)} THEN gap"
    return f"CASE WHEN cur + k > n THEN NULL WHEN {_fits('cur', miss)} THEN 0{first}{later if max_gap else ''} END"


def reading(
    ks, min_repeat: int = 3, miss: int = 0, max_gap: int = 0, max_gaps: int = 10_000_000,
    policy: str = "ranked", every_start: bool = False, seqs: str = EVENTS, columns: str = REPEAT,
    covered: str = "repeat('0', length(seq))", source: str = "seqs",
) -> str:
    """Left to right reading as a recursive query; every round moves one unit."""
    ks = list(ks)
    by_position = policy == "position"
    stop = "pos >= n" if by_position else f"ki > {len(ks)}"
    fresh = "substr(s, pos + 1, k)"
    report = f"(moves = 'end' AND cnt >= {min_repeat}" + (
        ")" if by_position else " AND contains(substr(cov, pos + 1, cur - pos), '0'))"
    )
    if by_position:
        fail_pos = f"CASE WHEN ki < {len(ks)} THEN pos ELSE pos + 1 END"
        fail_ki = f"CASE WHEN ki < {len(ks)} THEN ki + 1 ELSE 1 END"
        past_pos, past_ki, past_cov = fail_pos, fail_ki, "cov"
        hit_ki = "1"
    else:
        fail_pos, fail_ki = "pos + 1", "ki"
        past_pos, past_ki = "0", "ki + 1"
        past_cov = "cov" if policy == "ranked" else "repeat('0', n)"
        hit_ki = "ki"
    hit_pos = "pos + 1" if every_start else "cur - k"
    hit_cov = "cov" if by_position else (
        "substr(cov, 1, pos) || repeat('1', cur - pos) || substr(cov, cur + 1)"
    )
    return f"""WITH RECURSIVE {seqs},
walk AS (
  SELECT seq_id, seq_name, seq AS s, length(seq)::BIGINT AS n, 1::BIGINT AS ki, 0::BIGINT AS pos,
         {covered} AS cov, 0::BIGINT AS cnt, 0::BIGINT AS cur, 0::BIGINT AS gap, 0::BIGINT AS used,
         FALSE AS hit, 0::BIGINT AS hk, 0::BIGINT AS hcnt, 0::BIGINT AS hpos, 0::BIGINT AS hend
  FROM {source}
  UNION ALL
  SELECT seq_id, seq_name, s, n,
         (CASE WHEN hit_now THEN {hit_ki} WHEN moves = 'past' THEN {past_ki}
              WHEN moves IN ('skip', 'end') THEN {fail_ki} ELSE ki END)::BIGINT,
         (CASE WHEN hit_now THEN {hit_pos} WHEN moves = 'past' THEN {past_pos}
              WHEN moves IN ('skip', 'end') THEN {fail_pos} ELSE pos END)::BIGINT,
         CASE WHEN hit_now THEN {hit_cov} WHEN moves = 'past' THEN {past_cov} ELSE cov END,
         (CASE WHEN moves = 'seed' THEN 1 WHEN moves = 'unit' THEN cnt + 1 ELSE 0 END)::BIGINT,
         (CASE WHEN moves = 'seed' THEN pos + k WHEN moves = 'unit' THEN cur + jump + k ELSE 0 END)::BIGINT,
         (CASE WHEN moves = 'unit' AND jump > 0 THEN jump WHEN moves = 'unit' THEN gap ELSE 0 END)::BIGINT,
         (CASE WHEN moves = 'unit' AND jump > 0 THEN used + 1 WHEN moves = 'unit' THEN used ELSE 0 END)::BIGINT,
         hit_now, k::BIGINT, cnt, pos, cur - 1
  FROM (SELECT *, {report} AS hit_now FROM (
    SELECT *, CASE WHEN pos + k > n THEN 'past'
                   WHEN cnt = 0 AND strpos(substr({fresh} || {fresh}, 2), {fresh}) <> k THEN 'skip'
                   WHEN cnt = 0 THEN 'seed'
                   WHEN jump IS NULL THEN 'end' ELSE 'unit' END AS moves
    FROM (SELECT *, CASE WHEN cnt = 0 THEN NULL ELSE {_jump(miss, max_gap, max_gaps)} END AS jump
          FROM (SELECT * EXCLUDE (hit, hk, hcnt, hpos, hend), ({ks}::BIGINT[])[ki] AS k
                FROM walk WHERE NOT ({stop})))))
)
SELECT {columns} FROM (
  SELECT seq_id, seq_name, hk::INTEGER AS k, substr(s, hpos + 1, hk) AS motif, hcnt AS cnt,
         hpos AS start_pos, hend AS end_pos FROM walk WHERE hit)"""


def around(ks, min_repeat: int = 3, miss: int = 0, max_gap: int = 0, seqs: str = EVENTS) -> str:
    """The run through every position: first to the left, then to the right."""
    gaps = 10_000_000
    left_first = "".join(
        f" WHEN gap = 0 AND used < {gaps} AND {_fits(f'low - k - {g}', miss)} THEN {g}" for g in range(1, max_gap + 1)
    )
    left_later = f" WHEN gap > 0 AND used < {gaps} AND {_fits('low - k - gap', miss)} THEN gap" if max_gap else ""
    left = f"CASE WHEN low - k < 0 THEN NULL WHEN {_fits('low - k', miss)} THEN 0{left_first}{left_later} END"
    word = "substr(s, pos + 1, k)"
    return f"""WITH RECURSIVE {seqs},
walk AS (
  SELECT * FROM (
    SELECT seq_id, seq_name, seq AS s, length(seq)::BIGINT AS n, k::BIGINT AS k,
           unnest(range(0, length(seq)))::BIGINT AS pos, 0 AS stage
    FROM seqs, (SELECT unnest({list(ks)}) AS k)) b,
    LATERAL (SELECT b.pos AS low, b.pos + b.k AS cur, 1::BIGINT AS cnt, 0::BIGINT AS gap, 0::BIGINT AS used)
  WHERE pos + k <= n AND strpos(substr({word} || {word}, 2), {word}) = k
  UNION ALL
  SELECT seq_id, seq_name, s, n, k, pos, CASE WHEN jump IS NULL THEN stage + 1 ELSE stage END,
         (CASE WHEN stage = 0 AND jump IS NOT NULL THEN low - k - jump ELSE low END)::BIGINT,
         (CASE WHEN stage = 1 AND jump IS NOT NULL THEN cur + k + jump ELSE cur END)::BIGINT,
         (CASE WHEN jump IS NOT NULL THEN cnt + 1 ELSE cnt END)::BIGINT,
         (CASE WHEN jump > 0 THEN jump ELSE gap END)::BIGINT,
         (CASE WHEN jump > 0 THEN used + 1 ELSE used END)::BIGINT
  FROM (SELECT *, CASE WHEN stage = 0 THEN {left} ELSE {_jump(miss, max_gap, gaps)} END AS jump
        FROM walk WHERE stage < 2)
)
SELECT seq_id, seq_name, k::INTEGER AS k, substr(s, pos + 1, k) AS motif, pos, cnt, low AS start_pos,
       cur - 1 AS end_pos FROM walk WHERE stage = 2 AND cnt >= {min_repeat}"""
