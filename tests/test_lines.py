"""Text in, text out."""

import pytest
from pyspark.sql import functions as F

from stutter import find_repeats, mine_file
from stutter.functions import udtf
from stutter.operators import blocks, exact, relations
from stutter.plans import mine
from stutter.sources import lines, sinks
from stutter.sources.chunks import chunk_sequences

FASTA = [">one", "acacac", "acxx", "", ">two", ">three", "gg", "gg", "ab>b", "abababab"]


def write(tmp_path, files):
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    return str(tmp_path)


@pytest.mark.parametrize("few", [100_000, 0])
def test_read_lines_over_files_and_splits(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(lines, "_FEW_SPLITS", few)
    rows = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    folder = write(tmp_path, {"a.txt": rows[:100], "b.txt": rows[100:3000], "c.txt": rows[3000:]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = lines.read_lines(spark, folder)
        assert df.rdd.getNumPartitions() > 8
        assert [r.value for r in df.orderBy("line_no").collect()] == rows
        assert sorted(r.line_no for r in df.collect()) == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_and_ordinals(spark, tmp_path):
    folder = write(tmp_path, {"a.fa": FASTA})
    body = [v for v in FASTA if not v.startswith(">")]
    got = {r.seq_id: (r.seq_name, r.seq) for r in lines.read_records(spark, folder).collect()}
    assert got == {i: (f"seq{i}", v) for i, v in enumerate(body)}
    strict = lines.read_records(spark, folder, header="contains").orderBy("seq_id").collect()
    assert [r.seq for r in strict] == [v for v in FASTA if ">" not in v]
    heads = lines.header_lines(lines.read_lines(spark, folder)).orderBy("line_no").collect()
    assert [r.value for r in heads] == [">one", ">two", ">three"]
    with pytest.raises(ValueError):
        lines.is_header("other")


@pytest.mark.parametrize("block,fan", [(1, 2), (1, 3), (3, 4), (1000, 4096)])
def test_stitch(spark, block, fan):
    df = spark.createDataFrame(list(enumerate(["stray"] + FASTA)), "line_no long, value string")
    got = chunk_sequences(lines.stitch_pieces(df, block=block, fan=fan), 1000).collect()
    assert {r.seq_id: (r.seq_name, r.chunk) for r in got} == {
        -1: ("seq0", "stray"), 0: (">one", "acacacacxx"), 2: (">three", "ggggab>babababab"),
    }
    glued = "stray" + "".join(v for v in FASTA if not v.startswith(">"))
    parts = chunk_sequences(lines.stitch_pieces(df, by=None, block=block, fan=fan), 4).orderBy("chunk_id").collect()
    assert [r.chunk for r in parts] == [glued[i : i + 4] for i in range(0, len(glued), 4)]


def test_symbols(spark):
    rows = [(i % 3 if i % 2 else 0, i, ("click", "cancel", "call")[i * i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "u long, t long, s string").repartition(5)
    symbols = lines.symbols_of(df, "s")
    assert sorted(symbols) == list(symbols) and len(set(symbols.values())) == len(symbols)
    got = lines.symbol_pieces(df, "u", ["t"], F.col("s"), size=16, symbols=symbols)
    assert all(len(r.piece) <= 16 for r in got.collect())
    whole = {r.seq_id: r.chunk for r in chunk_sequences(got, 1000).collect()}
    want = {}
    for u, _, s in rows:
        want[u] = want.get(u, "") + symbols[s]
    assert whole == want


@pytest.mark.parametrize("bad,symbols", [(None, {"x": "X"}), ("new", {"x": "X"}), ("", None), (None, None), ("xy", None)])
def test_values_without_a_symbol_stop_the_job(spark, bad, symbols):
    df = spark.createDataFrame([(0, 0, "x"), (0, 1, bad), (0, 2, "x")], "u long, t long, s string")
    with pytest.raises(Exception, match="not one symbol"):
        lines.symbol_pieces(df, "u", ["t"], F.col("s"), symbols=symbols).collect()
    if bad is None:
        got = lines.symbol_pieces(df, "u", ["t"], F.col("s"), symbols=symbols, skip_null=True)
        assert got.first().piece == ("XX" if symbols else "xx")


def test_names(spark):
    seqs = spark.createDataFrame([(0, "seq0", "aa"), (1, "seq1", "bb"), (2, "seq2", "")], "seq_id long, seq_name string, seq string")
    names = spark.createDataFrame([(0, ">x"), (1, ">y"), (9, ">z")], "ordinal long, name string")
    assert sorted(tuple(r) for r in lines.name_lookup(seqs, names).collect()) == [
        (0, ">x", "aa"), (1, ">y", "bb"), (2, "seq2", ""),
    ]
    with pytest.raises(Exception, match="several names"):
        lines.name_lookup(seqs, names.union(names)).collect()


def test_text_of_a_repeat_is_one_line(spark, tmp_path):
    df = spark.createDataFrame([(0, "a\\b", 2, "x\n", 3, 0, 5)], exact.REPEAT_SCHEMA)
    sinks.write_text(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["(0,a\\\\b,x\\n,3,0,5)"]


def test_mine_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = write(tmp_path / "in", {"a.fa": FASTA})
    mine_file(spark, folder, str(tmp_path / "out"), (2,), single_file=True)
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["(0,seq0,ac,3,0,5)", "(6,seq6,ab,4,0,7)"]
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    mine_file(spark, folder, str(tmp_path / "out2"), (2,), stitch=True, form="parquet")
    rows = spark.read.parquet(str(tmp_path / "out2")).collect()
    assert sorted((r.seq_name, r.motif, r.cnt, r.start_pos, r.end_pos) for r in rows) == [
        (">one", "ac", 4, 0, 7), (">three", "ba", 4, 7, 14),
    ]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = write(tmp_path / "in", {"a.txt": ["abcabdabcabdabcabc", "acacacac", "aaaaaa"]})
    mine.main([folder, str(tmp_path / "out"), "--k", "3,2,1", "--miss", "1", "--max-gaps", "5", "--split", "8",
               "--drop-contained", "--sorted", "--form", "parquet"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert (0, "abc", 0, 17) in [(r.seq_id, r.motif, r.start_pos, r.end_pos) for r in got.collect()]
    mine.main([folder, str(tmp_path / "all"), "--k", "2", "--every-start", "--size", "4", "--policy", "separate"])
    assert spark.read.text(str(tmp_path / "all")).count() == 1
    with pytest.raises(TypeError, match="size"):
        mine_file(spark, folder, str(tmp_path / "no"), (2,), split=8, size=4)


def test_folders(spark, tmp_path):
    first, second = blocks.scratch(spark, "x"), blocks.scratch(spark, "x")
    assert first != second and first.startswith(blocks.shared_folder(spark))

    class Cluster:
        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        blocks.shared_folder(Cluster)


def test_relations(spark):
    empty = spark.createDataFrame([], "seq_id long, seq_name string, seq string")
    assert find_repeats(empty, (2,)).count() == 0
    seqs = spark.createDataFrame([(4, "x", "ababab"), (5, "y", "aaaa")], empty.schema)
    found = find_repeats(seqs, (2, 1), policy="separate")
    assert relations.filter_by_seq_k(found, seq_id=4, k=2).count() == 1
    assert relations.filter_by_seq_k(found, seq_id=5, k=2).count() == 0
    assert relations.min_repeat_filter(found, 4).count() == 1
    assert relations.union_repeats(found, found).count() == 2 * found.count()
    both = relations.tagged(chunk_sequences(seqs, 3), found)
    assert relations.segments_of(both).count() == 4 and relations.repeats_of(both).count() == 2
    assert [tuple(r) for r in relations.work_rows(seqs).orderBy("seq_id").collect()] == [
        (4, "x", "ababab", 0, 0, 5), (5, "y", "aaaa", 0, 0, 3),
    ]
    assert sorted(r.value for r in sinks.format_repeats(found).collect()) == ["(4,x,ab,3,0,5)", "(5,y,a,4,0,3)"]
    ranks = relations.sorted_repeats(found).orderBy("rank").collect()
    assert [(r.seq_id, r["rank"]) for r in ranks] == [(4, 1), (5, 2)]


def test_sql_function(spark):
    udtf.register(spark)
    got = spark.sql(
        "SELECT r.* FROM VALUES ('abcXabcabcXabc!'), (null) t(s), "
        "LATERAL tandem_repeats(t.s, array(3), 3, 0, 1, 'ranked') r"
    ).collect()
    assert [tuple(r) for r in got] == [(3, "abc", 4, 0, 13)]
