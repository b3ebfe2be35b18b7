"""Readers on small files, and streams on a folder of them."""

import gzip
import json

from tessera.sources import readers as R
from tessera.streaming import windows


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("iris_0", 5.1, 3.5), ("iris_1", 4.9, 3.0)], "obs string, a double, b double")
    for name, compression in (("t.tsv", None), ("t.csv", "gzip"), ("t.parquet", None)):
        R.write_dataframe(df, str(tmp_path / name), compression)
        assert sorted(map(tuple, R.read_dataframe(spark, str(tmp_path / name)).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "w.tsv").write_text("id\tx\ty\no1\t1\t2\n")
    assert {(r.obs, r.attr, r.v) for r in R.read_wide(spark, str(tmp_path / "w.tsv")).collect()} == {("o1", "x", 1.0), ("o1", "y", 2.0)}


def test_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "s.fa.gz", "wt") as f:
        f.write(">s1 first\nacgt\nAC\n>s2\nTT\n")
    got = {r.seq_id: r.seq for r in R.read_fasta(spark, str(tmp_path / "s.fa.gz")).collect()}
    assert got == {"s1": "ACGTAC", "s2": "TT"}
    R.write_fasta(R.read_fasta(spark, str(tmp_path / "s.fa.gz")), str(tmp_path / "out"))
    assert {r.seq_id for r in R.read_fasta(spark, str(tmp_path / "out")).collect()} == {"s1", "s2"}


def test_blast_and_annotations(spark, tmp_path):
    (tmp_path / "b.m8").write_text("q\ts\t99\t10\t0\t0\t1\t9\t1\t9\t1e-5\t50\nq\tt\t80\t10\t0\t0\t1\t9\t1\t9\t1e-5\t70\n")
    lengths = spark.createDataFrame([("q", 16)], "qseqid string, qlength int")
    rows = R.read_blast(spark, str(tmp_path / "b.m8"), query_lengths=lengths).collect()
    assert [r.sseqid for r in rows] == ["t", "s"] and rows[0].qratio == 0.5
    (tmp_path / "a.gff").write_text("#x\nc1\tsrc\tgene\t1\t9\t.\t+\t0\tID=g1;Name=n;\n")
    assert R.read_gff(spark, str(tmp_path / "a.gff")).head().fields == {"ID": "g1", "Name": "n"}
    (tmp_path / "a.gtf").write_text('c1\tsrc\texon\t1\t9\t.\t+\t0\tgene_id "g1"; note "a b";\n')
    assert R.read_gff(spark, str(tmp_path / "a.gtf"), "gtf", "exon").head().fields == {"gene_id": "g1", "note": "a b"}


def test_nested_json_and_records(spark, tmp_path):
    tree = {"name": "r", "children": [{"name": "A", "children": [{"name": "B", "children": [{"name": "C", "children": [{"name": "K00001 x; enzyme"}, {"name": "M00002 module name"}]}]}]}]}
    (tmp_path / "k.json").write_text(json.dumps(tree))
    got = {r.id: r.name for r in R.read_hierarchy_json(spark, str(tmp_path / "k.json")).collect()}
    assert got == {"K00001": "enzyme", "M00002": "module name"}
    (tmp_path / "m.flat").write_text("ENTRY       M1\nORTHOLOGY   K1 one\n            K2 two\nDEFINITION  (K1+K2) K3\n///\n")
    got = {r.section: r["values"] for r in R.read_module_record(spark, str(tmp_path / "m.flat")).collect()}
    assert got["ORTHOLOGY"] == ["K1 one", "K2 two"] and got["ENTRY"] == ["M1"]
    d = spark.createDataFrame([("(K1+K2) K3-K4,K1",)], "d string")
    assert d.select(R.ortholog_set("d").alias("s")).head().s == ["K1", "K2", "K3", "K4"]
    m = spark.createDataFrame([("M1", ["K1", "M2"]), ("M2", ["K2", "R9"])], "module string, members array<string>")
    assert {r.module: r.members for r in R.expand_modules(m).collect()} == {"M1": ["K1", "K2"], "M2": ["K2"]}


def test_text_formats(spark, tmp_path):
    (tmp_path / "d.mat").write_text("# x\n2\n1: a 0.0 0.5\n2: b 0.5 0.0\n")
    assert {(r.obs, r.attr): r.v for r in R.read_distmat(spark, str(tmp_path / "d.mat")).collect()} == {("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 0.0}
    (tmp_path / "log").write_text("Baseline=0.5\nnothing\nAccuracy=0.6\nAccuracy=0.7\n")
    r = R.accuracy_trace(spark, str(tmp_path / "log")).head()
    assert r.baseline == 0.5 and r.trace == [0.6, 0.7]
    (tmp_path / "g.gmt").write_text("s\tdesc\ta\tb\n")
    assert {(r.set_name, r.feature) for r in R.read_gene_sets(spark, str(tmp_path / "g.gmt")).collect()} == {("s", "a"), ("s", "b")}
    (tmp_path / "q.tsv").write_text("bin1\tc_1_1&&c_2_4\tPF1;PF2\n")
    assert {(r.orf, r.contig) for r in R.read_quality_table(spark, str(tmp_path / "q.tsv")).collect()} == {("c_1_1", "c_1"), ("c_2_4", "c_2")}


def test_stream_matches_batch(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, "click", 2.0), ("2024-01-01 00:50:00", 1, "view", 3.0), ("2024-01-01 01:10:00", 1, "view", 5.0)]
    df = spark.createDataFrame(rows, "ts string, user_id int, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = windows.depth_richness(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("depths").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, windows.depth_richness(df).collect()))
    assert sorted(map(tuple, spark.table("depths").collect())) == want and len(want) == 2


def test_fasta_marks_inside_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 beta->gamma protein\nAC\nGT\n>s2\n\n>s3 x>y\r\nTT\r\n")
    got = {r.seq_id: r.seq for r in R.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"s1": "ACGT", "s2": "", "s3": "TT"}
    assert {r.seq_id for r in R.read_fasta(spark, str(tmp_path), description=True).collect()} == {"s1 beta->gamma protein", "s2", "s3 x>y"}


def test_distance_matrices_of_a_folder(spark, tmp_path):
    for k, name in enumerate("ab"):
        (tmp_path / f"{name}.mat").write_text(f"2\n{name}1 0.0 0.{k + 1}\n{name}2 0.{k + 1} 0.0\n")
    got = {(r.obs, r.attr): r.v for r in R.read_distmat(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got["a1", "a2"] == 0.1 and got["b2", "b1"] == 0.2
