import numpy as np
import pytest
from pyspark.errors import PySparkException

from cladelake.sources import cache, readers, writers
from cladelake.streaming.catalog import stream_catalog


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1.0,s1,100,a.fq,single,fastq\n2.0,s2,50,b_1.fq,paired_1,fastq\n2.0,s2,50,/abs/b_2.fq,paired_2,fastq\n")
    cat = readers.read_catalog(spark, f"{tmp_path}/c.csv")
    paths = [r.path for r in cat.orderBy("t", "read_type").collect()]
    assert paths[0].endswith("/a.fq") and paths[0] != "a.fq" and paths[2] == "/abs/b_2.fq"
    got = {r["sample"]: r.paired for r in readers.sample_sources(cat).collect()}
    assert got == {"s1": False, "s2": True}
    (tmp_path / "bad.tsv").write_text("1.0\ts1\t100\ta.fq\tdouble\tfastq\n")
    with pytest.raises(PySparkException):
        readers.read_catalog(spark, f"{tmp_path}/bad.tsv").collect()
    with pytest.raises(ValueError):
        readers.read_catalog(spark, f"{tmp_path}/c.txt")
    (tmp_path / "half.csv").write_text("1.0,s1,100,a.fq,paired_1,fastq\n")
    with pytest.raises(PySparkException):
        readers.sample_sources(readers.read_catalog(spark, f"{tmp_path}/half.csv")).collect()


def test_fastq_round_trip(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1/1 x\nACGT\n+\nIIII\n@r2/1\nAC\n+\n!I\n")
    reads = readers.read_fastq(spark, f"{tmp_path}/r.fastq")
    rows = {r.read_id: r for r in reads.collect()}
    assert rows["r1/1"].seq == "ACGT" and rows["r1/1"].meta == "x" and rows["r2/1"].qual == [0, 40]
    writers.write_fastq(reads, f"{tmp_path}/out")
    again = {r.read_id: (r.seq, r.qual) for r in readers.read_fastq(spark, f"{tmp_path}/out").collect()}
    assert again == {k: (r.seq, r.qual) for k, r in rows.items()}
    tagged = readers.tag_orientation(reads, "paired_1")
    assert {r.mate_prefix for r in tagged.collect()} == {"r1", "r2"}
    with pytest.raises(PySparkException):
        readers.tag_orientation(reads, "paired_2").collect()
    (tmp_path / "bad.fastq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(PySparkException):
        readers.read_fastq(spark, f"{tmp_path}/bad.fastq").collect()


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">a|1 first\nACGT\nAC\n>b\nTT\n")
    got = {r.id: (r.description, r.seq) for r in readers.read_fasta(spark, f"{tmp_path}/m.fa").collect()}
    assert got == {"a|1": ("first", "ACGTAC"), "b": (None, "TT")}
    writers.write_fasta(readers.read_fasta(spark, f"{tmp_path}/m.fa"), f"{tmp_path}/fa")
    assert {r.id: r.seq for r in readers.read_fasta(spark, f"{tmp_path}/fa").collect()} == {"a|1": "ACGTAC", "b": "TT"}


def test_database(spark, tmp_path):
    (tmp_path / "db.json").write_text('[{"id":"s","genus":"G","species":"p","name":"n","genome_length":9,"seqs":[{"id":"q"}],"markers":[{"id":"m","name":"g","type":"subseq","source":"q","source_i":"0","start":1,"end":4,"strand":"-"}]}]')
    db = readers.read_database(spark, f"{tmp_path}/db.json")
    assert readers.strain_table(db).first().cluster == []
    assert readers.marker_table(db).first().strand == "-"
    (tmp_path / "bad.json").write_text('[{"id":"s"}]')
    with pytest.raises(PySparkException):
        readers.read_database(spark, f"{tmp_path}/bad.json").collect()


def test_sam_and_hits(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tx\nr\t0\tm1\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\nr\t256\tm2\t5\t0\t4M\t*\t0\t0\t*\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    got = [(r.marker, r.start, r.seq) for r in readers.read_sam(spark, f"{tmp_path}/a.sam").orderBy("ord").collect()]
    assert got == [("m1", 0, "ACGT"), ("m2", 4, "ACGT")]
    (tmp_path / "b.tsv").write_text("q1\t90\t10\t100\t1\t81\t1e-9\t99\t0\t80\nq1\t1\t5\t100\t1\t5\t1e-9\t99\t0\t80\n")
    hits = readers.read_blast(spark, f"{tmp_path}/b.tsv", 50).collect()
    assert [(h.sstart, h.send, h.strand) for h in hits] == [(10, 90, "-")]


def test_gff_lists_and_clusters(spark, tmp_path):
    (tmp_path / "g.gff").write_text("#c\ns\tx\tgene\t1\t9\t.\t+\t.\tgbkey=Gene;Name=n;gene=g\ns\tx\tgene\t1\t9\t.\t+\t.\tgbkey=Gene;Name=n\ns\tx\tcds\t1\t9\t.\t+\t.\tgbkey=CDS\n")
    assert sorted(r.name for r in readers.genes(readers.read_gff(spark, f"{tmp_path}/g.gff")).collect()) == ["g", "n"]
    (tmp_path / "l.txt").write_text("# no\ns1\tx\n\ns2\n")
    assert sorted(r[0] for r in readers.read_id_list(spark, f"{tmp_path}/l.txt").collect()) == ["s1", "s2"]
    (tmp_path / "c.txt").write_text("a:a,b\nc:c\n")
    got = readers.read_clusters(spark, f"{tmp_path}/c.txt")
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("a", "b"), ("c", "c")]
    writers.write_clusters(got, f"{tmp_path}/cl")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/cl").collect()) == ["a\ta,b", "c\tc"]


def test_abundances_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1.0, "a", 0.25), (1.0, "b", 0.75), (2.0, "a", 1.0), (2.0, "b", 0.0)], "t double, strain_id string, abundance double")
    writers.write_abundances(p, f"{tmp_path}/ab")
    assert sorted(map(tuple, readers.read_abundances(spark, f"{tmp_path}/ab").collect())) == sorted(map(tuple, p.collect()))


def test_triangle(spark, tmp_path):
    np.array([0.5, 0.25, 0.75], np.float32).tofile(f"{tmp_path}/d.bin")
    assert sorted(map(tuple, readers.read_triangle(spark, f"{tmp_path}/d.bin", 3).collect())) == [(0, 1, 0.5), (0, 2, 0.25), (1, 2, 0.75)]
    with pytest.raises(PySparkException):
        readers.read_triangle(spark, f"{tmp_path}/d.bin", 4).collect()


def test_cache(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    key = cache.cache_key(a=1, b=["x"])
    assert key == cache.cache_key(b=["x"], a=1) != cache.cache_key(a=2, b=["x"])
    for _ in range(2):
        assert cache.load_or_compute(spark, f"file://{tmp_path}/c", key, make).count() == 3
    assert len(calls) == 1
    assert cache.table_signature(spark.range(9)) == cache.table_signature(spark.range(9).repartition(4)) != cache.table_signature(spark.range(8))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1.0,s1,100,a.fq,single,fastq\n")
    run = lambda: stream_catalog(spark, f"{tmp_path}/in", lambda df: df.groupBy("t").sum("depth"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text("2.0,s2,50,b.fq,single,fastq\n")
    run()
    assert sorted(r.t for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1.0, 2.0]
