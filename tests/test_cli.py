import numpy as np

from cladelake import cli


def test_filter(spark, tmp_path):
    marker = "".join(np.random.default_rng(0).choice(list("ACGT"), 200))
    (tmp_path / "m.fa").write_text(f">g|m1\n{marker}\n")
    good, poor = marker[20:80], marker[20:50] + "A" * 30
    lines = [f"r1\t0\tg|m1\t21\t60\t60M\t*\t0\t0\t{good}\t{'I' * 60}", f"r2\t0\tg|m1\t21\t60\t60M\t*\t0\t0\t{poor}\t{'I' * 60}", f"r1\t256\tg|m1\t22\t60\t60M\t*\t0\t0\t*\t*"]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    cli.main(["filter", f"{tmp_path}/a.sam", f"{tmp_path}/m.fa", f"{tmp_path}/out"], spark)
    report = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/out/metadata").collect()
    assert sorted((r.READ, r.PASSED_FILTER) for r in report) == [("r1", "1"), ("r2", "0")]
    assert spark.read.text(f"{tmp_path}/out/reads").where("value like '@r1%'").count() == 1


def test_infer_and_interpret(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(t, r, int(k), 0.0 if k == s else -8.0) for t in (1, 2) for r, s in enumerate(rng.choice(2, 200, p=[0.8, 0.2])) for k in range(3)]
    spark.createDataFrame(rows, "t int, read_id int, strain_id bigint, ll double").write.parquet(f"{tmp_path}/ll")
    spark.createDataFrame([(i, 100) for i in range(3)], "strain_id bigint, marker_len int").write.parquet(f"{tmp_path}/len")
    cli.main(["infer", f"{tmp_path}/ll", f"{tmp_path}/len", f"{tmp_path}/post", "--epochs", "30", "--samples", "50"], spark)
    cli.main(["interpret", f"{tmp_path}/post", f"{tmp_path}/prof", "--threshold", "0.2"], spark)
    q = {(r.t, r.strain_id): r.q2 for r in spark.read.parquet(f"{tmp_path}/prof/quantiles").collect()}
    assert q[1.0, 0] > 0.6


def test_cluster(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = ("".join(rng.choice(list("ACGT"), 300)) for _ in range(2))
    spark.createDataFrame([(1, a), (2, a), (3, b)], "strain_id bigint, seq string").write.parquet(f"{tmp_path}/m")
    cli.main(["cluster", f"{tmp_path}/m", f"{tmp_path}/c"], spark)
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/c").collect()) == ["1\t1,2", "3\t3"]
