import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladelake.operators import abundance as ab
from cladelake.operators import cluster as cl
from cladelake.operators import evidence as ev
from cladelake.operators import inference as inf
from cladelake.operators import intervals as iv
from cladelake.operators import ranking
from cladelake.operators import sequence_sets as ss
from cladelake.operators import sparse as sp
from cladelake.plans import registry
from cladelake.plans.fixtures import run


def test_touching_intervals_merge_and_gaps_do_not(spark):
    df = spark.createDataFrame([("k", 1, 5, 1), ("k", 5, 9, 2), ("k", 20, 30, 3), ("k", 22, 25, 4), ("m", 6, 9, 5)], "k string, s int, e int, o int")
    got = sorted((r.k, r.s, r.e, r.members) for r in iv.merge(df, ["k"], "s", "e", ["o"]).collect())
    assert got == [("k", 1, 9, 2), ("k", 20, 30, 2), ("m", 6, 9, 1)]
    again = iv.merge(iv.merge(df, ["k"], "s", "e", ["o"]), ["k"], "s", "e", ["members"])
    assert sorted((r.k, r.s, r.e) for r in again.collect()) == [g[:3] for g in got]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join_equals_a_theta_join(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 60), rng.integers(-50, 200, 60), rng.integers(0, 60, 60))]
    a = spark.createDataFrame(rows[:30], "k int, s int, e int").withColumn("i", F.monotonically_increasing_id())
    b = spark.createDataFrame(rows[30:], "k int, u int, v int").withColumn("j", F.monotonically_increasing_id())
    got = iv.overlap_join(a, b, ["k"], ("s", "e"), ("u", "v"), width).select("i", "j", "clip_start", "clip_end")
    want = a.join(b, "k").where("s <= v and u <= e").select("i", "j", F.greatest("s", "u"), F.least("e", "v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_log_semiring_product(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 5)) * 300, rng.normal(size=(5, 3)) * 300
    left = spark.createDataFrame([(i, k, float(a[i, k])) for i in range(4) for k in range(5) if (i + k) % 3], "i int, k int, v double")
    right = spark.createDataFrame([(k, j, float(b[k, j])) for k in range(5) for j in range(3)], "k int, j int, w double")
    for r in sp.lse_matmul(left, right, ["k"], ["i", "j"], "v", "w").collect():
        terms = [a[r.i, k] + b[k, r.j] for k in range(5) if (r.i + k) % 3]
        assert r.ll == pytest.approx(np.logaddexp.reduce(terms))
        assert r.ll >= max(terms) - 1e-9


def test_ties_vote_for_all(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, "b", -1.0), (2, "a", -5.0), (2, "c", -4.0)], "r int, s string, ll double")
    assert {x.s: x.votes for x in sp.argmax_vote(df, ["r"], ["s"], "ll").collect()} == {"a": 1, "b": 1, "c": 1}


def test_mates_and_singles_partition_the_evidence(spark):
    rows = [(p, s, float(-p - s), f) for p in range(6) for s in range(2) for f in (True, False) if (p + s + f) % 3]
    df = spark.createDataFrame(rows, "p int, s int, ll double, f boolean")
    f, r = df.where("f"), df.where("not f")
    pairs = ev.mate_pairs(f, r, "p", "s", "ll")
    single = ev.unpaired(f, r, pairs, "p")
    done = {x.p for x in pairs.collect()}
    assert {x.p for x in single.collect()}.isdisjoint(done)
    assert single.count() == sum(x[0] not in done for x in rows)


def test_containment_join_finds_both_strands(spark):
    m = spark.createDataFrame([(1, "ACGTACGGATTACA"), (2, "TTGTAATCCG")], "m int, marker_seq string")
    f = spark.createDataFrame([("GGATTAC",)], "frag string")
    got = sorted((r.m, r.pos, r.strand) for r in ev.containment_join(f, m, 4).collect())
    assert got == [(1, 7, "+"), (2, 3, "-")]


def test_fragment_frequencies(spark):
    hits = spark.createDataFrame([(1, 9, 5, 20, 1), (1, 9, 5, 20, 7), (2, 9, 6, 20, 3)], "frag_id int, strain_id int, frag_len int, marker_len int, pos int")
    windows = [(w, math.log(p)) for w, p in ((5, 0.5), (6, 0.3), (7, 0.2))]
    got = {r.frag_id: r.logfreq for r in ev.fragment_frequencies(hits, windows).collect()}
    assert got[1] == pytest.approx(math.log(2 * 0.5 + 0.5)) and got[2] == pytest.approx(math.log(0.3))


def test_linkage_keeps_diameters_within_the_threshold(spark):
    x = np.random.default_rng(3).random(40) * 3
    d = np.abs(x[:, None] - x)
    pairs = [(i, j, float(d[i, j])) for i in range(40) for j in range(i + 1, 40)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, d double")
    got = {r.node: r.cluster for r in cl.complete_linkage(df, 0.3).collect()}
    for a in got:
        for b in got:
            if got[a] == got[b] and a != b:
                assert d[a, b] <= 0.3
    whole = cl.linkage_labels(40, *np.triu_indices(40, 1), d[np.triu_indices(40, 1)], 0.3)
    assert all(got[i] == whole[i] for i in got)


def test_average_linkage():
    label = cl.linkage_labels(3, np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([1.0, 5.0, 3.0]), 4.0, "average")
    assert label.tolist() == [0, 0, 0]


def test_negative_binomial_fit_recovers_its_parameters():
    rng = np.random.default_rng(5)
    v, c = np.unique(rng.negative_binomial(12, 0.3, 200000), return_counts=True)
    n, p = inf.fit_negative_binomial(v.astype(float), c.astype(float))
    assert n == pytest.approx(12, rel=0.05) and p == pytest.approx(0.3, rel=0.05)


def test_length_weights(spark):
    reads = spark.createDataFrame([(6,)], "len int")
    assert {r.len: r.weight for r in inf.length_weights(reads, 10).collect()} == {6: 5, 5: 2, 4: 2}


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(7)
    t, n, s = 3, 2, 4
    ll = [rng.normal(size=(5, s)) for _ in range(t)]
    eps, gum = rng.normal(size=(t, n, s)), rng.normal(size=(n, s))
    params = {"mean": rng.normal(size=(t, s)), "log_scale": rng.normal(size=(t, s)) * 0.1 - 1, "presence": rng.normal(size=s)}

    def data(log_y):
        z = log_y[:, :, None, :] + np.stack(ll)[:, None]
        top = np.logaddexp.reduce(z, axis=3)
        return top.sum(2), np.exp(z - top[..., None]).sum(2)

    f = lambda p: inf.elbo(p, eps, gum, np.array([1.0, 2.0]), 0.7, data, np.array([100.0, 50, 200, 80]), np.full(t, 5.0), 0.3)
    _, grads = f(params)
    for name, g in grads.items():
        for at in np.ndindex(g.shape):
            up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert g[at] == pytest.approx((f(up)[0] - f(down)[0]) / 2e-5, rel=1e-4, abs=1e-5), (name, at)


def test_distributed_data_pass_equals_the_local_one(spark):
    rng = np.random.default_rng(2)
    rows = [(t, r, s, float(rng.normal())) for t in range(2) for r in range(30) for s in range(3) if rng.random() < 0.7]
    m = spark.createDataFrame(rows, "t int, read_id int, strain_id int, ll double").repartition(3)
    blocks = inf.data_blocks(m, {0: 0, 1: 1}, {0: 0, 1: 1, 2: 2})
    y = np.log(rng.dirichlet(np.ones(3), size=(2, 4)))
    v, g = inf.data_pass(blocks, y)
    w, h = inf._local_data(blocks.toPandas(), 2, 3)(y)
    assert np.allclose(v, w) and np.allclose(g, h)


def test_inference_recovers_simulated_abundances(spark):
    rng = np.random.default_rng(11)
    truth = np.array([[0.7, 0.2, 0.1], [0.2, 0.5, 0.3]])
    rows = []
    for t in range(2):
        for r, s in enumerate(rng.choice(3, 400, p=truth[t])):
            rows += [(t, r, int(k), 0.0 if k == s else -6.0) for k in range(3)]
    post = inf.infer(spark.createDataFrame(rows, "t int, read_id int, strain_id int, ll double"), {0: 100, 1: 100, 2: 100}, epochs=60, iterations=5)
    y = post.samples(400).mean(1)
    assert np.allclose(y.sum(1), 1)
    hellinger = np.sqrt(((np.sqrt(y) - np.sqrt(truth)) ** 2).sum(1)) / np.sqrt(2)
    assert hellinger.max() < 0.12
    assert (post.inclusion() > 0.5).all()


def test_plateau():
    p = inf.Plateau(patience=1, factor=0.1, min_rate=0.02)
    assert [round(p.update(v, 1.0), 3) for v in (1, 2, 2, 2)] == [1.0, 1.0, 1.0, 0.1]


def test_psis_smooths_the_tail():
    rng = np.random.default_rng(0)
    lw = rng.exponential(0.3, 4000)
    out, k = inf.psis(lw)
    assert np.exp(out).sum() == pytest.approx(1) and k == pytest.approx(0.3, abs=0.15)


def test_psis_tail_is_of_all_events(spark, tmp_path):
    from cladelake.plans.operator_queries import psis_tail

    rng = np.random.default_rng(1)
    value = np.concatenate((rng.exponential(4.0, 2000), rng.exponential(16.0, 4000)))
    spark.createDataFrame([(i, "2024-01-01", 1, "view", float(v)) for i, v in enumerate(value)], "event_id bigint, ts string, user_id bigint, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert psis_tail(spark, str(tmp_path)).first()[0] == pytest.approx(inf.psis(value / 20)[1], rel=1e-9)
    assert inf.psis_shape(spark.createDataFrame([(1.0,), (None,)], "v double"), "v") == (1, np.inf)


def test_hellinger_of_equal_profiles_is_zero(spark):
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "t int, s string, v double")
    q = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0)], "t int, s string, v double")
    got = {r.t: r.hellinger for r in ab.hellinger(p, q, ["t"], "s", "v").collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(1)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitions_do_not_change_results(spark, sf, parts):
    from cladelake.plans import operator_queries as oq

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, oq.interval_merge(spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, oq.interval_merge(spark, sf).collect()))


@pytest.mark.parametrize("range_rows", [7, 50, 10**6])
def test_global_rank_by_ranges(spark, range_rows):
    rng = np.random.default_rng(4)
    rows = [(None if x % 11 == 0 else int(x % 23), f"k{y:03d}") for x, y in rng.integers(0, 400, (600, 2))] + [(5, "k000")] * 200
    df = spark.createDataFrame(rows, "a int, b string")
    got = ranking.global_rank(df, ["a", "b"], range_rows=range_rows).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(rows) + 1))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_global_rank_of_nothing_and_one_value(spark):
    assert ranking.global_rank(spark.createDataFrame([], "a int"), ["a"], range_rows=5).count() == 0
    same = ranking.global_rank(spark.createDataFrame([(None,)] * 40, "a int"), ["a"], range_rows=5)
    assert sorted(r.place for r in same.collect()) == list(range(1, 41))


def plain_linkage(n, dist, threshold):
    """Complete linkage over all pairs, merge by merge."""
    groups = {i: [i] for i in range(n)}
    far = lambda a, b: max(dist.get((min(i, j), max(i, j)), np.inf) for i in groups[a] for j in groups[b])
    while True:
        best = min(((far(a, b), a, b) for a in groups for b in groups if a < b), default=(np.inf, 0, 0))
        if best[0] > threshold:
            return sorted(map(sorted, groups.values()))
        groups[best[1]] += groups.pop(best[2])


def test_complete_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 60
    at = rng.random((n, 2))
    dist = {(i, j): round(float(np.abs(at[i] - at[j]).sum()), 3) for i in range(n) for j in range(i + 1, n)}
    got = cl.complete_linkage(spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "a bigint, b bigint, d double"), 0.25).toPandas()
    groups = sorted(map(sorted, got.groupby("cluster").node.apply(list).tolist() + [[i] for i in range(n) if i not in set(got.node)]))
    assert groups == plain_linkage(n, dist, 0.25) and (got.groupby("cluster").node.min() == got.groupby("cluster").node.min().index).all()


def test_linkage_of_many_nodes_needs_no_square():
    n = 30000
    label = cl.linkage_labels(n, np.arange(n - 1), np.arange(1, n), np.where(np.arange(n - 1) % 2 == 0, 0.1, 0.2), 0.3)
    assert (label == np.arange(n) // 2 * 2).all()


def test_jaccard_with_a_bound_equals_the_filtered_join(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(80):
        base = rng.choice(40, int(rng.integers(1, 20)), replace=False) + 40 * (k % 4)
        rows += [(k, f"i{x}") for x in {int(x) for x in base} | {int(y) for y in rng.integers(0, 160, 1)} | {999}]
    sets = spark.createDataFrame(rows, "seq_id bigint, kmer string")
    plain = {(r.a, r.b): r.jaccard for r in cl.jaccard(sets, "seq_id").collect()}
    for least in (0.2, 0.5, 0.8, 1.0):
        assert {(r.a, r.b): r.jaccard for r in cl.jaccard(sets, "seq_id", least=least).collect()} == {k: v for k, v in plain.items() if v >= least}


def test_hamming_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    seqs = {i: "".join(rng.choice(list("AC"), int(rng.integers(0, 9)))) for i in range(120)}
    got = {(r.a, r.b): r.d for r in cl.hamming_pairs(spark.createDataFrame(list(seqs.items()), "seq_id bigint, seq string"), "seq_id", "seq", 2).collect()}
    d = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    want = {(a, b): d(x, y) for a, x in seqs.items() for b, y in seqs.items() if a < b and len(x) == len(y) and d(x, y) <= 2}
    assert got == want


def test_fragments_shorter_than_all_windows(spark):
    hits = spark.createDataFrame([(1, 7, 3, 10, 1), (1, 7, 3, 10, 4), (2, 7, 9, 10, 1)], "frag_id bigint, strain_id bigint, frag_len int, marker_len int, pos int")
    got = {r.frag_id: r.logfreq for r in ev.fragment_frequencies(hits, [(5, float(np.log(0.5))), (6, float(np.log(0.25)))]).collect()}
    assert got == {1: pytest.approx(np.log(0.75))}


def test_strains_with_n_stay_alone(spark, tmp_path):
    from cladelake import cli

    seq = "ACGTTGCAACGGTTAACCGGATTA"
    spark.createDataFrame([("a", seq), ("b", seq), ("c", seq + "N"), ("c", seq)], "strain_id string, seq string").write.parquet(str(tmp_path / "m"))
    cli.main(["cluster", str(tmp_path / "m"), str(tmp_path / "o"), "--k", "5"], spark)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect() if not r.value.startswith("#"))
    assert lines == ["a\ta,b", "c\tc"]


def test_fasta_keeps_marks_inside_descriptions(spark, tmp_path):
    from cladelake.sources import readers

    (tmp_path / "x.fa").write_text(">m1 a>b and c\nACGT\nAC\n>m2\nGG\n")
    got = {r.id: (r.description, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got["m1"] == ("a>b and c", "ACGTAC") and got["m2"][1] == "GG"


def test_psis_against_the_published_steps():
    """Tail size, profile-posterior fit and smoothing written out with plain loops."""
    rng = np.random.default_rng(7)
    lw = rng.standard_t(2, 500)
    out, k = inf.psis(lw)
    x = np.sort(lw - lw.max())
    m = int(np.ceil(min(0.2 * 500, 3 * np.sqrt(500))))
    cut = x[-m - 1]
    y = np.sort(np.exp(x[x > cut]) - np.exp(cut))
    n, grid = len(y), 20 + int(np.sqrt(len(y)))
    quart = y[int(n / 4 + 0.5) - 1]
    theta = [1 / y[-1] + (1 - np.sqrt(grid / (j - 0.5))) / (3 * quart) for j in range(1, grid + 1)]
    like = [n * (np.log(-t / np.mean(np.log1p(-t * y))) - np.mean(np.log1p(-t * y)) - 1) for t in theta]
    weight = [1 / sum(np.exp(b - a) for b in like) for a in like]
    best = sum(t * w for t, w in zip(theta, weight, strict=True))
    raw = np.mean(np.log1p(-best * y))
    shape, scale = (n * raw + 5) / (n + 10), -raw / best
    assert k == pytest.approx(shape, rel=1e-9)
    want = x.copy()
    if shape >= 1 / 3:
        want[-n:] = [min(0, np.log(scale / shape * ((1 - (i + 0.5) / n) ** -shape - 1) + np.exp(cut))) for i in range(n)]
    want -= np.log(np.exp(want).sum())
    assert np.allclose(np.sort(out), np.sort(want))


def test_isolates_and_seeds(spark, tmp_path):
    from cladelake.sources import readers

    (tmp_path / "a.fa").write_text(">c|1 first\nACGT\nAC\n>c2\nGG\n")
    (tmp_path / "b.fa").write_text(">c9\nTTT\n")
    (tmp_path / "i.tsv").write_text(f"Accession\tFastaPath\tGenus\tSpecies\nA1\t{tmp_path}/a.fa\tG\ts\nB1\t{tmp_path}/b.fa\tG\tt\n")
    got = sorted((r.strain_id, r.name, r.marker_id, r.marker_name, r.seq) for r in readers.read_isolates(spark, str(tmp_path / "i.tsv")).collect())
    assert got == [("A1", "Gs_A1", "c2", "Contig-1:A1", "GG"), ("A1", "Gs_A1", "c:1", "Contig-0:A1", "ACGTAC"), ("B1", "Gt_B1", "c9", "Contig-0:B1", "TTT")]
    (tmp_path / "e.tsv").write_text("Accession\tFastaPath\tGenus\tSpecies\n")
    with pytest.raises(ValueError):
        readers.read_isolates(spark, str(tmp_path / "e.tsv"))
    (tmp_path / "s.tsv").write_text(f"g1\ta.fa\ng2\t{tmp_path}/b.fa\n")
    assert {r.name: r.path.rsplit("/", 1)[1] for r in readers.read_seeds(spark, str(tmp_path / "s.tsv")).collect()} == {"g1": "a.fa", "g2": "b.fa"}
    (tmp_path / "s.tsv").write_text("g1\tnone.fa\n")
    with pytest.raises(FileNotFoundError):
        readers.read_seeds(spark, str(tmp_path / "s.tsv"))


def test_point_lookup(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (1, 3, 0.75)], "i int, j int, v double")
    assert sp.point_lookup(df, {"i": 1, "j": 2}, "v") == 0.5
    for j in (3, 4):
        with pytest.raises(KeyError):
            sp.point_lookup(df, {"i": 1, "j": j}, "v")


def test_posterior_round_trip(spark, tmp_path):
    post = inf.Posterior([1.0, 2.5], ["a", "b", "c"], np.arange(6.0).reshape(2, 3), -np.ones((2, 3)), np.array([0.1, -2, 3]), [])
    post.save(spark, str(tmp_path / "p"))
    again = inf.Posterior.load(spark, str(tmp_path / "p"))
    assert again.times == post.times and again.strains == post.strains and np.array_equal(again.samples(5), post.samples(5))


def shuffled(spark, run):
    """Bytes that a job writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        all_ = store.executorList(False)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    before = so_far()
    run()
    return so_far() - before


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder whose documents have 300 letters each, and three near copies; and the number of letters."""
    rng = np.random.default_rng(8)
    texts = ["".join("ACGT"[x] for x in rng.integers(0, 4, 300)) for _ in range(1200)]
    texts += [texts[0][:-1], texts[0] + "A", texts[1][:297] + "ACGT", "", None, "AC"]
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), sum(len(x or "") for x in texts)


def test_minhash_est_shuffles_no_kmers(spark, long_texts):
    path, letters = long_texts
    found = []
    assert shuffled(spark, lambda: found.extend(registry.QUERIES["minhash_est"](spark, path).collect())) < 2 * letters
    assert {(0, 1200), (0, 1201), (1200, 1201), (1, 1202)} >= {(r.a, r.b) for r in found} >= {(0, 1200), (0, 1201)}


def test_minhash_of_sequences_equals_that_of_sets(spark):
    rng = np.random.default_rng(9)
    seqs = spark.createDataFrame([(i, "".join("ACGT"[x] for x in rng.integers(0, 4, int(n)))) for i, n in enumerate(rng.integers(0, 90, 40))], "id bigint, seq string")
    for k, hashes in ((3, 5), (15, 12)):
        want: dict = {}
        for r in cl.minhash(cl.kmer_sets(seqs, "id", "seq", k), "id", hashes).orderBy("id", "h").collect():
            want.setdefault(r.id, []).append(r.sig)
        assert {r.id: [bytes(x).hex() for x in r.sigs] for r in ss.minhash_sequences(seqs, "id", "seq", k, hashes).collect()} == want


def test_jaccard_of_sequences_equals_that_of_sets(spark):
    rng = np.random.default_rng(10)
    base = ["".join("ACGT"[x] for x in rng.integers(0, 4, int(n))) for n in rng.integers(0, 120, 12)]
    seqs = [b[int(rng.integers(0, 6)) : len(b) - int(rng.integers(0, 6))] + "ACGTTGCAACG" * int(rng.integers(0, 2)) for b in base for _ in range(8)] + ["A" * 50, "A" * 60, "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string").repartition(3)
    plain = {(r.a, r.b): r.jaccard for r in cl.jaccard(cl.kmer_sets(df, "id", "seq", 5), "id").collect()}
    for least in (0.25, 0.8, 1.0):
        want = {k: v for k, v in plain.items() if v >= least}
        assert len(want) > 3
        assert {(r.a, r.b): r.jaccard for r in ss.jaccard_sequences(df, "id", "seq", 5, least).collect()} == want


@pytest.mark.parametrize("name", ["jaccard_kmer", "complete_linkage"])
def test_alike_sequences_shuffle_prefixes_only(spark, long_texts, name):
    path, letters = long_texts
    found = []
    assert shuffled(spark, lambda: found.extend(registry.QUERIES[name](spark, path).collect())) < 20 * letters
    if name == "jaccard_kmer":
        assert {(0, 1200), (0, 1201), (1200, 1201), (1, 1202)} == {(r.a, r.b) for r in found}
    else:
        assert {r.node: r.cluster for r in found if r.cluster != r.node} == {1200: 0, 1201: 0, 1202: 1}


def test_inference_reads_its_input_once_and_packs_equal_reads(spark):
    rng = np.random.default_rng(12)
    kinds = [{int(s): float(x) for s, x in zip(rng.choice(4, 2, replace=False), rng.normal(size=2).round(2), strict=True)} for _ in range(6)]
    rows = [(t, r, s, x - r % 3) for t in (3, 5) for r in range(300) for s, x in kinds[(r + t) % 6].items()] + [(9, 1, 77, -1.0)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    m = spark.createDataFrame(rows, "t int, read_id int, strain_id int, ll double").repartition(3).mapInArrow(seen, "t int, read_id int, strain_id int, ll double")
    blocks = inf.data_blocks(m, {3: 0, 5: 1}, {s: s for s in range(4)})
    assert blocks.count() < 100
    y = np.log(rng.dirichlet(np.ones(4), size=(2, 3)))
    z = [[[np.logaddexp.reduce([y[t, n, s] + x - r % 3 for s, x in kinds[(r + (3, 5)[t]) % 6].items()]) for r in range(300)] for n in range(3)] for t in range(2)]
    value, grad = inf.data_pass(blocks, y)
    assert np.allclose(value, np.sum(z, 2)) and np.allclose(grad.sum(2), 300)
    for most in (0, 10**6):
        read.value = 0
        post = inf.infer(m, dict.fromkeys(range(4), 100), epochs=2, iterations=2, max_local_rows=most)
        assert read.value == len(rows)
        assert post.times == [3, 5, 9]
        if most:
            assert np.allclose(post.mean, before.mean) and np.allclose(post.trace, before.trace)
        before = post


def test_seed_candidates_shuffle_nothing(spark, long_texts):
    path, letters = long_texts
    found = []
    assert shuffled(spark, lambda: found.extend(registry.QUERIES["seed_candidates"](spark, path).collect())) < letters / 10
    assert (1, 1202) in {(r.read_id, r.marker_id) for r in found}


@pytest.mark.parametrize("index_bytes", [None, 2000])
def test_seed_pairs_equal_the_join_of_sets(spark, index_bytes):
    rng = np.random.default_rng(13)
    seqs = ["".join("ACGT"[x] for x in rng.integers(0, 4, int(n))) for n in rng.integers(0, 90, 60)] + ["", None, "ACGT" * 20]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string")
    reads, markers = df.where("id % 3 = 1").withColumnRenamed("id", "r"), df.where("id % 3 <> 1").withColumnRenamed("id", "m")
    join = cl.kmer_sets(reads, "r", "seq", 4).join(cl.kmer_sets(markers, "m", "seq", 4), "kmer").groupBy("r", "m").agg(F.count("*").alias("seeds")).where("seeds >= 3")
    want = sorted(map(tuple, join.collect()))
    assert want and sorted(map(tuple, ss.seed_pairs(reads, markers, "r", "m", "seq", 4, 3, index_bytes).collect())) == want


@pytest.mark.parametrize("index_bytes", [None, 3000])
def test_jaccard_pairs_equal_the_join_of_sets(spark, index_bytes):
    rng = np.random.default_rng(14)
    seqs = ["".join("ACGT"[x] for x in rng.integers(0, 4, int(n))) for n in rng.integers(0, 90, 60)] + ["", None, "ACGT" * 20]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string").repartition(3)
    want = {(r.a, r.b): r.jaccard for r in cl.jaccard(cl.kmer_sets(df, "id", "seq", 4), "id").collect()}
    got = ss.jaccard_pairs(df, "id", "seq", 4, index_bytes).collect()
    assert len(got) == len(want) > 500 and {(r.a, r.b): r.jaccard for r in got} == want


def test_jaccard_kmer_returns_all_that_share_a_kmer(spark, long_texts):
    """Also those that are little alike."""
    want = cl.jaccard(cl.kmer_sets(spark.read.parquet(f"{long_texts[0]}/documents.parquet"), "doc_id", "text", 15), "doc_id").collect()
    got = {(r.a, r.b): r.jaccard for r in registry.QUERIES["jaccard_kmer"](spark, long_texts[0]).collect()}
    assert min(got.values()) < 0.1 and got == {(r.a, r.b): round(r.jaccard, 6) for r in want}


@pytest.mark.parametrize("index_bytes", [None, 1000])
def test_minhash_pairs_equal_those_of_sets(spark, index_bytes):
    rng = np.random.default_rng(15)
    seqs = ["".join("ACGT"[x] for x in rng.integers(0, 4, int(n))) for n in rng.integers(0, 90, 60)] + ["", None, "ACGT" * 20]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string").repartition(3)
    want = {(r.a, r.b): r.estimate for r in cl.minhash_similarity(cl.minhash(cl.kmer_sets(df, "id", "seq", 4), "id", 16), "id", 16).collect()}
    got = ss.minhash_pairs(df, "id", "seq", 4, 16, index_bytes).collect()
    assert len(got) == len(want) > 500 and {(r.a, r.b): r.estimate for r in got} == want


def test_minhash_est_returns_all_that_agree_in_a_hash(spark, tmp_path):
    """Also those of fewer than 13."""
    rng = np.random.default_rng(16)
    base = "".join("ACGT"[x] for x in rng.integers(0, 4, 200))
    texts = [base, base[100:] + "".join("ACGT"[x] for x in rng.integers(0, 4, 100)), base[40:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.estimate for r in registry.QUERIES["minhash_est"](spark, str(tmp_path)).collect()}
    want = cl.minhash_similarity(cl.minhash(cl.kmer_sets(df, "doc_id", "text", 15), "doc_id", 16), "doc_id", 16).collect()
    assert got == {(r.a, r.b): r.estimate for r in want} and min(got.values()) < 13 / 16


def test_seed_candidates_are_all_pairs(spark, sf):
    """Whatever the remainders of their ids."""
    sets = cl.kmer_sets(run(spark, sf, "SELECT * FROM fx_seq"), "seq_id", "seq", 10)
    pairs = sets.withColumnRenamed("seq_id", "a").join(sets.withColumnRenamed("seq_id", "b"), "kmer").where("a < b").groupBy("a", "b").agg(F.count("*").alias("seeds")).where("seeds >= 5")
    got = sorted(map(tuple, registry.QUERIES["seed_candidates"](spark, sf).collect()))
    assert got == sorted(map(tuple, pairs.collect())) and {r % 25 for r, _, _ in got} > {0, 1, 2} and {m % 25 for _, m, _ in got} > {0, 1, 2}
