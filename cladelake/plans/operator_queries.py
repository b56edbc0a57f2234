"""Queries that apply the library's operators, each with the SQL it must equal."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladelake.functions import alignment as al
from cladelake.functions import numeric as nm
from cladelake.functions import quality as ql
from cladelake.functions import sequences as sq
from cladelake.operators import abundance as ab
from cladelake.operators import cluster as cl
from cladelake.operators import evidence as ev
from cladelake.operators import inference as inf
from cladelake.operators import intervals as iv
from cladelake.operators import ranking as rk
from cladelake.operators import sequence_sets as ss
from cladelake.operators import sparse as sp
from cladelake.plans.fixtures import run, view
from cladelake.sources import readers as rd
from cladelake.sources import writers as wr
from cladelake.sources.spool import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


MARGINAL = """a AS (SELECT t, read_id, frag_id, max(ll) AS v FROM fx_hit GROUP BY t, read_id, frag_id),
b AS (SELECT frag_id, strain_id, ln(count(*)) AS w FROM fx_hit GROUP BY frag_id, strain_id),
j AS (SELECT a.t, a.read_id, b.strain_id, a.v + b.w AS x FROM a JOIN b ON a.frag_id = b.frag_id),
m AS (SELECT t, read_id, strain_id, x, max(x) OVER (PARTITION BY t, read_id, strain_id) AS mx FROM j),
p AS (SELECT t, read_id, strain_id, round(max(mx) + ln(sum(exp(x - mx))), 6) AS ll FROM m GROUP BY t, read_id, strain_id)"""


def marginal(spark: SparkSession, sf: str) -> DataFrame:
    """(t, read_id, strain_id, ll): read evidence times strain frequencies, in log space."""
    hit = view(spark, sf, "fx_hit")
    a = hit.groupBy("t", "read_id", "frag_id").agg(F.max("ll").alias("v"))
    b = hit.groupBy("frag_id", "strain_id").agg(F.log(F.count("*")).alias("w"))
    return sp.lse_matmul(a, b, ["frag_id"], ["t", "read_id", "strain_id"], "v", "w", deal=["t", "read_id"]).withColumn("ll", r6("ll"))


@query(f"WITH {MARGINAL}, v AS (SELECT p.t, p.strain_id, count(*) AS votes FROM p JOIN (SELECT t, read_id, max(ll) AS top FROM p GROUP BY t, read_id) q ON p.t = q.t AND p.read_id = q.read_id AND p.ll = q.top GROUP BY p.t, p.strain_id) SELECT t, strain_id, votes, round(votes / sum(votes) OVER (PARTITION BY t), 6) AS share FROM v")
def slice_shares(spark, sf):
    votes = sp.argmax_vote(marginal(spark, sf), ["t", "read_id"], ["t", "strain_id"], "ll")
    return votes.withColumn("share", r6(F.col("votes") / F.sum("votes").over(Window.partitionBy("t"))))


@query(f"WITH {MARGINAL} SELECT t, strain_id, count(*) AS reads, round(max(ll), 4) AS best, cast(sum(cast(round(ll * 1000000) AS bigint)) AS bigint) AS total FROM p GROUP BY t, strain_id")
def lse_matmul(spark, sf):
    return marginal(spark, sf).groupBy("t", "strain_id").agg(F.count("*").alias("reads"), r6(F.max("ll"), 4).alias("best"), F.sum(F.round(F.col("ll") * 1000000).cast("bigint")).alias("total"))


@query("SELECT p.strain_id, count(*) AS votes FROM fx_hit p JOIN (SELECT t, read_id, max(ll) AS top FROM fx_hit GROUP BY t, read_id) q ON p.t = q.t AND p.read_id = q.read_id AND p.ll = q.top GROUP BY p.strain_id")
def argmax_vote(spark, sf):
    return sp.argmax_vote(view(spark, sf, "fx_hit"), ["t", "read_id"], ["strain_id"], "ll")


@query("SELECT t, strain_id, round(max(mx) + ln(sum(exp(ll - mx))), 6) AS lse FROM (SELECT *, max(ll) OVER (PARTITION BY t, strain_id) AS mx FROM fx_hit) x GROUP BY t, strain_id")
def logsumexp(spark, sf):
    return nm.logsumexp(view(spark, sf, "fx_hit"), ["t", "strain_id"], "ll", "lse").withColumn("lse", r6("lse"))


@query("SELECT t, sample_no, round(exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY t), 9) AS share FROM (SELECT *, value / 100 AS v, max(value / 100) OVER (PARTITION BY t) AS mx FROM fx_series) x")
def softmax_partition(spark, sf):
    return view(spark, sf, "fx_series").select("t", "sample_no", r6(nm.softmax(F.col("value") / 100, ["t"]), 9).alias("share"))


@query("SELECT strain_id, round(sum(v / c), 6) AS total FROM (SELECT strain_id, read_id, exp(ll / 100) AS v, sum(exp(ll / 100)) OVER (PARTITION BY read_id) AS c FROM fx_hit) x GROUP BY strain_id")
def col_norm_row_sum(spark, sf):
    hit = view(spark, sf, "fx_hit").withColumn("v", F.exp(F.col("ll") / 100))
    return sp.column_normalised_row_sum(hit, "strain_id", "read_id", "v").withColumn("total", r6("total"))


@query("""WITH x AS (SELECT read_id, strain_id % 10 AS g, max(ll) / 20 AS ll FROM fx_hit GROUP BY read_id, strain_id % 10),
q AS (SELECT *, max(ll) OVER (PARTITION BY read_id) AS mx FROM x),
p AS (SELECT read_id, g, exp(ll - mx) / sum(exp(ll - mx)) OVER (PARTITION BY read_id) AS p FROM q),
n AS (SELECT count(DISTINCT read_id) AS n FROM p),
o AS (SELECT g, sum(p) AS sx, sum(p * p) AS sxx FROM p GROUP BY g),
c AS (SELECT a.g AS a, b.g AS b, sum(a.p * b.p) AS sxy FROM p a JOIN p b ON a.read_id = b.read_id AND a.g < b.g GROUP BY a.g, b.g)
SELECT c.a, c.b, round((sxy / n - u.sx / n * (v.sx / n)) / sqrt((u.sxx / n - pow(u.sx / n, 2)) * (v.sxx / n - pow(v.sx / n, 2))), 6) AS corr
FROM c JOIN o u ON c.a = u.g JOIN o v ON c.b = v.g CROSS JOIN n""")
def strain_corr(spark, sf):
    x = run(spark, sf, "SELECT read_id, strain_id % 10 AS g, max(ll) / 20 AS ll FROM fx_hit GROUP BY read_id, strain_id % 10")
    return sp.correlation(x, ["read_id"], "g", "ll").withColumn("corr", r6("corr"))


@query("SELECT read_id, cast(row_number() OVER (ORDER BY f, read_id) - 1 AS bigint) AS idx FROM (SELECT read_id, min(ord) AS f FROM fx_hit GROUP BY read_id) x")
def dense_index(spark, sf):
    return sp.dense_index(view(spark, sf, "fx_hit"), "read_id", "ord").withColumn("idx", F.col("idx").cast("bigint"))


@query("SELECT cast(floor(idx / 1000) AS bigint) AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY f, read_id) - 1 AS idx FROM (SELECT read_id, min(ord) AS f FROM fx_hit GROUP BY read_id) x) y GROUP BY 1")
def batch_split(spark, sf):
    return sp.dense_index(view(spark, sf, "fx_hit"), "read_id", "ord").groupBy(F.floor(F.col("idx") / 1000).cast("bigint").alias("batch")).agg(F.count("*").alias("n"))


@query("SELECT t, read_id, count(*) AS n FROM fx_hit WHERE ll > -100 GROUP BY t, read_id")
def prune_reads(spark, sf):
    hit = view(spark, sf, "fx_hit")
    alive = hit.where("ll > -100").select("t", "read_id").distinct()
    return hit.where("ll > -100").join(alive, ["t", "read_id"], "left_semi").groupBy("t", "read_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM documents) x WHERE n <= 100 OR (r - 1) % cast(floor(n / 100) AS bigint) = 0")
def thin_sorted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    step = max(docs.count() // 100, 1)
    return rk.global_rank(docs, ["n_chars", "doc_id"]).where((F.col("place") - 1) % step == 0).drop("place")


# ---- sources

@query("SELECT sample_id, t, cast(row_number() OVER (ORDER BY t, sample_id) AS bigint) AS place FROM fx_sample")
def catalog_sorted(spark, sf):
    return rk.global_rank(view(spark, sf, "fx_sample").select("sample_id", "t"), ["t", "sample_id"])


@query("SELECT event_id, k, coalesce(k, -1) AS with_default FROM fx_json")
def json_extract(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.where(rd.require(F.col("props").isNotNull(), "missing key props")).select("event_id", k.alias("k"), F.coalesce(k, F.lit(-1)).alias("with_default"))


@query("SELECT pair_id, cast(count(*) AS bigint) AS mates, coalesce(max(CASE WHEN is_forward THEN turn END), -1) AS fwd, coalesce(max(CASE WHEN NOT is_forward THEN turn END), -1) AS rev FROM fx_mate GROUP BY pair_id")
def mate_prefix(spark, sf):
    ids = view(spark, sf, "fx_mate").select(F.concat(F.col("pair_id").cast("string"), F.when(F.col("is_forward"), "/1").otherwise("/2")).alias("read_id"), "is_forward", "turn")
    prefix = F.regexp_replace("read_id", "/[12]$", "").cast("bigint")
    return ids.groupBy(prefix.alias("pair_id")).agg(F.count("*").alias("mates"), F.coalesce(F.max(F.when(F.col("is_forward"), F.col("turn"))), F.lit(-1)).alias("fwd"), F.coalesce(F.max(F.when(~F.col("is_forward"), F.col("turn"))), F.lit(-1)).alias("rev"))


@query("SELECT i.strain_id, i.s, i.e, i.strand, CASE WHEN i.strand = '-' THEN reverse(translate(substr(q.seq, i.a, i.b - i.a + 1), 'ACGT', 'TGCA')) ELSE substr(q.seq, i.a, i.b - i.a + 1) END AS cut FROM (SELECT *, s % 100 + 1 AS a, s % 100 + 30 AS b FROM fx_interval) i JOIN fx_seq q ON q.seq_id = i.strain_id WHERE length(q.seq) >= i.b")
def marker_extract(spark, sf):
    i = view(spark, sf, "fx_interval").selectExpr("*", "cast(s % 100 + 1 as int) as a", "cast(s % 100 + 30 as int) as b")
    q = view(spark, sf, "fx_seq").withColumnRenamed("seq_id", "strain_id")
    return i.join(q, "strain_id").where(F.length("seq") >= F.col("b")).select("strain_id", "s", "e", "strand", sq.subsequence(F.col("seq"), F.col("a"), F.col("b"), F.col("strand")).alias("cut"))


@query("SELECT read_id, ord, last_value(seq IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY ord, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM (SELECT l_orderkey AS read_id, l_linenumber AS ord, l_partkey * 10000 + l_suppkey AS line, CASE WHEN l_linenumber = 1 OR l_returnflag = 'R' THEN l_returnflag || l_linestatus END AS seq FROM lineitem) x")
def sam_inherit_seq(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines = li.selectExpr("l_orderkey as read_id", "l_linenumber as ord", "struct(l_linenumber, l_partkey * 10000 + l_suppkey) as line", "case when l_linenumber = 1 or l_returnflag = 'R' then l_returnflag || l_linestatus end as seq")
    return rd.inherit_sequence(lines, "read_id", "line", ("seq",)).select("read_id", "ord", "seq")


@query("SELECT ord, read_id, least(a, b) AS sstart, greatest(a, b) AS send, CASE WHEN a > b THEN '-' ELSE '+' END AS strand FROM (SELECT ord, read_id, CASE WHEN strand = '-' THEN e ELSE s END AS a, CASE WHEN strand = '-' THEN s ELSE e END AS b FROM fx_interval) x WHERE abs(a - b) + 1 >= 75")
def blast_normalize(spark, sf):
    hits = view(spark, sf, "fx_interval").selectExpr("ord", "read_id", "case when strand = '-' then e else s end as sstart", "case when strand = '-' then s else e end as send")
    return rd.normalise_blast(hits, 75).select("ord", "read_id", "sstart", "send", "strand")


@query("SELECT o_orderkey, o_orderstatus AS gene, 'p' || o_orderkey AS last_dup FROM orders")
def gff_attr_map(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.concat(F.lit("gbkey=Gene;gene="), F.col("o_orderstatus"), F.lit(";Name=x;p=0;p=p"), F.col("o_orderkey").cast("string"))
    attr = rd.attributes(text)
    return o.select("o_orderkey", attr["gene"].alias("gene"), attr["p"].alias("last_dup"))


@query("SELECT i.strain_id, count(*) AS n FROM fx_interval i SEMI JOIN (SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7') k ON i.strain_id = k.s_suppkey GROUP BY i.strain_id")
def subset_semi(spark, sf):
    keep = spark.read.parquet(f"{sf}/supplier.parquet").where("s_name like '%7'").select(F.col("s_suppkey").alias("strain_id"))
    return view(spark, sf, "fx_interval").join(keep, "strain_id", "left_semi").groupBy("strain_id").agg(F.count("*").alias("n"))


@query("SELECT cast(n_regionkey AS string) AS rep, cast(n_nationkey AS string) AS strain_id FROM nation")
def cluster_explode(spark, sf):
    lines = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_regionkey").cast("string").alias("rep")).agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")).cast("array<string>"), ",").alias("m"))
    return rd.explode_clusters(lines.select(F.concat_ws(":", "rep", "m").alias("value")), "value")


PROFILE = "SELECT t, kind AS strain_id, round(sum(value), 4) AS abundance FROM fx_series GROUP BY t, kind"


@query(f"SELECT t, strain_id, abundance FROM ({PROFILE}) x")
def abund_unpivot(spark, sf):
    return ab.to_long(ab.to_wide(run(spark, sf, PROFILE))).where("abundance is not null")


@query("SELECT t, {} FROM fx_series GROUP BY t".format(", ".join(f"round(sum(CASE WHEN kind = '{k}' THEN value END), 4) AS {k}" for k in ("click", "purchase", "view"))))
def abund_pivot(spark, sf):
    return ab.to_wide(run(spark, sf, PROFILE), strains=["click", "purchase", "view"])


TRIANGLE = "SELECT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j, cast(sum(l_quantity) AS bigint) AS d FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2"


@query(f"WITH p AS ({TRIANGLE}) SELECT i, j, d FROM p UNION ALL SELECT j AS i, i AS j, d FROM p")
def symmetrize(spark, sf):
    return cl.symmetrize(run(spark, sf, TRIANGLE), "i", "j", "d")


# ---- filters

PASS = "CASE WHEN is_edge THEN aln_len ELSE read_len END"


@query(f"SELECT read_id, ord, marker_id FROM fx_aln WHERE read_len > 120 AND n_match / cast({PASS} AS double) > 0.975 AND exp_err < 0.01 * read_len")
def filter_reads(spark, sf):
    ok = ev.passes_filter(F.col("aln_len"), F.col("read_len"), F.col("n_match"), F.col("aln_len"), F.col("exp_err"), F.col("is_edge"), min_length=120, error_rate=0.01)
    return view(spark, sf, "fx_aln").where(ok).select("read_id", "ord", "marker_id")


@query(f"WITH x AS (SELECT *, n_match / cast({PASS} AS double) > 0.985 AND exp_err < 0.01 * read_len AS ok FROM fx_aln), y AS (SELECT *, min(CASE WHEN ok THEN ord END) OVER (PARTITION BY read_id) AS f FROM x) SELECT read_id, ord, ok FROM y WHERE f IS NULL OR ord <= f")
def first_pass_per_read(spark, sf):
    ok = ev.passes_filter(F.col("aln_len"), F.col("read_len"), F.col("n_match"), F.col("aln_len"), F.col("exp_err"), F.col("is_edge"), identity=0.985, error_rate=0.01)
    return ev.until_first_pass(view(spark, sf, "fx_aln").withColumn("ok", ok), "read_id", "ord", "ok").select("read_id", "ord", "ok")


@query("SELECT read_id AS \"READ\", marker_id AS \"MARKER\", cast(is_edge AS int) AS \"IS_EDGE_MAPPED\", read_len AS \"READ_LEN\", read_len - n_match AS \"N_MISMATCHES\", round(100.0 * n_match / read_len, 4) AS \"PCT_ID\", round(exp_err, 4) AS \"EXP_ERRORS\" FROM fx_aln")
def filter_metadata(spark, sf):
    return view(spark, sf, "fx_aln").select(F.col("read_id").alias("READ"), F.col("marker_id").alias("MARKER"), F.col("is_edge").cast("int").alias("IS_EDGE_MAPPED"), F.col("read_len").alias("READ_LEN"), (F.col("read_len") - F.col("n_match")).alias("N_MISMATCHES"), r6(100.0 * F.col("n_match") / F.col("read_len"), 4).alias("PCT_ID"), r6("exp_err", 4).alias("EXP_ERRORS"))


QUAL = "substr(md5(cast(event_id AS string)), 1, 20)"


@query(f"SELECT event_id, round(list_sum([pow(10, -(ascii(c) - 33) / 10.0) for c in string_split({QUAL}, '')]), 9) AS errors FROM events")
def expected_errors(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", r6(ql.expected_errors(ql.decode(F.expr(QUAL))), 9).alias("errors"))


@query(f"SELECT event_id, array_to_string([ascii(c) - 33 for c in string_split({QUAL}, '')], ',') AS sanger, round(list_sum([10 * log10(pow(10, (ascii(c) - 64) / 10.0) + 1) for c in string_split({QUAL}, '')]), 6) AS solexa FROM events")
def phred_decode(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("q", F.expr(QUAL))
    return e.select("event_id", F.array_join(F.transform(ql.decode(F.col("q")), lambda x: x.cast("int").cast("string")), ",").alias("sanger"), r6(F.aggregate(ql.decode(F.col("q"), "fastq-solexa"), F.lit(0.0), lambda s, x: s + x)).alias("solexa"))


@query("SELECT event_id, (event_id & 4) <> 0 AS unmapped, (event_id & 16) <> 0 AS reverse, (event_id & 256) <> 0 AS secondary FROM events WHERE (event_id & 4) = 0")
def sam_flags(spark, sf):
    e, f = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    return e.where(~al.has_flag(f, "unmapped")).select("event_id", *[al.has_flag(f, n).alias(n) for n in ("unmapped", "reverse", "secondary")])


@query("SELECT seq_id, length(seq) AS n FROM fx_seq WHERE seq_id NOT IN (SELECT seq_id FROM fx_seq WHERE contains(seq, 'ACA'))")
def anti_strains_with_n(spark, sf):
    s = view(spark, sf, "fx_seq")
    return s.join(s.where(sq.count_letter(F.replace("seq", F.lit("ACA"), F.lit("N")), "N") > 0).select("seq_id"), "seq_id", "left_anti").select("seq_id", F.length("seq").cast("bigint").alias("n"))


# ---- joins

@query("SELECT f.pair_id, f.strain_id, round(f.ll + r.ll, 6) AS ll FROM fx_mate f JOIN fx_mate r ON f.pair_id = r.pair_id AND f.strain_id = r.strain_id WHERE f.is_forward AND NOT r.is_forward")
def mate_pair_join(spark, sf):
    m = view(spark, sf, "fx_mate")
    return ev.mate_pairs(m.where("is_forward"), m.where("not is_forward"), "pair_id", "strain_id", "ll").withColumn("ll", r6("ll"))


@query("WITH done AS (SELECT DISTINCT f.pair_id FROM fx_mate f JOIN fx_mate r ON f.pair_id = r.pair_id AND f.strain_id = r.strain_id WHERE f.is_forward AND NOT r.is_forward) SELECT conv_id, turn, pair_id, strain_id FROM fx_mate WHERE pair_id NOT IN (SELECT pair_id FROM done)")
def unpaired_anti(spark, sf):
    m = view(spark, sf, "fx_mate")
    f, r = m.where("is_forward"), m.where("not is_forward")
    return ev.unpaired(f, r, ev.mate_pairs(f, r, "pair_id", "strain_id", "ll"), "pair_id").select("conv_id", "turn", "pair_id", "strain_id")


EXACT = "WITH f AS (SELECT DISTINCT substr(seq, 11, 24) AS frag FROM fx_seq WHERE length(seq) >= 60), g AS (SELECT frag, frag AS probe, '+' AS strand FROM f UNION ALL SELECT frag, reverse(translate(frag, 'ACGT', 'TGCA')), '-' FROM f), m AS (SELECT seq_id, seq, unnest(range(1, greatest(length(seq) - 22, 1))) AS pos FROM fx_seq WHERE length(seq) >= 24)"


@query(f"{EXACT} SELECT g.frag, g.strand, m.seq_id, m.pos FROM m JOIN g ON substr(m.seq, m.pos, 24) = g.probe")
def exact_match_join(spark, sf):
    s = view(spark, sf, "fx_seq")
    frags = s.where("length(seq) >= 60").select(F.substring("seq", 11, 24).alias("frag")).distinct()
    return ev.containment_join(frags, s.where("length(seq) >= 24").withColumnRenamed("seq", "marker_seq"), 15).select("frag", "strand", "seq_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def lookup_broadcast(spark, sf):
    customer, nation = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "nation"))
    lost = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").where(rd.require(F.col("n_name").isNotNull(), "unknown nation"))
    return lost.groupBy("n_name").agg(F.count("*").alias("n"), r6(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT marker_id, strain_id FROM (SELECT l_partkey AS marker_id, l_suppkey AS strain_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey) AS r FROM lineitem) x WHERE r = 1")
def first_owner(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey as marker_id", "l_suppkey as strain_id", "l_orderkey as o")
    return ev.first_owner(li, "marker_id", "strain_id", "o").select("marker_id", "strain_id")


@query("SELECT i.ord, i.read_id, h.name FROM fx_interval i LEFT JOIN (SELECT strain_id % 50 AS k, min(name) AS name FROM fx_strain GROUP BY strain_id % 50) h ON i.strain_id = h.k")
def lookup_head1(spark, sf):
    head = view(spark, sf, "fx_strain").groupBy((F.col("strain_id") % 50).alias("strain_id")).agg(F.min("name").alias("name"))
    return view(spark, sf, "fx_interval").join(head, "strain_id", "left").select("ord", "read_id", "name")


@query("WITH m AS (SELECT i.strain_id, count(DISTINCT i.gene || i.s) AS hits FROM fx_interval i WHERE i.gene || i.s IN (SELECT gene || s FROM fx_interval WHERE strain_id = 5) GROUP BY i.strain_id) SELECT strain_id, hits FROM m ORDER BY hits DESC, strain_id LIMIT 1")
def best_match(spark, sf):
    m = view(spark, sf, "fx_interval").select("strain_id", F.concat("gene", F.col("s").cast("string")).alias("marker"))
    return ev.best_match(m, m.where("strain_id = 5"), "marker", "strain_id")


FREQ = "SELECT frag_id, strain_id, ln(count(*)) AS logfreq FROM fx_hit GROUP BY frag_id, strain_id"


NEXT = "SELECT frag_id, strain_id, frag_id + unnest(range(1, 5)) AS other FROM f"


@query(f"WITH f AS ({FREQ}), n AS ({NEXT}) SELECT n.frag_id AS frag1, b.frag_id AS frag2, n.strain_id, round(a.logfreq + b.logfreq, 6) AS logfreq FROM n JOIN f a ON a.frag_id = n.frag_id AND a.strain_id = n.strain_id JOIN f b ON b.frag_id = n.other AND b.strain_id = n.strain_id")
def pair_freq_join(spark, sf):
    f = run(spark, sf, FREQ)
    shared = f.select(F.col("frag_id").alias("frag1"), "strain_id", F.explode(F.array(*[F.col("frag_id") + k for k in range(1, 5)])).alias("frag2"))
    pairs = shared.join(f.select(F.col("frag_id").alias("frag2"), "strain_id"), ["frag2", "strain_id"], "left_semi").select("frag1", "frag2").distinct()
    return ev.pair_frequencies(pairs, f).select("frag1", "frag2", "strain_id", r6("logfreq").alias("logfreq"))


ISLANDS = "a AS (SELECT *, max(e) OVER (PARTITION BY strain_id, gene ORDER BY s, e, ord, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM fx_interval), b AS (SELECT *, cast(sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY strain_id, gene ORDER BY s, e, ord, read_id ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM a)"


@query(f"WITH {ISLANDS} SELECT strain_id, gene, island, min(s) AS s, max(e) AS e, count(*) AS members FROM b GROUP BY strain_id, gene, island")
def interval_merge(spark, sf):
    return iv.merge(view(spark, sf, "fx_interval"), ["strain_id", "gene"], "s", "e", ["ord", "read_id"])


GFF = "SELECT strain_id, 'g' || cast(s % 97 AS string) AS name, s + 10 AS gs, e + 10 AS ge, ord AS gord FROM fx_interval WHERE gene = 'N'"


@query(f"WITH g AS ({GFF}) SELECT i.ord, i.read_id, g.name, greatest(i.s, g.gs) AS clip_start, least(i.e, g.ge) AS clip_end FROM fx_interval i JOIN g ON i.strain_id = g.strain_id AND i.s <= g.ge AND g.gs <= i.e WHERE i.gene = 'A'")
def overlap_join(spark, sf):
    return iv.overlap_join(view(spark, sf, "fx_interval").where("gene = 'A'"), run(spark, sf, GFF), ["strain_id"], ("s", "e"), ("gs", "ge"), 500).select("ord", "read_id", "name", "clip_start", "clip_end")


@query(f"WITH g AS ({GFF}), x AS (SELECT i.ord, i.read_id, g.name, max(least(i.e, g.ge) - greatest(i.s, g.gs) + 1) AS n FROM fx_interval i JOIN g ON i.strain_id = g.strain_id AND i.s <= g.ge AND g.gs <= i.e WHERE i.gene = 'A' GROUP BY i.ord, i.read_id, g.name) SELECT ord, read_id, string_agg(name, ',' ORDER BY n DESC, name) AS names FROM x GROUP BY ord, read_id")
def overlap_topk(spark, sf):
    o = iv.overlap_join(view(spark, sf, "fx_interval").where("gene = 'A'"), run(spark, sf, GFF), ["strain_id"], ("s", "e"), ("gs", "ge"), 500)
    o = o.groupBy("ord", "read_id", "name").agg(F.max(F.col("clip_end") - F.col("clip_start") + 1).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))), lambda x: x["name"])
    return o.groupBy("ord", "read_id").agg(F.array_join(names, ",").alias("names"))


@query(f"WITH {ISLANDS} SELECT strain_id, gene, island, 'MERGED_' || count(*) || '_' || min(s) AS marker_id, string_agg(cast(ord AS string), '|' ORDER BY s, e, ord, read_id) AS members, '+' AS strand FROM b GROUP BY strain_id, gene, island HAVING count(*) > 1")
def merge_markers(spark, sf):
    b = iv.islands(view(spark, sf, "fx_interval"), ["strain_id", "gene"], "s", "e", ["ord", "read_id"])
    members = F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "ord", "read_id"))), lambda x: x["ord"].cast("string"))
    return b.groupBy("strain_id", "gene", "island").agg(F.concat(F.lit("MERGED_"), F.count("*").cast("string"), F.lit("_"), F.min("s").cast("string")).alias("marker_id"), F.array_join(members, "|").alias("members"), F.count("*").alias("n")).where("n > 1").drop("n").withColumn("strand", F.lit("+"))


@query("SELECT s.strain_id, coalesce(c.rep, -1) AS rep, coalesce(c.w, 0) AS weight FROM fx_strain s LEFT JOIN (SELECT n_nationkey AS k, min(n_regionkey) AS rep, 1 AS w FROM nation GROUP BY n_nationkey) c ON s.strain_id = c.k")
def cluster_expand(spark, sf):
    c = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_nationkey").cast("bigint").alias("strain_id")).agg(F.min("n_regionkey").alias("rep"))
    return view(spark, sf, "fx_strain").select("strain_id").join(c.withColumn("w", F.lit(1)), "strain_id", "left").select("strain_id", F.coalesce("rep", F.lit(-1)).alias("rep"), F.coalesce("w", F.lit(0)).alias("weight"))


@query("SELECT n_regionkey AS rep, string_agg(cast(n_nationkey AS string), ',' ORDER BY cast(n_nationkey AS string)) AS members FROM nation GROUP BY n_regionkey")
def cluster_tsv(spark, sf):
    return wr.cluster_lines(spark.read.parquet(f"{sf}/nation.parquet"), "n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("rep"), "members")


# ---- aggregates

@query("SELECT t, sample_name, CASE WHEN count(*) = 1 AND count(CASE WHEN read_type = 'single' THEN 1 END) = 1 THEN 'single' WHEN count(*) = 2 AND count(DISTINCT read_type) = 2 AND count(CASE WHEN read_type = 'single' THEN 1 END) = 0 THEN 'pair' ELSE 'invalid' END AS shape FROM fx_sample GROUP BY t, sample_name")
def sample_shape(spark, sf):
    single = F.count_if(F.col("read_type") == "single")
    shape = F.when((F.count("*") == 1) & (single == 1), "single").when((F.count("*") == 2) & (F.count_distinct("read_type") == 2) & (single == 0), "pair").otherwise("invalid")
    return view(spark, sf, "fx_sample").groupBy("t", "sample_name").agg(shape.alias("shape"))


WINDOWS = nm.nbinom_logpmf(20.0, 0.25, range(40, 81))
EXACT_HITS = "SELECT frag_id, strain_id, cast(40 + frag_id % 30 AS int) AS frag_len, cast(200 AS int) AS marker_len, cast(ord % 161 + 1 AS int) AS pos FROM fx_hit"


@query(f"WITH w AS (SELECT * FROM (VALUES {', '.join(f'({w}, {lp!r})' for w, lp in WINDOWS)}) v(w, lp)), h AS (SELECT frag_id, strain_id, frag_len, count(*) AS n, count(CASE WHEN pos = 1 OR pos + frag_len - 1 = marker_len THEN 1 END) AS n_edge FROM ({EXACT_HITS}) x GROUP BY frag_id, strain_id, frag_len) SELECT frag_id, strain_id, round(ln(sum(exp(lp) * CASE WHEN w = frag_len THEN n WHEN w > frag_len THEN n_edge ELSE 0 END)), 6) AS logfreq FROM h, w GROUP BY frag_id, strain_id")
def frag_freq(spark, sf):
    return ev.fragment_frequencies(run(spark, sf, EXACT_HITS), WINDOWS).withColumn("logfreq", r6("logfreq"))


@query("SELECT strain_id, cast(sum(e - s + 1) AS bigint) AS total, round(ln(sum(e - s + 1)), 6) AS log_total, cast(floor(quantile_cont(e - s + 1, 0.5)) AS bigint) AS med FROM fx_interval GROUP BY strain_id")
def marker_len_stats(spark, sf):
    size = F.col("e") - F.col("s") + 1
    return view(spark, sf, "fx_interval").groupBy("strain_id").agg(F.sum(size).alias("total"), r6(F.log(F.sum(size))).alias("log_total"), F.floor(F.percentile(size, 0.5)).alias("med"))


@query("SELECT strain_id, string_agg(gene || ':' || n, '|' ORDER BY gene) AS signature FROM (SELECT strain_id, gene, count(*) AS n FROM fx_interval GROUP BY strain_id, gene) x GROUP BY strain_id")
def copy_signature(spark, sf):
    return cl.copy_signature(view(spark, sf, "fx_interval"), "strain_id", "gene")


@query("SELECT t, kind, round(quantile_cont(value, 0.025), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.975), 6) AS q3 FROM fx_series GROUP BY t, kind")
def traj_quantiles(spark, sf):
    return ab.quantiles(view(spark, sf, "fx_series"), ["t", "kind"], "value").select("t", "kind", *[r6(q).alias(q) for q in ("q1", "q2", "q3")])


HALF = "SELECT t, strain_id, sum(value) / sum(sum(value)) OVER (PARTITION BY t) AS p FROM fx_series WHERE sample_no % 2 = {} GROUP BY t, strain_id"


@query(f"WITH a AS ({HALF.format(0)}), b AS ({HALF.format(1)}) SELECT t, round(sqrt(sum(pow(sqrt(coalesce(a.p, 0)) - sqrt(coalesce(b.p, 0)), 2))) / sqrt(2), 6) AS hellinger FROM a FULL JOIN b USING (t, strain_id) GROUP BY t")
def hellinger(spark, sf):
    return ab.hellinger(run(spark, sf, HALF.format(0)), run(spark, sf, HALF.format(1)), ["t"], "strain_id", "p").withColumn("hellinger", r6("hellinger"))


@query("SELECT sha256(string_agg(strain_id || ':' || name, ';' ORDER BY strain_id)) AS signature FROM fx_strain")
def db_signature(spark, sf):
    item = F.struct("strain_id", F.concat(F.col("strain_id").cast("string"), F.lit(":"), F.col("name")).alias("x"))
    return view(spark, sf, "fx_strain").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), ";"), 256).alias("signature"))


# ---- windows and time

@query("SELECT t, cast(dt AS int) AS dt, round(pow(dt, -0.5), 9) AS scale FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS dt FROM (SELECT DISTINCT t FROM fx_sample) x) y WHERE dt IS NOT NULL")
def time_increments(spark, sf):
    return ab.time_increments(view(spark, sf, "fx_sample")).select("t", "dt", r6("scale", 9).alias("scale"))


LATENT = "SELECT strain_id % 20 AS s, t, avg(value) / 100 AS x FROM fx_series GROUP BY strain_id % 20, t"


@query(f"WITH x AS ({LATENT}), d AS (SELECT s, t, x, x - lag(x) OVER (PARTITION BY s ORDER BY t) AS dx, t - lag(t) OVER (PARTITION BY s ORDER BY t) AS dt FROM x), f AS (SELECT sum(CASE WHEN dx IS NULL THEN x * x END) AS first, sum(dx * dx / dt) AS walk, count(DISTINCT s) AS n_s, count(DISTINCT t) AS n_t FROM d) SELECT round(-0.5 * n_s * ln(first) - 0.5 * (n_t - 1) * n_s * ln(walk), 6) AS loglik FROM f")
def jeffreys_loglik(spark, sf):
    w = Window.partitionBy("s").orderBy("t")
    d = run(spark, sf, LATENT).select("s", "t", "x", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    sums = d.agg(F.sum(F.when(F.col("dx").isNull(), F.col("x") * F.col("x"))).alias("first"), F.sum(F.col("dx") * F.col("dx") / F.col("dt")).alias("walk"), F.count_distinct("s").alias("n_s"), F.count_distinct("t").alias("n_t"))
    return sums.select(r6(ab.jeffreys_log_prior(F.col("first"), F.col("walk"), F.col("n_s"), F.col("n_t"))).alias("loglik"))


@query("SELECT sample_no, round(avg(value) OVER (PARTITION BY kind ORDER BY sample_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM fx_series")
def moving_avg(spark, sf):
    return ab.moving_average(view(spark, sf, "fx_series"), ["kind"], ["sample_no"], "value", 10).select("sample_no", r6("mean").alias("mean"))


# ---- scalars

@query("SELECT seq_id, translate(seq, 'ACGTN-', '012345') AS code FROM fx_seq")
def seq_encode(spark, sf):
    return view(spark, sf, "fx_seq").select("seq_id", sq.encode(F.col("seq")).alias("code"))


@query("SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM fx_seq")
def revcomp(spark, sf):
    return view(spark, sf, "fx_seq").select("seq_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT seq_id, cast(length(seq) - length(replace(seq, 'T', '')) AS int) AS n_t, cast(length(seq) AS int) AS n FROM fx_seq")
def count_n(spark, sf):
    return view(spark, sf, "fx_seq").select("seq_id", sq.count_letter(F.col("seq"), "T").alias("n_t"), F.length("seq").alias("n"))


CIGAR = "cast(event_id % 7 + 1 AS string) || 'S' || cast(event_id % 90 + 10 AS string) || 'M' || cast(event_id % 3 + 1 AS string) || 'I' || cast(event_id % 5 + 1 AS string) || 'D' || '12M'"


@query(f"SELECT event_id, array_to_string(regexp_extract_all(c, '\\d+([MIDNSHP=X])', 1), '') AS ops, cast(list_sum([cast(x AS int) for x in regexp_extract_all(c, '(\\d+)([MIDNSHP=X])', 1)]) AS bigint) AS total FROM (SELECT event_id, {CIGAR} AS c FROM events) x")
def cigar_parse(spark, sf):
    ops = al.cigar_ops(F.expr(CIGAR))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.array_join(F.transform(ops, lambda x: x["op"]), "").alias("ops"), F.aggregate(ops, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("total"))


@query("SELECT event_id, cast(event_id % 3 + 1 AS int) AS inserted, cast(event_id % 5 + 1 AS int) AS deleted, cast(event_id % 7 + 1 AS int) AS clipped FROM events")
def cigar_counts(spark, sf):
    c = F.expr(CIGAR)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *[al.cigar_total(c, k).alias(n) for n, k in (("inserted", "I"), ("deleted", "D"), ("clipped", "SH"))])


@query("SELECT seq_id, substr(m, 18, 3) || substr(m, 21, 10) || '--' || substr(m, 31, 15) || substr(m, 46, 2) AS marker_aln, substr(r, 1, 13) || substr(r, 14, 2) || '---' || substr(r, 16, 14) AS read_aln, 17 AS marker_start, 47 AS marker_end FROM (SELECT a.seq_id, a.seq AS m, substr(b.seq, 1, 29) AS r FROM fx_seq a JOIN fx_seq b ON b.seq_id = a.seq_id + 1 WHERE length(a.seq) >= 60 AND length(b.seq) >= 29) x")
def alignment_reconstruct(spark, sf):
    both = run(spark, sf, "SELECT a.seq_id, a.seq AS m, substr(b.seq, 1, 29) AS r FROM fx_seq a JOIN fx_seq b ON b.seq_id = a.seq_id + 1 WHERE length(a.seq) >= 60 AND length(b.seq) >= 29")
    made = al.reconstruct(F.lit("3S10M2I3D12M2S"), F.lit(20), F.col("m"), F.col("r"))
    return both.select("seq_id", made.alias("x")).select("seq_id", "x.marker_aln", "x.read_aln", "x.marker_start", "x.marker_end")


PAIRED = "SELECT seq_id, rpad(s, n, '-') AS x, rpad(r, n, '-') AS y, n FROM (SELECT a.seq_id, a.seq AS s, b.seq AS r, cast(greatest(length(a.seq), length(b.seq)) AS int) AS n FROM fx_seq a JOIN fx_seq b ON b.seq_id = a.seq_id + 1) p"


@query(f"SELECT seq_id, cast(coalesce(list_sum([CASE WHEN x[i] = y[i] THEN 1 ELSE 0 END for i in range(1, n + 1)]), 0) AS int) AS same FROM ({PAIRED}) p")
def aln_identity(spark, sf):
    return run(spark, sf, PAIRED).select("seq_id", al.matches(F.col("x"), F.col("y")).alias("same"))


@query(f"SELECT seq_id, round(coalesce(list_sum([CASE WHEN x[i] = y[i] AND i % 40 > 0 THEN ln(1 - pow(10, -(i % 40) / 10.0)) WHEN x[i] <> y[i] AND x[i] <> 'N' THEN -ln(3) - (i % 40) * ln(10) / 10 ELSE 0 END for i in range(1, n + 1)]), 0) + 2 * (-4 - ln(4)) + 1 * -4 - ln(2), 4) AS ll FROM ({PAIRED}) p")
def phred_loglik(spark, sf):
    q = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i % 40).cast("double"))).otherwise(F.array().cast("array<double>"))
    base = ql.error_log_likelihood(F.col("x"), F.col("y"), q) + ql.indel_log_likelihood(F.lit(2), F.lit(1), -4.0, -4.0) - math.log(2)
    return run(spark, sf, PAIRED).select("seq_id", r6(base, 4).alias("ll"))


@query("SELECT p_partkey, p_name || '|' || p_partkey AS composed, p_brand || '$' || (p_partkey % 7) AS indexed, split_part(p_name || '|' || p_partkey, '|', 2) AS parsed FROM part")
def id_compose(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    c = F.concat_ws("|", "p_name", "p_partkey")
    return part.select("p_partkey", c.alias("composed"), F.concat_ws("$", "p_brand", F.col("p_partkey") % 7).alias("indexed"), F.split_part(c, F.lit("|"), F.lit(2)).alias("parsed"))


@query("SELECT sample_no, round(1 / (1 + exp(-v)), 9) AS p, round(ln(1 + exp(v)) - v / (1 + exp(-v)), 9) AS entropy FROM (SELECT sample_no, (value - 50) / 20 AS v FROM fx_series) x")
def expit_entropy(spark, sf):
    v = (F.col("value") - 50) / 20
    return view(spark, sf, "fx_series").select("sample_no", r6(nm.expit(v), 9).alias("p"), r6(nm.bernoulli_entropy(v), 9).alias("entropy"))


@query("SELECT cast(k AS int) AS w, round(lgamma(k + 20.0) - lgamma(k + 1.0) - lgamma(20.0) + 20 * ln(0.25) + k * ln(0.75), 9) AS logp FROM (SELECT unnest(range(40, 81)) AS k) x")
def nbinom_logpmf(spark, sf):
    return spark.createDataFrame(WINDOWS, "w int, logp double").withColumn("logp", r6("logp", 9))


@query("SELECT a.seq_id, CASE WHEN a.seq = b.seq AND a.seq_id % 3 > 0 THEN round(ln(1 - 0.001), 9) ELSE round(ln(0.001), 9) END AS ll FROM fx_seq a JOIN fx_seq b ON b.seq_id = a.seq_id + 1")
def noiseless_loglik(spark, sf):
    both = run(spark, sf, "SELECT a.seq_id, a.seq AS x, b.seq AS y FROM fx_seq a JOIN fx_seq b ON b.seq_id = a.seq_id + 1")
    return both.select("seq_id", r6(ql.noiseless_log_likelihood(F.col("x"), F.col("y"), F.when(F.col("seq_id") % 3 == 0, 1).otherwise(0), 0.001), 9).alias("ll"))


@query("SELECT sample_id, 'r' || sample_id || CASE read_type WHEN 'paired_1' THEN '/1' WHEN 'paired_2' THEN '/2' ELSE '' END AS read_id FROM fx_sample")
def mate_suffix(spark, sf):
    return view(spark, sf, "fx_sample").select("sample_id", al.with_mate_suffix(F.concat(F.lit("r"), F.col("sample_id").cast("string")), F.col("read_type")).alias("read_id"))


@query("SELECT seq_id, length(seq) AS n FROM fx_seq WHERE length(seq) >= 15")
def min_fragment(spark, sf):
    return ev.long_enough(view(spark, sf, "fx_seq"), "seq").select("seq_id", F.length("seq").cast("bigint").alias("n"))


@query("SELECT i.ord, i.read_id, s.name FROM fx_interval i JOIN fx_strain s ON i.strain_id = s.strain_id")
def hit_strain_join(spark, sf):
    contigs = view(spark, sf, "fx_strain").select("strain_id", "name")
    return ev.hits_with_strains(view(spark, sf, "fx_interval"), contigs, "strain_id", "name").select("ord", "read_id", "name")


# ---- similarity and clustering

ONE_EACH = "SELECT min(seq_id) AS seq_id, seq FROM fx_seq GROUP BY seq"
SETS = f"SELECT DISTINCT seq_id, substr(seq, i, 15) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, greatest(length(seq) - 13, 1))) AS i FROM ({ONE_EACH}) o WHERE length(seq) >= 15) x"
JACCARD = f"s AS ({SETS}), n AS (SELECT seq_id, count(*) AS n FROM s GROUP BY seq_id), c AS (SELECT a.seq_id AS a, b.seq_id AS b, count(*) AS c FROM s a JOIN s b ON a.kmer = b.kmer AND a.seq_id < b.seq_id GROUP BY 1, 2)"


@query("SELECT seq_id, min(seq_id) OVER (PARTITION BY seq) AS class_id FROM fx_seq")
def seq_classes(spark, sf):
    """Copies of a sequence, compared once by their class in the queries below."""
    return cl.classes(view(spark, sf, "fx_seq"), "seq_id", "seq")


@query(f"WITH {JACCARD} SELECT c.a, c.b, round(c.c / (x.n + y.n - c.c), 6) AS jaccard FROM c JOIN n x ON c.a = x.seq_id JOIN n y ON c.b = y.seq_id")
def jaccard_kmer(spark, sf):
    """All pairs with a 15-mer in common; the others' similarity is 0."""
    return ss.jaccard_pairs(run(spark, sf, ONE_EACH), "seq_id", "seq", 15).withColumn("jaccard", r6("jaccard"))


@query(f"WITH s AS ({SETS}), g AS (SELECT seq_id, h, min(md5(h || ':' || kmer)) AS sig FROM s, (SELECT unnest(range(16)) AS h) f GROUP BY seq_id, h) SELECT a.seq_id AS a, b.seq_id AS b, round(count(*) / 16.0, 6)::DOUBLE AS estimate FROM g a JOIN g b ON a.h = b.h AND a.sig = b.sig AND a.seq_id < b.seq_id GROUP BY 1, 2")
def minhash_est(spark, sf):
    """All pairs that agree in one hash or more; the others' estimate is 0."""
    return ss.minhash_pairs(run(spark, sf, ONE_EACH), "seq_id", "seq", 15, 16).withColumn("estimate", r6("estimate"))


@query(f"WITH s AS ({ONE_EACH}) SELECT a.seq_id AS a, b.seq_id AS b, cast(hamming(a.seq, b.seq) AS int) AS d FROM s a JOIN s b ON length(a.seq) = length(b.seq) AND length(a.seq) > 0 AND a.seq_id < b.seq_id WHERE hamming(a.seq, b.seq) <= 3")
def pairwise_hamming(spark, sf):
    return cl.hamming_pairs(run(spark, sf, ONE_EACH).where("length(seq) > 0"), "seq_id", "seq", 3)


@query()
def complete_linkage(spark, sf):
    """The cluster of each distinct sequence, its own where no other is near."""
    near = ss.jaccard_sequences(run(spark, sf, ONE_EACH), "seq_id", "seq", 15, 0.8)  # no cluster has a pair beyond the threshold
    found = cl.complete_linkage(near.select("a", "b", (1 - F.col("jaccard")).alias("d")), 0.2)
    return run(spark, sf, ONE_EACH).select(F.col("seq_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


@query(f"""WITH c AS (SELECT p_partkey AS node, p_size AS cluster FROM part), p AS ({TRIANGLE}),
d AS (SELECT i AS a, j AS b, d FROM p UNION ALL SELECT j, i, d FROM p),
m AS (SELECT d.a, o.cluster AS k, sum(d.d) / n.n AS m FROM d JOIN c o ON d.b = o.node JOIN (SELECT cluster, count(*) AS n FROM c GROUP BY cluster) n ON n.cluster = o.cluster GROUP BY d.a, o.cluster, n.n),
j AS (SELECT m.*, c.cluster FROM m JOIN c ON m.a = c.node),
v AS (SELECT cluster, k, avg(m) AS cm FROM j GROUP BY cluster, k),
o AS (SELECT j.cluster, j.a, round(sum(abs(j.m - v.cm)), 9) AS gap FROM j JOIN v ON j.cluster = v.cluster AND j.k = v.k GROUP BY j.cluster, j.a)
SELECT cluster, a AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY gap, a) AS r FROM o) x WHERE r = 1""")
def cluster_medoid(spark, sf):
    d = cl.symmetrize(run(spark, sf, TRIANGLE), "i", "j", "d").select(F.col("i").alias("a"), F.col("j").alias("b"), "d")
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("cluster"))
    return cl.medoids(d, part).select("cluster", "medoid")


@query("SELECT s.s_suppkey AS strain_id, string_agg(coalesce(f.gene, repeat('-', 3)), '' ORDER BY g.g) AS joined FROM supplier s CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS g) g LEFT JOIN (SELECT strain_id, gene AS g, repeat(gene, 3) AS gene FROM fx_interval GROUP BY strain_id, gene) f ON f.strain_id = s.s_suppkey AND f.g = g.g GROUP BY s.s_suppkey")
def concat_gapfill(spark, sf):
    have = view(spark, sf, "fx_interval").select("strain_id", "gene").distinct().withColumn("aln", F.repeat("gene", F.lit(3)))
    grid = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("strain_id"), F.explode(F.array(*map(F.lit, "ANR"))).alias("gene"))
    full = grid.join(have, ["strain_id", "gene"], "left").withColumn("aln", F.coalesce("aln", F.repeat(F.lit("-"), F.lit(3))))
    return full.groupBy("strain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gene", "aln"))), lambda x: x["aln"]), "").alias("joined"))


@query("WITH k AS (SELECT seq_id, substr(seq, i, 10) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, greatest(length(seq) - 8, 1))) AS i FROM fx_seq WHERE length(seq) >= 10) x) SELECT a.seq_id AS read_id, b.seq_id AS marker_id, count(*) AS seeds FROM (SELECT DISTINCT seq_id, kmer FROM k) a JOIN (SELECT DISTINCT seq_id, kmer FROM k) b ON a.kmer = b.kmer AND a.seq_id < b.seq_id GROUP BY 1, 2 HAVING count(*) >= 5")
def seed_candidates(spark, sf):
    """Each sequence is a read and a marker; a pair of them, whose seeds are the same both ways, is given once, the smaller id as the read."""
    pairs = ss.kmer_pairs(view(spark, sf, "fx_seq"), "seq_id", "seq", 10, 5)
    return pairs.select(F.col("a").alias("read_id"), F.col("b").alias("marker_id"), F.col("common").alias("seeds"))


# ---- model

SAMPLES = "SELECT t, cast(sample_no % 10 AS int) AS n, strain_id % 25 AS rep, max(value) / 20 AS x FROM fx_series GROUP BY t, sample_no % 10, strain_id % 25"
MEMBERS = "SELECT cast(n_nationkey AS bigint) AS rep, cast(n_nationkey * 10 AS bigint) AS strain_id FROM nation UNION ALL SELECT cast(n_nationkey AS bigint), cast(n_nationkey * 10 + 1 AS bigint) FROM nation WHERE n_nationkey % 2 = 0"
PROB = "SELECT strain_id % 25 AS rep, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS prob FROM fx_series GROUP BY strain_id % 25"
INTERPRET = f"s AS ({SAMPLES}), p AS ({PROB}), m AS ({MEMBERS}), k AS (SELECT s.*, max(x) OVER (PARTITION BY t, n) AS mx FROM s WHERE rep IN (SELECT rep FROM p WHERE prob > 0.85)), y AS (SELECT t, n, rep, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY t, n) AS y FROM k), z AS (SELECT rep, count(*) AS c FROM m GROUP BY rep), q AS (SELECT y.t, y.n, m.strain_id, y.y / z.c AS abundance FROM y JOIN m ON y.rep = m.rep JOIN z ON z.rep = m.rep)"


def _profile(spark, sf):
    return ab.interpret(run(spark, sf, SAMPLES), run(spark, sf, PROB), run(spark, sf, MEMBERS), 0.85)


@query(f"WITH {INTERPRET} SELECT t, n, strain_id, round(abundance, 9) AS abundance FROM q")
def interpret_profile(spark, sf):
    return _profile(spark, sf).withColumn("abundance", r6("abundance", 9))


@query(f"WITH {INTERPRET}, l AS (SELECT strain_id, 1000 + strain_id % 7 AS marker_len, 1000000 + strain_id AS genome_len FROM m), w AS (SELECT q.*, sum(abundance * l.marker_len / l.genome_len) OVER (PARTITION BY t, n) AS w FROM q JOIN l ON l.strain_id = q.strain_id) SELECT t, n, strain_id, round(abundance * (100 + t) / 1000 / w, 6) AS overall FROM w")
def overall_abundance(spark, sf):
    lengths = run(spark, sf, MEMBERS).selectExpr("strain_id", "1000 + strain_id % 7 as marker_len", "1000000 + strain_id as genome_len")
    depth = run(spark, sf, "SELECT DISTINCT t, 100 + t AS kept, 1000 AS depth FROM fx_series")
    return ab.overall(_profile(spark, sf), depth, lengths).withColumn("overall", r6("overall"))


@query()
def fragment_length_fit(spark, sf):
    reads = view(spark, sf, "fx_aln").select(F.col("read_len").alias("len"))
    w = inf.length_weights(reads, 2000).orderBy("len").toPandas()
    n, p = inf.fit_negative_binomial(w["len"].to_numpy(float), w["weight"].to_numpy(float))
    return spark.createDataFrame([(float(n), float(p))], "n double, p double")


@query()
def posterior_abundance(spark, sf):
    """Posterior mean abundance and inclusion of ten strain groups over the shipping years."""
    hits = run(spark, sf, "SELECT t, read_id, strain_id % 10 AS strain_id, ll FROM fx_hit").repartition("t", "read_id")  # the one shuffle of reads
    m = hits.groupBy("t", "read_id", "strain_id").agg((F.max("ll") / 10).alias("ll"))
    post = inf.infer(m, {s: 1000 for s in range(10)}, epochs=15, iterations=3, samples=3)
    y = post.samples(500).mean(1)
    rows = [(int(t), int(s), float(y[i, j]), float(post.inclusion()[j])) for i, t in enumerate(post.times) for j, s in enumerate(post.strains)]
    return spark.createDataFrame(rows, "t int, strain_id bigint, abundance double, inclusion double")


@query()
def psis_tail(spark, sf):
    """Shape of the tail of all events' weights."""
    _, k = inf.psis_shape(run(spark, sf, "SELECT value / 20 AS v FROM fx_series"), "v")
    return spark.createDataFrame([(float(k),)], "shape double")


@query("SELECT 'r' || seq_id AS read_id, seq, cast(length(seq) AS int) AS n, round(list_sum([pow(10, -(ascii(c) % 40) / 10.0) for c in string_split(seq, '')]), 6) AS errors FROM fx_seq WHERE length(seq) > 0")
def fastq_parse(spark, sf):
    """Four-line records written from documents and read back."""
    path = f"{shared_dir(spark)}/fastq-{uuid.uuid4().hex}"
    seqs = view(spark, sf, "fx_seq").where("length(seq) > 0")
    reads = seqs.select(F.concat(F.lit("r"), F.col("seq_id").cast("string")).alias("read_id"), "seq", F.transform(F.split("seq", ""), lambda c: (F.ascii(c) % 40).cast("double")).alias("qual"), F.lit("sim").alias("meta"))
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws(" ", "read_id", "meta")), F.col("seq"), F.lit("+"), ql.encode(F.col("qual"))).alias("value")).write.text(path)
    return rd.read_fastq(spark, path).select("read_id", "seq", F.size("qual").alias("n"), r6(ql.expected_errors(F.col("qual")), 6).alias("errors"))
