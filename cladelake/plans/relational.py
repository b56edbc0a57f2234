"""Queries whose text both engines run as it stands."""

from __future__ import annotations

#: name -> text over tables and fixture views.
TEXTS: dict[str, str] = {
    # sources and sinks
    "scan_catalog": "SELECT sample_id, cast(t AS double) AS t, cast(sample_name AS string) AS sample, depth, read_type FROM fx_sample WHERE read_type IN ('single', 'paired_1', 'paired_2')",
    "union_refs": "SELECT genus, species, cast(count(*) AS bigint) AS n FROM (SELECT genus, species, strain_id FROM fx_strain WHERE strain_id % 2 = 0 UNION ALL SELECT genus, species, strain_id FROM fx_strain WHERE strain_id % 3 = 0) u GROUP BY genus, species",
    "dedup_paired": "SELECT min(c_custkey) AS custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) GROUP BY c_nationkey",
    "orphan_markers": "SELECT l_partkey AS marker_id, l_suppkey AS source, cast(count(*) AS bigint) AS n FROM lineitem LEFT ANTI JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3) k ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey",
    # filters
    "ll_threshold": "SELECT t, cast(count(*) AS bigint) AS kept, round(sum(ll), 4) AS total FROM fx_hit WHERE ll >= -60 GROUP BY t",
    "restrict_species": "SELECT strain_id, name FROM fx_strain WHERE lower(genus) = lower('Asia') AND lower(species) = lower('nation_2')",
    "prune_empty": "SELECT strain_id, genus FROM fx_strain WHERE strain_id IN (SELECT strain_id FROM fx_interval WHERE gene = 'R')",
    "case_category": "SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE 'STANDARD%' THEN 'standard' ELSE 'other' END AS category, cast(count(*) AS bigint) AS n, replace(p_brand, 'Brand', 'B') AS brand FROM part GROUP BY 1, 3",
    # joins
    "join_dim": "SELECT s.name, s.genus, cast(count(*) AS bigint) AS n FROM fx_interval i JOIN fx_strain s ON i.strain_id = s.strain_id WHERE i.gene = 'A' GROUP BY s.name, s.genus",
    # aggregates
    "read_depth": "SELECT t, cast(sum(CASE WHEN read_type = 'single' THEN depth ELSE 2 * depth END) AS bigint) AS depth FROM fx_sample GROUP BY t",
    "slice_stats": "SELECT t, cast(count(CASE WHEN read_type = 'paired_1' THEN 1 END) AS bigint) AS pairs, cast(sum(depth) AS bigint) AS total, min(depth) AS least FROM fx_sample GROUP BY t",
    "species_count": "SELECT cast(count(DISTINCT genus) AS bigint) AS genera, cast(count(DISTINCT species) AS bigint) AS species FROM fx_strain",
    "hits_per_read": "SELECT t, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd FROM (SELECT t, read_id, count(*) AS n FROM fx_hit GROUP BY t, read_id) x GROUP BY t",
    "marker_fraction": "SELECT s.genus, round(avg(m.len / cast(s.genome_len AS double)), 9) AS fraction FROM (SELECT strain_id, cast(sum(e - s + 1) AS double) AS len FROM fx_interval GROUP BY strain_id) m JOIN fx_strain s ON s.strain_id = m.strain_id GROUP BY s.genus",
    # order
    "top2_per_read": "SELECT t, read_id, strain_id, ll FROM (SELECT t, read_id, strain_id, ll, row_number() OVER (PARTITION BY t, read_id ORDER BY ll DESC, strain_id, ord) AS r FROM fx_hit) x WHERE r <= 2",
    "longest_marker": "SELECT strain_id, gene, s, e FROM (SELECT *, row_number() OVER (PARTITION BY strain_id, gene ORDER BY e - s DESC, ord, read_id) AS r FROM fx_interval) x WHERE r = 1",
    "closest_len": "SELECT strain_id, s, e, cast(abs(e - s - 100) AS bigint) AS off FROM (SELECT *, row_number() OVER (PARTITION BY strain_id ORDER BY abs(e - s - 100), ord, read_id) AS r FROM fx_interval WHERE abs(e - s - 100) <= 10) x WHERE r = 1",
    "sample_per_group": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id AS string)), doc_id) AS r FROM documents) x WHERE r <= 50",
    # strings
    "strip_suffix": "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)$', '') AS stem, md5(html) AS digest FROM pages",
    "prefix_filter": "SELECT p_partkey, p_type FROM part WHERE regexp_like(p_type, '^(PROMO|SMALL)')",
}
#: Where DuckDB needs other words for the same thing.
DUCK: dict[str, str] = {
    "orphan_markers": "SELECT l_partkey AS marker_id, l_suppkey AS source, cast(count(*) AS bigint) AS n FROM lineitem ANTI JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3) k ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey",
    "strip_suffix": "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)$', '') AS stem, md5(html) AS digest FROM pages",
    "prefix_filter": "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(PROMO|SMALL)')",
}
