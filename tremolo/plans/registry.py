"""All queries of the library and their SQL, by name.

A query is an operator with its inputs. An input is SQL over the tables of the folder
(``{events}``), or another query whose result is read; both give one DataFrame plan for Spark and
one text for the SQL check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bursts, cohort, connectivity, embedding, features, graph, learning, series, spikes, stats
from ..operators.base import SqlOperator, expand

# Recordings are event types, units are users, ticks are microseconds since the start of 2024.
_SPIKES = "SELECT event_type AS rec, user_id AS unit, @MICROS(ts) AS tick FROM {events}"
# A graph of users: who is active next after whom in the purchase stream.
_NEXT = "SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM {events} WHERE event_type = 'purchase'"
_ARCS = f"SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM ({_NEXT}) z WHERE dst IS NOT NULL GROUP BY src, dst"
_EDGES = f"SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src, dst, w FROM ({_ARCS}) p UNION ALL SELECT dst AS src, src AS dst, w FROM ({_ARCS}) q) z WHERE src <> dst GROUP BY src, dst"
_SIGNED = f"SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN -w ELSE w END AS w FROM ({_EDGES}) y"
_NODES = "SELECT DISTINCT user_id AS id FROM {events}"
_MODULES = "SELECT DISTINCT user_id AS id, user_id % 4 AS module FROM {events}"
_PLACES = "SELECT vec_id AS unit, CAST(@AT(embedding, 1) AS DOUBLE) AS x, CAST(@AT(embedding, 2) AS DOUBLE) AS y FROM {embeddings}"
_SAMPLES = "SELECT vec_id AS unit, label AS cluster, CAST(i AS INT) AS i, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, label, @POSLIST(embedding, i, v) FROM {embeddings}) z"
_TEMPLATES = "SELECT label AS unit, vec_id AS electrode, CAST(i AS INT) AS i, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, label, @POSLIST(embedding, i, v) FROM {embeddings}) z"
_PRED = "SELECT o_orderstatus AS label, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_orderkey % 3 = 0 THEN 'P' ELSE 'O' END AS predicted, o_orderpriority AS grp FROM {orders}"
_FITTED = "SELECT c_mktsegment AS grp, c_acctbal AS y, c_acctbal * 0.9 + c_nationkey AS p FROM {customer}"
_SERIES = "SELECT o_custkey AS culture, c_mktsegment AS grp, (@MONTHNO(o_orderdate) - 23941) % 24 AS value, ln(avg(o_totalprice)) AS x FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3"
_GRID = "SELECT 0 AS g UNION ALL SELECT 6 UNION ALL SELECT 12"
_CUSTOMERS = "SELECT c_custkey AS id, c_mktsegment AS a, CAST(n_regionkey AS VARCHAR(10)) AS b, c_mktsegment AS grp, c_mktsegment AS label, c_nationkey AS batch, c_nationkey % 5 AS cluster, c_custkey % 3 <> 0 AS train, c_acctbal AS x FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"
_VALUES = "SELECT l_returnflag AS cluster, l_linestatus AS g, 'quantity' AS feature, 'quantity' AS f, l_quantity AS x FROM {lineitem} UNION ALL SELECT l_returnflag, l_linestatus, 'price', 'price', l_extendedprice FROM {lineitem} UNION ALL SELECT l_returnflag, l_linestatus, 'discount', 'discount', l_discount FROM {lineitem}"
_POOLS = "SELECT 'a' AS var, 'BUILDING' AS value, 'made' AS pool UNION ALL SELECT 'a', 'MACHINERY', 'made' UNION ALL SELECT 'a', 'HOUSEHOLD', 'home' UNION ALL SELECT 'b', '0', 'south' UNION ALL SELECT 'b', '1', 'west' UNION ALL SELECT 'b', '2', 'east'"
_LABELS = "SELECT p_brand AS x, p_size % 7 AS y FROM {part}"
_BINS = "SELECT CAST(floor(e * 5) AS INT) AS bin, avg(e) AS mx, avg(f) AS my, count_if(label % 2 = 0) AS a, count_if(label % 2 = 1) AS b FROM (SELECT CAST(@AT(embedding, 1) AS DOUBLE) AS e, CAST(@AT(embedding, 2) AS DOUBLE) AS f, label FROM {embeddings}) z GROUP BY 1"
_WEIGHTED = "SELECT i, j, w, 1.5 - w AS d, i % 5 - 1 AS li, j % 5 - 1 AS lj FROM (SELECT src AS i, dst AS j, 1 / (1 + w) AS w FROM (" + _EDGES + ") y) z"
_PARTITIONS = "SELECT 1 AS part, id, @IDIV(id, 10) AS community, 0.5 AS weight FROM (" + _NODES + ") a UNION ALL SELECT 2, id, @IDIV(id, 15), 0.3 FROM (" + _NODES + ") b"
_WINDOWS = "SELECT 'first' AS win, 0 AS t0, 172800000000 AS t1 UNION ALL SELECT 'second', 345600000000, 518400000000 UNION ALL SELECT 'overlap', 86400000000, 432000000000"
_BOXES = "SELECT 1 AS box, -0.1 AS x0, -0.1 AS y0, 0.1 AS x1, 0.1 AS y1 UNION ALL SELECT 2, 0.0, 0.0, 0.3, 0.3"
_CANDIDATES = "SELECT 4 AS n, 60000000 AS threshold UNION ALL SELECT 4, 600000000 UNION ALL SELECT 4, 3600000000 UNION ALL SELECT 5, 600000000 UNION ALL SELECT 8, 600000000 UNION ALL SELECT 8, 3600000000"
_LOOKUP = "SELECT 1 AS ord, '1,27' AS chips, 'first' AS info UNION ALL SELECT 2, '3,5', 'second' UNION ALL SELECT 3, '0', 'third'"


class Query:
    """An operator bound to its inputs: callable with (session, folder)."""

    def __init__(self, operator: SqlOperator, params: dict | None = None, **inputs: str | Query):
        self.operator, self.params, self.inputs = operator, params or {}, inputs

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.operator(**{k: read(spark, sf_dir, v) for k, v in self.inputs.items()}, **self.params)

    @property
    def sql(self) -> str:
        given = {k: v.sql if isinstance(v, Query) else re.sub(r"\{(\w+)\}", r"\1", v) for k, v in self.inputs.items()}
        return self.operator.oracle(**given, **self.params)


def read(spark: SparkSession, sf_dir: str, source: str | Query) -> DataFrame:
    """DataFrame of an input: a query's result, or SQL over the folder's tables."""
    if isinstance(source, Query):
        return source(spark, sf_dir)
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in set(re.findall(r"\{(\w+)\}", source))}
    return spark.sql(expand(source, 0), **tables)


_activity = Query(spikes.activity_features, spikes=_SPIKES)
_flags = Query(spikes.unit_activity_features, spikes=_SPIKES)
_binned = Query(spikes.binned_activity, spikes=_SPIKES)
_density = Query(spikes.density_map, points="SELECT label AS cluster, x, y FROM (" + _PLACES.replace("vec_id AS unit", "vec_id AS unit, label") + ") z")
_bursts = Query(bursts.gap_bursts, stream=_SPIKES)
_dunn = Query(bursts.dunn_threshold, stream=_SPIKES, candidates=_CANDIDATES)
_ccg = Query(connectivity.ccg_counts, spikes=_SPIKES)
_sttc = Query(connectivity.tiling_coefficient, spikes=_SPIKES)
_degrees_dir = Query(graph.degrees_dir, edges=_ARCS, nodes=_NODES)
_f = Query(stats.f_measure, labels=_LABELS)
_members = Query(stats.membership_weights, neighbours=_WEIGHTED)

_UNDIRECTED_ALONE = ("transitivity", "assortativity", "local_assortativity", "edge_overlap", "matching_index", "topological_overlap", "rich_club", "rich_club_wei", "threshold_absolute", "weight_conversion", "walk_counts")
_UNDIRECTED_WITH_NODES = ("degrees", "density_und", "clustering", "threshold_proportional", "pajek_lines")
_DIRECTED_WITH_NODES = ("density_dir", "clustering_dir", "transitivity_dir", "clustering_wd", "transitivity_wd")
_BY_MODULE = ("participation", "diversity", "module_zscore", "module_order")

_SQL: dict[str, Query] = {
    "isi": Query(spikes.isi, spikes=_SPIKES),
    "activity_features": _activity,
    "unit_activity_features": _flags,
    "qc_recordings": Query(spikes.qc_recordings, flags=_flags),
    "min_unit_filter": Query(spikes.min_unit_filter, spikes=_SPIKES),
    "amplitude_qc": Query(spikes.amplitude_qc, units="SELECT s_suppkey AS unit, s_acctbal / 5000 AS amplitude FROM {supplier}"),
    "waveform_qc": Query(spikes.waveform_qc, waveforms=_SAMPLES),
    "tonic_removal": Query(spikes.tonic_removal, features=_activity),
    "rebuilt_spikes": Query(spikes.rebuilt_spikes, spikes=_SPIKES, flags=_flags),
    "robust_unit_means": Query(spikes.robust_unit_means, features=_activity),
    "cluster_unit_means": Query(spikes.cluster_unit_means, features=_activity),
    "binned_activity": _binned,
    "range_histogram": Query(spikes.range_histogram, values="SELECT l_returnflag AS g, l_extendedprice AS x FROM {lineitem}"),
    "log_isi_histogram": Query(spikes.log_isi_histogram, spikes=_SPIKES),
    "density_map": _density,
    "cluster_shifts": Query(spikes.cluster_shifts, density=_density),
    "raster": Query(spikes.raster, spikes=_SPIKES),
    "time_split": Query(spikes.time_split, spikes=_SPIKES, windows=_WINDOWS),
    "cumulative_activity": Query(spikes.cumulative_activity, binned=_binned),
    "central_difference": Query(spikes.central_difference, binned=_binned),
    "gaussian3": Query(spikes.gaussian3, binned=_binned),
    "local_peaks": Query(spikes.local_peaks, binned=_binned),
    "network_order": Query(spikes.network_order, spikes=_SPIKES),
    "peak_waveform": Query(spikes.peak_waveform, templates=_TEMPLATES),
    "close_units": Query(spikes.close_units, places=_PLACES),
    "series_autocorrelation": Query(spikes.series_autocorrelation, binned=_binned),
    "trapezoid": Query(spikes.trapezoid, waveforms=_SAMPLES),
    "isi_n_spans": Query(bursts.isi_n_spans, stream=_SPIKES),
    "gap_bursts": _bursts,
    "merged_bursts": Query(bursts.merged_bursts, bursts=_bursts),
    "burst_spike_counts": Query(bursts.burst_spike_counts, bursts=_bursts, stream=_SPIKES),
    "burst_features": Query(bursts.burst_features, bursts=_bursts, stream=_SPIKES),
    "n_grid": Query(bursts.n_grid, stream=_SPIKES),
    "dunn_threshold": _dunn,
    "best_isi_n": Query(bursts.best_isi_n, dunn=_dunn),
    "ccg_counts": _ccg,
    "acg_counts": Query(connectivity.acg_counts, ccg=_ccg),
    "ccg_sum": Query(connectivity.ccg_sum, ccg=_ccg),
    "tiling_coefficient": _sttc,
    "confusion_matrix": Query(stats.confusion_matrix, pred=_PRED),
    "class_metrics": Query(stats.class_metrics, pred=_PRED),
    "confusion_metrics": Query(stats.confusion_metrics, pred=_PRED),
    "cluster_purity": Query(stats.cluster_purity, pred=_PRED),
    "group_accuracy": Query(stats.group_accuracy, pred=_PRED),
    "cv_folds": Query(stats.cv_folds, rows=_CUSTOMERS),
    "one_way_anova": Query(stats.one_way_anova, rows=_CUSTOMERS),
    "regression_by_group": Query(stats.regression_by_group, pred=_FITTED),
    "f_measure": _f,
    "greedy_pairs": Query(stats.greedy_pairs, scores=_f),
    "bin_f_measure": Query(stats.bin_f_measure, bins=_BINS),
    "quadratic_form": Query(stats.quadratic_form, bins=_BINS),
    "informativeness": Query(stats.informativeness, values=_VALUES),
    "cross_entropy": Query(stats.cross_entropy, edges=_WEIGHTED),
    "membership_weights": _members,
    "fuzzy_union": Query(stats.fuzzy_union, weights=_members),
    "supervised_weights": Query(stats.supervised_weights, edges=_WEIGHTED),
    "pooled_groups": Query(cohort.pooled_groups, rows=_CUSTOMERS, pools=_POOLS),
    "one_vs_rest": Query(cohort.one_vs_rest, rows=_CUSTOMERS),
    "culture_groups": Query(cohort.culture_groups, recordings="SELECT o_orderpriority AS chip, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS plated FROM {orders}"),
    "best_recordings": Query(cohort.best_recordings, recordings="SELECT c_mktsegment AS grp, c_custkey AS rec, count(*) AS units FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2"),
    "tolerance_pivot": Query(cohort.tolerance_pivot, series=_SERIES, grid=_GRID),
    "sparse_pivot": Query(cohort.sparse_pivot, series=_SERIES),
    "batch_zscore": Query(cohort.batch_zscore, rows=_CUSTOMERS),
    "input_matrix": Query(cohort.input_matrix, rows=_CUSTOMERS),
    "baseline_norm": Query(cohort.baseline_norm, series=_SERIES),
    "scaled_norm": Query(cohort.scaled_norm, series=_SERIES),
    "column_scaling": Query(cohort.column_scaling, rows=_CUSTOMERS),
    "group_trajectories": Query(cohort.group_trajectories, series=_SERIES),
    "group_log_ratio": Query(cohort.group_log_ratio, series=_SERIES),
    "cluster_proportions": Query(cohort.cluster_proportions, rows=_CUSTOMERS),
    "cluster_heatmap": Query(cohort.cluster_heatmap, values=_VALUES),
    "cluster_quantiles": Query(cohort.cluster_quantiles, values=_VALUES),
    "cluster_waveforms": Query(cohort.cluster_waveforms, waveforms=_SAMPLES),
    "label_frequency": Query(cohort.label_frequency, rows="SELECT p_brand AS label FROM {part}"),
    "removed_clusters": Query(cohort.removed_clusters, units="SELECT l_suppkey AS culture, l_partkey AS unit, l_linenumber AS cluster FROM {lineitem}"),
    "lookup_join": Query(cohort.lookup_join, lookup=_LOOKUP, recordings="SELECT s_suppkey AS id, s_name AS chip_id FROM {supplier}"),
    "path_parts": Query(cohort.path_parts, paths="SELECT page_id AS id, url AS path FROM {pages}"),
    "age_days": Query(cohort.age_days, dates="SELECT event_id AS id, concat('2401', lpad(CAST(day(ts) AS VARCHAR(2)), 2, '0')) AS recorded, '231205' AS plated FROM {events}"),
    "json_metadata": Query(cohort.json_metadata, rows="SELECT event_type AS g, props FROM {events}"),
    "distinct_pairs": Query(cohort.distinct_pairs, pairs=f"SELECT src AS a, dst AS b FROM ({_ARCS}) y"),
    "set_difference": Query(cohort.set_difference, left="SELECT c_custkey AS id FROM {customer}", right="SELECT o_custkey AS id FROM {orders}"),
    "group_product": Query(cohort.group_product, rows=_CUSTOMERS),
    "cohort_cube": Query(cohort.cohort_cube, rows=_CUSTOMERS),
    "degrees_dir": _degrees_dir,
    "joint_degree": Query(graph.joint_degree, degrees=_degrees_dir),
    "signed_strengths": Query(graph.signed_strengths, edges=_SIGNED, nodes=_NODES),
    "clustering_sign": Query(graph.clustering_sign, edges=_SIGNED, nodes=_NODES),
    "assortativity_dir": Query(graph.assortativity_dir, edges=_ARCS),
    "flow_coefficient": Query(graph.flow_coefficient, edges=_ARCS),
    "triad_census": Query(graph.triad_census, edges=_ARCS),
    "agreement": Query(graph.agreement, partitions=_PARTITIONS),
    "partition_distance": Query(graph.partition_distance, labels=_LABELS),
    "spatial_edges": Query(graph.spatial_edges, edges=_EDGES, places=_PLACES),
    "rentian_boxes": Query(graph.rentian_boxes, boxes=_BOXES, edges=_EDGES, places=_PLACES),
    **{name: Query(getattr(graph, name), edges=_EDGES) for name in _UNDIRECTED_ALONE},
    **{name: Query(getattr(graph, name), edges=_EDGES, nodes=_NODES) for name in _UNDIRECTED_WITH_NODES},
    **{name: Query(getattr(graph, name), edges=_ARCS, nodes=_NODES) for name in _DIRECTED_WITH_NODES},
    **{name: Query(getattr(graph, name), edges=_EDGES, modules=_MODULES) for name in _BY_MODULE},
}


def _detected_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.detect_bursts(read(spark, sf_dir, _SPIKES), n=4, isi_n=300_000_000)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = connectivity.Held(read(spark, sf_dir, _SPIKES))
    return connectivity.ccg_links(connectivity.correlograms(held), together=True, held=held)


def _close_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.units_between(read(spark, sf_dir, _PLACES))


def _correlograms(form: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: connectivity.correlograms(read(spark, sf_dir, _SPIKES), form)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_features(read(spark, sf_dir, "SELECT user_id AS id, event_id AS t, value AS x FROM {events}"))


_ROWS = "SELECT vec_id AS id, embedding AS x FROM {embeddings}"


def _components_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.principal_components(read(spark, sf_dir, _ROWS), 3)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every row whose id is divisible by 100, against all rows."""
    rows = read(spark, sf_dir, _ROWS)
    return embedding.nearest_neighbours(rows.where("id % 100 = 0"), rows)


_LABELLED = "SELECT vec_id AS id, CAST(vec_id % 17 AS VARCHAR(4)) AS unit_of, CAST(label % 3 AS VARCHAR(4)) AS label, embedding AS x FROM {embeddings}"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.cross_classify(read(spark, sf_dir, _LABELLED), "logistic", k=3)


def _regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.cross_regress(read(spark, sf_dir, _LABELLED), k=2, trees=20)


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = embedding.principal_components(read(spark, sf_dir, _ROWS), 4)
    return learning.mixture(axes.select("id", F.col("scores").alias("x")), ks=(2, 3))


def _k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.k_means(read(spark, sf_dir, _ROWS), 8)


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.power_qc(read(spark, sf_dir, _SAMPLES))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.waveform_features(read(spark, sf_dir, _SAMPLES))


def _train_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.train_regularity(read(spark, sf_dir, _SPIKES), width=3_600_000_000)


def _network_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.network_regularity(read(spark, sf_dir, _SPIKES), width=3_600_000_000)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(read(spark, sf_dir, _EDGES), read(spark, sf_dir, _NODES))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_distances(read(spark, sf_dir, _EDGES), read(spark, sf_dir, _NODES))


def _path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_statistics(distances=_distances(spark, sf_dir))


def _ccg_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL: 101 rows for each ordered pair of units of a recording."""
    return connectivity.correlograms(read(spark, sf_dir, _SPIKES), "grid")


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.core_numbers(read(spark, sf_dir, _EDGES))


def _covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = f"SELECT rec, unit, @IDIV(tick, 3600000000) AS bin, count(*) AS n FROM ({_SPIKES}) z GROUP BY 1, 2, 3"
    return connectivity.differential_covariance(read(spark, sf_dir, raster))


def _by_sources(kernel: str, schema: str, then: Callable[[DataFrame], DataFrame] = lambda found: found, **params) -> Callable[[SparkSession, str], DataFrame]:  # noqa: ANN003
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = read(spark, sf_dir, f"SELECT 'purchase' AS g, src, dst, w FROM ({_EDGES}) y")
        return then(graph.by_sources(edges, read(spark, sf_dir, f"SELECT 'purchase' AS g, id FROM ({_NODES}) y"), kernel, schema, **params))

    return run


def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda found: found.groupBy("g", *keys).agg(F.sum("betweenness").alias("betweenness"))


def _mean_inverse(found: DataFrame) -> DataFrame:
    pairs = F.sum("nodes") * (F.sum("nodes") - 1)
    return found.groupBy("g").agg(F.when(pairs > 0, F.sum("inverse") / pairs).otherwise(0.0).alias("efficiency"))


def _path_summary(found: DataFrame) -> DataFrame:
    pairs = F.sum("nodes") * (F.sum("nodes") - 1)
    return found.groupBy("g").agg(
        F.when(F.sum("reached") > 0, F.sum("total") / F.sum("reached")).otherwise(0.0).alias("mean_distance"),
        F.when(pairs > 0, F.sum("inverse") / pairs).otherwise(0.0).alias("efficiency"),
        F.min("low").alias("radius"),
        F.max("high").alias("diameter"),
    )


def _kernel(kernel: str, schema: str, **params) -> Callable[[SparkSession, str], DataFrame]:  # noqa: ANN003
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = read(spark, sf_dir, f"SELECT 'purchase' AS g, src, dst, w FROM ({_EDGES}) y")
        return graph.dense(edges, read(spark, sf_dir, f"SELECT 'purchase' AS g, id FROM ({_NODES}) y"), kernel, schema, **params)

    return run


# Kernels over the whole matrix of a graph, and the columns they give beside the graph's name.
_KERNELS = {
    "global_efficiency": "g string, efficiency double",
    "local_efficiency": "g string, id long, efficiency double",
    "pagerank": "g string, id long, rank double",
    "mean_first_passage": "g string, a long, b long, steps double",
    "diffusion_efficiency": "g string, efficiency double",
    "gateway": "g string, id long, gateway double",
    "louvain": "g string, id long, community long, modularity double",
    "spectral_modularity": "g string, id long, community long, modularity double",
    "consensus": "g string, id long, community long",
    "core_periphery": "g string, id long, core long",
    "link_communities": "g string, a long, b long, community long",
    "backbone": "g string, a long, b long, w double, in_tree boolean",
    "s_core": "g string, id long, in_core boolean",
    "navigation": "g string, success double",
    "search_information": "g string, a long, b long, bits double",
    "path_transitivity": "g string, a long, b long, transitivity double",
    "resource_efficiency": "g string, a long, b long, efficiency double",
    "quasi_idempotence": "g string, step long, correlation double",
    "reorder_matrix": "g string, id long, place long",
    "rewired": "g string, a long, b long, w double, swaps long",
    "null_model_signed": "g string, a long, b long, w double",
    "generated": "g string, a long, b long",
    "ks_energy": "g string, energy double, degree double, clustering double, betweenness double, length double",
}

# Forms of kernels with parameters: query -> (kernel, columns, parameters).
_EDGE_LIST = "g string, a long, b long"
_FORMS: dict[str, tuple[str, str, dict]] = {
    "clique_communities": ("clique_communities", "g string, id long, community long", {}),
    "local_efficiency_wei": ("local_efficiency", "g string, id long, efficiency double", {"weighted": True}),
    "rewired_dir": ("rewired", "g string, a long, b long, w double, swaps long", {"directed": True}),
    "rewired_connected": ("rewired", "g string, a long, b long, w double, swaps long", {"connected": True, "iterations": 1}),
    **{f"generated_{kind}": ("generated", _EDGE_LIST, {"kind": kind}) for kind in ("lattice", "ring", "toeplitz", "fractal", "even")},
    "generated_und": ("generated", _EDGE_LIST, {"directed": False}),
}

_NODE_BETWEENNESS = "g string, id long, betweenness double"
_EDGE_BETWEENNESS = "g string, a long, b long, betweenness double"
# Queries over the arcs of a graph, by blocks of sources or whole, without its matrix.
_FROM_SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "distance_wei": _by_sources("distance_wei", "g string, a long, b long, d double, hops double"),
    "global_efficiency_wei": _by_sources("inverse_distances", "g string, inverse double, nodes long", _mean_inverse),
    "betweenness_wei": _by_sources("betweenness", _NODE_BETWEENNESS, _summed("id"), weighted=True),
    "betweenness": _by_sources("betweenness", _NODE_BETWEENNESS, _summed("id")),
    "edge_betweenness": _by_sources("edge_betweenness", _EDGE_BETWEENNESS, _summed("a", "b")),
    "edge_betweenness_wei": _by_sources("edge_betweenness", _EDGE_BETWEENNESS, _summed("a", "b"), weighted=True),
    "edge_range": _by_sources("edge_range", "g string, a long, b long, range double, shortcut boolean"),
    "subgraph_centrality": _by_sources("subgraph_centrality", "g string, id long, centrality double", loops=True),
    "eigenvector_centrality": _by_sources("eigenvector_centrality", "g string, id long, centrality double", whole=True, loops=True),
    "walks": _by_sources("walks", "g string, steps long, walks double", whole=True, loops=True),
    "paths": _by_sources("paths", "g string, edges long, paths double, cycles double, cycle_share double", whole=True, q=3),
    "latticised": _by_sources("latticised", "g string, a long, b long, w double, swaps long", whole=True, seeded=True),
    "generative_model": _by_sources("generative_model", _EDGE_LIST, whole=True, seeded=True),
    "characteristic_path": _by_sources("hop_statistics", "g string, reached long, total long, inverse double, low double, high double, nodes long", _path_summary),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **_SQL,
    "close_units": _close_units,
    "ccg_counts": _correlograms("counts"),
    "ccg_sum": _correlograms("sum"),
    "detect_bursts": _detected_bursts,
    "ccg_links": _links,
    "series_features": _series,
    "principal_components": _components_of_rows,
    "nearest_neighbours": _neighbours,
    "k_means": _k_means,
    "cross_classify": _classified,
    "cross_regress": _regressed,
    "gaussian_mixture": _mixture,
    "power_qc": _power,
    "waveform_features": _shapes,
    "train_regularity": _train_regularity,
    "network_regularity": _network_regularity,
    "ccg_grid": _ccg_grid,
    "distance_bin": _distances,
    "path_statistics": _path_statistics,
    "connected_components": _components,
    "core_numbers": _cores,
    "differential_covariance": _covariance,
    **{f"graph_{name}": query for name, query in _FROM_SOURCES.items()},
    **{f"graph_{name}": _kernel(name, schema) for name, schema in _KERNELS.items()},
    **{f"graph_{name}": _kernel(kernel, schema, **params) for name, (kernel, schema, params) in _FORMS.items()},
}
# Breadth first in one recursion: every pair once for each distance at which a walk meets it, the
# least of them counts. 12 hops are over the diameter of the graphs of the given tables.
_HOPS = (
    "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (" + re.sub(r"\{(\w+)\}", r"\1", expand(_EDGES, 1)) + ") z), "
    "r(a, b, d) AS (SELECT DISTINCT user_id, user_id, 0 FROM events UNION SELECT r.a, e.dst, r.d + 1 FROM r JOIN e ON r.b = e.src WHERE r.d < 12), "
    "h AS (SELECT a, b, CAST(min(d) AS INT) AS d FROM r GROUP BY a, b) "
)
ORACLE_SQL: dict[str, str] = {
    **{name: q.sql for name, q in _SQL.items()},
    "distance_bin": _HOPS + "SELECT a, b, d FROM h",
    "path_statistics": _HOPS + "SELECT a, round(avg(d * 1e0), 6) AS mean_distance, round(avg(1e0 / d), 6) AS mean_inverse, max(d) AS eccentricity, count(*) AS reached FROM h WHERE d > 0 GROUP BY a",
}
