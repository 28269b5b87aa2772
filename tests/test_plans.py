import numpy as np
import pandas as pd

from shiftscope.functions.numerics import information_scores
from shiftscope.operators import graphs, labels, regimes, scoring
from shiftscope.plans import confounding, constraint, mixtures, ordering
from shiftscope.plans.lagged import LaggedRegimes
from shiftscope.plans.topological import Topological
from shiftscope.sources import generators as gen, readers, sinks
from shiftscope.streaming import monitor


def test_grams_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    x["g"] = np.arange(200) % 2
    df = spark.createDataFrame(x).repartition(5)
    corr, n = scoring.correlation(df, ["a", "b", "c"])
    assert n == 200 and np.allclose(corr, np.corrcoef(x[["a", "b", "c"]].T))
    assert scoring.sampled(df, ["g"], 50).count() < 140


def test_topological_finds_order_and_changes(spark):
    truth = {(0, 1), (1, 2)}
    df = gen.context_rows(spark, truth, 3, 4, 300, 11, {0: [0] * 4, 1: [0, 0, 1, 1], 2: [0] * 4}, form="quad")
    model = Topological(["x0", "x1", "x2"], "context", "spline").fit(df)
    assert {(int(r.src[1]), int(r.dst[1])) for r in model.edges(spark).collect()} == truth
    change = {r.context: r.label for r in model.changes(spark).where("node = 'x1'").collect()}
    assert change["0"] == change["1"] != change["2"] == change["3"]
    assert {(r.node, r.context) for r in model.targets(spark).collect()} == {("x1", "2"), ("x1", "3")}


def test_lagged_finds_links_and_a_partition(spark):
    links = {(0, 0, 1), (1, 1, 1), (1, 0, 1)}
    df, truth = gen.time_series(spark, links, 2, 2, 240, 2, 2, 80, 3)
    model = LaggedRegimes(["x0", "x1"], max_lag=1, min_duration=40, iterations=3).fit(df)
    assert {("x0", "x0", 1), ("x1", "x1", 1)} <= {tuple(r) for r in model.edges(spark).collect()}
    rows = model.partition(spark).collect()
    assert sum(r.duration for r in rows) == 240 and rows[0].begin == 0


def test_confounders(spark):
    shifts = {0: ([0, 1], [0, 0, 1, 1, 2, 2, 3, 3])}
    df = gen.context_rows(spark, set(), 3, 8, 150, 5, confounders=shifts)
    found = {(r.a, r.b): r.confounded for r in confounding.confounders(df, "context", {"x0": [], "x1": [], "x2": []}).collect()}
    assert found["x0", "x1"] and not found["x0", "x2"]


def test_mixtures_share_a_population(spark):
    df = gen.mixed_rows(spark, 400, 2, 6)
    found = mixtures.node_mixtures(df, "row_id", {"x0": [], "x1": ["x0"], "x2": ["x0"]}, k_max=3)
    pairs, sets = mixtures.shared_sets(found)
    assert ["x1", "x2"] in sets
    got = found.where("node = 'x1'").join(df.select("row_id", "label").withColumnRenamed("label", "truth"), "row_id").toPandas()
    assert information_scores(got["truth"].to_numpy(), got["label"].to_numpy())["ami"] > 0.8


def test_constraint_and_order_methods(spark):
    df = gen.context_rows(spark, {(0, 2), (1, 2)}, 3, 1, 1500, 9)
    graph = constraint.discover(df, ["x0", "x1", "x2"])
    assert graph.directed == {(0, 2), (1, 2)}
    df = gen.context_rows(spark, {(0, 2), (1, 2)}, 3, 2, 800, 12, {0: [0, 1], 1: [0, 0], 2: [0, 0]})
    graph, names = constraint.joint(df, ["x0", "x1", "x2"], "context")
    assert names[3:] == ["ctx_1"] and not any(b >= 3 for _, b in graph.directed)
    df = gen.context_rows(spark, {(0, 1)}, 2, 1, 600, 13, form="quad", noise=0.5)
    assert ordering.discover(df, ["x0", "x1"], "cam") == {(0, 1)}


def test_graph_tables(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 2), (0, 2, 4)], "graph int, src int, dst int")
    got = {(r.src, r.dst, r.kind) for r in graphs.cpdag(edges).collect()}
    assert got == {(1, 2, "directed"), (3, 2, "directed"), (2, 4, "directed"), (0, 1, "undirected")}
    cells = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 0, -1), (0, 1, 2, 1), (0, 2, 1, 1)], "graph int, i int, j int, m int")
    assert {(r.src, r.dst, r.kind) for r in graphs.endpoint_edges(cells).collect()} == {(0, 1, "directed"), (1, 2, "bidirected")}
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    pairs = spark.createDataFrame([(3, 1), (1, 4)], "a int, b int")
    assert {r.node: r.component for r in graphs.components(pairs, nodes).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1}


def test_regime_tables(spark):
    golden = [(0, 52, 0), (52, 51, 1), (103, 62, 2)]
    part = spark.createDataFrame(golden, "begin int, duration int, regime int")
    assert [(r.t0, r.tn) for r in regimes.partition_to_windows(part, 1).orderBy("begin").collect()] == [(1, 52), (53, 103), (104, 165)]
    assert regimes.labels_of_segments(part, []).count() == 165
    windows = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "a", 0), (1, "b", 0), (2, "a", 0), (2, "b", 1)], "window int, node string, label int")
    assert {r.window: r.regime for r in regimes.regime_map(windows).collect()} == {0: 0, 1: 1, 2: 0}
    soft = spark.createDataFrame([([0.9, 0.1], [0.9, 0.1]), ([0.1, 0.9], [0.1, 0.9])], "p array<double>, q array<double>")
    assert labels.soft_mutual_information(soft, "p", "q").first()[0] > 0.2


def test_readers_and_sinks(spark, tmp_path):
    for c in range(2):
        (tmp_path / f"rows_context_{c}.tsv").write_text("0\t1\n1.5\t2\n3\t4\n")
    got = readers.context_tables(spark, str(tmp_path / "rows_context_*.tsv"))
    assert got.columns == ["context", "x0", "x1"] and got.count() == 4 and {r.context for r in got.collect()} == {0, 1}
    (tmp_path / "g.tsv").write_text("0\t1\t2\n0.0\t1.0\t0.0\n0.0\t0.0\t1.0\n0.0\t0.0\t0.0\n")
    assert {tuple(r) for r in readers.adjacency(spark, str(tmp_path / "g.tsv")).collect()} == {(0, 1), (1, 2)}
    (tmp_path / "e.txt").write_text("1\t3\n2\t3\n")
    assert {tuple(r) for r in readers.edge_list(spark, str(tmp_path / "e.txt")).collect()} == {(0, 2), (1, 2)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "loc1_2006_0_3.csv").write_text("1,2\n3,4\n5,6\n7,8\n")
    strengths = readers.strength_matrices(spark, str(tmp_path / "m"), 2)
    assert {(r.parent, r.lag, r.child): r.w for r in strengths.collect()}[(1, 1, 0)] == 7.0
    assert readers.strength_means(strengths, 0, 1, 2006).first().w == 4.0
    flux = tmp_path / "flux"
    flux.mkdir()
    lines = ["TIMESTAMP,TA"] + [f"2005{d:04d},1.0" for d in range(40)] + [f"2007{d:04d},{-9999 if d < 3 else 2.0}" for d in range(40)]
    (flux / "FLX_S1_FULLSET_DD_1.csv").write_text("\n".join(lines))
    (flux / "FLX_S2_FULLSET_DD_1.csv").write_text("\n".join(["TIMESTAMP,TA"] + [f"2006{d:04d},-9999" for d in range(40)]))
    meta = spark.createDataFrame([("S1", 2006, 2010), ("S2", 2000, 2010)], "site string, start_year int, end_year int")
    rows = readers.flux_sites(spark, str(flux), meta, ["TA"]).collect()
    assert {(r.site, r.year) for r in rows} == {("S1", 2007)} and sum(r.TA == 0 for r in rows) == 3
    # a file with its columns in another order keeps its values in their columns
    for site, head in (("S3", "TIMESTAMP,TA,P"), ("S4", "P,TIMESTAMP,TA")):
        cells = {"TIMESTAMP": "2006{:04d}", "TA": "1.5", "P": "7"}
        (flux / f"FLX_{site}_FULLSET_DD_1.csv").write_text("\n".join([head, *(",".join(cells[c] for c in head.split(",")).format(d) for d in range(40))]))
    meta = spark.createDataFrame([("S3", 2006, 2010), ("S4", 2000, 2010)], "site string, start_year int, end_year int")
    rows = readers.flux_sites(spark, str(flux), meta, ["TA", "P"]).collect()
    assert {(r.site, r.TA, r.P) for r in rows} == {("S3", 1.5, 7.0), ("S4", 1.5, 7.0)} and len(rows) == 80
    (tmp_path / "rows_context_2.tsv").write_text("1\t0\n0\t1\n")
    assert {(r.x0, r.x1) for r in readers.context_tables(spark, str(tmp_path / "rows_context_*.tsv")).where("context = 2").collect()} == {(1.0, 0.0)}
    np.save(tmp_path / "g1.npy", np.array([[0.0, 1.0], [3.0, 0.0]]))
    genes = readers.perturbation_matrices(spark, str(tmp_path / "g*.npy"), ["a", "b"]).orderBy("row").collect()
    assert [(r.perturbation, round(r.a, 3), round(r.b, 3)) for r in genes] == [("g1", 0.0, 0.693), ("g1", 1.386, 0.0)]
    results = spark.createDataFrame([("N_5_K_2", "m", "f1", 0.5), ("N_5_K_2", "m", "f1", 1.0), ("N_6_K_2", "m", "f1", -1.0), ("N_5_K_3", "m", "f1", 0.1)], "case string, method string, metric string, value double")
    assert [(r.N, r.n, r["mean"]) for r in sinks.sweep(results, {"K": "2"}, "N").collect()] == [(5.0, 2, 0.75), (6.0, 0, None)]
    sinks.write_table(results, str(tmp_path / "out"), ["method"], "tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).count() == 4


def test_stream_alarms(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=60), rng.normal(size=30) + 6])
    rows = pd.DataFrame({"series": 1, "ts": pd.date_range("2024-01-01", periods=90, freq="h"), "value": values})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = monitor.drift_alarms(stream).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("alarms").collect()
    assert found and found[0].direction == 1
    query = monitor.windowed_moments(stream).writeStream.format("memory").queryName("moments").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("moments").where("n = 24").count() >= 2
