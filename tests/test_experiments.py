"""Every experiment at a small size: shapes and floors, no times."""

import numpy as np
from pyspark.sql import functions as F

from skeinlake.operators import workloads
from skeinlake.operators.evaluate import recall_by_distance, timed
from skeinlake.plans import experiments as E
from skeinlake.sources import vecs
from skeinlake.sources.scratch import kept, shared_dir


def test_sweeps_reach_exact_search_at_full_width(spark):
    found = E.cells(spark, 400, 8, queries=10, nlist=8, nprobes=(1, 8), iterations=3).orderBy("nprobe").collect()
    assert [r["nprobe"] for r in found] == [1, 8] and found[0]["recall"] < found[1]["recall"] == 1.0
    found = E.graphs(spark, 300, 8, queries=10, efs=(10, 300), rows_per_shard=150).orderBy("ef").collect()
    assert found[1]["recall"] >= max(0.99, found[0]["recall"])


def test_other_experiments(spark):
    assert E.distances(spark, (4,), 50, 1).count() == 3 and E.brute(spark, (200,), 4, 3, 5, 1).first()["queries_per_second"] > 0
    assert {(r["data"], r["kind"]) for r in E.frontier(spark, 150, 4, 5, 5, (2,), (20,)).collect()} == {(d, k) for d in ("uniform", "clustered") for k in ("ivf", "graph")}
    spread = E.seeds(spark, 200, 4, 5, 2, (1, 2), 5).first()
    assert 0 <= spread["min"] <= spread["mean"] <= 1 and spread["stddev"] >= 0
    found = E.hybrid_tiers(spark, 150, 4, 5, (1, 4), 50, 8, (("common", "w0 w1"), ("rare", "w40"))).collect()
    assert len(found) == 4 and all(0 < r["recall"] <= 1 for r in found)
    fitted = E.crossover(spark, 300, 4, 5, (0.1, 0.9), repeats=1, nlist=4, iterations=1)
    assert fitted[0].where("same_at_full_width").count() == 2 and fitted[1].c_scan > 0 and fitted[1].c_index > 0


def test_vector_files_with_their_truth(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, queries = rng.uniform(-1, 1, (200, 6)).astype(np.float32), rng.uniform(-1, 1, (5, 6)).astype(np.float32)
    truth = np.argsort(((queries[:, None] - rows[None]) ** 2).sum(2), axis=1)[:, :10].astype(np.int32)
    for name, data, kind in (("b.fvecs", rows, "<f4"), ("q.fvecs", queries, "<f4"), ("t.ivecs", truth, "<i4")):
        (tmp_path / name).write_bytes(vecs.encode(data.tolist(), kind))
    found = E.files(spark, *[f"file://{tmp_path}/{n}" for n in ("b.fvecs", "q.fvecs", "t.ivecs")], k=10, nlist=4, nprobes=(4,), efs=(200,)).collect()
    assert all(r["recall"] == 1.0 for r in found) and len(found) == 2


def test_workloads_repeat_and_have_their_shape(spark):
    a, b = (workloads.vectors(spark, 60, 3, clusters=4).orderBy("id").collect() for _ in range(2))
    assert a == b and max(abs(x) for r in a for x in r["vec"]) <= 1.1
    ranks = workloads.documents(spark, 100, 30, 200).select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().orderBy(F.desc("count")).collect()
    assert ranks[0]["w"] == "w0" and ranks[0]["count"] > 3 * ranks[9]["count"]
    row = workloads.labelled(spark.range(4000), [0.1, 0.6]).agg(F.count_if("share_0"), F.count_if("share_1"), F.count_if(F.expr("share_0 and not share_1"))).first()
    assert 300 < row[0] < 500 and 2200 < row[1] < 2600 and row[2] == 0


def test_helpers(spark):
    truth = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7)], "q int, id bigint, dist double")
    found = spark.createDataFrame([(0, 9, 0.7), (0, 1, 0.5), (0, 8, 0.9)], "q int, id bigint, dist double")
    assert recall_by_distance(found, truth, 2) == 1.0
    calls = []
    assert timed(lambda: calls.append(1), 3)["min"] >= 0 and len(calls) == 4
    made = [kept(spark, "x", "helper", lambda path: path) for _ in range(2)]
    assert made[0] == made[1] and made[0].startswith(shared_dir(spark))
