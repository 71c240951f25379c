"""Queries against plain Python over all rows of their tables."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq
from compare import DATA

from tessera.operators import history as T
from tessera.plans import aoi, chips, history, raster

SF = str(DATA / "sf0.001")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def areas():
    """(aoi_index, recipe, region, phenotype, holdout) of all customers."""
    region = {r["r_regionkey"]: r["r_name"] for r in table("region")}
    of_nation = {r["n_nationkey"]: region[r["n_regionkey"]] for r in table("nation")}
    return [(r["c_custkey"], r["c_nationkey"], of_nation[r["c_nationkey"]], "" if r["c_custkey"] % 7 == 0 else r["c_mktsegment"], r["c_custkey"] % 5 == 0) for r in table("customer")]


def test_phenotypes_of_all_areas(spark):
    kinds = defaultdict(set)
    for _, recipe, _, phenotype, _ in areas():
        kinds[recipe].add(phenotype)
    want = {r: (",".join(sorted(k - {""})), len(k - {""}) > 1, len(k - {""}) == 1 and "" in k) for r, k in kinds.items()}
    assert {r["recipe"]: (r["phenotypes"], r["error"], r["warning"]) for r in aoi.phenotype_consistency(spark, SF).collect()} == want


def test_validation_of_all_areas(spark):
    val = defaultdict(bool)
    for _, recipe, region, _, holdout in areas():
        val[recipe] |= holdout or region == "ASIA"
    assert {r["recipe"]: r["has_val"] for r in aoi.has_explicit_val(spark, SF).collect()} == dict(val)


def test_best_epoch_of_whole_histories(spark):
    metric = defaultdict(dict)
    for r in history.epoch_history(spark, SF).collect():
        metric[r["run"]][r["epoch"]] = r["val_iou"]
    want = {}
    for run, of in metric.items():
        seen = {e: v for e, v in of.items() if v is not None}
        best = min(seen, key=lambda e: (-seen[e], e)) if seen else max(of)
        want[run] = (best, seen.get(best))
    assert {r["run"]: (r["best_epoch"], r["best_val_iou"]) for r in history.best_epoch(spark, SF).collect()} == want


def test_best_epoch_without_any_metric(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 2, None), (2, 0, 0.5), (2, 1, 0.5), (2, 2, None)], "run int, epoch long, val_iou double")
    assert {tuple(r) for r in T.best_epoch(rows, "run").collect()} == {(1, 2, None), (2, 0, 0.5)}


def test_all_chips_get_probabilities(spark):
    got = history.pixel_classifier_probabilities(spark, SF).collect()
    want = {(r["vec_id"], i) for r in table("embeddings") for i in range(chips.SIDE**2)}
    assert len(got) == len(want) and {(r["vec_id"], r["i"]) for r in got} == want
    assert all(r["fitted"] == (r["vec_id"] % 2 == 0) and 0 <= r["p"] <= 1 for r in got)


def test_all_ways_are_counted(spark):
    ways = Counter(r["p_partkey"] % 700 for r in table("part"))
    want = {r["vec_id"]: ways[r["vec_id"]] for r in table("embeddings")}
    assert {r["aoi_index"]: r["n_ways"] for r in raster.sample_projection(spark, SF).collect()} == want and 0 in want.values()
