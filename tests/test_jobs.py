"""Jobs of a recipe from the command line, against plain Python."""

import json

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tessera import cli, jobs
from tessera.operators import calibration
from tessera.plans import chips
from tessera.sources import recipes

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("jobs")
    aois = [{"bbox": [0.01 * i, 35.0, 0.01 * i + 0.005, 35.005], "region": "east" if i % 2 else "west", "holdout": i >= 12, "notes": "n" if i == 12 else ""} for i in range(20)]
    spec = {"name": "r", "imagery": "open", "ground_truth": "map", "feature": "building", "aois": aois, "training": {"epochs": 2, "batch": 6, "learning_rate": 0.05, "output_dir": str(top / "models")}}
    (top / "r.json").write_text(json.dumps(spec))
    chips.chips(spark, SF).where("vec_id < 19").select(F.col("vec_id").alias("aoi_index"), "px").write.parquet(str(top / "chips"))
    return top, recipes.load(top / "r.json"), {r["aoi_index"]: r["px"] for r in spark.read.parquet(str(top / "chips")).collect()}


def scores(px, predicted):
    tp, fp, fn = (sum(x["valid"] and bool(y) == a and x["target"] == b for x, y in zip(px, predicted, strict=True)) for a, b in ((True, 1), (True, 0), (False, 1)))
    return (1.0, 1.0) if tp + fp + fn == 0 else (tp / (tp + fp + fn), 2 * tp / (2 * tp + fp + fn))


def run(capsys, *arguments):
    assert cli.main([str(a) for a in arguments]) == 0
    return capsys.readouterr().out.splitlines()


def test_evaluation_and_sweep_before_a_training(job, capsys):
    top, _, px = job
    lines = run(capsys, "eval", top / "r.json", top / "chips", "--variant", "none")
    found = [scores(px[k], [x["p"] > 0.5 for x in px[k]]) for k in range(12, 19)]
    assert lines[0].startswith("WARNING") and lines[1:3] == [f"IoU = {np.mean([i for i, _ in found]):.4f}", f"F1  = {np.mean([f for _, f in found]):.4f}"]
    assert lines[3] == "per-region (argmax):" and [x.split(":")[0].strip() for x in lines[4:]] == ["east", "west"]
    lines = run(capsys, "sweep", top / "r.json", top / "chips", "--variant", "none")
    assert sum(x.startswith("AOI ") for x in lines) == 7
    for k in (12, 18):
        plain = [scores(px[k], [x["p"] >= t for x in px[k]]) for t in calibration.THRESHOLDS]
        line = next(x for x in lines if x.startswith(f"AOI {k} "))
        assert float(line.split("IoU=")[1].split()[0]) >= round(max(i for i, _ in plain), 4)  # area filters can only add to the choice
    written = json.loads(next((top / "models" / "r" / "none" / "thresholds").glob("part-*.json")).read_text().splitlines()[0])
    assert len(written["sweep"]) == len(calibration.THRESHOLDS) * len(calibration.AREA_FILTERS_M2)
    assert sum(x.startswith("AOI ") for x in run(capsys, "sweep", top / "r.json", top / "chips", "--on-train", "--variant", "none")) == 12


def test_training_then_the_jobs_that_use_it(job, capsys):
    top, _, px = job
    lines = run(capsys, "train", top / "r.json", top / "chips")
    assert lines[0].startswith("artifacts: ") and [x[:10] for x in lines[1:3]] == ["epoch   1:", "epoch   2:"] and lines[3].startswith("best epoch = ")
    best = lines[3].split("val_iou=")[1].rstrip(")")
    lines = run(capsys, "eval", top / "r.json", top / "chips")
    assert lines[0].startswith("loaded epoch ") and lines[1] == f"IoU = {best}"
    lines = run(capsys, "infer", top / "r.json", top / "chips", "--aoi", 0, "--threshold", 0.3)
    assert lines[1].startswith("AOI 12 [west] bbox=(0.12, 35.0, 0.125, 35.005)") and lines[2] == "  notes: n"
    out = top / "models" / "r" / "infer" / "aoi_0"
    features = [json.loads(x) for f in out.joinpath("prediction").glob("part-*") for x in f.read_text().splitlines()]
    polys = int(next(x for x in lines if "n_pred_polys" in x).split("=")[1])
    assert len(features) == polys > 0
    for f in features:
        for ring in f["geometry"]["coordinates"]:
            assert ring[0] == ring[-1] and all(0.12 - 1e-9 <= x <= 0.125 + 1e-9 and 35 - 1e-9 <= y <= 35.005 + 1e-9 for x, y in ring)
    assert len(run(capsys, "infer", top / "r.json", top / "chips", "--aoi", 3, "--all", "--area-filter-m2", 1e12)) == 6


def test_checks_of_areas(job, capsys):
    top, _, px = job
    rows = [json.loads(x) for x in run(capsys, "aoi-check", top / "r.json", top / "chips", "--min-count", 1)]
    assert len(rows) == 20 and rows[19]["reasons"] == ["imagery fetch failed: no chip"]
    own = px[3]
    assert rows[3]["valid_fraction"] == pytest.approx(sum(x["valid"] for x in own) / 64) and rows[3]["pixel_fraction"] == pytest.approx(sum(x["valid"] * x["target"] for x in own) / sum(x["valid"] for x in own))
    assert rows[3]["hard_pass"] and rows[3]["polygon_count"] > 0


def test_jobs_refuse_what_they_cannot_do(spark, job):
    top, recipe, _ = job
    table = spark.read.parquet(str(top / "chips"))
    with pytest.raises(IndexError, match="area 7 of 7"):
        jobs.infer(spark, recipe, table, str(top / "x"), 7)
    with pytest.raises(ValueError, match="squares"):
        jobs.evaluate(spark, recipe, table.withColumn("px", F.slice("px", 1, 63)), str(top / "x"))
    with pytest.raises(ValueError, match="squares"):
        jobs.evaluate(spark, recipe, table.limit(0), str(top / "x"))
