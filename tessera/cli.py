"""A thin command line: what there is, a query's rows, and checks of recipes.

python -m tessera.cli queries
python -m tessera.cli run NAME SF_DIR [--out PATH | --rows N]
python -m tessera.cli inspect RECIPE
python -m tessera.cli validate RECIPE
python -m tessera.cli grid W,S,E,N --cols 3 --rows 2
python -m tessera.cli train RECIPE CHIPS [--variant NAME]
python -m tessera.cli sweep RECIPE CHIPS [--variant NAME] [--on-train]
python -m tessera.cli eval RECIPE CHIPS [--variant NAME]
python -m tessera.cli infer RECIPE CHIPS [--variant NAME] [--aoi N] [--all] [--threshold T] [--area-filter-m2 A]
python -m tessera.cli aoi-check RECIPE CHIPS [--min-count N] [--min-pixel-fraction F] [--min-valid V]

CHIPS is a Parquet table of the areas' chips (aoi_index, px); see tessera.jobs.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import jobs
from tessera.functions import geo
from tessera.functions.figures import figure, told
from tessera.operators import aoi
from tessera.plans import calibration, catalogue, geometry, history, raster, search
from tessera.plans import aoi as areas
from tessera.sources import recipes

#: Messages of a recipe that are printed; the others are counted.
MOST_MESSAGES = 50
QUERIES = {k: v for part in (calibration, raster, areas, catalogue, geometry, history, search) for k, v in part.QUERIES.items()}


def validate(spark: SparkSession, recipe: recipes.Recipe) -> DataFrame:
    """(level, message) of a recipe: its errors, then its warnings; no rows if it is fine."""
    if not recipe.aois:
        return spark.createDataFrame([("error", "recipe has no AOIs")], "level string, message string")
    split = aoi.split(recipe.areas(spark).withColumn("recipe", F.lit(recipe.name)), "recipe", recipe.val_regions)
    kinds = split.agg(F.array_sort(F.collect_set(F.nullif(F.col("phenotype"), F.lit("")))).alias("kinds"), F.bool_or(F.coalesce("phenotype", F.lit("")) == "").alias("untagged"))
    several = kinds.where(F.size("kinds") > 1).select(F.lit("error").alias("level"), F.concat(F.lit("AOIs span multiple phenotypes "), F.array_join("kinds", ", ")).alias("message"))
    untagged = kinds.where((F.size("kinds") > 0) & (F.size("kinds") < 2) & F.col("untagged")).select(F.lit("warning").alias("level"), aoi.untagged_warning(F.col("kinds")).alias("message"))
    at = split.select("aoi_index", "split", ((F.col("w") + F.col("e")) / 2).alias("lon"), ((F.col("s") + F.col("n")) / 2).alias("lat"))
    near = aoi.close_pairs(at.where("split = 'train'"), at.where("split = 'val'"))
    close = near.select(F.lit("error").alias("level"), told("train AOI %s is %s m from val AOI %s", F.col("train"), figure(F.col("metres"), 0), F.col("val")).alias("message"))
    return several.union(close).union(untagged)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    for name in ("inspect", "validate"):
        commands.add_parser(name).add_argument("recipe")
    grid = commands.add_parser("grid")
    grid.add_argument("bbox")
    grid.add_argument("--cols", type=int, default=3)
    grid.add_argument("--rows", type=int, default=3)
    for name in ("train", "sweep", "eval", "infer", "aoi-check"):
        job = commands.add_parser(name)
        job.add_argument("recipe")
        job.add_argument("chips")
        job.add_argument("--variant")
        if name == "sweep":
            job.add_argument("--on-train", action="store_true")
        if name == "infer":
            job.add_argument("--aoi", type=int, default=0)
            job.add_argument("--all", action="store_true")
            job.add_argument("--threshold", type=float, default=0.5)
            job.add_argument("--area-filter-m2", type=float, default=0.0)
        if name == "aoi-check":
            job.add_argument("--min-count", type=int, default=10)
            job.add_argument("--min-pixel-fraction", type=float, default=0.03)
            job.add_argument("--min-valid", type=float, default=aoi.MIN_VALID_FRACTION)
    asked = parser.parse_args(arguments)
    if asked.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if asked.command == "run":
        rows = QUERIES[asked.name](spark, asked.sf_dir)
        if asked.out:
            rows.write.mode("overwrite").parquet(asked.out)
        else:
            rows.show(asked.rows, truncate=False)
    elif asked.command == "inspect":
        recipe = recipes.load(asked.recipe)
        print(f"{recipe.name}: {recipe.imagery}, {recipe.ground_truth}, {recipe.feature}, {len(recipe.aois)} areas")
        recipe.areas(spark).show(len(recipe.aois) or 1, truncate=False)
    elif asked.command == "validate":
        found = validate(spark, recipes.load(asked.recipe))
        counts = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        first = found.orderBy("level").limit(MOST_MESSAGES).collect()
        print("\n".join(f"{r['level']}: {r['message']}" for r in first) or "fine")
        if (more := sum(counts.values()) - len(first)) > 0:
            print(f"and {more} more")
        return int("error" in counts)
    elif asked.command != "grid":
        recipe, chips = recipes.load(asked.recipe), spark.read.parquet(asked.chips)
        run_dir = recipe.run_dir(asked.variant)
        report = {
            "train": lambda: jobs.train(spark, recipe, chips, run_dir),
            "sweep": lambda: jobs.sweep(spark, recipe, chips, run_dir, asked.on_train),
            "eval": lambda: jobs.evaluate(spark, recipe, chips, run_dir),
            "infer": lambda: jobs.infer(spark, recipe, chips, run_dir, asked.aoi, asked.threshold, asked.area_filter_m2, asked.all),
            "aoi-check": lambda: jobs.check(spark, recipe, chips, asked.min_count, asked.min_pixel_fraction, asked.min_valid),
        }[asked.command]()
        print("\n".join(report.lines))
    else:
        box = spark.range(1).select(geo.parse_bbox(F.lit(asked.bbox)).alias("b")).select("b.*")
        box.select(F.explode(geo.grid_cells({x: F.col(x) for x in "wsen"}, asked.cols, asked.rows)).alias("c")).select("c.*").show(asked.cols * asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
