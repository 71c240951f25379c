"""Recipes: which sources, feature and areas make a job. Read from JSON; nothing is executed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.catalogue import ROAD_WIDTHS_M

AOI_SCHEMA = "aoi_index int, w double, s double, e double, n double, region string, notes string, holdout boolean, phenotype string, source_item string, imagery_year int"


@dataclass(frozen=True)
class Training:
    epochs: int = 10
    batch: int = 4
    learning_rate: float = 1e-4
    max_side: int = 1024
    output_dir: str = "models"
    augment: bool = False
    jitter: bool = True
    seed: int = 0

    def resolved(self, **overrides) -> Training:
        """With overrides in place of own values; None leaves a value."""
        return Training(**(self.__dict__ | {k: v for k, v in overrides.items() if v is not None}))


@dataclass(frozen=True)
class Recipe:
    name: str
    imagery: str
    ground_truth: str
    feature: str
    aois: tuple[dict, ...] = ()
    val_regions: tuple[str, ...] = ()
    training: Training = field(default_factory=Training)

    @property
    def namespaces(self) -> dict[str, str]:
        """Keys of the cache's parts: imagery and polygons are shared by recipes that agree on them."""
        return {"recipe": f"{self.imagery}__{self.ground_truth}__{self.feature}", "imagery": self.imagery, "polygons": f"{self.ground_truth}__{self.feature}"}

    def run_dir(self, variant: str | None = None) -> str:
        return "/".join([self.training.output_dir, self.name, *([variant] if variant else [])])

    def areas(self, spark: SparkSession) -> DataFrame:
        """The areas in their order; the ordinal decides which one is last."""
        return spark.createDataFrame([tuple(a.get(k) for k in ("aoi_index", "w", "s", "e", "n", "region", "notes", "holdout", "phenotype", "source_item", "imagery_year")) for a in self.aois], AOI_SCHEMA)

    def area(self, index: int) -> dict:
        if not 0 <= index < len(self.aois):
            raise IndexError(f"area {index} of {len(self.aois)}")
        return self.aois[index]


def area(value, index: int) -> dict:
    """An area from four numbers, or from a dict with a bbox; missing tags are empty, not null."""
    defaults = {"region": "", "notes": "", "holdout": False, "phenotype": "", "source_item": "", "imagery_year": None}
    if isinstance(value, (list, tuple)) and len(value) == 4:
        value = {"bbox": value}
    if not isinstance(value, dict) or len(value.get("bbox", ())) != 4:
        raise TypeError(f"not an area: {value!r}")
    rest = {k: v for k, v in value.items() if k != "bbox"}
    if unknown := rest.keys() - defaults.keys():
        raise TypeError(f"unknown fields of an area: {', '.join(sorted(unknown))}")
    return {"aoi_index": index, **dict(zip("wsen", map(float, value["bbox"]), strict=True)), **defaults, **rest}


def load(path: str | Path) -> Recipe:
    """A recipe from a JSON file: FileNotFoundError, ValueError (not JSON, no name) or TypeError (wrong shape)."""
    spec = json.loads(Path(path).read_text())
    if not isinstance(spec, dict):
        raise TypeError("a recipe is an object")
    if missing := {"name", "imagery", "ground_truth", "feature"} - spec.keys():
        raise ValueError(f"a recipe needs {', '.join(sorted(missing))}")
    return Recipe(**{k: spec[k] for k in ("name", "imagery", "ground_truth", "feature")}, aois=tuple(area(a, i) for i, a in enumerate(spec.get("aois", ()))), val_regions=tuple(spec.get("val_regions", ())), training=Training(**spec.get("training", {})))


def overpass_query(feature: str, w: float, s: float, e: float, n: float) -> str:
    """The text that asks a map service for a feature in a box; boxes go south first."""
    box = f"({s},{w},{n},{e})"
    ways = {
        "building": [f'way["building"]{box};'],
        "park": [f'{kind}["{k}"="{v}"]{box};' for k, v in (("leisure", "park"), ("landuse", "recreation_ground")) for kind in ("way", "relation")],
        "parking": [f'way["{k}"="{v}"]{box};' for k, v in (("amenity", "parking"), ("parking", "surface"))],
        "road": [f'way["highway"~"^({"|".join(ROAD_WIDTHS_M)})$"]{box};'],
    }
    if not isinstance(feature, str):
        raise TypeError("a feature is a name")
    if feature not in ways:
        raise KeyError(f"unknown feature {feature!r}")
    return f"[out:json][timeout:60];({''.join(ways[feature])});out geom tags;"
