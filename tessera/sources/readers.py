"""Catalogue and map payloads as Spark data sources: ``open_imagery``, ``cloud_imagery`` and ``map_features``.

A payload is what a service returned for one area, a line of JSON in one of many files. A manifest
beside them says which box and which time each file covers, so a reader opens only the files that a
search can need, and the search's filters go down to it:

    readers.register(spark)
    spark.read.format("open_imagery").option("limit", 20).load(path).where("w <= 3 AND e >= 2")

``box``, ``since``, ``until`` and ``limit`` are options, as they are of the services: an area returns the
first ``limit`` of its features that meet the box and the time, and its line is read no further. Filters
on columns are pushed down besides (``spark.sql.python.filterPushdown.enabled``); they never change which
features an area returned, whether they are pushed down or not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

ITEMS = """aoi_index long, pos int, id string, w double, s double, e double, n double, datetime string, instruments array<string>, title string,
  cloud_cover double, assets map<string, struct<href: string, type: string, alternate: map<string, struct<href: string>>>>, file string"""
WAYS = "aoi_index long, pos int, id long, type string, w double, s double, e double, n double, coords array<struct<lon: double, lat: double>>, tags map<string, string>, file string"
MANIFEST = "file string, w double, s double, e double, n double, since string, until string, areas long"
#: Files that one task reads.
FILES_PER_TASK = 4
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Files(InputPartition):
    files: list[str]


@dataclass(frozen=True)
class Search:
    """What a service is asked for; None asks for all."""

    box: tuple[float, float, float, float] | None = None
    since: str | None = None
    until: str | None = None
    limit: int | None = None

    @classmethod
    def of(cls, options: dict) -> Search:
        given = {k.lower(): v for k, v in dict(options).items()}
        box = tuple(float(x) for x in given["box"].split(",")) if given.get("box") else None
        if box is not None and len(box) != 4:
            raise ValueError(f"a box is w,s,e,n, not {given['box']!r}")
        limit = int(given["limit"]) if given.get("limit") else None
        if limit is not None and limit < 0:
            raise ValueError("a limit is not negative")
        return cls(box, given.get("since") or None, given.get("until") or None, limit)

    def meets(self, w, s, e, n, since, until) -> bool:  # noqa: ANN001
        """Whether a box and a span of time, of which None is unknown, can hold what is asked for."""
        if self.box is not None:
            if None in (w, s, e, n) or not (w <= self.box[2] and e >= self.box[0] and s <= self.box[3] and n >= self.box[1]):
                return False
        return not (self.since is not None and (until is None or until < self.since)) and not (self.until is not None and (since is None or since > self.until))


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class PayloadReader(DataSourceReader):
    """Reads the payloads of the files that the search and the pushed filters leave."""

    def __init__(self, path: str, search: Search, member: str, row):  # noqa: ANN001
        self.path, self.search, self.member, self.row = path.rstrip("/"), search, member, row
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of a box's sides, the time and the area with constants; all others stay with Spark."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if type(f) in _COMPARE and len(name) == 1 and name[0] in ("w", "s", "e", "n", "datetime", "aoi_index") and f.value is not None:
                self.filters.append(f)
            else:
                yield f

    def listed(self) -> list[dict]:
        """The manifest: a row for each file."""
        fs, at = _opened(f"{self.path}/manifest")
        found = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.base_name.startswith("part-")]
        return [json.loads(line) for f in found for line in fs.open_input_stream(f, compression=None).readall().splitlines() if line]

    def needed(self) -> list[dict]:
        return [f for f in self.listed() if self._may_hold(f)]

    def _may_hold(self, of: dict) -> bool:
        """A filter bounds a side from one direction only: for that the file's box bounds all the boxes in it."""
        box = [of.get(k) for k in "wsen"]
        if not self.search.meets(*box, of.get("since"), of.get("until")):
            return False
        for f in self.filters:
            name, low_side = f.attribute[0], isinstance(f, (LessThan, LessThanOrEqual))
            if name in "ws" and (low_side or isinstance(f, EqualTo)) and (of.get(name) is None or not of[name] <= f.value):
                return False
            if name in "en" and (not low_side) and (of.get(name) is None or not of[name] >= f.value):
                return False
            if name == "datetime":
                first, last = of.get("since"), of.get("until")
                if first is None or (low_side or isinstance(f, EqualTo)) and first > f.value or not low_side and last < f.value:
                    return False
        return True

    def partitions(self) -> list[Files]:
        names = sorted(f["file"] for f in self.needed())
        return [Files(names[i : i + FILES_PER_TASK]) for i in range(0, len(names), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.files:
            fs, at = _opened(f"{self.path}/payloads/{name}")
            with fs.open_input_stream(at, compression=None) as stream:
                for line in _lines(stream):
                    yield from self._of_area(json.loads(line), name)

    def _of_area(self, payload: dict, name: str) -> Iterator[tuple]:
        left = self.search.limit
        area = payload.get("aoi_index")
        for pos, one in enumerate(payload.get(self.member) or []):
            if left == 0:
                return
            box, when, rest = self.row(one)
            if not self.search.meets(*box, when, when):
                continue
            left = None if left is None else left - 1
            known = {"aoi_index": area, "datetime": when, **dict(zip("wsen", box, strict=True))}
            if all(known[f.attribute[0]] is not None and _COMPARE[type(f)](known[f.attribute[0]], f.value) for f in self.filters):
                yield (area, pos, *rest, name)


def _lines(stream: pyarrow.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream, of which one at a time is in memory."""
    held: list[bytes] = []
    while part := stream.read(size):
        *whole, rest = part.split(b"\n")
        for line in whole:
            if own := b"".join([*held, line]).strip():
                yield own
            held = []
        held.append(rest)
    if own := b"".join(held).strip():
        yield own


def _number(x) -> float | None:  # noqa: ANN001
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _item(one: dict) -> tuple[tuple, str | None, tuple]:
    """(box, time, columns) of a feature of a catalogue; a box of another size than four is unknown."""
    p = one.get("properties") or {}
    found = one.get("bbox") or []
    box = tuple(_number(x) for x in found) if len(found) == 4 else (None,) * 4
    when = p.get("datetime")
    assets = {k: (a.get("href"), a.get("type"), {o: ((v or {}).get("href"),) for o, v in (a.get("alternate") or {}).items()}) for k, a in (one.get("assets") or {}).items() if a}
    return box, when, (one.get("id"), *box, when, p.get("instruments"), p.get("title"), _number(p.get("eo:cloud_cover")), assets)


def _way(one: dict) -> tuple[tuple, None, tuple]:
    coords = [(_number(c.get("lon")), _number(c.get("lat"))) for c in one.get("geometry") or []]
    lon, lat = [c[0] for c in coords if c[0] is not None], [c[1] for c in coords if c[1] is not None]
    box = (min(lon), min(lat), max(lon), max(lat)) if lon and lat else (None,) * 4
    return box, None, (one.get("id"), one.get("type"), *box, coords, {k: str(v) for k, v in (one.get("tags") or {}).items()})


class _Payloads(DataSource):
    columns, member, row = ITEMS, "features", staticmethod(_item)

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> PayloadReader:  # noqa: ANN001, ARG002
        path = self.options.get("path")
        if not path:
            raise ValueError("a path to payloads is needed")
        return PayloadReader(path, Search.of(self.options), self.member, self.row)


class OpenImagery(_Payloads):
    """Items of an open catalogue."""

    @classmethod
    def name(cls) -> str:
        return "open_imagery"


class CloudImagery(_Payloads):
    """Items of a catalogue with cloud cover."""

    @classmethod
    def name(cls) -> str:
        return "cloud_imagery"


class MapFeatures(_Payloads):
    """Elements of a map; ``box`` asks for those that meet it, and none has a time."""

    columns, member, row = WAYS, "elements", staticmethod(_way)

    @classmethod
    def name(cls) -> str:
        return "map_features"


SOURCES: dict[str, type[DataSource]] = {c.name(): c for c in (OpenImagery, CloudImagery, MapFeatures)}


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session and lets filters go down to them."""
    for c in SOURCES.values():
        spark.dataSource.register(c)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def source(name: str) -> type[DataSource]:
    """The data source of a name; a KeyError names those that there are."""
    if name not in SOURCES:
        raise KeyError(f"unknown data source {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def search(spark: SparkSession, name: str, path: str, box: tuple[float, float, float, float] | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a source for a search; see the options above."""
    register(spark)
    asked = {"box": ",".join(map(repr, map(float, box))) if box is not None else None, "since": since, "until": until, "limit": None if limit is None else str(limit)}
    return spark.read.format(source(name).name()).options(**{k: v for k, v in asked.items() if v is not None}).load(path)


def write_payloads(areas: DataFrame, path: str, files: int, member: str = "features", near: str = "aoi_index") -> None:
    """Writes payloads, a line for each row (aoi_index, features or elements, w, s, e, n, since, until), in about ``files`` files, and their manifest.

    Rows that are near by the column ``near`` share files, so that boxes and times of files stay small.
    """
    line = F.to_json(F.struct("aoi_index", member), {"ignoreNullFields": "false"})
    spark = areas.sparkSession
    areas.repartitionByRange(files, near).select(line.alias("value")).write.mode("overwrite").text(f"{path}/payloads")
    # what each file covers comes from the same areas, by the lines that it holds
    held = spark.read.text(f"{path}/payloads").select(F.get_json_object("value", "$.aoi_index").cast("long").alias("aoi_index"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    covers = areas.select("aoi_index", "w", "s", "e", "n", "since", "until").join(held, "aoi_index").groupBy("file")
    side = [F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.min("since").alias("since"), F.max("until").alias("until"), F.count(F.lit(1)).alias("areas")]
    covers.agg(*side).write.mode("overwrite").json(f"{path}/manifest")
