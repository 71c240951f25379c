"""Table functions for lateral joins: the candidates of an area tried one after the other, and a feature's geometries in a payload."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.operators.catalogue import FEATURES, FeatureSpec

#: Why an item can't serve.
FEW_BANDS = "COG has {} band(s); RGB needs >= 3"
OTHER_TYPES = "COG dtypes {} not in {{'uint8'}} (likely a DSM / elevation product masquerading as imagery)"
NONE_USABLE = "no usable item; rejected: "


def reject_reason(bands: int | None, dtypes: list[str] | None) -> str | None:
    """Why an item with these bands is no colour image; None if it is one."""
    if (bands or 0) < 3:
        return FEW_BANDS.format(bands or 0)
    first = tuple((dtypes or [])[:3])
    return None if len(first) == 3 and set(first) == {"uint8"} else OTHER_TYPES.format(first)


class _Attempts:
    def eval(self, items: list) -> Iterator[tuple]:
        """The items in their order up to the first that can serve, with the reasons of those before it."""
        for at, x in enumerate(items or [], 1):
            reason = reject_reason(x["bands"], x["dtypes"])
            yield at, x["id"], x["href"], reason
            if reason is None:
                return


class _Geometries:
    def eval(self, feature: str, elements: list, nth: list | None = None) -> Iterator[tuple]:
        """The ways of a feature among the elements of a payload, with their kind; a KeyError names an unknown feature.

        ``nth`` tells the positions of the elements where these are a part of a payload.
        """
        spec: FeatureSpec = FEATURES[feature]
        for ord_, e in zip(nth or range(len(elements or [])), elements or [], strict=True):
            if e is None or e["type"] != "way" or not spec.holds(e["tags"] or {}):
                continue
            line = [(p["lon"], p["lat"]) for p in e["geometry"] or []]
            if len(line) >= 2:
                yield ord_, "Polygon" if len(line) >= 4 and line[0] == line[-1] else "LineString", [list(p) for p in line], e["tags"]


attempts = udtf(_Attempts, returnType="rank int, id string, href string, reason string", useArrow=True)
geometries = udtf(_Geometries, returnType="ord long, kind string, line array<array<double>>, tags map<string,string>", useArrow=True)


def tried(candidates: DataFrame) -> DataFrame:
    """(aoi_index, rank, id, href, reason) of the candidates (aoi_index, rank, id, href, bands, dtypes) that are tried: all up to the first usable one."""
    items = F.sort_array(F.collect_list(F.struct("rank", "id", "href", "bands", "dtypes")))
    return candidates.groupBy("aoi_index").agg(items.alias("items")).lateralJoin(attempts(F.col("items").outer())).select("aoi_index", "rank", "id", "href", "reason")


def chosen(candidates: DataFrame, required: bool = False) -> DataFrame:
    """(aoi_index, id, href, rejects, error): the first usable candidate of each area, those that were rejected before it with reasons.

    An area without a usable one has an error that tells all rejects; with ``required`` the job fails with it.
    """
    ok = F.col("reason").isNull()
    rejects = F.transform(F.sort_array(F.collect_list(F.when(~ok, F.struct("rank", "id", "reason")))), lambda x: F.struct(x["id"].alias("id"), x["reason"].alias("reason")))
    found = tried(candidates).groupBy("aoi_index").agg(F.max(F.when(ok, F.struct("id", "href"))).alias("x"), rejects.alias("rejects"))
    told = F.array_join(F.transform("rejects", lambda r: F.concat(r["id"], F.lit(": "), r["reason"])), "; ")
    error = F.when(F.col("x").isNull(), F.concat(F.lit(NONE_USABLE), told))
    if required:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("area "), F.col("aoi_index").cast("string"), F.lit(": "), error))).cast("string")
    return found.select("aoi_index", "x.id", "x.href", "rejects", error.alias("error"))
