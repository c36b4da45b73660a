"""A Spark data source for paged ArcGIS REST layers, whose pages are read by tasks in parallel.

    spark.dataSource.register(ArcGISSource)
    spark.read.format("arcgis").option("url", ...).option("layer", 4).option("fields", "OBJECTID,Height").option("bbox", "w,s,e,n").load()

Options: url, layer, fields, bbox (west, south, east, north), page_size (2000), total (asked of the service if absent), transport: the import path `module:function` of a
function from URL to bytes, in place of HTTP. Rows are feature (the JSON of a feature), object_id, page, place, and lon and lat of a point (of others, null).

With the option pushdown (true; Spark then wants spark.sql.python.filterPushdown.enabled set), filters on object_id narrow the service's `where` and those on lon and lat its
envelope: what the service needn't give isn't asked for. Spark evaluates all filters on the rows again, so a service that gives more than asked for changes nothing. Which attributes come is the option fields.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlencode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGE, TIMEOUT_S = 2000, 30


class ArcGISError(RuntimeError):
    """The service gave no valid answer."""


def http(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=TIMEOUT_S) as answer:
        return answer.read()


def transport_of(options: dict) -> Callable[[str], bytes]:
    named = options.get("transport")
    if not named:
        return http
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)


def asked(transport: Callable[[str], bytes], url: str) -> dict:
    """The answer as an object; what is no JSON object, or says that there was an error, raises."""
    try:
        said = transport(url)
    except OSError as error:  # no connection, no answer in time, or an answer with a status that is an error
        raise ArcGISError(f"the service could not be reached: {error}") from error
    try:
        answer = json.loads(said)
    except ValueError as error:
        raise ArcGISError("the service gave an unreadable answer") from error
    if not isinstance(answer, dict):
        raise ArcGISError("the service's answer is no object")
    if "error" in answer:
        said = answer["error"]
        raise ArcGISError(str(said.get("message") if isinstance(said, dict) else said))
    return answer


def object_id(feature: dict) -> object:
    attributes = feature.get("attributes")
    return attributes.get("OBJECTID") if isinstance(attributes, dict) else None


def place_of(feature: dict) -> tuple[float | None, float | None]:
    """lon, lat of a feature that is a point."""
    geometry = feature.get("geometry")
    x, y = (geometry.get(c) if isinstance(geometry, dict) else None for c in ("x", "y"))
    whole = all(isinstance(v, int | float) and not isinstance(v, bool) for v in (x, y))
    return (float(x), float(y)) if whole else (None, None)


class Page(InputPartition):
    """Offsets from offset up to end; None: to the layer's end."""

    def __init__(self, offset: int, end: int | None):
        self.offset, self.end = offset, end


class ArcGISReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.page_size = int(options.get("page_size", PAGE))
        box = [float(x) for x in options.get("bbox", "-180,-90,180,90").split(",")]
        if len(box) != 4 or not (box[0] < box[2] and box[1] < box[3]):
            raise ArcGISError("bbox must be west,south,east,north, with west below east and south below north")
        self.box, self.where = box, []

    def url(self, **extra) -> str:
        west, south, east, north = self.box
        query = {"where": " AND ".join(self.where) or "1=1", "geometry": f"{west},{south},{east},{north}", "geometryType": "esriGeometryEnvelope", "inSR": 4326, "outSR": 4326, "spatialRel": "esriSpatialRelIntersects", "outFields": self.options.get("fields", "*"), "orderByFields": "OBJECTID", "f": "json"}
        return f"{self.options['url'].rstrip('/')}/{self.options['layer']}/query?{urlencode(query | extra)}"

    def partitions(self) -> list[Page]:
        if self.box[0] > self.box[2] or self.box[1] > self.box[3]:  # filters that no point meets
            return [Page(0, 0)]
        total = self.options.get("total")
        if total is None:
            total = asked(transport_of(self.options), self.url(returnCountOnly="true")).get("count")
            if total is None:
                raise ArcGISError("the service gave no count")
        starts = [*range(0, max(1, int(total)), self.page_size)]
        # a count may be too low by now, so the last one reads to the end
        return [Page(at, end) for at, end in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition: Page) -> Iterator[tuple]:
        transport, at = transport_of(self.options), partition.offset
        seen: set[int] = set()
        while partition.end is None or at < partition.end:
            size = self.page_size if partition.end is None else partition.end - at
            answer = asked(transport, self.url(resultOffset=at, resultRecordCount=size))
            page = answer.get("features")
            if not isinstance(page, list):
                raise ArcGISError("the service's answer has no features")
            more = answer.get("exceededTransferLimit")
            # what is no object is no feature, but counts in the service's offsets
            features = [feature for feature in page if isinstance(feature, dict)]
            numbers = {object_id(feature) for feature in features}
            # a service that ignores the offset gives the same features for ever
            if more and numbers <= seen:
                raise ArcGISError(f"paging stalled at {at}")
            seen |= numbers - {None}
            for n, feature in enumerate(features, at - partition.offset):
                number = object_id(feature)
                yield json.dumps(feature), None if number is None else int(number), partition.offset, n, *place_of(feature)
            # services may answer with fewer features than asked for
            at += len(page)
            if not more:
                break


class NarrowingReader(ArcGISReader):
    """Reads with Spark's filters in the requests."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All filters are left for Spark as well: an envelope has its borders in it, and it holds what merely touches it."""
        sides = {"lon": (0, 2), "lat": (1, 3)}
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if isinstance(f, In) and f.attribute == ("object_id",) and all(isinstance(v, int) for v in f.value):
                self.where.append(f"OBJECTID IN ({', '.join(map(str, sorted(f.value)))})")
            elif type(f) in signs and f.attribute == ("object_id",) and isinstance(f.value, int):
                self.where.append(f"OBJECTID {signs[type(f)]} {f.value}")
            elif type(f) in signs and f.attribute[0] in sides and isinstance(f.value, int | float) and f.value == f.value:
                low, high = sides[f.attribute[0]]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.box[low] = max(self.box[low], f.value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.box[high] = min(self.box[high], f.value)
            yield f


class ArcGISSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arcgis"

    def schema(self) -> str:
        return "feature string, object_id bigint, page bigint, place bigint, lon double, lat double"

    def reader(self, schema) -> ArcGISReader:
        return (NarrowingReader if self.options.get("pushdown", "false").lower() == "true" else ArcGISReader)(self.options)


def distinct_features(rows: DataFrame) -> DataFrame:
    """Of features with one object id the first; features without an id all stay."""
    first = F.row_number().over(Window.partitionBy("object_id").orderBy("page", "place"))
    named = rows.filter("object_id is not null").withColumn("n", first).filter("n = 1").drop("n")
    return named.unionByName(rows.filter("object_id is null"))
