"""What a service says about itself, as small frames and documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions import crs
from ..plans.catalog import Catalog, Collection

# The conformance classes that are met.
CONFORMANCE = (
    "http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core",
    "http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/geojson",
    "http://www.opengis.net/spec/ogcapi-features-2/1.0/conf/crs",
    "http://www.opengis.net/spec/ogcapi-features-3/1.0/conf/filter",
    "http://www.opengis.net/spec/ogcapi-features-3/1.0/conf/features-filter",
    "http://www.opengis.net/spec/ogcapi-features-3/1.0/conf/queryables",
    "http://www.opengis.net/spec/cql2/1.0/conf/cql2-text",
    "http://www.opengis.net/spec/cql2/1.0/conf/basic-cql2",
    "http://www.opengis.net/spec/cql2/1.0/conf/advanced-comparison-operators",
    "http://www.opengis.net/spec/cql2/1.0/conf/case-insensitive-comparison",
    "http://www.opengis.net/spec/cql2/1.0/conf/basic-spatial-functions",
    "http://www.opengis.net/spec/cql2/1.0/conf/spatial-functions",
    "http://www.opengis.net/spec/cql2/1.0/conf/functions",
)
_JSON_TYPES = {"boolean": "boolean", "int": "integer", "long": "integer", "float": "number", "double": "number", "array": "array"}
_FORMATS = {"int": "int32", "long": "int64", "float": "float", "double": "double", "date": "date", "timestamp": "date-time", "timestamptz": "date-time", "uuid": "uuid"}


def _frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def landing(catalog: Catalog) -> dict:
    links = [{"rel": r, "href": h} for r, h in (("self", "/"), ("service-desc", "/api"), ("conformance", "/conformance"), ("data", "/collections"))]
    return {"title": catalog.title, "description": catalog.description, "links": links}


def conformance(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(c,) for c in CONFORMANCE], "conforms_to string")


def collections(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [
        (c.name, c.title or c.name, c.description, list(map(float, c.spatial_extent)) if c.spatial_extent else None, [crs.to_uri(s) for s in c.srids])
        for c in catalog.collections.values()
    ]
    return _frame(spark, rows, "id string, title string, description string, bbox array<double>, crs array<string>")


def queryables(spark: SparkSession, collection: Collection) -> DataFrame:
    rows = [(n, _JSON_TYPES.get(p.public_kind, "string"), p.title or n) for n, p in collection.queryable().items()]
    return _frame(spark, rows, "name string, type string, title string")


def schema(spark: SparkSession, collection: Collection) -> DataFrame:
    """Properties with their JSON types; what can't be null is required."""
    c = collection
    rows = [(c.id.name, "id", _JSON_TYPES.get(c.id.public_kind, "string"), _FORMATS.get(c.id.public_kind), True)]
    if c.geometry:
        rows.append((c.geometry.name, "primary-geometry", "object", f"geometry-{c.geometry.geometry_type.lower()}", False))
    for p in c.properties:
        role = "primary-instant" if c.times and c.times[0][0] == p.name else None
        rows.append((p.name, role, _JSON_TYPES.get(p.public_kind, "string"), _FORMATS.get(p.public_kind), not p.nullable))
    return _frame(spark, rows, "name string, role string, type string, format string, required boolean")


def json_schema(collection: Collection) -> dict:
    properties = {}
    for p in collection.properties:
        d = {"type": _JSON_TYPES.get(p.public_kind, "string")}
        d |= {"format": _FORMATS[p.public_kind]} if p.public_kind in _FORMATS else {}
        d |= {k: v for k, v in (("title", p.title), ("description", p.description), ("enum", list(p.enum) if p.enum else None)) if v}
        properties[p.name] = d
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "title": collection.title or collection.name,
        "properties": properties,
        "required": [p.name for p in collection.properties if not p.nullable],
    }


def functions(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(f.name, f.description, f.returns, [f"{n}:{k}" for n, k in f.args]) for f in catalog.functions.listed()]
    return _frame(spark, rows, "name string, description string, returns string, arguments array<string>")


#: Types of the parameters that are no plain text.
_PARAMETERS = {
    "limit": {"type": "integer", "minimum": 1},
    "offset": {"type": "integer", "minimum": 0},
    "bbox": {"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 6},
    "bbox-crs": {"type": "string", "format": "uri"},
    "filter-crs": {"type": "string", "format": "uri"},
    "crs": {"type": "string", "format": "uri"},
    "filter-lang": {"type": "string", "enum": ["cql2-text"]},
    "properties": {"type": "array", "items": {"type": "string"}},
}


def _parameter(collection: Collection, name: str, catalog: Catalog) -> dict:
    given = dict(_PARAMETERS.get(name, {"type": "string"})) if name not in collection.params else {"type": "string"}
    if name == "limit":
        given |= {"maximum": catalog.limit_max, "default": catalog.limit_default}
    if name in ("bbox-crs", "filter-crs", "crs"):
        given |= {"enum": [crs.to_uri(s) for s in collection.srids], "default": crs.to_uri(84)}
    if name == "properties":
        given["items"] = {"type": "string", "enum": [p.name for p in collection.properties if not p.hidden]}
    listed = {"style": "form", "explode": False} if given.get("type") == "array" else {}
    return {"name": name, "in": "query", "required": False, "schema": given} | listed


def feature_schema(collection: Collection) -> dict:
    """The JSON schema of a feature, with that of its properties."""
    id_type = {"type": _JSON_TYPES.get(collection.id.public_kind, "string")}
    own = {k: v for k, v in json_schema(collection).items() if k != "$schema"}
    shape = {"nullable": True, "type": "object"} if collection.geometry else {"nullable": True, "enum": [None]}
    return {"type": "object", "required": ["type", "geometry", "properties"], "properties": {"type": {"type": "string", "enum": ["Feature"]}, "id": id_type, "geometry": shape, "properties": own}}


def openapi(catalog: Catalog) -> dict:
    """An OpenAPI 3.0 document: the paths that requests have, their parameters' types and the features' schemas."""
    names = ("f", "limit", "offset", "next", "bbox", "bbox-crs", "datetime", "crs", "properties", "filter", "filter-lang", "filter-crs")
    plain = {"get": {"responses": {"200": {"description": "OK"}}}}
    paths = dict.fromkeys(("/", "/conformance", "/collections", "/functions", "/items"), plain)
    schemas = {}

    def features(schema: dict) -> dict:
        return {"200": {"description": "OK", "content": {"application/geo+json": {"schema": schema}}}}

    for c in catalog.collections.values():
        given = [_parameter(c, n, catalog) for n in (*names, *c.params)]
        base, feature = f"/collections/{c.name}", {"$ref": f"#/components/schemas/{c.name}"}
        schemas[c.name] = feature_schema(c)
        for tail in ("", "/schema", "/queryables"):
            paths[base + tail] = plain
        collected = {"type": "object", "properties": {"type": {"type": "string", "enum": ["FeatureCollection"]}, "features": {"type": "array", "items": feature}}}
        paths[f"{base}/items"] = {"get": {"parameters": given, "responses": features(collected)}}
        one = {"name": "featureId", "in": "path", "required": True, "schema": schemas[c.name]["properties"]["id"]}
        paths[f"{base}/items/{{featureId}}"] = {"get": {"parameters": [one], "responses": features(feature) | {"404": {"description": "Not found"}}}}
    info = {"title": catalog.title, "version": catalog.version, "description": catalog.description}
    return {"openapi": "3.0.3", "info": info, "paths": paths, "components": {"schemas": schemas}}


def telemetry_line(collection: str, returned: int, **more) -> str:
    """One JSON line of what a request did."""
    return json.dumps({"collection": collection, "numberReturned": returned} | more, separators=(",", ":"))
