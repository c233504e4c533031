"""Features as text, row by row in the JVM: GeoJSON (also newline-delimited and as a text sequence), JSON-FG, CSV,
bulk-index lines and GML. Only geometries in WKB need an Arrow function.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import crs
from ..functions.geometry import Geometry, read_wkb, write_wkt
from ..functions.spatial import project_columns, reproject_wkb
from ..plans.catalog import Collection
from ..plans.properties import Property


@dataclass(frozen=True)
class Numbers:
    """Least and most decimals of floats, doubles and ordinates."""

    floats: tuple[int, int] = (0, 5)
    doubles: tuple[int, int] = (0, 8)
    ordinates: tuple[int, int] = (0, 7)


DEGREES, METRES = Numbers(), Numbers(ordinates=(0, 3))


def numbers_for(srid: int) -> Numbers:
    return DEGREES if crs.SRIDS[srid].degrees else METRES


def number_text(value: float, decimals: tuple[int, int]) -> str:
    """Rounded half up to the most decimals, without trailing zeros beyond the least."""
    low, high = decimals
    text = f"{Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-high), ROUND_HALF_UP):f}"
    if "." in text:
        whole, tail = text.split(".")
        tail = tail.rstrip("0").ljust(low, "0")
        text = f"{whole}.{tail}" if tail else whole
    return text.lstrip("-") if not text.strip("-0.") else text


def number(c: Column, decimals: tuple[int, int]) -> Column:
    """The same as a Column; null for what is no number."""
    low, high = decimals
    # a decimal of this scale has a point and all its decimals, and no zero with a sign
    text = F.round(c.cast("decimal(38,18)"), high).cast(f"decimal(38,{high})").cast("string")
    if low == 0 < high:
        text = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    elif low < high:
        text = F.concat(F.substring(text, F.lit(1), F.length(text) - (high - low)), F.rtrim(F.right(text, F.lit(high - low)), F.lit("0")))
    usable = ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 1e19)
    return F.when(usable, text)


def instant(c: Column) -> Column:
    """UTC with Z; seconds' fraction only if there is one, in three or six digits."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\.000000$", ""), r"(\.\d{3})000$", "$1"), F.lit("Z"))


def as_utc(c: Column, kind: str) -> Column:
    return F.to_utc_timestamp(c, F.current_timezone()) if kind == "timestamptz" else c


def json_string(c: Column) -> Column:
    text = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def json_value(c: Column, kind: str, form: Numbers) -> Column:
    """A public value as JSON text; SQL null stays null."""
    if kind in ("int", "long", "boolean"):
        return c.cast("string")
    if kind == "float":
        return number(c, form.floats)
    if kind == "double":
        return number(c, form.doubles)
    if kind == "date":
        return json_string(F.date_format(c, "yyyy-MM-dd"))
    if kind in ("timestamp", "timestamptz"):
        return json_string(instant(as_utc(c, kind)))
    if kind == "array":
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c if kind == "json" else json_string(c)


def _ordinates(c, form: Numbers, swap: bool) -> str:
    c = (c[1], c[0], *c[2:]) if swap else c
    return "[" + ",".join(number_text(v, form.ordinates) for v in c) + "]"


def geometry_json(g: Geometry, form: Numbers = DEGREES, swap: bool = False) -> str:
    """A GeoJSON geometry. Collections can be asked for in filters but are not written."""

    def walk(c, depth):
        return _ordinates(c, form, swap) if depth == 0 else "[" + ",".join(walk(x, depth - 1) for x in c) + "]"

    names = {"POINT": ("Point", 0), "LINESTRING": ("LineString", 1), "POLYGON": ("Polygon", 2)}
    names |= {"MULTIPOINT": ("MultiPoint", 1), "MULTILINESTRING": ("MultiLineString", 2), "MULTIPOLYGON": ("MultiPolygon", 3)}
    if g.kind not in names:
        raise ValueError("a geometry collection can't be written")
    name, depth = names[g.kind]
    return f'{{"type":"{name}","coordinates":{walk(g.coords, depth)}}}'


def wkt(g: Geometry, form: Numbers = DEGREES) -> str:
    return write_wkt(g, lambda v: number_text(v, form.ordinates))


def _each(wkb: Column, write, kind: str = "string") -> Column:
    @pandas_udf(kind)
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else write(read_wkb(bytes(b))) for b in blobs], dtype="object")

    return run(wkb)


def _is_xy(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StructType)


def geometry_text(df: DataFrame, name: str, form: Numbers, swap: bool = False) -> Column:
    c = F.col(f"`{name}`")
    if _is_xy(df, name):
        x, y = number(c["x"], form.ordinates), number(c["y"], form.ordinates)
        first, second = (y, x) if swap else (x, y)
        return F.concat(F.lit('{"type":"Point","coordinates":['), first, F.lit(","), second, F.lit("]}"))
    return _each(c, lambda g: geometry_json(g, form, swap))


def wkt_text(df: DataFrame, name: str, form: Numbers) -> Column:
    c = F.col(f"`{name}`")
    if _is_xy(df, name):
        return F.concat(F.lit("POINT ("), number(c["x"], form.ordinates), F.lit(" "), number(c["y"], form.ordinates), F.lit(")"))
    return _each(c, lambda g: wkt(g, form))


def _pairs(c: Collection, df: DataFrame) -> list[Property]:
    skip = {c.id.name, c.geometry.name if c.geometry else ""}
    return [c.prop(n) for n in df.columns if n not in skip and not n.startswith("_")]


def _object(pairs: list[tuple[str, Column]], nulls: bool = True) -> Column:
    """{"name":text,...}; a null text is written as null, or left out."""
    members = []
    for name, text in pairs:
        member = F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), F.coalesce(text, F.lit("null")) if nulls else text)
        members.append(member)
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")) if members else F.lit("{}")


def _properties(c: Collection, df: DataFrame, form: Numbers, swap: bool) -> Column:
    pairs = []
    for p in _pairs(c, df):
        text = geometry_text(df, p.name, form, swap) if p.kind == "geometry" else json_value(F.col(f"`{p.name}`"), p.public_kind, form)
        pairs.append((p.name, text))
    return _object(pairs, c.write_nulls)


def geojson(c: Collection, df: DataFrame, srid: int = 84, force_lon_lat: bool = False, form: Numbers | None = None) -> DataFrame:
    """One column, feature: each row as a GeoJSON feature, latitude first where the system has it so."""
    form = form or numbers_for(srid)
    swap = crs.SRIDS[srid].lat_lon and not force_lon_lat
    pairs = [("type", F.lit('"Feature"')), ("id", json_value(F.col(f"`{c.id.name}`"), c.id.public_kind, form))]
    pairs.append(("geometry", geometry_text(df, c.geometry.name, form, swap) if c.geometry else F.lit(None).cast("string")))
    pairs.append(("properties", _properties(c, df, form, swap)))
    return df.select(_object(pairs).alias("feature"))


def geojson_seq(c: Collection, df: DataFrame, srid: int = 84, **options) -> DataFrame:
    """Features with a record separator before each."""
    return geojson(c, df, srid, **options).select(F.concat(F.lit("\x1e"), F.col("feature")).alias("feature"))


def jsonfg(c: Collection, df: DataFrame, srid: int = 84) -> DataFrame:
    """Features of JSON-FG 0.2: place in the output's system and geometry in CRS84, and the first time property as time."""
    form, swap = numbers_for(srid), crs.SRIDS[srid].lat_lon
    same = crs.is_identity(srid, 84)
    pairs = [("type", F.lit('"Feature"')), ("id", json_value(F.col(f"`{c.id.name}`"), c.id.public_kind, form))]
    pairs.append(("properties", _properties(c, df, form, swap)))
    if c.geometry:
        name, g = c.geometry.name, F.col(f"`{c.geometry.name}`")
        if same:
            pairs.append(("geometry", geometry_text(df, name, DEGREES)))
        else:
            if _is_xy(df, name):
                x, y = project_columns(g["x"], g["y"], srid, 84)
                flat = df.withColumn("_crs84", F.when(g.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
            else:
                flat = df.withColumn("_crs84", reproject_wkb(g, srid, 84))
            df = flat
            pairs += [("place", geometry_text(df, name, form, swap)), ("geometry", geometry_text(df, "_crs84", DEGREES))]
    if c.times and c.times[0][0] in df.columns:
        p = c.prop(c.times[0][0])
        text = json_value(F.col(f"`{p.name}`"), p.public_kind, form)
        member = "date" if p.public_kind == "date" else "timestamp"
        pairs.append(("time", F.concat(F.lit(f'{{"{member}":'), text, F.lit("}"))))
    return df.select(_object(pairs).alias("feature"))


def jsonfg_head(c: Collection, srid: int = 84) -> dict:
    dimension = {"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1, "POLYGON": 2, "MULTIPOLYGON": 2}
    head: dict = {"conformsTo": ["http://www.opengis.net/spec/json-fg-1/0.2/conf/core"], "featureType": c.name}
    if c.geometry and c.geometry.geometry_type in dimension:
        head["geometryDimension"] = dimension[c.geometry.geometry_type]
    if srid != 84:
        head["coordRefSys"] = crs.to_uri(srid)
    return head


def collection_text(features: list[str], links: list[dict] = (), stamp: dt.datetime | None = None, head: dict | None = None) -> str:
    """A page's features as one FeatureCollection."""
    out = [json.dumps(head, ensure_ascii=False, separators=(",", ":"))[1:-1]] if head else []
    out.append('"type":"FeatureCollection","features":[' + ",".join(features) + "]")
    if stamp:
        out.append(f'"timeStamp":"{stamp.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}"')
    if links:
        out.append('"links":' + json.dumps(list(links), ensure_ascii=False, separators=(",", ":")))
    out.append(f'"numberReturned":{len(features)}')
    return "{" + ",".join(out) + "}"


_CSV = {"boolean", "int", "long", "float", "double", "string", "date", "timestamp", "timestamptz", "uuid", "geometry"}


def csv_header(c: Collection, df: DataFrame) -> str:
    return ",".join([c.id.name, *([c.geometry.name] if c.geometry else []), *(p.name for p in _pairs(c, df) if p.public_kind in _CSV)])


def csv(c: Collection, df: DataFrame, srid: int = 84) -> DataFrame:
    """One column, line: strings, times and WKT in quotes (doubled inside), numbers and booleans bare, null as nothing."""
    form = numbers_for(srid)
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))

    def text(p: Property) -> Column:
        x = F.col(f"`{p.name}`")
        if p.kind == "geometry":
            return quoted(wkt_text(df, p.name, form))
        kind = p.public_kind
        if kind in ("boolean", "int", "long", "float", "double"):
            return json_value(x, kind, form)
        if kind == "date":
            return quoted(F.date_format(x, "yyyy-MM-dd"))
        return quoted(instant(as_utc(x, kind)) if kind in ("timestamp", "timestamptz") else x.cast("string"))

    shown = [c.id, *([c.geometry] if c.geometry else []), *(p for p in _pairs(c, df) if p.public_kind in _CSV)]
    fields = [F.coalesce(text(p), F.lit("")) for p in shown]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def bulk(c: Collection, df: DataFrame, index: str | None = None, srid: int = 84) -> DataFrame:
    """Two lines a feature, the action and the document without null members and further geometries, as a column line."""
    form = numbers_for(srid)
    pairs = [("id", json_value(F.col(f"`{c.id.name}`"), c.id.public_kind, form))]
    if c.geometry:
        name = c.geometry.name
        if _is_xy(df, name):
            g = F.col(f"`{name}`")
            point = F.concat(F.lit("["), number(g["x"], form.ordinates), F.lit(","), number(g["y"], form.ordinates), F.lit("]"))
            pairs.append((name, point))
        elif c.geometry.geometry_type == "POINT":
            pairs.append((name, _each(F.col(f"`{name}`"), lambda g: _ordinates(g.coords, form, False))))
        else:
            pairs.append((name, geometry_text(df, name, form)))
    pairs += [(p.name, json_value(F.col(f"`{p.name}`"), p.public_kind, form)) for p in _pairs(c, df) if p.kind != "geometry"]
    action = json.dumps({"index": {"_index": index or c.name}}, separators=(",", ":"), ensure_ascii=False)
    return df.select(F.explode(F.array(F.lit(action), _object(pairs, nulls=False))).alias("line"))


def _gml_geometry(g: Geometry, form: Numbers, swap: bool, name: str) -> str:
    def positions(c):
        return " ".join(" ".join(number_text(v, form.ordinates) for v in ((p[1], p[0], *p[2:]) if swap else p)) for p in c)

    if g.kind not in ("POINT", "LINESTRING", "POLYGON"):
        raise ValueError("only points, lines and polygons are written as GML")
    at = f' srsName="{name}"'
    if g.kind == "POINT":
        return f"<gml:Point{at}><gml:pos>{positions([g.coords])}</gml:pos></gml:Point>"
    if g.kind == "LINESTRING":
        return f"<gml:LineString{at}><gml:posList>{positions(g.coords)}</gml:posList></gml:LineString>"
    rings = [f"<gml:LinearRing><gml:posList>{positions(r)}</gml:posList></gml:LinearRing>" for r in g.coords]
    inner = "".join(f"<gml:interior>{r}</gml:interior>" for r in rings[1:])
    return f"<gml:Polygon{at}><gml:exterior>{rings[0]}</gml:exterior>{inner}</gml:Polygon>"


def gml(c: Collection, df: DataFrame, srid: int = 84, prefix: str = "app") -> DataFrame:
    """One column, member: each row as a feature member of a WFS 1.1.0 collection in GML 3.1.1."""
    form, swap = numbers_for(srid), crs.SRIDS[srid].lat_lon
    name = f"urn:ogc:def:crs:EPSG::{srid}" if srid != 84 else "urn:ogc:def:crs:OGC:1.3:CRS84"

    def escaped(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.regexp_replace(x, a, b)
        return x

    def element(p: Property) -> Column:
        x = F.col(f"`{p.name}`")
        if p.kind == "geometry":
            if _is_xy(df, p.name):
                a, b = number(x["x"], form.ordinates), number(x["y"], form.ordinates)
                first, second = (b, a) if swap else (a, b)
                text = F.concat(F.lit(f'<gml:Point srsName="{name}"><gml:pos>'), first, F.lit(" "), second, F.lit("</gml:pos></gml:Point>"))
            else:
                text = _each(x, lambda g: _gml_geometry(g, form, swap, name))
        elif p.public_kind in ("timestamp", "timestamptz"):
            text = instant(as_utc(x, p.public_kind))
        elif p.public_kind in ("float", "double"):
            text = json_value(x, p.public_kind, form)
        else:
            text = escaped(x.cast("string"))
        whole = F.concat(F.lit(f"<{prefix}:{p.name}>"), text, F.lit(f"</{prefix}:{p.name}>"))
        return F.coalesce(whole, F.lit(""))

    shown = [*([c.geometry] if c.geometry else []), *(p for p in _pairs(c, df) if p.public_kind not in ("array", "json"))]
    identity = escaped(F.col(f"`{c.id.name}`").cast("string"))
    body = F.concat(F.lit(f'<gml:featureMember><{prefix}:{c.name} gml:id="{c.name}.'), identity, F.lit('">'), *map(element, shown))
    return df.select(F.concat(body, F.lit(f"</{prefix}:{c.name}></gml:featureMember>")).alias("member"))


def gml_document(members: list[str], namespace: str = "http://example.com/app", prefix: str = "app") -> str:
    return (
        '<?xml version="1.0" encoding="UTF-8"?><wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs" '
        f'xmlns:gml="http://www.opengis.net/gml" xmlns:{prefix}="{namespace}" numberOfFeatures="{len(members)}">'
        + "".join(members)
        + "</wfs:FeatureCollection>"
    )


def write_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """The one text column as lines, part by part on the executors."""
    df.write.option("compression", "gzip" if gzip else "none").text(path)
