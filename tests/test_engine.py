import datetime as dt
import math
import sqlite3
import struct
from types import SimpleNamespace
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane import queries
from terrane.functions import crs, geometry, registry, spatial
from terrane.operators import metadata
from terrane.plans import filters as fl
from terrane.plans import paging, params
from terrane.plans.catalog import Catalog, Collection
from terrane.plans.engine import Engine
from terrane.plans.properties import Property
from terrane.sinks import files, text
from terrane.sources import config, readers

TEST = """
getfeatures.limit.default=1000
collections=breakwater,pages
srid=3067
collections.breakwater.type=test
collections.breakwater.table=breakwater
collections.breakwater.title=Breakwaters
collections.breakwater.id.mapping=id
collections.breakwater.geometry.mapping=line
collections.breakwater.geometry.type=POINT
collections.breakwater.properties=mtk_id,accuracy,kind
collections.breakwater.properties.kind.enum=13,23
collections.breakwater.parameters=mtk_id,kind
collections.breakwater.testdata.1=1;POINT(1 1 100);11;null;13
collections.breakwater.testdata.2=2;POINT(1 1 100);22;4.0;23
collections.pages.type=test
collections.pages.id.mapping=fid
collections.pages.geometry.mapping=geom
collections.pages.properties=my_prop
collections.pages.extent.spatial.crs84=-110,-60,140,30
collections.pages.testdata.1=1;POINT(1 1 100);11
collections.pages.testdata.2=2;POINT(1 1 100);22
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, config.load(spark, TEST))


def features(engine, name, **query):
    c = engine.catalog.collection(name)
    return [r.feature for r in text.geojson(c, engine.items(name, {k.replace("_", "-"): v for k, v in query.items()})).collect()]


def test_geojson(engine):
    assert features(engine, "breakwater") == [
        '{"type":"Feature","id":"1","geometry":{"type":"Point","coordinates":[1,1,100]},"properties":{"mtk_id":"11","accuracy":null,"kind":"13"}}',
        '{"type":"Feature","id":"2","geometry":{"type":"Point","coordinates":[1,1,100]},"properties":{"mtk_id":"22","accuracy":"4.0","kind":"23"}}',
    ]


def test_next_page(engine):
    first = engine.page("pages", {"limit": "1"})
    assert (first.number_returned, first.rows[0].fid) == (1, "1")
    second = engine.page("pages", {"limit": "1", "next": first.next})
    assert (second.rows[0].fid, second.next) == ("2", None)


def test_multi_page(engine):
    seen, names, query = [], ["pages", "breakwater"], {"limit": "1"}
    while names:
        page = engine.multi_page(names, query)
        seen += [(n, r[0]) for n, r in page.rows]
        names, query = page.remaining, {"limit": "1", **({"next": page.next} if page.next else {})}
    assert seen == [("pages", "1"), ("pages", "2"), ("breakwater", "1"), ("breakwater", "2")]
    assert len(engine.multi_page(["pages", "breakwater"], {"limit": "3"}).rows) == 3
    assert engine.multi_page(["pages"], {"limit": "9"}).remaining == []


def test_by_id(engine):
    assert [r.mtk_id for r in engine.by_id("breakwater", "2").collect()] == ["22"]
    assert engine.by_id("breakwater", "9").isEmpty()


def test_parameters(engine):
    assert engine.items("breakwater", {"mtk_id": "22"}).count() == 1
    assert engine.items("breakwater", {"kind": "13,23"}).count() == 2
    for bad in ({"nothing": "1"}, {"kind": "99"}, {"limit": "x"}, {"filter-lang": "sql"}, {"crs": "http://www.opengis.net/def/crs/EPSG/0/3067"}, {"filter": "accuracy = '1'"}, {"bbox": "1,2,3"}):
        with pytest.raises(ValueError):
            engine.items("breakwater", bad)
    with pytest.raises(KeyError):
        engine.items("none")


def test_static_enum_is_free(engine):
    assert engine.items("breakwater", {"filter": "kind = '13'"}).count() == 1
    with pytest.raises(ValueError):
        engine.items("breakwater", {"filter": "kind = '14'"})


def test_csv_bulk_gml_html(engine):
    c, df = engine.catalog.collection("breakwater"), engine.items("breakwater")
    assert text.csv_header(c, df) == "id,line,mtk_id,accuracy,kind"
    assert [r.line for r in text.csv(c, df).collect()] == ['"1","POINT (1 1 100)","11",,"13"', '"2","POINT (1 1 100)","22","4.0","23"']
    assert [r.line for r in text.bulk(c, df).collect()][:2] == ['{"index":{"_index":"breakwater"}}', '{"id":"1","line":[1,1,100],"mtk_id":"11","kind":"13"}']
    assert "<gml:pos>1 1 100</gml:pos>" in text.gml_document([r.member for r in text.gml(c, df).collect()])
    assert "<td>4.0</td>" in files.html("t", ["id", "accuracy"], df.collect(), "/next?a=1&b=2")


def test_jsonfg(spark):
    made = spark.createDataFrame([(1, 500000.0, 6651411.190243, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 678000))], "id long, x double, y double, d date, t timestamp_ntz")
    c = Collection(
        "f", "t", {"t": readers.frame(made)}, Property("id", "id", "long", "t"), [Property("d", "d", "date", "t"), Property("t", "t", "timestamp", "t")],
        geometry=Property("g", "", "geometry", "t", xy=("x", "y"), srid=3067, geometry_type="POINT"), times=[("t", True)], srids=[84, 3067],
    )
    e = Engine(spark, Catalog().add(c))
    uri = "http://www.opengis.net/def/crs/EPSG/0/3067"
    assert text.jsonfg(c, e.items("f", {"crs": uri}), 3067).first().feature == (
        '{"type":"Feature","id":1,"properties":{"d":"2024-01-02","t":"2024-01-02T03:04:05.678Z"},"place":{"type":"Point","coordinates":[500000,6651411.19]},'
        '"geometry":{"type":"Point","coordinates":[27,60]},"time":{"timestamp":"2024-01-02T03:04:05.678Z"}}'
    )
    head = text.jsonfg_head(c, 3067)
    assert (head["geometryDimension"], head["coordRefSys"]) == (0, uri)
    assert text.collection_text(["{}"], head=head).endswith('"type":"FeatureCollection","features":[{}],"numberReturned":1}')


def test_geopackage(spark, engine, tmp_path):
    path = str(tmp_path / "out.gpkg")
    c = engine.catalog.collection("breakwater")
    assert files.write_geopackage(path, [(c, engine.items("breakwater"))]) == 2
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM rtree_breakwater_line").fetchone() == (2,)
    with pytest.raises(ValueError):
        readers.geopackage_schema(path, "nothing")
    key = readers.geopackage_schema(path, "breakwater")
    assert key[1:] == ("fid_", "line", 4326)
    rows = readers.geopackage(path, "breakwater")(spark).collect()
    assert [r.mtk_id for r in rows] == ["11", "22"]
    assert geometry.read_wkb(bytes(rows[0].line)).coords == (1, 1, 100)
    readers.to_parquet(spark, path, "breakwater", str(tmp_path / "p"), batch=1)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(FileExistsError):
        files.write_geopackage(path, [])


def test_derby(spark, tmp_path):
    rows = [(1, 'a "b", c\n', 2.5, True), (2, "", None, False), (3, None, -0.1, None), (4, " ä' ", 1e-300, True), (None, "\r\n\\N,\t ", 0.0, None)]
    df = spark.createDataFrame(rows, "`Key` int, `it's` string, d double, b boolean").repartition(3)
    url = files.write_derby(str(tmp_path), "odd's", df)
    read = readers.jdbc(url, '"odd\'s"', column="Key", low="1", high="4", parts=2)(spark)
    assert read.dtypes == df.dtypes
    assert sorted(map(repr, map(tuple, read.collect()))) == sorted(map(repr, rows))
    assert readers.jdbc(files.write_derby(str(tmp_path), "T", df.limit(0)), "T")(spark).isEmpty()


def test_shared_path(tmp_path):
    session = lambda known: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: known, master="local-cluster[2,1,1024]"), conf={})
    for known in (f"file://{tmp_path}/a b%20", f"file:{tmp_path}/a b%20", f"{tmp_path}/a b%20/"):
        assert files.shared_path(session(known)) == f"{tmp_path}/a b%20" and (tmp_path / "a b%20").is_dir()
    for known in ("hdfs://nowhere/x", None):
        with pytest.raises(ValueError):
            files.shared_path(session(known))


def test_jdbc_scan_of_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(0).write.parquet(f"{tmp_path}/supplier.parquet")
    assert queries.QUERIES["jdbc_scan"](spark, str(tmp_path)).isEmpty()


def test_wkb_predicates(spark):
    shapes = ["POINT(5 5)", "POINT(0 5)", "LINESTRING(-5 5,15 5)", "POLYGON((5 5,15 5,15 15,5 15,5 5))", "POINT(50 50)", None]
    df = spark.createDataFrame([(i, geometry.write_wkb(geometry.read_wkt(s)) if s else None) for i, s in enumerate(shapes)], "id int, g binary")
    p = Property("g", "g", "geometry")
    square = geometry.read_wkt("POLYGON((0 0,10 0,10 10,0 10,0 0))")
    found = lambda op: [r.id for r in df.filter(fl.to_column(fl.spatially(op, p, square))).orderBy("id").collect()]
    assert {op: found(op) for op in geometry.SPATIAL_OPERATORS} == {
        "INTERSECTS": [0, 1, 2, 3], "DISJOINT": [4], "WITHIN": [0], "TOUCHES": [1], "CROSSES": [2], "OVERLAPS": [3], "EQUALS": [], "CONTAINS": [],
    }
    assert found("INTERSECTS_INDEX") == [0, 1, 2, 3]
    assert [tuple(r) for r in df.select(spatial.st_min_x("g"), spatial.st_max_y("g"), spatial.st_is_empty("g")).limit(3).collect()] == [(5, 5, False), (0, 5, False), (-5, 5, False)]
    line = geometry.buffer(geometry.read_wkt("LINESTRING(40 50,60 50)"), 1)
    assert [r.id for r in df.filter(fl.to_column(fl.spatially("INTERSECTS", p, line))).collect()] == [4]


def test_keyset_with_nulls(spark):
    rows = [(1, None), (2, 5), (3, 5), (4, 7), (5, None), (6, 1)]
    t = spark.createDataFrame(rows, "id long, k int")
    for up in (True, False):
        c = Collection("c", "t", {"t": readers.frame(t)}, Property("id", "id", "long", "t", nullable=False), [Property("k", "k", "int", "t")], order=[("k", up)])
        e = Engine(spark, Catalog().add(c))
        whole, after = [r.id for r in e.items("c", {"limit": "10"}).collect()], None
        assert whole == ([6, 2, 3, 4, 1, 5] if up else [1, 5, 4, 2, 3, 6])
        seen = []
        while True:
            page = e.page("c", {"limit": "2", **({"next": after} if after else {})})
            seen += [r.id for r in page.rows]
            after = page.next
            if not after:
                break
        assert seen == whole


def test_pushdown(spark):
    path = "/root/testdata/sf0.001/orders.parquet"
    c = Collection("o", "o", {"o": readers.parquet(path)}, Property("o_orderkey", "o_orderkey", "long", "o"), [Property("o_totalprice", "o_totalprice", "double", "o")])
    c.queryables = ["o_totalprice"]
    df = Engine(spark, Catalog().add(c)).items("o", {"filter": "o_totalprice > 1000", "limit": "-1"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_cache(spark, engine):
    e = Engine(spark, engine.catalog, cache_size=1)
    assert e.page("pages") is e.page("pages")
    e.page("breakwater")
    assert len(e.cache.held) == 1


def test_same_bbox(spark):
    made = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 5.0), (2, 1.0, 1.0, 50.0, 5.0)], "id long, x double, y double, u double, v double")
    other = Property("h", "", "geometry", "t", xy=("u", "v"))
    c = Collection("c", "t", {"t": readers.frame(made)}, Property("id", "id", "long", "t"), [other], geometry=Property("g", "", "geometry", "t", xy=("x", "y")))
    c.params = {"both": params.SameBbox("h")}
    e = Engine(spark, Catalog().add(c))
    assert [r.id for r in e.items("c", {"bbox": "0,0,10,10", "both": "true"}).collect()] == [1]
    assert e.items("c", {"bbox": "0,0,10,10"}).count() == e.items("c", {"both": "true"}).count() == 2


def test_metadata(spark, engine):
    catalog = engine.catalog
    assert [r.id for r in metadata.collections(spark, catalog).collect()] == ["breakwater", "pages"]
    assert {r.name for r in metadata.functions(spark, catalog).collect()} == {"Buffer", "ST_Buffer"}
    assert [r.name for r in metadata.queryables(spark, catalog.collection("breakwater")).collect()] == ["mtk_id", "kind"]
    assert "/collections/pages/items" in metadata.openapi(catalog)["paths"]
    assert metadata.json_schema(catalog.collection("breakwater"))["properties"]["kind"]["enum"] == ["13", "23"]
    assert metadata.conformance(spark).count() == len(metadata.CONFORMANCE)
    assert metadata.landing(catalog)["title"] == "Features"
    api = metadata.openapi(catalog)
    given = {p["name"]: p["schema"] for p in api["paths"]["/collections/breakwater/items"]["get"]["parameters"]}
    assert (given["limit"]["type"], given["limit"]["maximum"], given["bbox"]["items"]["type"]) == ("integer", 10_000, "number")
    assert given["properties"]["items"]["enum"] == ["mtk_id", "accuracy", "kind"] and given["kind"] == {"type": "string"}
    assert api["components"]["schemas"]["pages"]["properties"]["properties"]["properties"] == {"my_prop": {"type": "string"}}


def test_next_link(engine):
    query = {"limit": "1", "offset": "3", "filter": "my_prop = 'a b'"}
    cursor = engine.page("pages", {"limit": "1"}).next
    link = paging.next_link("/collections/pages/items", query, cursor)
    asked = dict(parse_qsl(link.partition("?")[2]))
    assert asked == {"limit": "1", "filter": "my_prop = 'a b'", "next": cursor}
    assert engine.page("pages", {"limit": asked["limit"], "next": asked["next"]}).rows[0].fid == "2"
    assert paging.next_link("/x", query, None) is None


def test_layer_names(engine):
    rows = engine.multi(["breakwater", "pages"], {"layernames": "walls,leaves"}).select("collection").distinct().collect()
    assert {r.collection for r in rows} == {"walls", "leaves"}
    with pytest.raises(ValueError):
        engine.multi(["breakwater", "pages"], {"layernames": "walls"})


TWICE = registry.Function("Twice", lambda g, n: n * 2, (("geometry", "geometry"), ("n", "number")), "number")


def test_functions_of_a_configuration(spark):
    loaded = config.load(spark, TEST + f"functions={__name__}.TWICE\n")
    assert loaded.functions.call("twice", [geometry.point(1, 1), 4.0]) == 8


def test_srid_of_a_configuration(spark):
    config.load(spark, TEST + "srid=990001,990002\nsrid.990001.proj4=+proj=tmerc +lat_0=0 +lon_0=27 +k=0.9996 +x_0=500000 +y_0=0 +ellps=GRS80\nsrid.990002.proj4=+proj=utm +zone=35 +south +datum=WGS84\n")
    for x, y in ((26.5, 61.25), (27, 60)):
        assert crs.project(x, y, 84, 990001) == pytest.approx(crs.project(x, y, 84, 3067), abs=1e-6)
        south = crs.project(x, -y, 84, 990002)
        assert south == pytest.approx((crs.project(x, y, 84, 32635)[0], 10_000_000 - crs.project(x, y, 84, 32635)[1]), abs=1e-6)
        assert crs.project(*south, 32735, 84) == pytest.approx((x, -y), abs=1e-9)
    line = geometry.write_wkb(geometry.read_wkt("LINESTRING(26 60, 27 61)"))
    moved = spark.createDataFrame([(bytearray(line),), (None,)], "g binary").select(spatial.reproject_wkb(F.col("g"), 84, 990001).alias("g")).collect()
    assert geometry.read_wkb(bytes(moved[0].g)).coords[1] == pytest.approx(crs.project(27, 61, 84, 990001)) and moved[1].g is None
    for bad in ("+proj=lcc +lat_0=3", "+proj=lcc +lat_1=3 +lat_2=-3", "+proj=laea +lat_0=52", "+proj=tmerc +ellps=bessel", "+proj=utm +zone=3 +towgs84=1,2,3"):
        with pytest.raises(ValueError):
            crs.register(990003, bad)


def test_conic_projection(spark):
    """The origin, true lengths along both parallels, right angles kept, there and back, and the same as Columns."""
    crs.register(990004, "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80 +towgs84=0,0,0 +units=m")
    crs.register(990005, "+proj=lcc +lat_0=-37 +lon_0=145 +lat_1=-36 +lat_2=-38 +x_0=2500000 +y_0=2500000 +ellps=GRS80")
    assert crs.project(3, 46.5, 84, 990004) == pytest.approx((700_000, 6_600_000), abs=1e-6)
    assert crs.project(145, -37, 84, 990005) == pytest.approx((2_500_000, 2_500_000), abs=1e-6)
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)
    for code, lon, lat in ((990004, 5, 49), (990004, -2, 44), (990005, 141, -36), (990005, 149, -38)):
        step, at = 1e-5, crs.project(lon, lat, 84, code)
        east, north = crs.project(lon + step, lat, 84, code), crs.project(lon, lat + step, 84, code)
        narrow = math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        true = [crs.AXIS * math.cos(math.radians(lat)) / narrow * math.radians(step), crs.AXIS * (1 - e2) / narrow**3 * math.radians(step)]
        assert [math.dist(at, east), math.dist(at, north)] == pytest.approx(true, rel=1e-6)
        assert abs((east[0] - at[0]) * (north[0] - at[0]) + (east[1] - at[1]) * (north[1] - at[1])) < 1e-5
    spots = [(990004, -4.5, 41.0), (990004, 9.5, 51.2), (990005, 140.0, -39.5), (990005, 150.2, -33.0)]
    for code, lon, lat in spots:
        assert crs.project(*crs.project(lon, lat, 84, code), code, 84) == pytest.approx((lon, lat), abs=1e-9)
        x, y = spatial.project_columns(F.lit(lon), F.lit(lat), 84, code)
        lon2, lat2 = spatial.project_columns(x, y, code, 84)
        row = spark.range(1).select(x, y, lon2, lat2).first()
        assert tuple(row) == pytest.approx((*crs.project(lon, lat, 84, code), lon, lat), rel=1e-12)


def test_envelopes_in_bulk():
    shapes = ["POINT(1 2)", "POINT(3 4)", "LINESTRING(1 5, 7 2)", "LINESTRING(1 5, 7 2, 9 9)", "POLYGON((0 0, 4 0, 4 4, 0 0))", "POLYGON((0 0, 9 0, 9 9, 0 0), (2 1, 3 1, 3 2, 2 1))",
              "POINT EMPTY", "POINT(1 2 3)", "MULTIPOINT((1 2), (8 9))", "POINT(5 6)"]
    made = [geometry.read_wkt(x) for x in shapes]
    blobs = [geometry.write_wkb(g) for g in made] + [None, geometry.write_gpkg(made[0], 4326)]
    blobs.append(b"\0" + (1).to_bytes(4, "big") + struct.pack(">dd", 7, 8))
    found = spatial.wkb_envelopes(pd.Series(blobs, dtype="object"))
    for b, *bounds, empty in zip(blobs, *found, strict=True):
        e = geometry.read_wkb(b).envelope if b is not None else None
        assert (tuple(bounds) if e else None) == (tuple(map(float, e)) if e else None) and empty == (None if b is None else e is None)


def test_moments_in_a_geopackage():
    at = [dt.datetime(2024, 1, 2, 3, 4, 20, us) for us in (0, 151, 500_000, 20_151)]
    assert [files._stored(x) for x in at] == ["2024-01-02T03:04:20Z", "2024-01-02T03:04:20.000151Z", "2024-01-02T03:04:20.500Z", "2024-01-02T03:04:20.020151Z"]
    assert [dt.datetime.fromisoformat(files._stored(x)).replace(tzinfo=None) for x in at] == at


def test_points_in_bulk(spark):
    """Points on, in and beside all kinds of literals, against one at a time."""
    spots = [(a / 2, b / 2) for a in range(-4, 25) for b in range(-4, 25)] + [(float("nan"), 1.0), (3.1, 2.7)]
    ring = [(6 + 5 * math.cos(i * math.pi / 50), 6 + 5 * math.sin(i * math.pi / 50)) for i in range(100)]
    shapes = [
        "MULTILINESTRING((0 0, 4 4, 8 0), (8 0, 10 10), (1 1, 1 5, 5 5, 1 1))", "MULTILINESTRING((0 0, 2 0), (2 0, 2 2), (2 0, 4 0))", "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 0)), ((3 3, 9 3, 9 9, 3 9, 3 3), (5 5, 7 5, 7 7, 5 7, 5 5)))",
        "GEOMETRYCOLLECTION(POINT(1 1), LINESTRING(0 0, 3 0), POLYGON((2 2, 6 2, 2 6, 2 2)))", "MULTIPOINT((1 1), (2 3))", f"POLYGON(({', '.join(f'{x} {y}' for x, y in [*ring, ring[0]])}))",
    ]
    x, y = (np.array(v) for v in zip(*spots, strict=True))
    for text_ in shapes:
        g = geometry.read_wkt(text_)
        assert [w.decode() for w in spatial.locate_all(x, y, g).tolist()] == [geometry.locate(p, g) for p in spots], text_
    df = spark.createDataFrame([*spots, (None, 1.0)], "x double, y double")
    g = geometry.read_wkt(shapes[-1])
    for op, wanted in (("INTERSECTS", "IB"), ("DISJOINT", "E"), ("WITHIN", "I"), ("EQUALS", "")):
        rows = df.select("x", "y", spatial.point_predicate(op, F.col("x"), F.col("y"), g).alias("f")).collect()
        assert [r.f for r in rows] == [geometry.locate(p, g) in wanted if wanted else False for p in spots] + [None]


def test_points_and_circles(spark):
    """A circle's polygon as seen from its centre: native, by numpy, and of several points."""
    spots = [(10 + a / 4, 20 + b / 4) for a in range(-14, 15) for b in range(-14, 15)] + [(float("nan"), 20.0)]
    df = spark.createDataFrame([*spots, (None, 1.0)], "x double, y double")
    x, y = (np.array(v) for v in zip(*spots, strict=True))
    for quarter, wkt in ((8, "POINT(10 20)"), (20, "POINT(10 20)"), (3, "MULTIPOINT((10 20), (13 20.5))")):
        g = geometry.buffer(geometry.read_wkt(wkt), 3, quarter)
        for op, wanted in (("INTERSECTS", [b"I", b"B"]), ("DISJOINT", [b"E"]), ("WITHIN", [b"I"])):
            found = [r.f for r in df.select(spatial.point_predicate(op, F.col("x"), F.col("y"), g).alias("f")).collect()]
            assert found == [*np.isin(spatial.locate_all(x, y, g), wanted).tolist(), None], (quarter, op)
            clear = [i for i, (a, b) in enumerate(spots) if all(abs(math.hypot(a - c[0], b - c[1]) - 3) > 0.11 for c in ((10, 20), (13, 20.5)))]
            assert all(found[i] == (geometry.locate(spots[i], g).encode() in wanted) for i in clear), (quarter, op)
    assert geometry.buffer(geometry.point(10, 20), 3).mapped(lambda a, b: (a + 1, b)).about is None


def test_cache_is_refreshed(spark, engine):
    e = Engine(spark, engine.catalog, cache_size=2, cache_refresh=0)
    first = e.page("pages")
    again = e.page("pages")  # the held page, and a new one is being made
    for thread in list(e.cache.busy.values()):
        thread.join()
    e.cache.refresh = 60
    assert again is first and e.page("pages") is not first and e.page("pages").rows == first.rows


def test_observed(engine):
    df, seen = engine.observed("pages")
    df.collect()
    assert seen.get["number_returned"] == 2


def test_config_check(spark):
    assert config.check(spark, "collections=a\ncollections.a.type=test\n") == ["a: a: id.mapping is needed"]
    assert config.check(spark, TEST) == []
    assert config.read("a=b \\\n c\n# x\nd:${HOME_X_Y}") == {"a": "b c", "d": "${HOME_X_Y}"}


def test_config_over_tables(spark):
    text_ = """
collections=c,i
collections.c.table=customer
collections.c.id.mapping=c_custkey
collections.c.geometry.mapping=c_acctbal,c_nationkey
collections.c.properties=c_name,nation,one,many
collections.c.properties.nation.mapping=nation.n_name
collections.c.properties.one.mapping='1'
collections.c.properties.many.mapping=c_custkey,c_name
collections.c.joins=n
collections.c.joins.n.left=customer.c_nationkey
collections.c.joins.n.right=nation.n_nationkey
collections.c.parameters=nation
collections.c.parameters.nation.mapper=like
collections.c.filters=f
collections.c.filters.f.type=>
collections.c.filters.f.prop=c_name
collections.c.filters.f.value=C
collections.c.pagination=c_name
collections.c.pagination.order=DESC
collections.i.table=lineitem
collections.i.id.mapping=l_orderkey,l_linenumber
collections.i.properties=~l_tax
collections.i.pagination.unordered=true
"""
    e = Engine(spark, config.load(spark, text_, "/root/testdata/sf0.001"))
    row = e.items("c", {"nation": "NATION_1*", "limit": "1"}).first()
    assert row.nation.startswith("NATION_1") and row.one == 1 and row.many == f"{row.c_custkey}-{row.c_name}"
    assert "l_tax" not in e.items("i").columns
    assert e.by_id("i", "1-1").columns[0] == "l_orderkey_l_linenumber"


def test_stream(spark, tmp_path):
    from terrane.queries import catalog
    from terrane.streaming.items import stream_items, windowed_counts

    base = "/root/testdata/sf0.001"
    source = tmp_path / "in"
    spark.read.parquet(f"{base}/events.parquet").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    e = Engine(spark, catalog(base))
    request = {"filter": "event_type <> 'x' AND value > 10", "properties": "value"}
    q = stream_items(e, "events", stream, request).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == e.count("events", {"filter": request["filter"]}).first()[0]
    with pytest.raises(ValueError):
        stream_items(e, "events", stream, {"limit": "1"})
    q = windowed_counts(stream, "ts", "event_type").writeStream.format("memory").outputMode("complete").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet(str(source)).count()


def test_lines(engine, tmp_path, spark):
    c = engine.catalog.collection("pages")
    text.write_lines(text.geojson_seq(c, engine.items("pages")), str(tmp_path / "o"), gzip=True)
    assert all(r.value.startswith("\x1e{") for r in spark.read.text(str(tmp_path / "o")).collect())
