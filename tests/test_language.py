import datetime as dt

import pytest

from terrane.functions import crs, geometry, registry
from terrane.functions import transformers as tr
from terrane.functions.transformers import UNKNOWN
from terrane.operators.joins import Join, path
from terrane.plans import cql2, paging, params
from terrane.plans import filters as fl
from terrane.plans.properties import Property, coerce, static
from terrane.sinks import files
from terrane.sinks.text import geometry_json, number_text, wkt

N, B = cql2.Name, cql2.Binary


def number(text):
    return cql2.Lit("number", text)


def string(text):
    return cql2.Lit("string", text)


PARSED = [
    ("depth > 4", B(">", N("depth"), number("4"))),
    ("depth<>-2.50", B("<>", N("depth"), number("-2.50"))),
    ('"order" >= 1e3', B(">=", N("order"), number("1e3"))),
    ("owner = 'O''Hara'", B("=", N("owner"), string("O'Hara"))),
    ("owner = 'O\\'Hara'", B("=", N("owner"), string("O'Hara"))),
    ("owner = 'ends with a quote'''", B("=", N("owner"), string("ends with a quote'"))),
    ("a = 1 AND b = 2 OR c = 3", cql2.Logic("OR", (cql2.Logic("AND", (B("=", N("a"), number("1")), B("=", N("b"), number("2")))), B("=", N("c"), number("3"))))),
    ("a = 1 and (b = 2 or not c = 3)", cql2.Logic("AND", (B("=", N("a"), number("1")), cql2.Logic("OR", (B("=", N("b"), number("2")), cql2.Logic("NOT", (B("=", N("c"), number("3")),))))))),
    ("depth BETWEEN 2 AND 5", cql2.Logic("AND", (B(">=", N("depth"), number("2")), B("<=", N("depth"), number("5"))))),
    ("depth NOT BETWEEN 2 AND 5", cql2.Logic("OR", (B("<", N("depth"), number("2")), B(">", N("depth"), number("5"))))),
    ("kind IN ('oak', 'elm')", cql2.Logic("OR", (B("=", N("kind"), string("oak")), B("=", N("kind"), string("elm"))))),
    ("kind NOT IN ('oak', 'elm')", cql2.Logic("AND", (B("<>", N("kind"), string("oak")), B("<>", N("kind"), string("elm"))))),
    ("CASEI(kind) IN (CASEI('Ük'), CASEI('ELM'))", cql2.Logic("OR", (B("=", N("kind"), string("Ük"), True), B("=", N("kind"), string("ELM"), True)))),
    ("kind LIKE 'o_k%'", cql2.LikeOf(N("kind"), "o_k%")),
    ("kind NOT LIKE 'o_k%'", cql2.LikeOf(N("kind"), "o_k%", negated=True)),
    ("kind LIKE casei('O%')", cql2.LikeOf(N("kind"), "O%", casei=True)),
    ("kind IS NULL", cql2.NullOf(N("kind"))),
    ("kind is not null", cql2.NullOf(N("kind"), True)),
    ("planted >= DATE('2020-02-29')", B(">=", N("planted"), cql2.Lit("date", "2020-02-29"))),
    ("seen < timestamp('2020-02-29T10:20:30.5Z')", B("<", N("seen"), cql2.Lit("timestamp", "2020-02-29T10:20:30.5Z"))),
    ("S_WITHIN(place, POINT(3 4))", cql2.SpatialOf("WITHIN", N("place"), cql2.Lit("geometry", geometry.point(3, 4)))),
    ("s_touches(place, BBOX(1, 2, 3, 4))", cql2.SpatialOf("TOUCHES", N("place"), cql2.Lit("geometry", geometry.box(1, 2, 3, 4)))),
    ("S_CROSSES(place, near(POINT(3 4), 5))", cql2.SpatialOf("CROSSES", N("place"), cql2.Call("near", (cql2.Lit("geometry", geometry.point(3, 4)), number("5"))))),
    ("true", cql2.Lit("boolean", True)),
    ("\t", cql2.Empty()),
]


@pytest.mark.parametrize(("text", "tree"), PARSED)
def test_parser(text, tree):
    assert cql2.parse(text) == tree


@pytest.mark.parametrize("wkt_text", ["MULTIPOINT((1 4), (3 8))", "LINESTRING(0 1, 2 3)", "POLYGON((0 0, 4 0, 4 4))", "GEOMETRYCOLLECTION(LINESTRING(5 6, 7 8), POINT(9 9))"])
def test_parser_geometries(wkt_text):
    read = cql2.parse(f"S_DISJOINT(place, {wkt_text.lower()})").value.value
    assert read.coords == geometry.read_wkt(wkt_text.replace("4 4))", "4 4, 0 0))"), 84).coords


@pytest.mark.parametrize("text", ["owner = 'O'''Hara'", "a =", "a = 1 b", "1 = a", "a LIKE 3", "S_WITHIN(a)", "a IN ()", "(a = 1", "a BETWEEN 'x' AND 'y'", "a = TIMESTAMP('2020-02-29T10:20:30+01:00')"])
def test_parser_refuses(text):
    with pytest.raises(ValueError):
        cql2.parse(text)


def test_only_queryables():
    with pytest.raises(ValueError):
        cql2.Lowering({}).filter(cql2.parse("secret = 1"))


@pytest.mark.parametrize(
    ("kind", "text", "value"),
    [
        ("int", "261254150482831638", UNKNOWN), ("int", "1337.000", 1337), ("int", "555.", 555), ("int", ".0", 0), ("int", "5.0001", UNKNOWN),
        ("long", "261254150482831638", 261254150482831638), ("long", "1E7", 10_000_000), ("int", "null", None), ("boolean", "TRUE", True),
        ("date", "2024-02-29", dt.date(2024, 2, 29)), ("timestamp", "2024-01-01T01:00:00+01:00", dt.datetime(2024, 1, 1)),
        ("uuid", "A987FBC9-4BED-3078-CF07-9141BA07C9F3", "a987fbc9-4bed-3078-cf07-9141ba07c9f3"),
    ],
)
def test_literals(kind, text, value):
    assert coerce(kind, text) == value


def test_static_guesses():
    assert [static("a", m).kind for m in ("'1'", "'5000000000'", "'1.5'", "'true'", "'x'", "'null$DATE'")] == ["int", "long", "double", "boolean", "string", "date"]


def test_transformers_in():
    slices = tr.make("Slices", "string", "%d[0:2],'/',%d[2:6],'/',%d[6:9]")
    assert slices.into("12/345/6") == "120345006"
    assert slices.into("1/0/999") == "010000999"
    assert slices.into("x") is UNKNOWN
    chain = tr.make("Chain", "long", "LongToString() | Prefix(tree-)")
    assert chain.into("tree-77") == 77
    assert chain.into("bush-77") is UNKNOWN
    codes = tr.make("CodeList", "string", '{"1":"oak","2":"elm","3":null,"4":null,"5":"none","$null":"none"}')
    assert codes.into("elm") == "2"
    assert sorted(codes.into(None)) == codes.nulls() == ["3", "4"]
    assert set(codes.into("none")) == {"5", None}
    assert codes.into("ash") is UNKNOWN
    building = tr.make("BuildingFunction", "string")
    assert [building.into(x) for x in ("N", "A", "-99", "19")] == [["N%", "L%"], "A%", "-99", "19"]
    assert all(building.into(x) is UNKNOWN for x in ("L", "AB", "20", "O"))
    with pytest.raises(ValueError):
        tr.make("FixedLength", "int", "4").into("123")


def test_chains_with_nulls():
    """What stands for a null at one step is all that the step before makes null."""
    gaps = tr.make("Chain", "string", "NullIf(x) | IfNull(-)")
    assert gaps.into("-") == [None, "x"] and gaps.into("a") == "a" and gaps.nulls() == []
    assert tr.make("Chain", "string", "IfNull(-) | NullIf(x)").nulls() == ["x"]
    assert tr.make("Chain", "long", "LongToString() | IfNull(0)").into("0") is None


def test_transformers_out(spark):
    df = spark.createDataFrame([(12345, "49840108760011", "A", "0110"), (-7, "04440100010000", "D", "-99"), (None, None, None, "L12")], "n long, s string, c string, b string")
    codes = {"A": "foo", "D": None, "$null": "qux"}
    from pyspark.sql import functions as F

    rows = df.select(
        tr.make("Chain", "long", "LongToString() | Prefix(foobar)").out(F.col("n")),
        tr.make("FixedLength", "long", "4").out(F.col("n")),
        tr.make("Slices", "string", "%d[0:3],'-',%d[3:6]").out(F.col("s")),
        tr.CodeList("string", codes).out(F.col("c")),
        tr.make("BuildingFunction", "string").out(F.col("b")),
        tr.make("IfNull", "long", "5").out(F.col("n")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("foobar12345", "2345", "498-401", "foo", "01", 12345),
        ("foobar-7", "-007", "44-401", None, "-99", -7),
        (None, None, None, "qux", "N", 5),
    ]


@pytest.mark.parametrize(
    ("pattern", "expected"), [("foo*bar*", "foo%bar%"), ("foo@*bar", "foo*bar"), ("foo%bar", "foo\\%bar"), ("f?o", "f_o"), ("end@", "end"), ("a@@b", "a@b")]
)
def test_like_dialect(pattern, expected):
    assert fl.sql_pattern(pattern, "*", "?", "@") == expected


def test_folding():
    p = Property("n", "n", "int")
    one, two = fl.equal(p, "1"), fl.equal(p, "2")
    assert fl.equal(p, "1.5") is fl.DENY
    assert fl.not_equal(p, "1.5") is fl.PASS
    assert fl.equal(p, "null") == fl.IsNull(prop=p, stored=True)
    assert fl.conjunction(one, fl.DENY) is fl.DENY
    assert fl.disjunction(one, fl.PASS) is fl.PASS
    assert fl.conjunction() is fl.PASS
    assert fl.negated(fl.conjunction(one, two)) == fl.disjunction(fl.not_equal(p, "1"), fl.not_equal(p, "2"))
    assert fl.negated(fl.negated(fl.like(Property("s"), "a%"))) == fl.like(Property("s"), "a%")
    assert fl.properties_of(fl.negated(fl.conjunction(one, fl.is_null(Property("m", "m", "int"))))) == {"n", "m"}


@pytest.mark.parametrize("text", ["2018-02-12T00Z", "2018-02-12T00:00:00", "2018-02-12 00:00:00Z", "2018-02-12T00:00:00+02", "2018-02-12T00:00:00+02:00:01", "2018-02-12T00:00:00 +02:00"])
def test_datetime_refuses(text):
    with pytest.raises(ValueError):
        params.instants(text)


def test_datetime_takes():
    utc = dt.timezone.utc
    assert params.instants("2018-02-12T02:00:00+02:00") == (dt.datetime(2018, 2, 12, tzinfo=utc),) * 2
    assert params.instants("../2018-02-12T00:00:00Z") == (None, dt.datetime(2018, 2, 12, tzinfo=utc))
    assert params.instants("../..") is None


def test_antimeridian():
    g = params.bbox_geometry("160.6,-55.95,-170,-25.89", 84)
    assert [geometry.Geometry("POLYGON", c).envelope for c in g.coords] == [(160.6, -55.95, 180, -25.89), (-180, -55.95, -170, -25.89)]
    inside = lambda x: geometry.holds("INTERSECTS", geometry.point(x, -40), g)
    assert all(map(inside, (165, 170, 175, -175, -172, -170.5)))
    assert not any(map(inside, (150, -160)))
    assert params.bbox_geometry("-55.95,160.6,-25.89,-170", 4326).coords == g.coords
    with pytest.raises(ValueError):
        params.bbox_geometry("10,0,5,1", 3067)
    two = geometry.Geometry("MULTIPOLYGON", (geometry.box(0, 0, 1, 1).coords, geometry.box(1, 0, 2, 1).coords), 3067)
    assert params.merged(two).envelope == (0, 0, 2, 1)


@pytest.mark.parametrize(
    ("source", "position", "target", "expected", "within"),
    [
        (84, (27, 60), 3067, (500000, 6651411.190242998), 1e-4),
        (3067, (500000, 6670000), 3879, (25611025.9845, 6674350.2959), 1e-3),
        (3879, (25611025.9845, 6674350.2959), 84, (27.0, 60.1669116), 1e-7),
        (84, (27, 60), 3857, (3005626.2514, 8399737.8898), 1e-3),
    ],
)
def test_projection(source, position, target, expected, within):
    there = crs.project(*position, source, target)
    assert there == pytest.approx(expected, abs=within)
    assert crs.project(*there, target, source) == pytest.approx(position, abs=1e-3 if abs(position[0]) > 400 else 1e-9)


def test_crs_uris():
    assert crs.parse_uri(None) == 84
    assert crs.parse_uri(crs.to_uri(3067)) == 3067
    for bad in ("EPSG:3067", "http://www.opengis.net/def/crs/EPSG/0/1"):
        with pytest.raises(ValueError):
            crs.parse_uri(bad)


SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0))"


@pytest.mark.parametrize(
    ("a", "b", "true"),
    [
        ("POINT(5 5)", SQUARE, "INTERSECTS WITHIN"),
        ("POINT(0 5)", SQUARE, "INTERSECTS TOUCHES"),
        ("POINT(50 5)", SQUARE, "DISJOINT"),
        ("LINESTRING(-5 5,15 5)", SQUARE, "INTERSECTS CROSSES"),
        ("LINESTRING(0 0,10 0)", SQUARE, "INTERSECTS TOUCHES"),
        ("LINESTRING(1 1,2 2)", SQUARE, "INTERSECTS WITHIN"),
        ("POLYGON((5 5,15 5,15 15,5 15,5 5))", SQUARE, "INTERSECTS OVERLAPS"),
        ("POLYGON((10 0,20 0,20 10,10 10,10 0))", SQUARE, "INTERSECTS TOUCHES"),
        ("POLYGON((10 0,10 10,0 10,0 0,10 0))", SQUARE, "INTERSECTS EQUALS WITHIN CONTAINS"),
        (SQUARE, "POLYGON((1 1,2 1,2 2,1 2,1 1))", "INTERSECTS CONTAINS"),
        ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", "INTERSECTS CROSSES"),
        ("LINESTRING(0 0,2 0)", "LINESTRING(1 0,3 0)", "INTERSECTS OVERLAPS"),
        ("LINESTRING(0 0,2 0)", "LINESTRING(2 0,3 0)", "INTERSECTS TOUCHES"),
        ("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,8 2,8 8,2 8,2 2))", "POINT(5 5)", "DISJOINT"),
        ("MULTIPOINT((5 5),(50 50))", SQUARE, "INTERSECTS CROSSES"),
    ],
)
def test_relations(a, b, true):
    a, b = map(geometry.read_wkt, (a, b))
    assert {op for op in geometry.SPATIAL_OPERATORS if geometry.holds(op, a, b)} == set(true.split())
    for op, back in (("INTERSECTS", "INTERSECTS"), ("WITHIN", "CONTAINS"), ("CONTAINS", "WITHIN")):
        assert geometry.holds(back, b, a) == (op in true.split())


@pytest.mark.parametrize("text", ["POINT (1 2)", "LINESTRING (1 2 3, 4 5 6)", SQUARE, "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((1 2, 3 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2))", "POINT EMPTY"])
def test_codecs(text):
    g = geometry.read_wkt(text)
    assert geometry.read_wkt(geometry.write_wkt(g)) == g
    assert geometry.read_wkb(geometry.write_wkb(g)) == g
    assert geometry.read_wkb(geometry.write_gpkg(g, 3067)).coords == g.coords or g.kind == "GEOMETRYCOLLECTION"


def test_ewkt():
    assert geometry.read_wkt("SRID=4269;POINT(1 2)", 0).srid == 4269
    assert geometry.read_wkt("POINT(1 2)", 0).srid == 0
    for bad in ("POINT(1)", "LINESTRING(1 1)", "CIRCLE(1 1)", "POINT(1 1) x", "POLYGON((0 0,1 1))"):
        with pytest.raises(ValueError):
            geometry.read_wkt(bad)


def test_buffer():
    f = registry.Functions()
    round_ = f.call("buffer", [geometry.point(0, 0), 10.0])
    assert round_.kind == "POLYGON" and len(round_.coords[0]) == 33
    assert len(f.call("ST_Buffer", [geometry.point(0, 0), 1.0, "quad_segs=2 join=round"]).coords[0]) == 9
    line = f.call("Buffer", [geometry.read_wkt("LINESTRING(0 0,10 0,10 10)"), 1.0])
    assert geometry.locate((5, 0.9), line) == geometry.locate((10.9, 5), line) == "I"
    assert geometry.locate((5, 1.1), line) == "E"
    styled = lambda style, wkt_text="LINESTRING(0 0,10 0,10 10)": f.call("ST_Buffer", [geometry.read_wkt(wkt_text), 1.0, style])
    at = lambda style, *spots, **more: "".join(geometry.locate(p, styled(style, **more)) for p in spots)
    corner, ends = ((10.95, -0.95), (10.45, -0.45), (11.1, 0.5)), ((-0.5, 0), (-0.95, 0.95), (10, 10.5), (0.5, 0.5))
    assert at("join=mitre", *corner) == "IIE" and at("join=bevel", *corner) == "EIE" and at("join=round", *corner) == "EIE"
    assert at("join=bevel endcap=flat", *ends) == "EEEI" and at("endcap=square", *ends) == "IIII" and at("join=miter endcap=round", *ends) == "IEII"
    assert at("join=mitre", (19, 0), (20.2, 0), wkt_text="LINESTRING(0 2, 20 0, 0 -2)") == "IE"  # a tip beyond the limit is cut off
    square = "POLYGON((0 0,10 0,10 10,0 10,0 0),(3 3,7 3,7 7,3 7,3 3))"
    assert at("join=mitre", (-0.95, -0.95), (10.95, 10.95), (3.5, 5), (5, 5), (-1.1, 5), wkt_text=square) == "IIIEE"
    assert at("join=bevel", (-0.95, -0.95), (-0.4, -0.4), wkt_text=square) == "EI"
    assert at("endcap=square", (5.9, 5.9), (6.1, 5), wkt_text="POINT(5 5)") == "IE"
    for bad in (["x", 1.0], [geometry.point(0, 0)], [geometry.point(0, 0), -1.0], [geometry.point(0, 0), 1.0, "join=odd"], [geometry.point(0, 0), 1.0, "side=left"]):
        with pytest.raises(ValueError):
            f.call("ST_Buffer", bad)


def test_join_path():
    joins = [Join("abc", "a", "def", "d"), Join("def", "d", "baz", "b"), Join("baz", "b", "qux", "q"), Join("x", "x", "y", "y")]
    assert [j.right for j in path(joins, "abc", "qux")] == ["def", "baz", "qux"]
    assert [j.right for j in path(joins, "qux", "abc")] == ["baz", "def", "abc"]
    assert path(joins, "abc", "y") is None


@pytest.mark.parametrize(("value", "low", "high", "text"), [(0.12578, 0, 3, "0.126"), (4.0, 0, 5, "4"), (4.0, 1, 5, "4.0"), (3.99, 0, 5, "3.99"), (4.32, 3, 5, "4.320"), (-0.0, 0, 3, "0"), (1e-9, 0, 5, "0"), (2.5, 0, 0, "3")])
def test_numbers(value, low, high, text):
    assert number_text(value, (low, high)) == text


def test_geometry_text():
    g = geometry.read_wkt("POLYGON((0 0,10 0,10 10,0 0),(1 1,2 1,2 2,1 1))")
    assert wkt(g) == "POLYGON ((0 0, 10 0, 10 10, 0 0), (1 1, 2 1, 2 2, 1 1))"
    assert geometry_json(geometry.point(130, 50), swap=True) == '{"type":"Point","coordinates":[50,130]}'
    with pytest.raises(ValueError):
        geometry_json(geometry.read_wkt("GEOMETRYCOLLECTION(POINT(1 1))"))


def test_cursor_text():
    c = paging.Cursor(("a:b", None, "3"))
    assert paging.read_cursor(c.wire(), 3) == c
    assert paging.read_cursor(paging.Cursor(("x",), 5).wire(), 1) == paging.Cursor(("x",), 5)
    for bad in ("!", "YWJj", c.wire()):
        with pytest.raises(ValueError):
            paging.read_cursor(bad, 2)


def test_formats():
    assert files.negotiate("csv") == "csv"
    assert files.negotiate(None, "text/html,application/xml") == "html"
    assert files.negotiate(None, "") == "json"
    for f, accept in (("pdf", ""), (None, "image/png")):
        with pytest.raises(ValueError):
            files.negotiate(f, accept)


def test_smile():
    assert files.smile({"a": 1}) == b":)\n\x00\xfa\x80a\xc2\xfb"
    assert files.smile([None, True, False, "", "é"]) == b":)\n\x00\xf8\x21\x23\x22\x20\x80\xc3\xa9\xf9"
    assert files.smile(16)[4:] == b"\x24\xa0" and files.smile(-1)[4:] == b"\xc1"
