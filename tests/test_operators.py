"""Geometry, rasters, layouts and jobs on hand-made rows."""

import pytest

from quillgrid.operators import classify, geometry, graph, jobs, layout, raster, svgtext


def test_box_edges_and_first_match(spark):
    points = spark.createDataFrame([(1, 1, 1, 10.0, 10.0), (1, 2, 2, 20.0, 15.0), (1, 3, 3, 15.0, 12.0), (1, 4, 4, 21.0, 12.0)], "page int, path_id int, path_ord int, x double, y double")
    boxes = spark.createDataFrame([(1, 8, 2, 10, 10, 10, 5, "b"), (1, 9, 1, 14, 11, 2, 2, "a")], "page int, word_id int, word_ord int, left int, top int, width int, height int, text string")
    assert {r.path_id: r.text for r in geometry.match_paths(points, boxes).collect()} == {1: "b", 2: "b", 3: "a"}


@pytest.mark.parametrize(
    ("transforms", "want"),
    [([], (1, 2)), (["translate(5)"], (6, 2)), (["scale(2)"], (2, 4)), (["scale(2) translate(3,4)"], (5, 8)), (["scale(2)", "translate(3,4)"], (8, 12)), (["matrix(1,0,0,1,9,9)"], (1, 2))],
)
def test_transforms(spark, transforms, want):
    path = spark.createDataFrame([(1, 1, 1, "M1,2 L3 4", transforms), (1, 2, 2, " M1 2", transforms)], "page int, path_id int, path_ord int, d string, transforms array<string>")
    assert [(r.x, r.y) for r in geometry.start_points(path).collect()] == [want]


def test_diagonal_pixels_are_one_component(spark):
    mask = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 5, 5), (2, 0, 1), (1, 0, 0)], "image_id int, y int, x int")
    got = sorted((r.image_id, r.y, r.x, r.label) for r in raster.labelled(mask).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 1, 0), (1, 5, 5, 5 * raster.STRIDE + 5), (2, 0, 1, 1)]


def test_clusters_go_by_anchor(spark):
    stats = spark.createDataFrame([(1, float(v), 0.0) for v in (0, 6, 12, 18)], "image_id int, cy double, cx double")
    assert tuple(raster.grid_dimensions(stats, 10).first()) == (1, 2, 1)


def test_blank_image_is_a_table(spark):
    pixels = spark.createDataFrame([(1, y, x, 255) for y in range(20) for x in range(20)], "image_id int, y int, x int, g int")
    assert classify.classified(pixels).first().is_table
    grid = spark.createDataFrame([(1, y, x, 0 if y % 10 == 5 or x % 10 == 5 else 255) for y in range(60) for x in range(60)], "image_id int, y int, x int, g int")
    assert not classify.classified(grid).first().is_table


def test_palette_with_black_and_white(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, 0, 0), (1, 0, 1, 255, 255, 255), (1, 0, 2, 9, 8, 7)], "image_id int, y int, x int, r int, g int, b int")
    colours = raster.palette(pixels)
    assert [r.color for r in colours.orderBy("cindex").collect()] == ["#ffffff", "#090807", "#000000"]
    assert [r.v for r in raster.isolated(pixels, colours, 1, True).orderBy("x").collect()] == [0, 255, 0]
    assert raster.unused_colour(colours, ["#FFFFFE"], False).first().color == "#fffffd"
    assert raster.unused_colour(colours, []).first().color == "#000001"


def test_last_item_takes_unshared_room(spark):
    items = spark.createDataFrame([("a", 0, 2.0, 1.0, 0, 0), ("a", 1, 3.0, 4.0, 0, 0)], "layout_id string, pos int, w double, h double, stretch int, align int")
    assert [r.length for r in layout.stretched(items, "h", 10).orderBy("pos").collect()] == [2.0, 8.0]
    assert [r.length for r in layout.stretched(items, "v", 10).orderBy("pos").collect()] == [1.0, 9.0]
    assert tuple(layout.box_sizes(items, "c").first()) == ("a", 3.0, 4.0)
    with pytest.raises(NotImplementedError):
        layout.placed(items, "right to left")


def test_units(spark):
    rows = spark.createDataFrame([("1pt",), ("1in",), ("2px",), ("3",), ("4cm",), (None,)], "value string")
    assert [r.px for r in layout.unit_values(rows).collect()] == [1.25, 90.0, 2.0, 3.0, None, None]


def test_merge_without_svg_tag(spark):
    docs = spark.createDataFrame([(1, 1, "<g/>"), (2, 1, "<?xml v?><SVG a><metadata>\n</metadata><g/></SVG>"), (2, 2, "<svg b>x</svg>")], "grp int, doc_id int, svg string")
    got = {r.grp: (r.merged, r.error) for r in svgtext.merged(docs).collect()}
    assert got == {1: (None, "no svg tag"), 2: ("<SVG a>\n<g/>\nx\n</svg>", None)}


def test_inputs(spark):
    files = spark.createDataFrame([(3, "/a/x.png"), (1, "/a/x.png"), (2, "/b/x.png"), (4, "/c[1].png")], "ord int, path string")
    plan = jobs.input_output_plan(files, "/out", "p_*.svg")
    assert sorted((r.ord, r.output) for r in plan.collect()) == [(1, "/out/p_x.svg"), (2, "/out/p_x.svg"), (4, "/out/p_c[1].svg")]
    assert [tuple(r) for r in jobs.collisions(plan).collect()] == [("/out/p_x.svg", 2, 1)]
    assert jobs.escaped_brackets(files).where("ord = 4").first().escaped == "/c[[]1[]].png"


def test_components_of_nothing_and_of_a_chain(spark):
    assert graph.components(spark.createDataFrame([], "u int, v int")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (60, 61)], "u int, v int")
    got = {r.v: r.root for r in graph.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 60: 60, 61: 60}
