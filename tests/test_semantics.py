"""Hand-derived cases of images, layouts, trees, jobs and tables."""

import pytest

from quillgrid.functions import storage
from quillgrid.operators import classify, geometry, jobs, layout, ocr, raster, svgtext
from quillgrid.sources import files


def grid_image(image, side, step, width=1):
    """Dark lines on white, every ``step`` pixels, from edge to edge."""
    return [(image, y, x, 0 if y % step < width or x % step < width else 255) for y in range(side) for x in range(side)]


def test_classifier_goes_by_each_image_alone(spark):
    kind = "image_id int, y int, x int, g int"
    rows = grid_image(1, 60, 10) + grid_image(2, 90, 30) + [(3, y, x, 255) for y in range(40) for x in range(40)]
    got = {r.image_id: r for r in classify.classified(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].crossings, got[1].rows, got[1].cols, got[1].is_table) == (36, 6, 6, False)
    assert (got[2].crossings, got[2].rows, got[2].cols, got[2].is_table) == (9, 3, 3, False)
    assert (got[3].crossings, got[3].rows, got[3].h_coverage, got[3].is_table) == (0, 0, 0.0, True)
    alone = classify.classified(spark.createDataFrame(grid_image(1, 60, 10), kind)).collect()
    assert alone == [got[1]]
    assert classify.classified(spark.createDataFrame([], kind)).count() == 0


def test_thick_crossings_count_once(spark):
    rows = grid_image(1, 120, 30, 2)  # lines are narrower than the opening's four pixels
    (r,) = classify.classified(spark.createDataFrame(rows, "image_id int, y int, x int, g int")).collect()
    assert (r.crossings, r.rows, r.cols) == (16, 4, 4)


def test_grid_takes_centres_as_they_are(spark):
    stats = spark.createDataFrame([(1, 0.0, 0.0), (1, 8.4, 8.0), (1, 8.6, 16.0)], "image_id int, cx double, cy double")
    (r,) = raster.grid_dimensions(stats, 8.5).collect()
    assert (r.cols, r.rows) == (2, 2)


@pytest.mark.parametrize("tile", [2, 256])
def test_labels_do_not_depend_on_width_or_tile(spark, tile):
    mask = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 4), (1, 9, 100_000), (2, 0, 5)], "image_id int, y int, x int")
    got = {(r.image_id, r.y, r.x): r.label for r in raster.labelled(mask, tile).collect()}
    assert got == {(1, 0, 5): 5, (1, 1, 4): 5, (1, 2, 4): 5, (1, 9, 100_000): 9 * raster.STRIDE + 100_000, (2, 0, 5): 5}


def test_colours_are_halved_along_their_widest_channel(spark):
    rows = [(1, 0, x, r, g, 0) for x, (r, g) in enumerate([(0, 0), (10, 0), (200, 0), (210, 0), (210, 40)])]
    got = raster.median_cut_rgb(spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int"), 1)
    assert [tuple(r)[3:] for r in sorted(got.collect())] == [(70, 0, 0)] * 3 + [(210, 20, 0)] * 2


def test_tsv_round_trip_of_nulls_and_fractions(spark, tmp_path):
    kind = "src string, ord long, " + ", ".join(f"{c} {'double' if c == 'conf' else 'string' if c == 'text' else 'int'}" for c in ocr.TSV_COLUMNS)
    rows = [("a", 1, 5, 1, 1, 1, 1, 1, 10, None, 30, 40, 96.5, "x"), ("a", 2, 5, 1, None, 1, 1, 2, 10, 20, 30, 40, None, None), ("a", 3, 1, 1, 0, 0, 0, 0, 0, 0, 9, 9, -1.0, "t\tb\nc")]
    words = spark.createDataFrame(rows, kind)
    assert [r.line for r in ocr.tsv_lines(words).orderBy("ord").collect()] == ["5\t1\t1\t1\t1\t1\t10\t\t30\t40\t96.5\tx", "5\t1\t\t1\t1\t2\t10\t20\t30\t40\t\t", "1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\tt b c"]
    back = [tuple(r)[1:] for r in ocr.parse_tsv(ocr.tsv_documents(words)).orderBy("ord").collect()]
    assert back == [rows[0][1:], (*rows[1][1:-1], ""), (*rows[2][1:-1], "t b c")]


def layouts(spark, rows):
    return spark.createDataFrame(rows, "layout_id string, direction string, spacing double")


ITEM = "layout_id string, pos int, kind string, child_id string, w double, h double, stretch int, align int, dx double, dy double"


def test_layouts_nest_to_any_depth(spark):
    """Five levels of one-item rows and columns about a file beside a larger one."""
    chain = [(f"l{i}", 0, "layout", f"l{i + 1}", None, None, 0, 0, None, None) for i in range(4)]
    items = chain + [("l0", 1, "file", None, 30.0, 50.0, 0, 0x21, None, None), ("l4", 0, "file", None, 10.0, 20.0, 0, 0x84, None, None)]
    got = {(r.layout_id, r.pos): (r.depth, r.x, r.y, r.width, r.height) for r in layout.nested(layouts(spark, [(f"l{i}", "hv"[i % 2], 1.0) for i in range(5)]), spark.createDataFrame(items, ITEM)).collect()}
    assert got[("l0", 0)] == (0, 0.0, 0.0, 10.0, 50.0) and got[("l0", 1)] == (0, 11.0, 0.0, 30.0, 50.0)
    assert got[("l3", 0)] == (3, 0.0, 0.0, 10.0, 50.0)
    assert got[("l4", 0)] == (4, 0.0, 15.0, 10.0, 20.0)  # in the middle of 50


def test_free_items_take_no_room(spark):
    items = [("l", 0, "file", None, 10.0, 20.0, 0, 0x21, None, None), ("l", 1, "free", None, 99.0, 99.0, 5, 1, 3.0, 4.0), ("l", 2, "file", None, 10.0, 5.0, 0, 0x21, None, None)]
    got = {r.pos: (r.x, r.y, r.width, r.height) for r in layout.nested(layouts(spark, [("l", "h", 2.0)]), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {0: (0.0, 0.0, 10.0, 20.0), 1: (15.0, 4.0, 0.0, 20.0), 2: (14.0, 0.0, 10.0, 5.0)}


def test_composites_are_as_large_as_their_last_item(spark):
    items = [("l", 0, "file", None, 40.0, 50.0, 0, 0, None, None), ("l", 1, "file", None, 10.0, 5.0, 0, 0x21, None, None)]
    got = {r.pos: (r.x, r.y, r.width, r.height) for r in layout.nested(layouts(spark, [("l", "c", 2.0)]), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {0: (0.0, 0.0, 10.0, 50.0), 1: (0.0, 0.0, 10.0, 5.0)}


def test_layouts_refuse_and_stay_empty(spark):
    with pytest.raises(NotImplementedError):
        layout.nested(layouts(spark, [("l", "rtl", 0.0)]), spark.createDataFrame([], ITEM))
    assert layout.nested(layouts(spark, []), spark.createDataFrame([], ITEM)).count() == 0
    circle = [("a", 0, "layout", "b", None, None, 0, 0, None, None), ("b", 0, "layout", "a", None, None, 0, 0, None, None)]
    assert layout.nested(layouts(spark, [("a", "h", 0.0), ("b", "h", 0.0)]), spark.createDataFrame(circle, ITEM)).count() == 0


def test_resized_and_repeated_files(spark):
    cells = spark.createDataFrame([("l", 0, 5.0, 5.0, 0, 0.0, 0.0, 5.0, 5.0), ("l", 1, 5.0, 5.0, 0, 0.0, 0.0, 6.0, 5.0), ("l", 2, 5.0, 5.0, 1, 0.0, 0.0, 6.0, 5.0), ("l", 3, 5.0, 5.0, 1, 0.0, 0.0, 5.0, 9.0), ("l", 4, 1.0, 1.0, 0x21, 0.0, 0.0, 1.0, 1.0), ("l", 4, 1.0, 1.0, 0x21, 0.0, 0.0, 1.0, 1.0)], "layout_id string, pos int, w double, h double, align int, cx double, cy double, cw double, ch double")
    assert sorted((r.pos, r.problem) for r in layout.checked(cells).collect()) == [(1, "resized"), (3, "resized"), (4, "duplicate")]


def test_tree_walk(spark):
    kind = "page int, node_id int, parent_id int, tag string, transform string"
    rows = [(1, 0, None, "SVG", "scale(9)"), (1, 1, 0, "g", "translate(10,20) scale(2)"), (1, 2, 1, "g", None), (1, 3, 2, "path", "scale(3) translate(1,2)"), (1, 4, 99, "path", "translate(7)"), (2, 3, None, "g", "rotate(5)")]
    got = {(r.page, r.node_id): (r.sx, r.sy, r.tx, r.ty) for r in geometry.tree_transforms(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 1): (2.0, 2.0, 10.0, 20.0), (1, 2): (2.0, 2.0, 10.0, 20.0), (1, 3): (6.0, 6.0, 12.0, 24.0), (1, 4): (1.0, 1.0, 7.0, 0.0), (2, 3): (1.0, 1.0, 0.0, 0.0)}
    assert geometry.tree_transforms(spark.createDataFrame([], kind)).count() == 0


def test_prefix_is_taken_literally(spark):
    rows = [(1, "a$1\\", svgtext.SVG, {"id": "n", "style": "x:url(#g)"}), (2, "p", "http://other/", {"id": "n"}), (3, "p", None, {"id": "n"})]
    got = {r.n: r.attrs for r in svgtext.prefixed(spark.createDataFrame(rows, "n int, prefix string, namespace string, attrs map<string,string>")).collect()}
    assert got == {1: {"id": "a$1\\n", "style": "x:url(#a$1\\g)"}, 2: {"id": "n"}, 3: {"id": "n"}}


def test_input_expansion(spark):
    listed = spark.createDataFrame([(p,) for p in ("/a/x.png", "/a/y.png", "/a/.h.png", "/a/[1].png", "/b/x.png", "/a/c/x.png", "/a/1.png")], "path string")
    names = lambda args, **how: sorted((r.ord, r.path) for r in jobs.expanded_inputs(spark.createDataFrame(list(enumerate(args)), "ord int, arg string"), listed, **how).collect())
    assert names(["/a/*.png"]) == [(0, "/a/1.png"), (0, "/a/[1].png"), (0, "/a/x.png"), (0, "/a/y.png")]
    assert names(["/?/x.*", "/a/x.png", "/gone"]) == [(0, "/a/x.png"), (0, "/b/x.png"), (2, "/gone")]
    assert names(["/?/x.*", "/a/x.png", "/gone"], missing=False, duplicates=True) == [(0, "/a/x.png"), (0, "/b/x.png"), (1, "/a/x.png")]
    assert names(["/a/[1]*"]) == [(0, "/a/[1].png")]
    assert names(["/a/[1x]*"], brackets=True) == [(0, "/a/1.png"), (0, "/a/x.png")]
    paths = spark.createDataFrame([("x/../y/./z",), ("/p//q",), ("../../..",)], "path string")
    assert [r.absolute for r in jobs.absolute(paths, "/root/d").collect()] == ["/root/d/y/z", "/p/q", "/"]


def test_arguments_and_options(spark):
    values = spark.createDataFrame([("3",), ("1.5",), ("-1",), (None,), ("x",)], "value string")
    assert [r.status for r in jobs.argument_status(values, 0, None, "int").collect()] == ["ok", "must be an integer", "must be 0 or greater", "must be an integer", "must be an integer"]
    assert [r.status for r in jobs.argument_status(values, 0, 2).collect()] == ["must be between 0 and 2", "ok", "must be between 0 and 2", "must be a number", "must be a number"]
    given = spark.createDataFrame([(1, 1, "colors", "16"), (1, 2, "colors", "1.5"), (1, 3, "remap", "p.png"), (2, 1, "quantization", "zz"), (2, 2, "riemersma", "true"), (2, 3, "floydsteinberg", "true")], "run_id int, ord int, option string, value string")
    got = {(r.run_id, r.option): (r.value, r.status) for r in jobs.option_values(given, sequential=False).collect()}
    assert got[1, "colors"] == ("1.5", "must be an integer") and got[2, "quantization"] == ("zz", "must be one of mc,as,nq")
    assert got[2, "prescale"] == ("2", "default") and got[2, "riemersma"] == ("true", "ok") and len(got) == 2 * len(jobs.PARALLEL)
    alone = {(r.run_id, r.option): (r.value, r.status) for r in jobs.option_values(given).collect()}
    assert alone[2, "prescale"] == ("1.0", "default") and (1, "cores") not in alone and alone[1, "background"] == (None, "default")
    assert sorted(tuple(r) for r in jobs.exclusive_errors(given).collect()) == [(1, "remap not allowed with colors"), (2, "one of colors and remap is required"), (2, "riemersma not allowed with floydsteinberg")]


def test_vector_documents_are_read_and_written(spark, tmp_path):
    docs = spark.createDataFrame([("<svg/>",), ("<svg>\n</svg>",)], "document string")
    files.write_documents(docs, f"{tmp_path}/docs")
    got = files.read_svg(spark, f"{tmp_path}/docs").collect()
    assert "".join(sorted(r.svg for r in got)).count("<svg") == 2 and all(r.doc_id.startswith("file:") for r in got)


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://far:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_path(Session(), "x")


def test_stretched_rows_end_at_the_least_length(spark):
    """Room is what items, gaps and both margins leave: 100 - (10 + 10 + 2 + 2) goes to the last one."""
    rows = [("a", 0, 10.0, 5.0, 0, 0), ("a", 1, 10.0, 5.0, 0, 0), ("b", 0, 10.0, 5.0, 1, 0), ("b", 1, 10.0, 5.0, 3, 0)]
    items = spark.createDataFrame(rows, "layout_id string, pos int, w double, h double, stretch int, align int")
    got = {(r.layout_id, r.pos): (r.cx, r.cw) for r in layout.placed(items, "h", 2, 1, 100).collect()}
    assert got == {("a", 0): (1.0, 10.0), ("a", 1): (13.0, 86.0), ("b", 0): (1.0, 29.0), ("b", 1): (32.0, 67.0)}
    assert all(sum(got[k, 1]) + 1 == 100 for k in "ab")
    down = {r.pos: (r.cy, r.ch) for r in layout.placed(items.where("layout_id = 'a'"), "v", 2, 1, 50).collect()}
    assert down == {0: (1.0, 5.0), 1: (8.0, 41.0)}


def test_margins_of_nested_layouts(spark):
    """A column with a margin of 5 in a row with a margin of 2 beside a taller file."""
    items = [("r", 0, "layout", "c", None, None, 0, 0, None, None), ("r", 1, "file", None, 30.0, 60.0, 0, 0x21, None, None), ("c", 0, "file", None, 10.0, 20.0, 0, 0x21, None, None), ("c", 1, "file", None, 12.0, 6.0, 0, 0x21, None, None)]
    known = spark.createDataFrame([("r", "h", 1.0, 2.0), ("c", "v", 3.0, 5.0)], "layout_id string, direction string, spacing double, margin double")
    got = {(r.layout_id, r.pos): (r.x, r.y, r.width, r.height) for r in layout.nested(known, spark.createDataFrame(items, ITEM)).collect()}
    assert got == {("r", 0): (2.0, 2.0, 22.0, 60.0), ("r", 1): (25.0, 2.0, 30.0, 60.0), ("c", 0): (7.0, 7.0, 10.0, 20.0), ("c", 1): (7.0, 30.0, 12.0, 6.0)}


def test_paths_are_a_pages_own(spark):
    paths = spark.createDataFrame([(1, 5), (2, 5)], "page int, path_id int")
    assert [tuple(r) for r in geometry.without_matched(paths, spark.createDataFrame([(1, 5)], "page int, path_id int")).collect()] == [(2, 5)]


def test_boxes_of_any_size_take_four_cells_at_most(spark):
    box = "page int, word_id int, word_ord int, left double, top double, width double, height double, text string"
    boxes = [(1, 1, 3, 0.0, 0.0, 1e9, 1e9, "page"), (1, 2, 2, -5.0, -5.0, 0.0, 0.0, "point"), (1, 3, 1, 100.0, 100.0, 50.0, 3.0, "word"), (1, 4, 0, 100.0, 100.0, -1.0, 3.0, "none"), (1, 5, 0, None, 0.0, 9.0, 9.0, "null"), (2, 6, 0, 0.0, 0.0, 31.0, 33.0, "odd")]
    points = [(1, 1, 1, -5.0, -5.0), (1, 2, 2, 100.0, 103.0), (1, 3, 3, 1e9, 0.0), (1, 4, 4, 1e9 + 1, 0.0), (2, 5, 5, 31.0, 33.0), (2, 6, 6, 31.5, 33.0), (3, 7, 7, 0.0, 0.0)]
    hits = geometry.match_paths(spark.createDataFrame(points, "page int, path_id int, path_ord int, x double, y double"), spark.createDataFrame(boxes, box))
    assert {r.path_id: r.text for r in hits.collect()} == {1: "point", 2: "word", 3: "page", 5: "odd"}
