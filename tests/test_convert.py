"""What the whole conversion reads and leaves behind."""

import glob

from quillgrid.functions import storage
from quillgrid.operators import ocr
from quillgrid.plans import svg_queries
from tests.compare import SMALL, duck


# F4
def test_only_documents_with_a_drawing_get_a_word_table(spark):
    drawn = {r[0] for r in duck().sql("SELECT DISTINCT event_id // 100 FROM events JOIN documents ON doc_id = event_id // 100").fetchall()}
    assert {r.src for r in svg_queries.word_tables(spark, SMALL).select("src").collect()} == drawn


def test_tables_that_are_over_are_dropped(spark):
    storage.clear(spark)
    svg_queries.convert_drawing(spark, SMALL)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in glob.glob(storage.application_folder(spark).removeprefix("file://") + "/*")]
    assert sorted(left) == ["edited", "paths", "tree"]


def test_scales_file_by_file(spark):
    page = "\t".join(map(str, (1, 1, 0, 0, 0, 0, 0, 0, 1250, 1000, -1, "")))
    word = "\t".join(map(str, (5, 1, 1, 1, 1, 1, -5, 122, 153, 29, 96.5, "a")))
    files = [("a", f"h\n{page}\n{word}"), ("b", f"h\n{word}\n{page}"), ("c", f"h\n{word}"), ("d", f"h\n{page}\n{word}"), ("e", f"h\n{page}\n{word}\n{page.replace('1250', '1')}")]
    boxes = [("a", "0 0 625 50"), ("b", "0 0 1000 50"), ("c", "0 0 1000 50"), ("d", "0,0,625,50"), ("e", "0 0 x 50"), ("f", "0 0 1 1")]
    files, boxes = spark.createDataFrame(files, "src string, content string"), spark.createDataFrame(boxes, "src string, view_box string")
    rows = ocr.parse_tsv(files)
    want = ocr.scaled(rows.join(ocr.scale_factors(rows, boxes), "src"), ocr.F.col("scale")).drop("scale")
    got = ocr.parse_tsv_to_scale(files.join(boxes, "src"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
