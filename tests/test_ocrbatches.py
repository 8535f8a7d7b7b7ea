"""OCR tables by whole documents: what is shuffled, odd documents and slices."""

import pyarrow as pa

from quillgrid.functions import batches
from quillgrid.operators import ocr, ocrbatches
from quillgrid.plans import catalog
from tests.compare import SMALL


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def docs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])


ODD = [(None, "n"), (1, "a bb\nccc  d"), (1, "x yy"), (2, None), (3, ""), (4, 'q"\\\t 12 \n\n-1.5 zzz zzz\r'), (5, " 3 ")]


# F2
def test_tsv_parse_header_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["tsv_parse_header"](spark, SMALL)) == 1


def test_whole_keys(monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array([None, None, 1, 1, 1, 1, 2, 3, 3]), pa.array(range(9))], names=["k", "v"])
    for size in range(1, 10):
        monkeypatch.setattr(batches, "ROWS", size)
        for cut in range(1, 9):
            got = [p.column(0).to_pylist() for p in batches.whole(iter([rows.slice(0, cut), rows.slice(cut)]), 1)]
            assert sum(got, []) == rows.column(0).to_pylist()
            assert all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_words_of_odd_documents(spark):
    got = ocrbatches.words(docs(ODD)).to_pylist()
    assert [(r["src"], r["line_num"], r["word_num"], r["left"], r["text"]) for r in got if r["src"] in (None, 1, 3)] == [
        (None, 1, 1, 50, "n"), (1, 1, 1, 50, "a"), (1, 1, 1, 72, "x"), (1, 1, 2, 94, "bb"), (1, 1, 2, 133, "yy"), (1, 2, 1, 50, "ccc"), (1, 2, 2, 106, ""), (1, 2, 3, 111, "d"), (3, 1, 1, 50, ""),
    ]
    assert not [r for r in got if r["src"] == 2]


def test_numbers_are_written_as_before(spark):
    numbers = [0.0, -0.5, 1e-4, 1.5e-7, 12345678.5, 2.0**53, 1e300, 99.75, float("nan"), float("inf"), None]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "conf double").select(ocr._cell("conf")).collect()]
    assert [x or "" for x in ocrbatches._decimal(pa.array(numbers, pa.float64())).to_pylist()] == want


def test_odd_cells_are_read_as_before(spark):
    cells = ["", "7", "-7", "+7", " 7 ", "7.9", "x", "99999999999", "2147483647", "-2147483648", "1e3", "\t8", "９"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    want = rows.selectExpr("i", "coalesce(try_cast(c AS INT), try_cast(regexp_extract(c, '^\\\\s*([+-]?[0-9]+)', 1) AS INT)) AS n", "try_cast(c AS DOUBLE) AS d").orderBy("i").collect()
    assert ocrbatches._told(pa.array(cells), r"^-?[0-9]{1,9}$", pa.int32(), ocrbatches._whole).to_pylist() == [r.n for r in want]
    assert ocrbatches._told(pa.array(cells), r"^[+-]?[0-9]+(\.[0-9]+)?$", pa.float64(), ocrbatches._number).to_pylist() == [r.d for r in want]


def test_short_lines_and_other_names_by_header(spark):
    files = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["b\ta\n1\t2\n3\n", "a\n", None, "﻿ c\ta\n\n5\t6\t7"])], names=["src", "content"])
    assert ocrbatches.parsed_by_header(files, ["a", "b"]).to_pylist() == [{"src": 1, "ord": 1, "a": "2", "b": "1"}, {"src": 1, "ord": 2, "a": None, "b": "3"}, {"src": 4, "ord": 1, "a": None, "b": None}, {"src": 4, "ord": 2, "a": "6", "b": None}]
    rows = ocr.parse_tsv_by_header(spark.createDataFrame([(1, "b\ta\n1\t2\n3\n"), (2, "a\n")], "src int, content string"))
    assert [r.row for r in rows.orderBy("ord").collect()] == [{"b": "1", "a": "2"}, {"b": "3", "a": None}]


# F6
def test_tsv_parse_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["tsv_parse"](spark, SMALL)) == 1


# F11
def test_word_groups_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["word_groups"](spark, SMALL)) == 1


# F12
def test_word_groups_scaled_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["word_groups_scaled"](spark, SMALL)) == 1


# F10
def test_groups_json_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["groups_json"](spark, SMALL)) == 1


# F8
def test_text_layer_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["text_layer"](spark, SMALL)) == 1


# F7
def test_json_roundtrip_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["json_roundtrip"](spark, SMALL)) == 1


# F9
def test_tsv_roundtrip_shuffles_documents_once(spark):
    assert shuffles(catalog.QUERIES["tsv_roundtrip"](spark, SMALL)) == 1
