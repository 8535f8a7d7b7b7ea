"""Word grouping on hand-made tables, and the edge cases of parsing."""

import pytest

from quillgrid.operators import ocr
from quillgrid.plans.views import TSV_COLUMNS

HEAD = "\t".join(TSV_COLUMNS)


def tsv(*rows):
    return "\n".join([HEAD, *("\t".join(map(str, r)) for r in rows)])


SAMPLE = tsv(
    (1, 1, 0, 0, 0, 0, 0, 0, 1250, 1000, -1, ""),
    (5, 1, 1, 1, 1, 1, 120, 122, 153, 29, 96.5, "Sample"),
    (5, 1, 1, 1, 1, 2, 293, 119, 101, 35, 91, "Text"),
    (5, 1, 1, 1, 1, 3, 999, 120, 125, 28, 90, "Here"),
    (5, 1, 1, 1, 2, 1, 121, 200, 50, 20, 30, "123"),
    (5, 1, 1, 1, 2, 2, 500, 200, 9, 20, 95, " x "),
    (4, 1, 1, 1),
)


def grouped(spark, scale=1.0):
    rows = ocr.parse_tsv(spark.createDataFrame([("a", SAMPLE)], "src string, content string"))
    groups = ocr.long_or_numeric(ocr.word_groups(ocr.scaled(ocr.words_by_level(rows), scale)))
    return sorted((g.left, g.top, g.width, g.height, g.text) for g in groups.collect())


@pytest.mark.parametrize(
    ("scale", "want"),
    [
        (1.0, [(120, 122, 274, 35, "Sample Text"), (121, 200, 50, 20, "123"), (999, 120, 125, 28, "Here")]),
        (0.8, [(96, 98, 219, 28, "Sample Text"), (97, 160, 40, 16, "123"), (799, 96, 100, 22, "Here")]),
    ],
)
def test_groups(spark, scale, want):
    assert grouped(spark, scale) == want


def test_filters_differ(spark):
    rows = ocr.parse_tsv(spark.createDataFrame([("a", SAMPLE)], "src string, content string"))
    assert ocr.words_by_level(rows).count() == 5
    assert sorted(r.text for r in ocr.words_by_confidence(rows).collect()) == ["Here", "Sample", "Text", "x"]
    assert ocr.page_widths(rows).first().ocr_width == 1250


def test_odd_cells(spark):
    text = tsv((5, 1, 1, 1, 1, 1, "12.7", "x", "", "-3", "nan?", "﻿ a \r")) + "\nshort\tline\n"
    r = ocr.parse_tsv(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "src string, content string")).collect()
    assert [(x.left, x.top, x.width, x.height, x.conf, x.text) for x in r] == [(12, None, None, -3, None, "a")]


def test_rounding_is_half_up(spark):
    rows = spark.createDataFrame([(-5, 5, 3, 0)], "left int, top int, width int, height int")
    assert tuple(ocr.scaled(rows, 0.5).first()) == (-2, 3, 2, 0)


def test_json_that_is_no_array(spark):
    files = spark.createDataFrame([("a", "{}"), ("b", "oops"), ("c", None), ("d", "[]")], "src string, json string")
    assert ocr.json_rows(files).count() == 0


def test_empty_tables(spark):
    words = ocr.parse_tsv(spark.createDataFrame([], "src string, content string"))
    assert ocr.long_or_numeric(ocr.word_groups(words)).count() == 0
    assert ocr.groups_as_json(ocr.word_groups(words)).count() == 0
