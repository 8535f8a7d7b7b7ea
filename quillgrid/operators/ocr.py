"""OCR tables: parsing, filtering, scaling and grouping of words.

All operators are DataFrame to DataFrame.  ``src`` names the file, ``ord`` the
row's place in it; nulls come from cells that do not parse and drop out of
comparisons, except that an unknown gap starts a new group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_whole
from . import ocrbatches
from .ocrbatches import LINE, TSV_COLUMNS

#: Strips all Unicode white space and byte order marks at both ends.
TRIM = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
CONF_LEAST = 60
GROUP_SCHEMA = "array<struct<left:int,top:int,width:int,height:int,text:string>>"


def trimmed(col):
    return F.regexp_replace(col, TRIM, "")


def rounded(col):
    """Half up, also below zero: -2.5 gives -2."""
    return F.floor(col + F.lit(0.5)).cast("int")


def _cell(name: str):
    """A cell as text: nothing for null, whole confidences without a point, no
    tabs or line breaks inside of texts."""
    c = F.col(name)
    if name == "conf":
        c = F.when((c == F.floor(c)) & (F.abs(c) < 2**53), c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif name == "text":
        c = F.regexp_replace(c, "[\t\r\n]", " ")
    return F.coalesce(c.cast("string"), F.lit(""))


def tsv_lines(words: DataFrame) -> DataFrame:
    """(src, ord, line): rows as tab-separated text, always of all cells; numbers
    and nulls are read again as they were, a null text as the empty one."""
    return words.select("src", "ord", F.concat_ws("\t", *map(_cell, TSV_COLUMNS)).alias("line"))


#: Columns of a parsed table but for its file.
PARSED = f"ord bigint, {', '.join(f'{c} int' for c in TSV_COLUMNS[:10])}, conf double, text string"


def _kind(rows: DataFrame, column: str) -> str:
    return f"{column} {rows.schema[column].dataType.simpleString()}"


def tsv_documents(words: DataFrame) -> DataFrame:
    """(src, content): header and rows of each file."""
    rows = words.select("src", "ord", *TSV_COLUMNS).repartition("src").sortWithinPartitions("src", "ord")
    return map_whole(rows, 1, ocrbatches.tsv, f"{_kind(words, 'src')}, content string")


def parse_tsv(files: DataFrame) -> DataFrame:
    """Rows of (src, content) by position; the first line and lines of fewer
    than 12 cells are dropped.  A cell that begins with an integer is that one."""
    return map_whole(files.select("src", "content"), 2, ocrbatches.parsed, f"{_kind(files, 'src')}, {PARSED}")


def parse_tsv_to_scale(files: DataFrame) -> DataFrame:
    """``parse_tsv`` of (src, content, view_box), a row for each file, ``scaled`` by
    its ``scale_factors``, file by file."""
    return map_whole(files.select("src", "content", "view_box"), 3, ocrbatches.parsed_to_scale, f"{_kind(files, 'src')}, {PARSED}")


def parse_tsv_by_header(files: DataFrame) -> DataFrame:
    """(src, ord, row): each line as a map from the header's names."""
    body = files.select("src", F.split(trimmed(F.col("content")), "\n").alias("lines")).where("size(lines) >= 2")
    each = body.select("src", F.split(F.col("lines")[0], "\t").alias("names"), F.posexplode("lines").alias("ord", "line")).where("ord > 0")
    each = each.select("src", F.col("ord").cast("long").alias("ord"), "names", F.split("line", "\t").alias("cells"))
    return each.select("src", "ord", F.expr("map_from_arrays(names, transform(names, (n, i) -> get(cells, i)))").alias("row"))


def words_by_level(rows: DataFrame) -> DataFrame:
    return rows.where("level = 5").withColumn("text", trimmed(F.col("text"))).where("text <> ''")


def words_by_confidence(rows: DataFrame, least: float = CONF_LEAST) -> DataFrame:
    return rows.where(F.col("conf") > least).where(trimmed(F.col("text")) != "")


def scaled(rows: DataFrame, scale: float | Column) -> DataFrame:
    """Each of the four numbers rounded on its own; one scale, or one a row."""
    by = scale if isinstance(scale, Column) else F.lit(float(scale))
    return rows.withColumns({c: rounded(F.col(c) * by) for c in ("left", "top", "width", "height")})


def page_widths(rows: DataFrame) -> DataFrame:
    """(src, width) of the first page row of each file."""
    return rows.where("level = 1").groupBy("src").agg(F.min_by("width", "ord").alias("ocr_width"))


def scale_factors(rows: DataFrame, drawings: DataFrame) -> DataFrame:
    """(src, scale): view-box width over page width; 1 where either is missing."""
    box = F.split("view_box", " ")
    width = F.when(F.size(box) == 4, F.expr("try_cast(split(view_box, ' ')[2] AS DOUBLE)"))
    both = drawings.select("src", width.alias("w")).join(page_widths(rows), "src", "left")
    return both.select("src", F.when((F.col("w") > 0) & (F.col("ocr_width") > 0), F.col("w") / F.col("ocr_width")).otherwise(F.lit(1.0)).alias("scale"))


def line_groups(words: DataFrame) -> DataFrame:
    return words.groupBy(*LINE).agg(F.count("*").alias("n_words"), F.min("ord").alias("first_ord"))


def word_gaps(words: DataFrame) -> DataFrame:
    """Each word with gap and threshold against the one before it in its line;
    brk is 1 where a new group starts."""
    w = f"(PARTITION BY {', '.join(LINE)} ORDER BY left, ord)"
    prev = words.selectExpr("*", f"lag(left + width) OVER {w} AS prev_right", f"lag(width) OVER {w} AS pw", f"lag(length(text)) OVER {w} AS pl")
    average = F.when(F.try_divide(F.col("pw").cast("double"), F.col("pl")) < 1, F.lit(10.0)).otherwise(F.try_divide(F.col("pw").cast("double"), F.col("pl")))
    return (
        prev.withColumn("gap", F.col("left") - F.col("prev_right"))
        .withColumn("threshold", rounded(average * 1.5))
        .withColumn("brk", F.when(F.col("gap") <= F.col("threshold"), 0).otherwise(1))
        .drop("prev_right", "pw", "pl")
    )


def word_groups(words: DataFrame) -> DataFrame:
    """Runs of near words of a line as one: text in order, left and top of the
    first, right edge of the last, the largest height."""
    rows = words.select(*LINE, "left", "ord", "top", "width", "height", "text").repartition(*LINE).sortWithinPartitions(*LINE, "left", "ord")
    out = ", ".join(_kind(words, c) for c in LINE) + f", gid bigint, {_kind(words, 'ord')}, left int, top int, width int, height int, text string"
    return map_whole(rows, len(LINE), ocrbatches.word_groups, out)


def long_or_numeric(groups: DataFrame) -> DataFrame:
    """Drops groups of one or two characters unless they are numbers."""
    return groups.where(r"length(text) >= 3 OR text RLIKE '^-?[0-9.]+$'")


def groups_as_json(groups: DataFrame) -> DataFrame:
    """(src, json): the groups of each file in the order of their lines."""
    rows = groups.select(*LINE, "gid", "ord", *ocrbatches.BOX, "text").repartition("src").sortWithinPartitions(*LINE)
    return map_whole(rows, 1, ocrbatches.groups_as_json, f"{_kind(groups, 'src')}, json string")


def json_rows(files: DataFrame) -> DataFrame:
    """Rows of (src, json); what is no array gives none."""
    return files.select("src", F.posexplode(F.when(F.col("json").rlike(r"^\s*\["), F.from_json("json", GROUP_SCHEMA))).alias("i", "g")).select("src", "i", "g.*")
