"""Vector documents as text: root attributes, merging, id prefixes, stacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = r"(?i)<svg[^>]*>"
SVG = "http://www.w3.org/2000/svg"


def stripped(svg: Column) -> Column:
    """Without prolog, doctype, metadata and svg tags."""
    for pattern in (r"(?i)<\?xml.*?\?>", r"(?i)<!DOCTYPE[^>]*>", r"(?is)<metadata>.*?</metadata>", TAG, r"(?i)</svg>"):
        svg = F.regexp_replace(svg, pattern, "")
    return svg


def root_attributes(docs: DataFrame) -> DataFrame:
    """Width, height and view box of the root, as written; null where the root
    is no svg element.  The prolog goes first, for the XML reader's sake."""
    bare = F.regexp_replace(F.regexp_replace("svg", r"(?i)<\?xml.*?\?>", ""), r"(?i)<!DOCTYPE[^>]*>", "")
    xml = docs.withColumn("xml", bare)
    return xml.select("doc_id", *(F.xpath_string("xml", F.lit(f"/svg/@{a}")).alias(a.lower()) for a in ("width", "height", "viewBox")))


def merged(docs: DataFrame) -> DataFrame:
    """(grp, merged, error): the layers of each group in one document under the
    first svg tag; an error where no layer has one."""
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "svg")))
    text = docs.groupBy("grp").agg(F.array_join(F.transform(rows, lambda r: r["svg"]), "\n").alias("all"))
    tag = F.regexp_extract("all", TAG, 0)
    body = F.regexp_replace(stripped(F.col("all")), r"^\s+|\s+$", "")
    return text.select("grp", F.when(tag != "", F.concat(tag, F.lit("\n"), body, F.lit("\n</svg>"))).alias("merged"), F.when(tag == "", F.lit("no svg tag")).alias("error"))


def prefixed(nodes: DataFrame) -> DataFrame:
    """Attributes (a map) with a document's prefix put before ids, local links
    in link attributes and url(#...) elsewhere; elements whose ``namespace`` is not
    that of svg stay as they are."""
    p = F.col("prefix")
    literal = F.regexp_replace(p, r"([\\$])", r"\\$1")  # a dollar or backslash is no reference

    def fixed(k: Column, v: Column) -> Column:
        return (
            F.when(k == "id", F.concat(p, v))
            .when(k.startswith("xlink:"), F.when(v.startswith("#"), F.concat(F.lit("#"), p, F.substring(v, 2, 1 << 30))).otherwise(v))
            .otherwise(F.when(F.instr(v, "url(#") > 0, F.regexp_replace(v, F.lit(r"url\(#(.*)\)"), F.concat(F.lit("url(#"), literal, F.lit("$1)")))).otherwise(v))
        )

    return nodes.withColumn("attrs", F.when(F.col("namespace") == SVG, F.transform_values("attrs", fixed)).otherwise(F.col("attrs")))


def placed_transform(docs: DataFrame) -> DataFrame:
    """(doc_id, transform): a scaling matrix from the view box to the box of a
    document, or a translation where it has none.  Columns: width_px, height_px,
    x, y, view_box (by commas, else by white space)."""
    parts = F.when(F.instr("view_box", ",") > 0, F.split("view_box", r"\s*,\s*")).otherwise(F.split(F.trim("view_box"), r"\s+"))
    v = F.transform(parts, lambda c: c.try_cast("double"))
    d = docs.withColumn("v", F.when(F.col("view_box").isNotNull(), v))
    num = lambda c: F.format_string("%.4f", c)
    matrix = F.concat(F.lit("matrix("), num(F.try_divide(F.col("width_px"), F.col("v")[2])), F.lit(",0,0,"), num(F.try_divide(F.col("height_px"), F.col("v")[3])), F.lit(","), num(F.col("x") - F.col("v")[0]), F.lit(","), num(F.col("y") - F.col("v")[1]), F.lit(")"))
    return d.select("doc_id", F.when(F.col("v").isNull(), F.concat(F.lit("translate("), num(F.col("x")), F.lit(","), num(F.col("y")), F.lit(")"))).otherwise(matrix).alias("transform"))


def routed(nodes: DataFrame) -> DataFrame:
    """Where each top-level child goes: shared definitions, nowhere, or the layer."""
    return nodes.withColumn("route", F.when(F.col("tag") == "defs", "defs").when(F.col("tag").isin("metadata"), "drop").otherwise("layer"))


def namespaces(maps: DataFrame) -> DataFrame:
    """(prefix, uri, conflict) over all documents' namespace declarations."""
    return maps.groupBy("prefix").agg(F.min("uri").alias("uri"), (F.countDistinct("uri") > 1).alias("conflict"))


def stacked(layers: DataFrame) -> DataFrame:
    """(grp, document): layers in order, items without layout next, raw elements
    last (``class`` 0, 1, 2), in one document."""
    rows = F.array_sort(F.collect_list(F.struct("class", "ord", "body")))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="no"?>\n<svg xmlns="http://www.w3.org/2000/svg" version="1.1">\n'
    return layers.groupBy("grp").agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["body"]), "\n"), F.lit("\n</svg>")).alias("document"))
