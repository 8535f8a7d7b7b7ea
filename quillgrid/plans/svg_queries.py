"""Registered queries on parsed vector documents, and the whole conversion."""

from pyspark.sql import functions as F

from ..functions.storage import dropped, lasting, temporary
from ..operators import geometry as g
from ..operators import ocr, ocrbatches
from ..operators import svgtext as t
from ..operators import svgtree as tree
from . import views as v
from .ocr_queries import FILTERED, GAPS, GROUPS, LINE
from .registry import query

SVG = f"WITH {v.SVG_DOCS}"
UNIT = "CASE doc_id % 4 WHEN 0 THEN 'pt' WHEN 1 THEN 'px' WHEN 2 THEN 'in' ELSE '' END"
BOX = "CASE doc_id % 3 WHEN 0 THEN concat('0,0,', size * 8, ',', size * 4) ELSE concat('0 ', doc_id % 7, ' ', size * 8, ' ', size * 4) END"
NS = "http://www.w3.org/2000/svg"


@query("svg_nodes", f"""WITH p AS (SELECT p_partkey AS doc_id, p_size AS size, p_brand AS brand FROM part),
n AS (SELECT doc_id, 4 AS node, NULL AS parent, 0 AS depth, 'element' AS kind, 'svg' AS tag, concat('xmlns={NS};width=', size * 10, {UNIT}, ';height=', size * 5, 'px;viewBox=', {BOX}) AS attrs, NULL AS text FROM p
  UNION ALL SELECT doc_id, 5, 4, 1, 'element', 'metadata', '', NULL FROM p
  UNION ALL SELECT doc_id, 6, 5, 2, 'text', NULL, NULL, concat(chr(10), 'made by ', brand, chr(10)) FROM p
  UNION ALL SELECT doc_id, 8, 4, 1, 'element', 'g', concat('id=g', doc_id), NULL FROM p
  UNION ALL SELECT doc_id, 9, 8, 2, 'element', 'path', concat('id=a;d=M 1 ', size), NULL FROM p)
SELECT *, CAST(node AS BIGINT) AS ord, CASE WHEN kind = 'element' THEN '{NS}' END AS namespace FROM n""")
def svg_nodes(s, d):
    pairs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return tree.parsed(v.svg_docs(s, d)).withColumn("attrs", pairs)


@query("svg_roundtrip", f"""SELECT p_partkey AS doc_id, concat('<svg xmlns="{NS}" width="', p_size * 10, {UNIT}, '" height="', p_size * 5, 'px" viewBox="', {BOX}, '"><metadata>', chr(10), 'made by ', p_brand, chr(10), '</metadata><g id="g', p_partkey, '"><path id="a" d="M 1 ', p_size, '"/></g></svg>') AS document
 FROM (SELECT *, p_partkey AS doc_id, p_size AS size FROM part)""")
def svg_roundtrip(s, d):
    return tree.serialised(tree.parsed(v.svg_docs(s, d)))


#: One thing wrong with most of the drawings.
BROKEN = """CASE p_partkey % 9 WHEN 0 THEN concat(svg, '<svg/>') WHEN 1 THEN replace(svg, '</g>', '</h>') WHEN 2 THEN replace(svg, '</svg>', '') WHEN 3 THEN replace(svg, ' id="a"', ' id="a" id="b"')
 WHEN 4 THEN replace(svg, ' id="a"', ' id=a') WHEN 5 THEN replace(svg, '2000/svg', '1999/xhtml') WHEN 6 THEN concat(svg, ' end') WHEN 7 THEN replace(svg, 'made by', 'made < by') ELSE svg END"""


@query("svg_problems", """SELECT p_partkey AS doc_id, ['second root', 'closing tag of another element', 'element that does not end', 'repeated attribute', 'attribute without a quoted value', 'root is no svg element', 'text outside of the root', 'stray <'][p_partkey % 9 + 1] AS problem
 FROM part WHERE p_partkey % 9 < 8""")
def svg_problems(s, d):
    return tree.problems(v.svg_docs(s, d).selectExpr("doc_id", BROKEN.replace("p_partkey", "doc_id") + " AS svg"))


@query("svg_element_routing", """WITH n(tag, route, node) AS (VALUES ('metadata', 'drop', 5), ('g', 'layer', 8)) SELECT p_partkey AS doc_id, node, tag, route FROM part, n""")
def svg_element_routing(s, d):
    """Top-level children of parsed drawings."""
    return t.routed(tree.parsed(v.svg_docs(s, d)).where("depth = 1 AND kind = 'element'").select("doc_id", "node", "tag")).select("doc_id", "node", "tag", "route")


@query("svg_id_prefix", f"""SELECT p_partkey AS doc_id, concat('<svg xmlns="{NS}" width="', p_size * 10, {UNIT}, '" height="', p_size * 5, 'px" viewBox="', {BOX}, '"><metadata>', chr(10), 'made by ', p_brand, chr(10), '</metadata><g id="d', p_partkey, '_g', p_partkey, '"><path id="d', p_partkey, '_a" d="M 1 ', p_size, '"/></g></svg>') AS document
 FROM (SELECT *, p_partkey AS doc_id, p_size AS size FROM part)""")
def svg_id_prefix(s, d):
    nodes = tree.parsed(v.svg_docs(s, d)).withColumn("prefix", F.concat(F.lit("d"), "doc_id", F.lit("_")))
    return tree.serialised(t.prefixed(nodes).drop("prefix"))


#: Path and groups of a drawing of 100 events; odd drawings have two groups, the others three.
PER = 100
GROUP = f"event_id % CASE WHEN event_id {{div}} {PER} % 2 = 0 THEN 3 ELSE 2 END"
D = "CASE WHEN event_id % 11 = 0 THEN ' M 1 2' WHEN event_id % 5 = 0 THEN concat('m', (event_id * 37) % 900, '.5 ', (event_id * 17) % 500) ELSE concat('M ', (event_id * 37) % 900, ',', (event_id * 17) % 500, ' L 5 5') END"
OWN = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' transform=\"translate(5)\"' WHEN 2 THEN ' transform=\"scale(0.5) translate(2,-1)\"' ELSE ' transform=\"translate(-1.5 2)\"' END"
OUTER = "CASE k WHEN 0 THEN ' transform=\"translate(3, 4) scale(0.5)\"' WHEN 1 THEN ' transform=\"scale(2,1)\"' ELSE '' END"
VIEW = "CASE WHEN doc_id % 3 = 0 THEN '0,0,900,500' ELSE '0 0 900 500' END"
HEAD = '<?xml version="1.0" standalone="no"?>\n<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 20010904//EN" "svg10.dtd">\n'
DESC = '<desc>R &amp; D &#38; "more" <![CDATA[<x>]]></desc>'


def drawings(s, d):
    """(doc_id, svg, view_box): a drawing for each hundred events."""
    paths = v.table(s, d, "events").selectExpr(f"event_id div {PER} AS doc_id", "event_id", f"{GROUP.format(div='div')} AS k", f"concat('\n<path d=\"', {D}, '\"', {OWN}, '/>') AS path")
    groups = paths.groupBy("doc_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "path"))), lambda x: x["path"]), "").alias("paths"))
    one = groups.selectExpr("doc_id", "k", f"concat('<g id=\"g', k, '\"', {OUTER}, '>', paths, '</g>') AS g").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda x: x["g"]), "").alias("body"))
    return one.select("doc_id", F.expr(VIEW).alias("view_box"), F.concat(F.lit(f'{HEAD}<svg version="1.0" xmlns="{NS}" width="900pt" height="500pt" viewBox="'), F.expr(VIEW), F.lit(f'">{DESC}'), "body", F.lit("</svg>\n")).alias("svg"))


def word_tables(s, d):
    """(src, content): the OCR table of each document that has a drawing, with a row for its page."""
    drawn = v.table(s, d, "events").selectExpr(f"event_id div {PER} AS doc_id").distinct()
    page = F.concat(F.lit("$1" + "1\t1\t0\t0\t0\t0\t0\t0\t"), (1000 + F.col("src") % 700).cast("string"), F.lit("\t2000\t-1\t\n"))
    return v.over_documents(s, d, "content string", ocrbatches.tsv, only=drawn).withColumn("content", F.regexp_replace("content", F.lit("^([^\n]*\n)"), page))


def converted(docs, tables):
    """(doc_id, document) of drawings (doc_id, svg, view_box) and OCR tables (src,
    content) of the same ids: paths that begin in a confident word go, three groups
    get their colours, and the word groups come in as a layer of text."""
    with temporary(docs.sparkSession):
        nodes = lasting(g.written(tree.parsed(docs), "nodes"))
    scaled = g.written(ocr.parse_tsv_to_scale(tables.join(docs.select(F.col("doc_id").alias("src"), "view_box"), "src")), "scaled")
    at = nodes.where("kind = 'element'").select(F.col("doc_id").alias("page"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "tag", F.col("attrs")["transform"].alias("transform"), F.col("attrs")["d"].alias("d"))
    moves = g.tree_transforms(at.drop("d"))
    points = g.moved_points(at.where("tag = 'path'").join(moves, ["page", "node_id"]).select("page", F.col("node_id").alias("path_id"), F.col("node_id").alias("path_ord"), "d", F.struct("sx", "sy", "tx", "ty").alias("m")))
    words = ocr.words_by_confidence(scaled).select(F.col("src").alias("page"), F.col("ord").alias("word_id"), F.col("ord").alias("word_ord"), "left", "top", "width", "height", "text")
    gone = g.match_paths(points, words).select(F.col("page").alias("doc_id"), F.col("path_id").alias("node"))
    groups = nodes.where("kind = 'element' AND tag = 'g'").select("doc_id", "node", F.expr("CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT)").alias("ord"))
    fills = g.coloured_groups(groups).where("fill IS NOT NULL").select("doc_id", "node", F.col("fill").alias("value"))
    lines = ocr.long_or_numeric(ocr.word_groups(ocr.words_by_level(scaled)))
    lines = lines.withColumn("ord", F.struct(F.expr(f"min(ord) OVER (PARTITION BY {LINE})").alias("line_ord"), "gid"))
    layer = g.text_layer(lines).withColumnRenamed("src", "doc_id")
    edited = g.written(tree.with_text_layer(tree.with_attribute(tree.without(nodes, gone), fills, "fill"), layer), "edited")
    dropped(nodes, scaled)
    return tree.serialised(edited)


# each side is made from the given tables without a parser: matched paths by arithmetic on their numbers
@query("convert_drawing", f"""WITH {v.WORDS},
e AS (SELECT event_id, event_id // {PER} AS doc_id, {GROUP.format(div="//")} AS k, {D} AS d, {OWN} AS own, CASE WHEN event_id % 5 = 0 THEN (event_id * 37) % 900 + 0.5 ELSE (event_id * 37) % 900 END::DOUBLE AS x0, ((event_id * 17) % 500)::DOUBLE AS y0 FROM events),
m AS (SELECT *, [0.5, 2, 1][k + 1]::DOUBLE AS gx, [0.5, 1, 1][k + 1]::DOUBLE AS gy, [3, 0, 0][k + 1]::DOUBLE AS ga, [4, 0, 0][k + 1]::DOUBLE AS gb, [1, 1, 0.5, 1][event_id % 4 + 1]::DOUBLE AS ox, [0, 5, 2, -1.5][event_id % 4 + 1]::DOUBLE AS oa, [0, 0, -1, 2][event_id % 4 + 1]::DOUBLE AS ob FROM e),
pt AS (SELECT event_id, doc_id, x0 * (gx * ox) + (ga + oa * gx) AS x, y0 * (gy * ox) + (gb + ob * gy) AS y FROM m WHERE event_id % 11 <> 0),
f AS (SELECT DISTINCT src, CASE WHEN src % 3 = 0 THEN 1 ELSE 900::DOUBLE / (1000 + src % 700) END AS scale FROM words),
sw AS (SELECT w.* REPLACE ({", ".join(f'CAST(floor("{c}" * scale + 0.5) AS INTEGER) AS "{c}"' for c in ("left", "top", "width", "height"))}, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') AS text) FROM words w JOIN f USING (src) WHERE src IN (SELECT doc_id FROM e)),
hit AS (SELECT DISTINCT event_id FROM pt JOIN sw ON sw.src = pt.doc_id AND conf > 60 AND text <> '' AND x BETWEEN "left" AND "left" + width AND y BETWEEN top AND top + height),
gr AS (SELECT doc_id, k, '<g id="g' || k || '"' || {OUTER} || CASE WHEN doc_id % 2 = 0 THEN ' fill="' || ['red', 'green', 'gray'][k + 1] || '"' ELSE '' END || '>' || string_agg(chr(10) || CASE WHEN event_id IN (SELECT event_id FROM hit) THEN '' ELSE '<path d="' || d || '"' || own || '/>' END, '' ORDER BY event_id) || '</g>' AS g FROM e GROUP BY doc_id, k),
dr AS (SELECT doc_id, string_agg(g, '' ORDER BY k) AS body FROM gr GROUP BY doc_id),
kept AS (SELECT * FROM sw WHERE text <> ''), {GAPS}, {GROUPS}, {FILTERED}, lo AS (SELECT *, min(ord) OVER (PARTITION BY {LINE}) AS line_ord FROM flt),
tx AS (SELECT src, '<g id="ocr_text_layer">' || string_agg(printf('<text x="%.2f" y="%.2f" font-size="%dpx" fill="#666666" font-family="Arial, sans-serif">', "left"::DOUBLE, (top + height)::DOUBLE, CAST(floor(height * 1.1::DOUBLE + 0.5) AS BIGINT)) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>', '' ORDER BY line_ord, gid) || '</g>' AS layer FROM lo GROUP BY src)
SELECT doc_id, '<svg version="1.0" xmlns="{NS}" width="900pt" height="500pt" viewBox="' || {VIEW} || '"><desc>R &amp; D &amp; "more" &lt;x&gt;</desc>' || body || coalesce(layer, '') || '</svg>' AS document FROM dr LEFT JOIN tx ON src = doc_id""")
def convert_drawing(s, d):
    return converted(drawings(s, d), word_tables(s, d))
