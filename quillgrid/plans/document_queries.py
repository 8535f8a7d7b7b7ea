"""Registered queries on layouts, vector documents and jobs."""

from pyspark.sql import functions as F

from ..operators import jobs as j
from ..operators import layout as lay
from ..operators import svgtext as t
from . import views as v
from .registry import query

UNITS = "concat(p_size, '.5', CASE p_partkey % 5 WHEN 0 THEN 'pt' WHEN 1 THEN 'px' WHEN 2 THEN 'in' WHEN 3 THEN 'cm' ELSE '' END)"


@query("unit_convert", f"""WITH u AS (SELECT p_partkey AS id, {UNITS} AS value FROM part), n AS (SELECT *, TRY_CAST(regexp_extract(value, '^(.*?)(pt|px|in)?$', 1) AS DOUBLE) AS number, regexp_extract(value, '^(.*?)(pt|px|in)?$', 2) AS u FROM u)
SELECT id, value, number, CASE WHEN number IS NOT NULL THEN NULLIF(u, '') END AS unit, round(number * CASE u WHEN 'pt' THEN 1.25::DOUBLE WHEN 'in' THEN 90.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS px FROM n""")
def unit_convert(s, d):
    return lay.unit_values(v.table(s, d, "part").selectExpr("p_partkey AS id", f"{UNITS} AS value"))


ITEMS = f"WITH {v.LAYOUT_ITEMS}"


def _placed(along, across, least, spacing, margin, direction):
    before = f"{margin}::DOUBLE + coalesce(sum(length + {spacing}) OVER (PARTITION BY layout_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    breadth = "(SELECT z.w FROM items z WHERE z.layout_id = st.layout_id ORDER BY z.pos DESC LIMIT 1)" if direction == "c" else f"max({across}) OVER (PARTITION BY layout_id)"
    m = f"{margin}::DOUBLE"
    need = f"({margin}::DOUBLE + (SELECT z.{along} FROM items z WHERE z.layout_id = items.layout_id ORDER BY z.pos DESC LIMIT 1))" if direction == "c" else f"(2 * {margin}::DOUBLE + sum({along} + {spacing}::DOUBLE) OVER (PARTITION BY layout_id) - {spacing})"
    cells = {"h": (before, m, "length", breadth), "v": (m, before, breadth, "length"), "c": ("0::DOUBLE", "0::DOUBLE", breadth, "length")}[direction]
    return f"""{ITEMS}, 
-- what items, the gaps between them and both margins leave
r AS (SELECT *, greatest(0, {least} - {need}) AS room, sum(stretch) OVER (PARTITION BY layout_id) AS total, max(pos) OVER (PARTITION BY layout_id) AS last FROM items),
st AS (SELECT *, {along} + CASE WHEN total > 0 THEN stretch * (room / total) WHEN pos = last THEN room ELSE 0 END AS length FROM r),
cells AS (SELECT layout_id, pos, w, h, align, {", ".join(f"{e} AS {c}" for e, c in zip(cells, ("cx", "cy", "cw", "ch")))} FROM st)"""


CELLS = "SELECT layout_id, pos, w, h, align, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cw, 6) AS cw, round(ch, 6) AS ch FROM cells"


def _rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query("hbox_layout", f"{_placed('w', 'h', 0, 2, 1, 'h')} {CELLS}")
def hbox_layout(s, d):
    return _rounded(lay.placed(v.layout_items(s, d), "h", 2, 1), *"cx cy cw ch".split())


@query("vbox_layout", f"{_placed('h', 'w', 0, 3, 0, 'v')} {CELLS}")
def vbox_layout(s, d):
    return _rounded(lay.placed(v.layout_items(s, d), "v", 3), *"cx cy cw ch".split())


@query("composite_layout", f"{_placed('h', 'w', 0, 0, 0, 'c')} {CELLS}")
def composite_layout(s, d):
    return _rounded(lay.placed(v.layout_items(s, d), "c"), *"cx cy cw ch".split())


@query("stretch_layout", f"{_placed('w', 'h', 400, 2, 1, 'h')} {CELLS}")
def stretch_layout(s, d):
    return _rounded(lay.placed(v.layout_items(s, d), "h", 2, 1, 400), *"cx cy cw ch".split())


def _side(low, high, mid, at, room, size):
    return f"round(CASE WHEN align & {low} > 0 THEN {at} WHEN align & {high} > 0 THEN {at} + ({room} - {size}) WHEN align & {mid} > 0 THEN {at} + 0.5::DOUBLE * ({room} - {size}) ELSE {at} END, 6)", f"CASE WHEN align & {low | high | mid} > 0 THEN {size} ELSE {room} END"


(AX, AW), (AY, AH) = _side(1, 2, 4, "cx", "cw", "w"), _side(32, 64, 128, "cy", "ch", "h")


@query("align_in_cell", f"{_placed('w', 'h', 400, 2, 1, 'h')} SELECT layout_id, pos, {AX} AS x, {AY} AS y, round({AW}, 6) AS width, round({AH}, 6) AS height FROM cells")
def align_in_cell(s, d):
    return _rounded(lay.aligned(lay.placed(v.layout_items(s, d), "h", 2, 1, 400)), "x", "y", "width", "height")


#: Trees of layouts: a page holds columns, a column holds rows, which hold files; each tenth file stands free.
TREE_ITEM = "CASE WHEN pos % 10 = 7 THEN 'free' ELSE 'file' END AS kind, CAST(NULL AS STRING) AS child_id, w, h, stretch, align, CAST(pos % 4 AS DOUBLE) AS dx, 0.5D AS dy"
TREE_SQL = f"""{ITEMS}, f AS (SELECT *, CASE WHEN pos % 10 = 7 THEN 'free' ELSE 'file' END AS kind, 'c' || split_part(layout_id, '-', 2) AS col_id FROM items),
-- what rows, columns and pages need
rn AS (SELECT layout_id, any_value(col_id) AS col_id, sum(CASE WHEN kind = 'file' THEN w ELSE 0 END) + 2::DOUBLE * (count(*) - 1) + 2 AS nw, max(CASE WHEN kind = 'file' THEN h ELSE 0 END) + 2 AS nh FROM f GROUP BY layout_id),
rp AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY layout_id) AS pos, 'p' || (CAST(substr(col_id, 2) AS BIGINT) % 3) AS page_id FROM rn),
cn AS (SELECT col_id, any_value(page_id) AS page_id, max(nw) + 4 AS nw, sum(nh) + 3::DOUBLE * (count(*) - 1) + 4 AS nh FROM rp GROUP BY col_id),
cp AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY col_id) AS pos FROM cn),
-- a page gives its columns their width and its own height; a column stretches its last row to the height
cc AS (SELECT *, coalesce(sum(nw + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, max(nh) OVER (PARTITION BY page_id) AS ch FROM cp),
-- a column keeps 2 free about its rows, a row 1 about its files
rc AS (SELECT rp.*, cc.x + 2 AS x, cc.nw AS cw, cc.ch, rp.nh + CASE WHEN rp.pos = max(rp.pos) OVER (PARTITION BY rp.col_id) THEN cc.ch - cc.nh ELSE 0 END AS rh FROM rp JOIN cc USING (col_id)),
rr AS (SELECT *, 2 + coalesce(sum(rh + 3) OVER (PARTITION BY col_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM rc),
-- a row shares out what its files and the gaps behind them leave
fi AS (SELECT f.layout_id, f.pos, f.kind, CASE WHEN f.kind = 'file' THEN f.w ELSE 0 END AS w, CASE WHEN f.kind = 'file' THEN f.h ELSE 0 END AS h, CASE WHEN f.kind = 'file' THEN stretch ELSE 0 END AS stretch, CASE WHEN f.kind = 'file' THEN align ELSE 0 END AS align, rr.x AS ox, rr.y AS oy, rr.cw AS aw, rr.rh AS ah, max(f.pos) OVER (PARTITION BY f.layout_id) AS last FROM f JOIN rr USING (layout_id)),
fr AS (SELECT *, greatest(0, aw - 2 - sum(w) OVER (PARTITION BY layout_id) - 2 * count(*) FILTER (WHERE kind = 'file' AND pos < last) OVER (PARTITION BY layout_id)) AS room, sum(stretch) OVER (PARTITION BY layout_id) AS total FROM fi),
fl AS (SELECT *, w + CASE WHEN total > 0 THEN stretch * (room / total) WHEN pos = last THEN room ELSE 0 END AS length FROM fr),
cells AS (SELECT *, ox + 1 + coalesce(sum(length + 2) OVER (PARTITION BY layout_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cx, oy + 1 AS cy, length AS cw, greatest(ah, max(h) OVER (PARTITION BY layout_id)) AS ch FROM fl),
tree AS (
SELECT page_id AS layout_id, CAST(pos AS INTEGER) AS pos, 0 AS depth, 'layout' AS kind, col_id AS child_id, round(x, 6) AS x, 0::DOUBLE AS y, round(nw, 6) AS width, round(ch, 6) AS height FROM cc
UNION ALL SELECT col_id, CAST(pos AS INTEGER), 1, 'layout', layout_id, round(x, 6), round(y, 6), round(cw, 6), round(rh, 6) FROM rr
UNION ALL SELECT layout_id, pos, 2, kind, NULL, round({AX} + CASE WHEN kind = 'free' THEN pos % 4 ELSE 0 END, 6), round({AY} + CASE WHEN kind = 'free' THEN 0.5::DOUBLE ELSE 0 END, 6), round({AW}, 6), round({AH}, 6) FROM cells)"""


def layout_tree(s, d):
    files = v.layout_items(s, d)
    rows = files.select("layout_id").distinct().selectExpr("layout_id", "concat('c', split_part(layout_id, '-', 2)) AS col_id")
    rows = rows.selectExpr("*", "CAST(row_number() OVER (PARTITION BY col_id ORDER BY layout_id) AS INT) AS pos")
    columns = rows.select("col_id").distinct().selectExpr("col_id", "concat('p', CAST(substr(col_id, 2) AS BIGINT) % 3) AS page_id")
    columns = columns.selectExpr("*", "CAST(row_number() OVER (PARTITION BY page_id ORDER BY col_id) AS INT) AS pos")
    inner = "'layout' AS kind, {} AS child_id, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS h, 0 AS stretch, 0 AS align, CAST(NULL AS DOUBLE) AS dx, CAST(NULL AS DOUBLE) AS dy"
    items = files.selectExpr("layout_id", "pos", *TREE_ITEM.split(", "))
    items = items.unionByName(rows.selectExpr("col_id AS layout_id", "pos", *inner.format("layout_id").split(", "))).unionByName(columns.selectExpr("page_id AS layout_id", "pos", *inner.format("col_id").split(", ")))
    layouts = rows.selectExpr("layout_id", "'h' AS direction", "2D AS spacing", "1D AS margin").unionByName(columns.selectExpr("col_id AS layout_id", "'v' AS direction", "3D AS spacing", "2D AS margin")).unionByName(columns.select("page_id").distinct().selectExpr("page_id AS layout_id", "'h' AS direction", "1D AS spacing", "0D AS margin"))
    return lay.nested(layouts, items)


@query("nested_layout", f"{TREE_SQL} SELECT * FROM tree")
def nested_layout(s, d):
    return layout_tree(s, d)


@query("debug_boxes", f"""{TREE_SQL} SELECT layout_id, pos, '<rect style="fill: none; stroke: ' || CASE kind WHEN 'layout' THEN 'black; stroke-width: 2.000000;' WHEN 'file' THEN 'red; stroke-width: 1.000000;' ELSE 'green; stroke-width: 1.000000;' END ||
 printf('" x="%.6f" y="%.6f" width="%.6f" height="%.6f"/>', x, y, width, height) AS element FROM tree""")
def debug_boxes(s, d):
    return lay.debug_boxes(layout_tree(s, d))


@query("layout_extra_groups", f"""{_placed('w', 'h', 0, 2, 1, 'h')}, at AS (SELECT layout_id, pos, {AX} AS x, {AY} AS y FROM cells) SELECT layout_id, pos, printf('<g transform="translate(%.6f,%.6f)"><title>item %d</title></g>', x, y, pos) AS element FROM at WHERE pos % 3 = 0""".replace(", at AS (", ", corners AS (").replace("FROM at WHERE", "FROM corners WHERE"))
def layout_extra_groups(s, d):
    items = lay.aligned(lay.placed(v.layout_items(s, d), "h", 2, 1))
    return lay.extra_groups(items.withColumn("xml", F.expr("CASE WHEN pos % 3 = 0 THEN concat('<title>item ', pos, '</title>') END")))


@query("layout_directions", "SELECT p_partkey AS id, ['h', 'v', 'c', 'rtl', 'btt'][p_partkey % 5 + 1] AS direction, CASE WHEN p_partkey % 5 < 3 THEN 'ok' ELSE 'not implemented' END AS status FROM part")
def layout_directions(s, d):
    return lay.direction_status(v.table(s, d, "part").selectExpr("p_partkey AS id", "element_at(array('h', 'v', 'c', 'rtl', 'btt'), CAST(p_partkey % 5 + 1 AS INT)) AS direction"))


@query("layout_box_size", f"{ITEMS} SELECT layout_id, sum(w) + 2::DOUBLE * (count(*) - 1) + 2 AS width, max(h) + 2::DOUBLE AS height FROM items GROUP BY layout_id")
def layout_box_size(s, d):
    return lay.box_sizes(v.layout_items(s, d), "h", 2, 1)


@query("layout_box_size_composite", f"{ITEMS} SELECT layout_id, arg_max(w, pos) AS width, arg_max(h, pos) AS height FROM items GROUP BY layout_id")
def layout_box_size_composite(s, d):
    return lay.box_sizes(v.layout_items(s, d), "c")


# expected from the files' sizes: a file keeps its size on an axis if it has a flag there, or if it has the cell's size anyway
@query("layout_validation", f"""{_placed('w', 'h', 400, 2, 1, 'h')}, i AS (SELECT *, pos - pos % 2 * CAST(w % 5 = 0 AS INTEGER) AS place FROM cells),
n AS (SELECT layout_id, place, count(*) AS n FROM i GROUP BY ALL),
kept AS (SELECT layout_id, place, (align & 7 > 0 OR w = round(cw, 6)) AND (align & 224 > 0 OR h = round(ch, 6)) AS ok FROM i)
SELECT DISTINCT layout_id, place AS pos, CASE WHEN n > 1 THEN 'duplicate' ELSE 'resized' END AS problem FROM kept JOIN n USING (layout_id, place) WHERE n > 1 OR NOT ok""")
def layout_validation(s, d):
    cells = lay.placed(v.layout_items(s, d), "h", 2, 1, 400)
    return lay.checked(cells.withColumn("pos", F.expr("pos - pos % 2 * CAST(w % 5 = 0 AS INT)")))


SVG = f"WITH {v.SVG_DOCS}"


@query("svg_root_attrs", f"{SVG} SELECT doc_id, regexp_extract(svg, '<svg[^>]* width=\"([^\"]*)\"', 1) AS width, regexp_extract(svg, '<svg[^>]* height=\"([^\"]*)\"', 1) AS height, regexp_extract(svg, '<svg[^>]* viewBox=\"([^\"]*)\"', 1) AS viewbox FROM svg_docs")
def svg_root_attrs(s, d):
    return t.root_attributes(v.svg_docs(s, d))


STRIP = "a"
for _p, _o in ((r"<\?xml.*?\?>", "gi"), (r"<!DOCTYPE[^>]*>", "gi"), (r"<metadata>.*?</metadata>", "gis"), (r"<svg[^>]*>", "gi"), (r"</svg>", "gi")):
    STRIP = f"regexp_replace({STRIP}, '{_p}', '', '{_o}')"
TAG = "regexp_extract(a, '<svg[^>]*>', 0, 'i')"
MERGE = f"CASE WHEN {TAG} <> '' THEN {TAG} || chr(10) || regexp_replace({STRIP}, '^\\s+|\\s+$', '', 'g') || chr(10) || '</svg>' END AS merged, CASE WHEN {TAG} = '' THEN 'no svg tag' END AS error"


@query("svg_merge_regex", f"{SVG}, m AS (SELECT grp, string_agg(svg, chr(10) ORDER BY doc_id) AS a FROM svg_docs GROUP BY grp) SELECT grp, {MERGE} FROM m")
def svg_merge_regex(s, d):
    return t.merged(v.svg_docs(s, d))



NAMESPACE = "CASE WHEN p_partkey % 5 = 0 THEN 'http://www.inkscape.org/namespaces/inkscape' ELSE 'http://www.w3.org/2000/svg' END"


@query("id_prefix", f"""SELECT p_partkey AS node_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE pre END || 'n' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '#' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE pre END || 'n' || p_partkey ELSE 'http://x/' END AS href,
 CASE WHEN p_partkey % 3 = 0 THEN 'fill:url(#' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE pre END || 'g' || p_size || ');stroke:none' ELSE 'fill:none' END AS style FROM (SELECT *, concat('d$', p_size, chr(92), '_') AS pre FROM part)""")
def id_prefix(s, d):
    nodes = v.table(s, d, "part").selectExpr(
        "p_partkey AS node_id", "concat('d$', p_size, char(92), '_') AS prefix", f"{NAMESPACE} AS namespace",
        "map('id', concat('n', p_partkey), 'xlink:href', CASE WHEN p_partkey % 2 = 0 THEN concat('#n', p_partkey) ELSE 'http://x/' END, 'style', CASE WHEN p_partkey % 3 = 0 THEN concat('fill:url(#g', p_size, ');stroke:none') ELSE 'fill:none' END) AS attrs",
    )
    return t.prefixed(nodes).select("node_id", F.col("attrs")["id"].alias("id"), F.col("attrs")["xlink:href"].alias("href"), F.col("attrs")["style"].alias("style"))


VB = "CASE p_partkey % 3 WHEN 0 THEN concat('0, 1,', p_size, ',', p_size * 2) WHEN 1 THEN concat('2 0 ', p_size, '  ', p_size) END"


@query("viewbox_matrix", f"""WITH b AS (SELECT p_partkey AS doc_id, CAST(p_size * 3 AS DOUBLE) AS w, CAST(p_size * 4 AS DOUBLE) AS h, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS y, {VB} AS vb FROM part),
p AS (SELECT *, list_transform(CASE WHEN contains(vb, ',') THEN string_split_regex(vb, '\\s*,\\s*') ELSE string_split_regex(trim(vb), '\\s+') END, lambda c: TRY_CAST(c AS DOUBLE)) AS v FROM b)
SELECT doc_id, CASE WHEN v IS NULL THEN printf('translate(%.4f,%.4f)', x, y) ELSE printf('matrix(%.4f,0,0,%.4f,%.4f,%.4f)', w / v[3], h / v[4], x - v[1], y - v[2]) END AS transform FROM p""")
def viewbox_matrix(s, d):
    return t.placed_transform(v.table(s, d, "part").selectExpr("p_partkey AS doc_id", "CAST(p_size * 3 AS DOUBLE) AS width_px", "CAST(p_size * 4 AS DOUBLE) AS height_px", "CAST(p_partkey % 50 AS DOUBLE) AS x", "CAST(p_partkey % 7 AS DOUBLE) AS y", f"{VB} AS view_box"))


TAGS = "CASE l_linenumber WHEN 1 THEN 'defs' WHEN 2 THEN 'metadata' WHEN 3 THEN 'namedview' ELSE 'g' END"


@query("element_routing", f"SELECT l_orderkey AS doc_id, l_linenumber AS ord, {TAGS} AS tag, CASE {TAGS} WHEN 'defs' THEN 'defs' WHEN 'metadata' THEN 'drop' ELSE 'layer' END AS route FROM lineitem")
def element_routing(s, d):
    return t.routed(v.table(s, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS ord", f"{TAGS} AS tag"))


NS = "concat('ns', p_size) AS prefix, concat('http://x/', p_size, CASE WHEN p_size % 9 = 0 AND p_partkey % 2 = 0 THEN '#' ELSE '' END) AS uri"


@query("namespace_merge", f"SELECT prefix, min(uri) AS uri, count(DISTINCT uri) > 1 AS conflict FROM (SELECT {NS} FROM part) GROUP BY prefix")
def namespace_merge(s, d):
    return t.namespaces(v.table(s, d, "part").selectExpr(*NS.replace(", concat('http", "|concat('http").split("|")))


BODY = "concat('<g id=\"', p_partkey, '\" transform=\"translate(', p_size, ',0)\"/>')"


@query("svg_stack_document", f"""SELECT p_partkey // 10 AS grp, '<?xml version="1.0" encoding="UTF-8" standalone="no"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" version="1.1">' || chr(10) || string_agg({BODY}, chr(10) ORDER BY p_size % 3, p_partkey) || chr(10) || '</svg>' AS document FROM part GROUP BY ALL""")
def svg_stack_document(s, d):
    return t.stacked(v.table(s, d, "part").selectExpr("p_partkey div 10 AS grp", "p_size % 3 AS class", "p_partkey AS ord", f"{BODY} AS body"))


PLAN = f"""WITH {v.FILES}, f AS (SELECT path, min(ord) AS ord FROM files GROUP BY path),
plan AS (SELECT ord, path, '/out/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.svg' AS output FROM f)"""


@query("input_output_plan", f"{PLAN} SELECT * FROM plan")
def input_output_plan(s, d):
    return j.input_output_plan(v.files(s, d), "/out")


@query("output_collisions", f"{PLAN} SELECT output, count(*) AS n_inputs, min(ord) AS first_ord FROM plan GROUP BY output HAVING count(*) > 1")
def output_collisions(s, d):
    return j.collisions(j.input_output_plan(v.files(s, d), "/out"))


@query("bracket_escape", f"WITH {v.FILES} SELECT ord, path, regexp_replace(path, '([\\[\\]])', '[\\1]', 'g') AS escaped FROM files")
def bracket_escape(s, d):
    return j.escaped_brackets(v.files(s, d))


# each fifth page names an argument: all of a folder by a first letter, one name in any folder, a file, a file that is missing
ARG = "CASE page_id % 5 WHEN 0 THEN concat(substr(path, 1, 7), '*.png') WHEN 1 THEN concat('/in/?/f', page_id % 7, '*') WHEN 2 THEN path WHEN 3 THEN concat('/in/', page_id % 5, '/*1].png') ELSE concat('/gone/', page_id % 3) END"
LISTED = f"WITH {v.FILES}, listed AS (SELECT DISTINCT path FROM files), p AS (SELECT ord // 2 AS page_id, ord, path FROM files), args AS (SELECT ord, {ARG} AS arg FROM p WHERE page_id % 3 = 0)"


@query("input_expansion", f"""{LISTED}, m AS (SELECT ord, l.path FROM args JOIN listed l ON (contains(arg, '*') OR contains(arg, '?')) AND len(string_split(arg, '/')) = len(string_split(l.path, '/'))
  AND len(list_filter(range(1, len(string_split(arg, '/')) + 1), lambda i: regexp_full_match(string_split(l.path, '/')[i], replace(replace(replace(replace(replace(string_split(arg, '/')[i], '.', chr(92) || '.'), '[', chr(92) || '['), ']', chr(92) || ']'), '*', '.*'), '?', '.')))) = len(string_split(arg, '/'))
  UNION ALL SELECT ord, arg FROM args WHERE NOT contains(arg, '*') AND NOT contains(arg, '?'))
SELECT min(ord) AS ord, path FROM m GROUP BY path""")
def input_expansion(s, d):
    files = v.files(s, d)
    args = files.selectExpr("ord div 2 AS page_id", "ord", "path").where("page_id % 3 = 0").selectExpr("ord", f"{ARG} AS arg")
    return j.expanded_inputs(args, files)


ARGS = "CASE WHEN event_id % 7 = 0 THEN 'many' WHEN event_id % 11 = 0 THEN '1.5' ELSE CAST(event_id % 400 - 20 AS {text}) END"


@query("argument_range_check", f"SELECT event_id, value, CASE WHEN NOT regexp_full_match(value, '-?[0-9]+') THEN 'must be an integer' WHEN CAST(value AS DOUBLE) BETWEEN 0 AND 256 THEN 'ok' ELSE 'must be between 0 and 256' END AS status FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'many' WHEN event_id % 11 = 0 THEN '1.5' ELSE CAST(event_id % 400 - 20 AS VARCHAR) END AS value FROM events)".replace("WHEN CAST(value AS DOUBLE)", "WHEN TRY_CAST(value AS DOUBLE)"))
def argument_range_check(s, d):
    return j.argument_status(v.table(s, d, "events").selectExpr("event_id", f"{ARGS.format(text='STRING')} AS value"), 0, 256, "int")


RUN_OPTION = "CASE event_id % 6 WHEN 0 THEN 'colors' WHEN 1 THEN 'prescale' WHEN 2 THEN 'quantization' WHEN 3 THEN 'smoothcorners' WHEN 4 THEN 'riemersma' ELSE 'colour' END"
RUN_VALUE = "CASE event_id % 5 WHEN 0 THEN concat(event_id % 300) WHEN 1 THEN concat(event_id % 4, '.5') WHEN 2 THEN 'as' WHEN 3 THEN 'true' ELSE '-1' END"
OPTION_TABLE = "{options}"
OPTION_SQL = f"""WITH o(option, kind, low, high, dflt, choices) AS (VALUES {OPTION_TABLE}), g AS (SELECT event_id // 4 AS run_id, event_id AS ord, {RUN_OPTION} AS option, {RUN_VALUE} AS value FROM events),
l AS (SELECT run_id, option, arg_max(value, ord) AS value FROM g GROUP BY ALL), runs AS (SELECT DISTINCT run_id FROM g),
x AS (SELECT run_id, option, l.value, kind, low, high, dflt, choices FROM (SELECT * FROM runs, o) r FULL JOIN l USING (run_id, option)),
y AS (SELECT *, TRY_CAST(value AS DOUBLE) AS number, regexp_full_match(value, '[+-]?[0-9]+') AS whole FROM x)
SELECT run_id, option, coalesce(value, dflt) AS value, CASE WHEN kind IS NULL THEN 'unknown' WHEN value IS NULL THEN 'default'
  WHEN kind = 'int' THEN CASE WHEN NOT whole THEN 'must be an integer' WHEN number < low OR number > high THEN 'must be ' || CASE WHEN high IS NULL THEN printf('%.3f or greater', low) ELSE printf('between %.3f and %.3f', low, high) END ELSE 'ok' END
  WHEN kind = 'float' THEN CASE WHEN number IS NULL THEN 'must be a number' WHEN number < low OR number > high THEN 'must be ' || CASE WHEN high IS NULL THEN printf('%.3f or greater', low) ELSE printf('between %.3f and %.3f', low, high) END ELSE 'ok' END
  WHEN kind = 'choice' AND value NOT IN ('mc', 'as', 'nq') THEN 'must be one of mc,as,nq' WHEN kind = 'flag' AND value NOT IN ('true', 'false') THEN 'must be true or false' ELSE 'ok' END AS status FROM y"""


def _option_sql(options):
    return OPTION_SQL.replace(OPTION_TABLE, ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in o) + ")" for o in options))


def _run_options(s, d):
    return v.table(s, d, "events").selectExpr("event_id div 4 AS run_id", "event_id AS ord", f"{RUN_OPTION} AS option", f"{RUN_VALUE} AS value")


@query("option_values", _option_sql(j.PARALLEL))
def option_values(s, d):
    return j.option_values(_run_options(s, d), sequential=False)


@query("option_values_sequential", _option_sql(j.SEQUENTIAL))
def option_values_sequential(s, d):
    return j.option_values(_run_options(s, d))


OPTIONS = "event_id, event_id % 3 AS n_inputs, CASE WHEN event_id % 2 = 0 THEN '*.svg' ELSE 'out.svg' END AS output, CASE WHEN event_id % 4 = 0 THEN 'riemersma' ELSE 'none' END AS dither, CASE WHEN event_id % 5 = 0 THEN 'as' ELSE 'mc' END AS quantization, event_id % 6 = 0 AS remap"


@query("option_validation", f"SELECT *, CASE WHEN n_inputs > 1 AND NOT contains(output, '*') THEN 'output needs * for several inputs' WHEN dither = 'riemersma' AND quantization <> 'as' AND NOT remap THEN 'riemersma needs as or remap' END AS error FROM (SELECT {OPTIONS} FROM events)")
def option_validation(s, d):
    v.table(s, d, "events").createOrReplaceTempView("quillgrid_events")
    return j.option_errors(s.sql(f"SELECT {OPTIONS} FROM quillgrid_events"))


@query("color_jobs", f"""WITH {v.RGB}, c AS (SELECT DISTINCT image_id, r, g, b FROM rgb), pal AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r DESC, g DESC, b DESC) - 1 AS INTEGER) AS cindex, format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b) AS color FROM c)
SELECT vec_id AS findex, image_id, cindex, color FROM (SELECT vec_id, {v.IMAGE.format(div="//")} AS image_id FROM embeddings) JOIN pal USING (image_id)""")
def color_jobs(s, d):
    from ..operators import raster

    return j.colour_jobs(v.table(s, d, "embeddings").selectExpr("vec_id AS findex", f"{v.IMAGE.format(div='div')} AS image_id"), raster.palette(v.rgb(s, d)))


@query("layer_completion", f"WITH {v.JOBS} SELECT findex, bool_and(done) AS all_done, count(*) AS n_layers FROM jobs GROUP BY findex")
def layer_completion(s, d):
    return j.layer_completion(v.jobs(s, d))


@query("progress_percent", f"WITH {v.JOBS} SELECT count(*) FILTER (WHERE done) AS n_done, count(*) AS n_total, round(count(*) FILTER (WHERE done) * 100.0::DOUBLE / count(*), 1) AS percent FROM jobs")
def progress_percent(s, d):
    return j.progress(v.jobs(s, d))


@query("positional_zip", "SELECT p_partkey AS n, p_name AS input, c_name AS output FROM part JOIN customer ON p_partkey = c_custkey")
def positional_zip(s, d):
    return j.zipped(v.table(s, d, "part").selectExpr("p_partkey AS n", "p_name AS input"), v.table(s, d, "customer").selectExpr("c_custkey AS n", "c_name AS output"))
