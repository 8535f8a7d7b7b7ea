"""Registered queries on paths and boxes."""

from pyspark.sql import functions as F

from ..operators import geometry as g
from . import views as v
from .ocr_queries import FILTERED, GAPS, GROUPS, KEPT, W, groups_filtered
from .registry import query

PART = "TRY_CAST(regexp_extract({a}, '{k}\\(\\s*([\\d.-]+)\\s*,?\\s*([\\d.-]+)?\\s*\\)', {i}) AS DOUBLE)"


def part(a, k, i):
    return PART.format(a=a, k=k, i=i)


TX, TY, SX, SY = (f"coalesce({part('a', 'translate', 1)}, 0)", f"coalesce({part('a', 'translate', 2)}, 0)", f"coalesce({part('a', 'scale', 1)}, 1)", f"coalesce({part('a', 'scale', 2)}, {part('a', 'scale', 1)}, 1)")
CUM = f"""{v.PATHS},
cum AS (SELECT *, list_reduce(transforms, lambda c, a: c, NULL) AS unused FROM paths WHERE FALSE),
steps AS (SELECT path_id, unnest(transforms) AS a, unnest(range(1, len(transforms) + 1)) AS k FROM paths),
st AS (SELECT path_id, k, {TX} AS tx, {TY} AS ty, {SX} AS sx, {SY} AS sy FROM steps),
sc AS (SELECT *, coalesce(product(sx) OVER w, 1) AS bx, coalesce(product(sy) OVER w, 1) AS by_ FROM st WINDOW w AS (PARTITION BY path_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT path_id, product(sx) AS sx, product(sy) AS sy, sum(tx * bx) AS tx, sum(ty * by_) AS ty FROM sc GROUP BY path_id),
full_m AS (SELECT paths.*, coalesce(m.sx, 1) AS sx, coalesce(m.sy, 1) AS sy, coalesce(m.tx, 0) AS tx, coalesce(m.ty, 0) AS ty FROM paths LEFT JOIN m USING (path_id)),
pts0 AS (SELECT *, TRY_CAST(regexp_extract(d, '^[Mm]\\s*([\\d.-]+)[\\s,]+([\\d.-]+)', 1) AS DOUBLE) AS x0, TRY_CAST(regexp_extract(d, '^[Mm]\\s*([\\d.-]+)[\\s,]+([\\d.-]+)', 2) AS DOUBLE) AS y0 FROM full_m),
pts AS (SELECT page, path_id, path_ord, x0 * sx + tx AS x, y0 * sy + ty AS y FROM pts0 WHERE x0 IS NOT NULL AND y0 IS NOT NULL)""".replace("cum AS (SELECT *, list_reduce(transforms, lambda c, a: c, NULL) AS unused FROM paths WHERE FALSE),\n", "")
MATCH = f"""{CUM}, {v.BOXES},
hit AS (SELECT p.page, path_id, path_ord, word_id, "left", top, text, row_number() OVER (PARTITION BY p.page, path_id ORDER BY word_ord, word_id) AS k
  FROM pts p JOIN boxes b ON p.page = b.page AND x BETWEEN "left" AND "left" + width AND y BETWEEN top AND top + height),
mt AS (SELECT page, path_id, path_ord, word_id, "left", top, text FROM hit WHERE k = 1)"""


def matches(s, d):
    return g.match_paths(g.start_points(v.paths(s, d)), v.boxes(s, d))


@query("parse_transform", f"WITH {v.PATHS}, steps AS (SELECT path_id, unnest(transforms) AS a, unnest(range(0, len(transforms))) AS depth FROM paths) SELECT path_id, CAST(depth AS INTEGER) AS depth, a AS attribute, {TX} AS tx, {TY} AS ty, {SX} AS sx, {SY} AS sy FROM steps")
def parse_transform(s, d):
    return g.parsed_transforms(v.paths(s, d))


@query("cumulative_transform", f"WITH {CUM} SELECT path_id, sx, sy, tx, ty FROM full_m")
def cumulative_transform(s, d):
    return g.cumulative_transforms(v.paths(s, d)).select("path_id", "m.*")


#: Elements of drawings: trees, and one long chain in each.
NODE = "event_id {div} 1000 AS page, event_id AS node_id, CASE WHEN event_id % 1000 = 0 THEN NULL WHEN event_id % 1000 > 900 THEN event_id - 1 ELSE event_id {div} 1000 * 1000 + event_id % 1000 {div} 3 END AS parent_id, CASE WHEN event_id % 1000 = 0 THEN 'svg' ELSE 'g' END AS tag, CASE event_id % 7 WHEN 0 THEN 'translate(5)' WHEN 1 THEN 'scale(0.5) translate(2,-1)' WHEN 2 THEN 'scale(2,1)' WHEN 3 THEN 'translate(-1.5 2)' WHEN 4 THEN 'rotate(9)' END AS transform"


@query("tree_transform", f"""WITH RECURSIVE nodes AS (SELECT {NODE.format(div="//")} FROM events),
st AS (SELECT page, node_id, parent_id, tag, {TX} AS tx, {TY} AS ty, {SX} AS sx, {SY} AS sy FROM (SELECT *, coalesce(transform, '') AS a FROM nodes)),
down AS (SELECT page, node_id, sx, sy, tx, ty FROM st WHERE tag <> 'svg' AND (parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM st WHERE tag <> 'svg'))
  UNION ALL SELECT st.page, st.node_id, down.sx * st.sx, down.sy * st.sy, down.tx + st.tx * down.sx, down.ty + st.ty * down.sy FROM down JOIN st ON st.parent_id = down.node_id AND st.page = down.page)
SELECT * FROM down""")
def tree_transform(s, d):
    return g.tree_transforms(v.table(s, d, "events").selectExpr(*NODE.format(div="div").replace(", CASE", "|CASE").replace(", event_id AS", "|event_id AS").split("|")))


@query("path_start_point", f"WITH {CUM} SELECT * FROM pts")
def path_start_point(s, d):
    return g.start_points(v.paths(s, d))


@query("match_paths_to_words", f"WITH {MATCH} SELECT * FROM mt")
def match_paths_to_words(s, d):
    return matches(s, d)


@query("paths_per_word", f'WITH {MATCH} SELECT page, "left", top, count(*) AS n_paths, arg_min(text, path_ord) AS text FROM mt GROUP BY page, "left", top')
def paths_per_word(s, d):
    return g.paths_per_word(matches(s, d))


@query("remove_matched_paths", f"WITH {MATCH} SELECT path_id % 1000 AS path_id, page, path_ord, d FROM paths WHERE path_id NOT IN (SELECT path_id FROM mt)")
def remove_matched_paths(s, d):
    """Path ids are those of a page here: each page has the same ones."""
    paths = v.paths(s, d).withColumn("path_id", F.col("path_id") % 1000)
    return g.without_matched(paths, g.match_paths(g.start_points(paths), v.boxes(s, d))).select("path_id", "page", "path_ord", "d")


GROUPS_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS ord, max(l_partkey) AS group_id FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query("color_three_groups", f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) = 3 THEN ['red', 'green', 'gray'][ord + 1] END AS fill FROM ({GROUPS_SQL})")
def color_three_groups(s, d):
    rows = v.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg({"l_partkey": "max"})
    return g.coloured_groups(rows.selectExpr("l_orderkey AS doc_id", "CAST(l_linenumber - 1 AS INT) AS ord", "`max(l_partkey)` AS group_id"))


@query("text_layer", f"""{W}, {KEPT}, {GAPS}, {GROUPS}, {FILTERED} SELECT src, ord, printf('%.2f', CAST("left" AS DOUBLE)) AS x, printf('%.2f', CAST(top + height AS DOUBLE)) AS y,
 CAST(CAST(floor(height * 1.1::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 'px' AS font_size, '#666666' AS fill, 'Arial, sans-serif' AS font_family, text FROM flt""")
def text_layer(s, d):
    return g.text_layer(groups_filtered(s, d))
