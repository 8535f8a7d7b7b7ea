"""Registered queries on rasters."""

from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..operators import classify, contours
from ..operators import raster as r
from ..operators import resample, trace
from ..sources import files
from . import views as v
from .registry import query

PAL = f"""{v.RGB}, colours AS (SELECT DISTINCT image_id, r, g, b FROM rgb),
pal AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r DESC, g DESC, b DESC) - 1 AS INTEGER) AS cindex, format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b) AS color, r, g, b FROM colours)"""
WIDTH = 64
STRIDE = r.STRIDE
WEB = [(0, 255, 255, 255), (1, 160, 160, 160), (2, 96, 96, 96), (3, 160, 32, 32), (4, 32, 160, 32), (5, 32, 32, 160), (6, 0, 0, 0)]
#: Components by a recursive walk from each pixel to smaller labels.
LABELS = f"""{v.MASK}, nb AS (SELECT a.image_id, a.y * {STRIDE} + a.x AS u, b.y * {STRIDE} + b.x AS v FROM mask a JOIN mask b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
walk AS (SELECT image_id, u AS root, u AS px FROM nb UNION SELECT walk.image_id, walk.root, nb.v FROM walk JOIN nb ON nb.image_id = walk.image_id AND nb.u = walk.px),
labels AS (SELECT image_id, CAST(px // {STRIDE} AS INTEGER) AS y, CAST(px % {STRIDE} AS INTEGER) AS x, CAST(min(root) AS BIGINT) AS label FROM walk GROUP BY image_id, px)"""
STATS = f"""{LABELS}, stats AS (SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy FROM labels GROUP BY ALL)"""
RUNS = """(SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, {o}, run) AS n FROM (SELECT *, {a} - row_number() OVER (PARTITION BY image_id, {o} ORDER BY {a}) AS run FROM {m})) WHERE n >= {k})"""


def runs(mask, axis, k):
    return RUNS.format(m=mask, a=axis, o="y" if axis == "x" else "x", k=k)


def coarse(s, d):
    """A denser mask, for lines."""
    return v.mask(s, d, 100)


COARSE = f"{v.PIXELS}, mask AS (SELECT image_id, y, x FROM pixels WHERE g > 100)"


@query("make_palette", f"WITH {PAL} SELECT image_id, cindex, color FROM pal")
def make_palette(s, d):
    return r.palette(v.rgb(s, d))


@query("palette_without_background", f"WITH {PAL} SELECT image_id, cindex, color FROM pal WHERE color <> '#a0a0a0'")
def palette_without_background(s, d):
    return r.without_background(r.palette(v.rgb(s, d)), "#A0A0A0")


@query("nonpalette_color", f"""WITH {PAL}, used AS (SELECT image_id, color FROM pal UNION SELECT image_id, c FROM (SELECT DISTINCT image_id FROM pal), (VALUES ('#000000'), ('#000001')) t(c)),
n AS (SELECT image_id, unnest(range(0, count(*) + 1)) AS k FROM used GROUP BY image_id),
f AS (SELECT n.image_id, k, format('#{{:06x}}', k) AS color FROM n) SELECT image_id, arg_min(color, k) AS color FROM f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.image_id = f.image_id AND u.color = f.color) GROUP BY image_id""")
def nonpalette_color(s, d):
    return r.unused_colour(r.palette(v.rgb(s, d)), ["#000000", "#000001"])


@query("palette_remap", f"""WITH {v.RGB}, web(i, pr, pg, pb) AS (VALUES {", ".join(map(str, WEB))}), c AS (SELECT DISTINCT r, g, b FROM rgb),
n AS (SELECT r, g, b, pr, pg, pb, row_number() OVER (PARTITION BY r, g, b ORDER BY (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb), i) AS k FROM c, web)
SELECT image_id, y, x, pr AS r, pg AS g, pb AS b FROM rgb JOIN n USING (r, g, b) WHERE k = 1""")
def palette_remap(s, d):
    images = v.rgb(s, d).select("image_id").distinct()
    web = s.createDataFrame(WEB, "cindex int, pr int, pg int, pb int")
    return r.remapped(v.rgb(s, d), images.crossJoin(F.broadcast(web)))


def _isolated(stack):
    return f"WITH {PAL}, i AS (SELECT rgb.*, cindex FROM rgb JOIN pal USING (image_id, r, g, b)) SELECT image_id, y, x, CASE WHEN cindex = 2{' OR cindex > 2' if stack else ''} THEN 0 ELSE 255 END AS v FROM i"


@query("isolate_color", _isolated(False))
def isolate_color(s, d):
    return r.isolated(v.rgb(s, d), r.palette(v.rgb(s, d)), 2)


@query("isolate_color_stack", _isolated(True))
def isolate_color_stack(s, d):
    return r.isolated(v.rgb(s, d), r.palette(v.rgb(s, d)), 2, True)


@query("background_layer", f"WITH {v.PIXELS} SELECT image_id, y, x, CASE WHEN g % 5 > 0 THEN 0 ELSE 255 END AS v FROM pixels")
def background_layer(s, d):
    return r.filled(v.pixels(s, d).selectExpr("image_id", "y", "x", "g % 5 AS alpha"))


@query("image_width", f"WITH {v.PIXELS} SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width_px, round((max(x) + 1) / 90, 6) AS width_in FROM pixels GROUP BY image_id")
def image_width(s, d):
    return r.widths(v.pixels(s, d))


@query("grayscale", f"WITH {v.RGB} SELECT image_id, y, x, CAST((r * 299 + g * 587 + b * 114 + 500) // 1000 AS INTEGER) AS v FROM rgb")
def grayscale(s, d):
    return r.grey(v.rgb(s, d))


@query("fuzz_opaque", f"WITH {v.RGB}, n AS (SELECT *, (r - 255) * (r - 255) + g * g + b * b <= {int(3 * 255 * 255 * 0.6 * 0.6)} AS near FROM rgb) SELECT image_id, y, x, {', '.join(f'CASE WHEN near THEN 255 ELSE {c} END AS {c}' for c in 'rgb')} FROM n")
def fuzz_opaque(s, d):
    return r.replaced_near(v.rgb(s, d), (255, 0, 0), 0.6)


@query("rescale_point", f"WITH {v.PIXELS}, k(i) AS (VALUES (0), (1)) SELECT image_id, y * 2 + a.i AS y, x * 2 + b.i AS x, g FROM pixels, k a, k b")
def rescale_point(s, d):
    return r.point_rescaled(v.pixels(s, d), 2)


@query("quantize_median_cut", f"""WITH {v.PIXELS}, n AS (SELECT image_id, g, count(*) AS n FROM pixels GROUP BY ALL),
a AS (SELECT *, CAST((sum(n) OVER (PARTITION BY image_id ORDER BY g ROWS UNBOUNDED PRECEDING) - n) * 16 // sum(n) OVER (PARTITION BY image_id) AS INTEGER) AS bucket FROM n),
m AS (SELECT image_id, bucket, CAST((2 * sum(g * n) + sum(n)) // (2 * sum(n)) AS INTEGER) AS q FROM a GROUP BY ALL)
SELECT p.image_id, p.y, p.x, q FROM pixels p JOIN a USING (image_id, g) JOIN m USING (image_id, bucket)""")
def quantize_median_cut(s, d):
    return r.median_cut(v.pixels(s, d), 16)


FRAME = "ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING"


@query("adaptive_threshold", f"""WITH {v.PIXELS}, a AS (SELECT *, 255 - g AS v, sum(255 - g) OVER (PARTITION BY image_id, y ORDER BY x {FRAME}) AS s1, count(*) OVER (PARTITION BY image_id, y ORDER BY x {FRAME}) AS n1 FROM pixels),
b AS (SELECT *, sum(s1) OVER (PARTITION BY image_id, x ORDER BY y {FRAME}) AS s, sum(n1) OVER (PARTITION BY image_id, x ORDER BY y {FRAME}) AS n FROM a) SELECT image_id, y, x FROM b WHERE v * n > s + 2 * n""")
def adaptive_threshold(s, d):
    return r.adaptive_mask(v.pixels(s, d))


def _opened(axis, k, dim):
    """Erosion and dilation on the dense grid, by window minima and maxima."""
    o, a, b = ("y" if axis == "x" else "x"), k // 2, k - 1 - k // 2
    return f"""WITH {COARSE}, dense AS (SELECT p.image_id, p.y, p.x, CAST(m.x IS NOT NULL AS INTEGER) AS v FROM pixels p LEFT JOIN mask m USING (image_id, y, x)),
e AS (SELECT *, CASE WHEN count(*) OVER w = {k} THEN min(v) OVER w ELSE 0 END AS v2 FROM dense WINDOW w AS (PARTITION BY image_id, {o} ORDER BY {axis} ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)),
f AS (SELECT *, max(v2) OVER (PARTITION BY image_id, {o} ORDER BY {axis} ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) AS v3 FROM e) SELECT image_id, y, x FROM f WHERE v3 = 1"""


@query("extract_lines_h", _opened("x", 3, 90))
def extract_lines_h(s, d):
    return r.lines(coarse(s, d), "x", 90)


@query("extract_lines_v", _opened("y", 4, 120))
def extract_lines_v(s, d):
    return r.lines(coarse(s, d), "y", 120)


NEAR = ", ".join(f"coalesce({f}(v) OVER (PARTITION BY image_id, {o} ORDER BY {a}), v)" for o, a in (("y", "x"), ("x", "y")) for f in ("lag", "lead"))


@query("bilevel_erode", f"WITH {v.PIXELS}, bw AS (SELECT *, CASE WHEN g > 110 THEN 255 ELSE 0 END AS v FROM pixels) SELECT image_id, y, x, least(v, {NEAR}) AS v FROM bw")
def bilevel_erode(s, d):
    return r.eroded(v.pixels(s, d), 110)


@query("coverage_fraction", f"WITH {v.MASK} SELECT image_id, round(count(DISTINCT x) / {WIDTH}, 6) AS fraction FROM mask GROUP BY image_id")
def coverage_fraction(s, d):
    return r.coverage(v.mask(s, d), "x", WIDTH)


@query("mask_intersection", f"WITH {COARSE} SELECT * FROM {runs('mask', 'x', 3)} INTERSECT SELECT * FROM {runs('mask', 'y', 3)}")
def mask_intersection(s, d):
    return r.both_masks(r.lines(coarse(s, d), "x", 90), r.lines(coarse(s, d), "y", 90))


def labels(s, d):
    return r.labelled(v.mask(s, d))


@query("connected_components", f"WITH RECURSIVE {LABELS} SELECT * FROM labels")
def connected_components(s, d):
    return labels(s, d)


@query("component_stats", f"WITH RECURSIVE {STATS} SELECT * FROM stats")
def component_stats(s, d):
    return r.component_stats(labels(s, d))


@query("long_components", f"WITH RECURSIVE {STATS} SELECT image_id, labels.y, labels.x FROM labels JOIN stats USING (image_id, label) WHERE stats.w >= 4")
def long_components(s, d):
    return r.long_components(labels(s, d), "x", 4)


@query("despeckle", f"WITH RECURSIVE {STATS} SELECT image_id, labels.y, labels.x FROM labels JOIN stats USING (image_id, label) WHERE area > 2")
def despeckle(s, d):
    return r.despeckled(labels(s, d), 2)


def _steps(name, axis, source, apart):
    """Clusters on an axis: from each centre to the least one that is further
    than the separation away, starting at the least of the image."""
    return f"""{name}c AS (SELECT DISTINCT image_id, sum({axis})::DOUBLE / count(*) AS v, {apart} AS apart FROM {source} GROUP BY image_id, label, apart),
{name}n AS (SELECT a.image_id, a.v, min(b.v) AS following FROM {name}c a LEFT JOIN {name}c b ON a.image_id = b.image_id AND b.v - a.v > a.apart GROUP BY a.image_id, a.v),
{name} AS (SELECT image_id, min(v) AS v, 1 AS n FROM {name}c GROUP BY image_id UNION ALL SELECT {name}.image_id, {name}n.following, n + 1 FROM {name} JOIN {name}n ON {name}.image_id = {name}n.image_id AND {name}.v = {name}n.v WHERE following IS NOT NULL)"""


@query("grid_dimensions", f"""WITH RECURSIVE {LABELS}, lab AS (SELECT *, 8 AS apart FROM labels), {_steps('gy', 'y', 'lab', 'apart')}, {_steps('gx', 'x', 'lab', 'apart')}
SELECT image_id, CAST((SELECT max(n) FROM gy WHERE gy.image_id = i.image_id) AS INTEGER) AS rows, CAST((SELECT max(n) FROM gx WHERE gx.image_id = i.image_id) AS INTEGER) AS cols FROM (SELECT DISTINCT image_id FROM lab) i""")
def grid_dimensions(s, d):
    return r.grid_dimensions(r.component_stats(labels(s, d)), 8)


def _pieces(name, mask):
    """Pixels of a mask with the component they belong to, by a walk."""
    return f"""{name}n AS (SELECT a.image_id, a.y * {STRIDE} + a.x AS u, b.y * {STRIDE} + b.x AS v FROM {mask} a JOIN {mask} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
{name}w AS (SELECT image_id, u AS root, u AS px FROM {name}n UNION SELECT {name}w.image_id, {name}w.root, {name}n.v FROM {name}w JOIN {name}n ON {name}n.image_id = {name}w.image_id AND {name}n.u = {name}w.px),
{name} AS (SELECT image_id, px // {STRIDE} AS y, px % {STRIDE} AS x, min(root) AS label FROM {name}w GROUP BY image_id, px)"""


def _long(name, axis, side):
    """Erosion and dilation on the dense grid with an image's own line, then the
    components that reach 0.4 of its side; sides are those of the image."""
    o = "y" if axis == "x" else "x"
    # a pixel stays if some k pixels in a row about it are all set
    return f"""{name}k AS (SELECT *, greatest(1, {side} // 30) AS k FROM fg JOIN size USING (image_id)),
{name}s AS (SELECT a.image_id, a.{o} AS o, a.{axis} AS s, any_value(a.k) AS k FROM {name}k a JOIN {name}k b ON a.image_id = b.image_id AND a.{o} = b.{o} AND b.{axis} BETWEEN a.{axis} AND a.{axis} + a.k - 1 GROUP BY ALL HAVING count(*) = any_value(a.k)),
{name}m AS (SELECT DISTINCT image_id, {'o AS y, s + i AS x' if axis == 'x' else 's + i AS y, o AS x'} FROM {name}s, LATERAL (SELECT unnest(range(0, k)) AS i)),
{_pieces(name + 'c', name + 'm')},
{name} AS (SELECT c.image_id, c.y, c.x FROM {name}c c JOIN size USING (image_id) WHERE (c.image_id, c.label) IN (
  SELECT (l.image_id, l.label) FROM {name}c l JOIN size USING (image_id) GROUP BY l.image_id, l.label HAVING max(l.{axis}) - min(l.{axis}) + 1 >= greatest(4, CAST(floor(0.4::DOUBLE * any_value({side})) AS BIGINT))))"""


@query("classify_image", f"""WITH RECURSIVE {v.RULED}, size AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM ruled GROUP BY ALL),
th AS (SELECT p.image_id, p.y, p.x, 255 - any_value(p.g) AS own, avg(255 - q.g) AS around FROM ruled p JOIN ruled q ON p.image_id = q.image_id AND q.x BETWEEN p.x - 7 AND p.x + 7 AND q.y BETWEEN p.y - 7 AND p.y + 7 GROUP BY ALL),
fg AS (SELECT image_id, y, x FROM th WHERE own > around + 2),
{_long('hl', 'x', 'width')}, {_long('vl', 'y', 'height')},
inter AS (SELECT image_id, y, x FROM hl INTERSECT SELECT image_id, y, x FROM vl), {_pieces('cross_', 'inter')},
cr AS (SELECT *, (SELECT greatest(8, least(width, height) // 100) FROM size WHERE size.image_id = cross_.image_id) AS apart FROM cross_),
{_steps('gy', 'y', 'cr', 'apart')}, {_steps('gx', 'x', 'cr', 'apart')},
n AS (SELECT image_id, count(DISTINCT label) AS n FROM cross_ GROUP BY image_id), gr AS (SELECT image_id, max(n) AS n FROM gy GROUP BY image_id), gc AS (SELECT image_id, max(n) AS n FROM gx GROUP BY image_id),
hc AS (SELECT image_id, count(DISTINCT x) AS n FROM hl GROUP BY image_id), vc AS (SELECT image_id, count(DISTINCT y) AS n FROM vl GROUP BY image_id),
f AS (SELECT size.image_id, coalesce(n.n, 0) AS crossings, CAST(coalesce(gr.n, 0) AS INTEGER) AS rows, CAST(coalesce(gc.n, 0) AS INTEGER) AS cols, round(coalesce(hc.n, 0) / width, 6) AS h_coverage, round(coalesce(vc.n, 0) / height, 6) AS v_coverage
  FROM size LEFT JOIN n USING (image_id) LEFT JOIN gr USING (image_id) LEFT JOIN gc USING (image_id) LEFT JOIN hc USING (image_id) LEFT JOIN vc USING (image_id))
SELECT *, NOT (crossings >= 5 AND h_coverage >= 0.25 AND v_coverage >= 0.25) AS is_table FROM f""")
def classify_image(s, d):
    return classify.classified(v.ruled(s, d))


def _halved(rounds):
    """Median cut round by round on distinct colours."""
    out = "m0 AS (SELECT image_id, r, g, b, count(*) AS n, 0 AS box FROM rgb GROUP BY ALL)"
    for i in range(rounds):
        out += f""",
d{i} AS (SELECT image_id, box, max(r) - min(r) AS dr, max(g) - min(g) AS dg, max(b) - min(b) AS db, sum(n) AS total FROM m{i} GROUP BY ALL),
k{i} AS (SELECT m{i}.*, total, CASE WHEN dr >= dg AND dr >= db THEN r WHEN dg >= db THEN g ELSE b END AS k FROM m{i} JOIN d{i} USING (image_id, box)),
b{i} AS (SELECT a.image_id, a.r, a.g, a.b, coalesce(sum(o.n), 0) AS before FROM k{i} a LEFT JOIN k{i} o ON a.image_id = o.image_id AND a.box = o.box AND (o.k, o.r, o.g, o.b) < (a.k, a.r, a.g, a.b) GROUP BY ALL),
m{i + 1} AS (SELECT image_id, r, g, b, n, 2 * box + CAST(2 * before >= total AS INTEGER) AS box FROM k{i} JOIN b{i} USING (image_id, r, g, b))"""
    return out


@query("quantize_rgb", f"""WITH {v.RGB}, {_halved(3)},
q AS (SELECT image_id, box, {", ".join(f"CAST((2 * sum({c} * n) + sum(n)) // (2 * sum(n)) AS INTEGER) AS q{c}" for c in "rgb")} FROM m3 GROUP BY ALL)
SELECT image_id, y, x, qr AS r, qg AS g, qb AS b FROM rgb JOIN m3 USING (image_id, r, g, b) JOIN q USING (image_id, box)""")
def quantize_rgb(s, d):
    return r.median_cut_rgb(v.rgb(s, d), 3)


def _lanczos(factor):
    """Both passes on the dense grid; a kernel of three lobes, stretched when the image shrinks."""
    stretch = min(1.0, factor)

    def table(name, side):
        z = f"((at - centre) * {stretch}::DOUBLE * pi())"
        return f"""{name}o AS (SELECT n, o, (o + 0.5::DOUBLE) / {factor}::DOUBLE - 0.5::DOUBLE AS centre FROM (SELECT n, unnest(range(0, greatest(1, CAST(floor(n * {factor}::DOUBLE + 0.5) AS BIGINT)))) AS o FROM (SELECT DISTINCT {side} AS n FROM size))),
{name}e AS (SELECT n, o, centre, unnest(range(CAST(ceil(centre - {3 / stretch!r}::DOUBLE) AS BIGINT), CAST(floor(centre + {3 / stretch!r}::DOUBLE) AS BIGINT) + 1)) AS at FROM {name}o),
{name} AS (SELECT n, o, greatest(0, least(n - 1, at)) AS s, CAST(sum(CAST(floor(CASE WHEN abs({z}) < 1e-9 THEN 1 ELSE 3 * sin({z}) * sin({z} / 3) / ({z} * {z}) END * 65536 + 0.5) AS BIGINT)) AS BIGINT) AS weight FROM {name}e GROUP BY ALL)"""

    return f"""WITH {v.PIXELS}, size AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM pixels GROUP BY image_id),
{table("wx", "width").replace(" at ", " k ").replace("(at ", "(k ").replace(" at)", " k)")}, {table("wy", "height").replace(" at ", " k ").replace("(at ", "(k ").replace(" at)", " k)")},
hp AS (SELECT image_id, height, y, o AS x, CAST(floor((sum(weight * g * 256) / sum(weight)::DOUBLE) + 0.5) AS BIGINT) AS g FROM pixels JOIN size USING (image_id) JOIN wx ON wx.n = width AND wx.s = x GROUP BY image_id, height, y, o)
SELECT image_id, CAST(o AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(greatest(0, least(255, floor(sum(weight * g) / (sum(weight) * 256::DOUBLE) + 0.5))) AS INTEGER) AS g FROM hp JOIN wy ON wy.n = height AND wy.s = y GROUP BY image_id, o, x"""


@query("rescale_lanczos", _lanczos(1.5))
def rescale_lanczos(s, d):
    return resample.lanczos_rescaled(v.pixels(s, d), 1.5)


@query("rescale_lanczos_smaller", _lanczos(0.4))
def rescale_lanczos_smaller(s, d):
    return resample.lanczos_rescaled(v.pixels(s, d), 0.4)


def _octree(most):
    """Leaves given up on each level, in the order of pixels and colour, as long as more than ``most`` are left."""
    levels = ""
    for k in range(7, -1, -1):
        levels += f""",
i{k} AS (SELECT image_id, r >> {7 - k} AS r, g >> {7 - k} AS g, b >> {7 - k} AS b, sum(n) AS n FROM c GROUP BY ALL),
o{k} AS (SELECT image_id, r >> 1 AS r, g >> 1 AS g, b >> 1 AS b, count(*) AS children, sum(n) AS n FROM i{k} GROUP BY ALL),
g{k} AS (SELECT a.image_id, a.r, a.g, a.b FROM o{k} a LEFT JOIN o{k} z ON z.image_id = a.image_id AND (z.n, z.r, z.g, z.b) < (a.n, a.r, a.g, a.b) GROUP BY a.image_id, a.r, a.g, a.b
  HAVING (SELECT count(*) FROM i{k} WHERE i{k}.image_id = a.image_id) - coalesce(sum(z.children - 1), 0) > {most})"""
    depth = " ".join(f"WHEN (image_id, r >> {8 - k}, g >> {8 - k}, b >> {8 - k}) IN (SELECT (image_id, r, g, b) FROM g{k}) THEN {k}" for k in range(8))
    return f"""WITH {v.RGB}, c AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL){levels},
d AS (SELECT *, CASE {depth} ELSE 8 END AS depth FROM c),
l AS (SELECT *, r >> (8 - depth) AS lr, g >> (8 - depth) AS lg, b >> (8 - depth) AS lb FROM d),
m AS (SELECT image_id, depth, lr, lg, lb, {", ".join(f"CAST((2 * sum({c} * n) + sum(n)) // (2 * sum(n)) AS INTEGER) AS q{c}" for c in "rgb")} FROM l GROUP BY ALL)
SELECT rgb.image_id, y, x, qr AS r, qg AS g, qb AS b FROM rgb JOIN l USING (image_id, r, g, b) JOIN m USING (image_id, depth, lr, lg, lb)"""


@query("quantize_octree", _octree(12))
def quantize_octree(s, d):
    return resample.octree(v.rgb(s, d), 12)


def web_palettes(s, d):
    return v.rgb(s, d).select("image_id").distinct().crossJoin(F.broadcast(s.createDataFrame(WEB, "cindex int, r int, g int, b int")))


@query("dither_floyd_steinberg", None)
def dither_floyd_steinberg(s, d):
    return resample.floyd_steinberg(v.rgb(s, d), web_palettes(s, d))


@query("dither_riemersma", None)
def dither_riemersma(s, d):
    return resample.riemersma(v.rgb(s, d), web_palettes(s, d))


#: Sides of pixels that face the background one by one, then walked from each ring's first until it comes round.
WALKED = """side AS (SELECT m.image_id, m.y, m.x, s.dir, m.y + s.fy AS y0, m.x + s.fx AS x0, m.y + s.ty AS y1, m.x + s.tx AS x1
  FROM mask m, (VALUES (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0)) s(dir, dy, dx, fy, fx, ty, tx)
  WHERE NOT EXISTS (SELECT 1 FROM mask n WHERE n.image_id = m.image_id AND n.y = m.y + dy AND n.x = m.x + dx)),
go AS MATERIALIZED (SELECT a.image_id, a.y0, a.x0, a.dir, a.y, a.x, arg_min([b.y0, b.x0, b.dir], CASE (b.dir - a.dir + 4) % 4 WHEN 3 THEN 0 ELSE 1 END) AS nxt FROM side a JOIN side b ON a.image_id = b.image_id AND a.y1 = b.y0 AND a.x1 = b.x0 GROUP BY ALL),
hop AS (SELECT image_id, [y0, x0, dir] AS e, nxt, y, x FROM go),
walk2 AS (SELECT image_id, e AS root, e, 0 AS step FROM hop UNION ALL SELECT w.image_id, root, hop.nxt, step + 1 FROM walk2 w JOIN hop ON hop.image_id = w.image_id AND hop.e = w.e WHERE hop.nxt > root),
-- a ring's first side is reached again from all of its sides, and none of them is less
ends AS (SELECT DISTINCT w.image_id, root FROM walk2 w JOIN hop ON hop.image_id = w.image_id AND hop.e = w.e WHERE hop.nxt = root),
cor AS (SELECT w.image_id, root, w.e, step, lag(w.e[3]) OVER (PARTITION BY w.image_id, root ORDER BY step) AS was FROM walk2 w JOIN ends USING (image_id, root)),
outl AS (SELECT image_id, root, count(*) AS n_corners, string_agg(e[2] || ',' || e[1], ' L ' ORDER BY step) AS points FROM cor WHERE was IS NULL OR was <> e[3] GROUP BY ALL),
-- the area by Green: down along the right of a pixel, up along its left
ar AS (SELECT image_id, root, CAST(sum(CASE e[3] WHEN 1 THEN e[2] WHEN 3 THEN -e[2] ELSE 0 END) AS DOUBLE) AS area FROM cor GROUP BY ALL)"""
RINGS = f"""{LABELS}, {WALKED}
SELECT o.image_id, l.label, o.root[1] * {4 * (STRIDE // 8)} + o.root[2] * 4 + o.root[3] AS ring, n_corners, area, 'M ' || points || ' Z' AS d
FROM outl o JOIN ar USING (image_id, root) JOIN hop ON hop.image_id = o.image_id AND hop.e = o.root JOIN labels l ON l.image_id = o.image_id AND l.y = hop.y AND l.x = hop.x"""


@query("trace_contours", f"WITH RECURSIVE {RINGS}")
def trace_contours(s, d):
    corners = contours.written(contours.rings(v.mask(s, d)), "corners")
    return contours.outlines(corners).join(contours.with_labels(corners, labels(s, d)), ["image_id", "ring"]).select("image_id", "label", "ring", "n_corners", "area", "d")


@query("trace_polygons", None)
def trace_polygons(s, d):
    """Outlines of despeckled masks within 1.5 pixels, as paths."""
    mask = r.despeckled(r.labelled(coarse(s, d)), 2)
    return contours.outlines(contours.simplified(contours.rings(mask), 1.5))


@query("image_scan", f"WITH {v.RGB} SELECT image_id, y, x, r, g, b FROM rgb")
def image_scan(s, d):
    """The colour images as files in the shared folder, read again."""
    at = shared_path(s, "images")
    files.write_images(v.rgb(s, d), at).count()
    return files.read_images(s, at).withColumn("image_id", F.regexp_extract("image_id", r"(\d+)\.png$", 1).cast("long"))


#: Every colour of an image as a mask; an image's number and its colour's make that of the mask.
TRACED = f"""{PAL}, mask AS (SELECT image_id * 100 + cindex AS image_id, y, x FROM rgb JOIN pal USING (image_id, r, g, b)), {WALKED},
layer AS (SELECT image_id // 100 AS img, image_id % 100 AS cindex, string_agg('M ' || points || ' Z', ' ' ORDER BY root) AS d FROM outl GROUP BY ALL),
docs AS (SELECT img, string_agg('<g id="layer' || l.cindex || '"><path fill="' || color || '" fill-rule="evenodd" d="' || d || '"/></g>' || chr(10), '' ORDER BY l.cindex) AS body FROM layer l JOIN pal ON pal.image_id = img AND pal.cindex = l.cindex GROUP BY img),
size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM rgb GROUP BY image_id)
SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="' || w || '" height="' || h || '" viewBox="0 0 ' || w || ' ' || h || '">' || chr(10) || body || '</svg>' AS document FROM size JOIN docs ON img = image_id"""


@query("trace_image", f"WITH RECURSIVE {TRACED}")
def trace_image(s, d):
    """All colours, every pixel's outline: the document is the image."""
    return trace.traced(v.rgb(s, d), 0, 0, 0.0)


@query("trace_image_simplified", None)
def trace_image_simplified(s, d):
    """The whole conversion with its usual steps: eight colours, no speckles, stacked and simplified layers."""
    return trace.traced(v.rgb(s, d), 8, 2, 1.5, True)


@query("quantize_neural", None)
def quantize_neural(s, d):
    return resample.neural(v.rgb(s, d), 12)
