"""URL filters: host rules, and a path-template tree for what they leave open.

Method of the tree, in DataFrame functions throughout: a path's segments are
first generalised by form (runs of digits become ``#``; long segments become
``*``), then by the tree: below one (host, template so far), where a node has at
least ``BRANCHES`` children, a child that holds less than 1/BRANCHES of the
node's URLs is variable and becomes ``*``.  The tree is made branching by branching:
what all forms of a node begin with is taken at once, then the segment in which
they differ is judged, and what stands below all variable values is pooled before
the next one is.  So rounds follow how deep paths branch, not how long they are; a
node of fewer than ``BRANCHES`` forms is left out, as nothing below it can branch.  Sibling templates whose share of bad
labels is statistically the same as that of all siblings together (``Z``
standard errors) are merged.  A template is rejected if its purity, the share of
bad labels smoothed by ``PRIOR`` labels at the corpus's rate, reaches ``REJECT``.

Rules match a host and its subdomains by reversed-host suffix, and the start of
the path; the longest wins and overrules the tree.

Hot hosts: URLs are summed to (host, form of the path) before anything is
shuffled by host, so all later steps see a row per template.  Verdicts go back to
the URLs by broadcast, or, beyond ``MAX_BROADCAST`` forms, by a join in which a
form of very many URLs is dealt out in parts.

Defined cases: null URLs and those without ``://`` have empty host and path and
are judged like any template; URLs without labels count for the tree's shape
only; without labels nothing is rejected; repeated rows are judged alike; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_join, written

BRANCHES, LONG, Z, PRIOR, REJECT = 8, 24, 2.0, 10.0, 0.5
#: Templates (rows of a few dozen bytes) that may be broadcast to the URLs.
MAX_BROADCAST = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (verdict, host, path prefix without the leading slash).
Rule = tuple[str, str, str]


def split_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path and form (the path with variable forms generalised)."""
    after = F.when(F.instr(url_col, "://") > 0, F.expr(f"substr({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    rest = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    long_ = F.transform(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: F.when(F.length(s) >= LONG, F.lit("*")).otherwise(s))
    return urls.withColumn("host", host).withColumn("path", path).withColumn("form", F.array_join(long_, "/"))


def rule_of(rules: list[Rule]):
    """The longest matching rule as text (``host/path``) and its verdict."""
    out, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # later ones are asked first: the longest, by the whole rule's length, wins
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        match = ((F.col("host") == host) | F.col("host").endswith("." + host)) & (F.col("path").startswith("/" + path))
        out, verdict = F.when(match, F.lit(f"{host}/{path}")).otherwise(out), F.when(match, F.lit(kind)).otherwise(verdict)
    return out, verdict


def templates(forms: DataFrame) -> DataFrame:
    """(host, form, template) from (host, form, n): forms generalised by the tree."""
    # a form's template so far, what is left of its segments, and whether its node can still branch
    now = forms.select("host", "form", "n", F.array().cast("array<string>").alias("above"), F.split("form", "/").alias("left"))
    own, done = ["host", "above"], []
    while True:
        # what all forms of a node begin with is no branching: those of the least and of the greatest have it in common
        node = now.groupBy(*own).agg(F.count("*").alias("forms"), F.min("left").alias("lo"), F.max("left").alias("hi"))
        differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        node = node.select(*own, "forms", F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("common"))
        after = lambda n: F.slice("left", n + 1, F.greatest(F.size("left") - n, F.lit(0)))
        at = now.join(node, own).select("host", "form", "n", "forms", F.concat("above", F.slice("left", F.lit(1), F.col("common"))).alias("above"), after(F.col("common")).alias("left"))
        at = written(at, "level")
        child = at.groupBy(*own, F.get("left", F.lit(0)).alias("seg")).agg(F.sum("n").alias("seg_n"))
        whole = child.groupBy(*own).agg(F.count("*").alias("kids"), F.sum("seg_n").alias("total"))
        wild = child.join(whole, own).where((F.col("kids") >= BRANCHES) & (F.col("seg_n") * BRANCHES < F.col("total"))).select(*own, "seg", F.lit("*").alias("wild"))
        named = at.withColumn("seg", F.get("left", F.lit(0))).join(wild, [*own, "seg"], "left")
        above = F.concat("above", F.array_compact(F.array(F.coalesce("wild", "seg"))))
        goes_on = (F.size("left") > 1) & (F.col("forms") >= BRANCHES)
        now = written(named.select("host", "form", "n", above.alias("above"), after(F.lit(1)).alias("left"), goes_on.alias("goes_on")), "level")
        dropped(at)
        done.append(now.where("NOT goes_on").select("host", "form", F.array_join(F.concat("above", "left"), "/").alias("template")))
        now = now.where("goes_on").drop("goes_on")
        if now.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def judged_templates(urls: DataFrame) -> DataFrame:
    """(host, form, n, template, purity) from (host, form, bad): bad is 1, 0 or null."""
    forms = urls.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    named = forms.join(templates(forms), ["host", "form"]).withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    branch = named.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    level = branch.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    rate = (F.col("all_bad") + 1.0) / (F.col("all_labelled") + 2.0)
    off = F.abs(F.col("bad") - F.col("labelled") * F.col("rate"))
    alike = branch.join(level, ["host", "parent"]).withColumn("rate", rate).withColumn("alike", off <= Z * F.sqrt(F.col("labelled") * F.col("rate") * (1 - F.col("rate"))))
    group = alike.withColumn("merged", F.when(F.col("alike"), F.concat("parent", F.lit("/~"))).otherwise(F.col("template")))
    sums = group.groupBy("host", "merged", "alike").agg(F.sum("labelled").alias("g_labelled"), F.sum("bad").alias("g_bad"))
    whole = forms.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("corpus_rate"))
    purity = (F.col("g_bad") + PRIOR * F.col("corpus_rate")) / (F.col("g_labelled") + PRIOR)
    by_template = group.select("host", "template", "merged", "alike").join(sums, ["host", "merged", "alike"]).crossJoin(F.broadcast(whole)).select("host", "template", purity.alias("purity"))
    return named.select("host", "form", "n", "template").join(by_template, ["host", "template"])


def judge(urls: DataFrame, rules: list[Rule], keep: list[str], most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict, template and purity of every
    row of ``urls`` (url, and bad: 1, 0 or null)."""
    rows = split_urls(urls)
    told = written(judged_templates(rows.select("host", "form", "bad")), "templates")
    rule, verdict = rule_of(rules)
    tree = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    if told.limit(most_broadcast + 1).count() <= most_broadcast:
        known = rows.join(F.broadcast(told.drop("n")), ["host", "form"])
    else:
        at = F.struct("host", "form")  # one key, neither part of which is null
        known = hot_join(rows.withColumn("at", at), told.select(at.alias("at"), F.col("n").alias("copies"), "template", "purity"), "at", F.struct(*keep))
    return known.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, tree).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def oracle(rules: list[Rule], labelled_sql: str) -> str:
    """DuckDB SQL; ``labelled_sql`` gives (page_id, url, bad)."""
    ordered = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    match = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", f"{h}/{p}", k) for k, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {m} THEN '{r}'" for m, r, _ in match) + " END"
    verdict = "CASE " + " ".join(f"WHEN {m} THEN '{k}'" for m, _, k in match) + f" WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END"
    return f"""
WITH RECURSIVE l AS ({labelled_sql}),
r AS (SELECT page_id, bad, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM l),
h AS (SELECT page_id, bad, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
u AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: CASE WHEN length(s) >= {LONG} THEN '*' ELSE s END), '/') AS form FROM h),
forms AS (SELECT host, form, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM u GROUP BY ALL),
-- segs: a form's segments, those before depth d generalised; a step judges segment d over all forms whose generalised beginning is the same
walk AS (SELECT host, form, n, string_split(form, '/') AS segs, 1 AS d, len(string_split(form, '/')) AS deep FROM forms
         UNION ALL
         SELECT host, form, n, CASE WHEN d > deep THEN segs WHEN kids >= {BRANCHES} AND seg_n * {BRANCHES} < total THEN list_concat(list_concat(segs[1:d - 1], ['*']), segs[d + 1:]) ELSE segs END, d + 1, deep
         FROM (SELECT *, sum(n) OVER (PARTITION BY host, d <= deep, segs[1:d]) AS seg_n, sum(n) OVER (PARTITION BY host, d <= deep, segs[1:d - 1]) AS total,
                      count(DISTINCT segs[d]) OVER (PARTITION BY host, d <= deep, segs[1:d - 1]) AS kids, max(deep) OVER () AS deepest FROM walk) WHERE d <= deepest),
named AS (SELECT forms.*, t.template, regexp_replace(t.template, '/[^/]*$', '') AS parent FROM forms JOIN (
          SELECT host, form, array_to_string(arg_max(segs, d), '/') AS template FROM walk GROUP BY host, form) t USING (host, form)),
branch AS (SELECT host, parent, template, sum(labelled) AS labelled, sum(bad) AS bad FROM named GROUP BY ALL),
lvl AS (SELECT host, parent, (sum(bad) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS rate FROM branch GROUP BY ALL),
grp AS (SELECT host, template, CASE WHEN alike THEN parent || '/~' ELSE template END AS merged, alike, labelled, bad FROM (
        SELECT branch.*, abs(bad - labelled * rate) <= {Z}::DOUBLE * sqrt(labelled * rate * (1 - rate)) AS alike FROM branch JOIN lvl USING (host, parent))),
sums AS (SELECT host, merged, alike, sum(labelled) AS gl, sum(bad) AS gb FROM grp GROUP BY ALL),
whole AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS corpus_rate FROM forms),
pure AS (SELECT host, template, (gb + {PRIOR}::DOUBLE * corpus_rate) / (gl + {PRIOR}::DOUBLE) AS purity FROM grp JOIN sums USING (host, merged, alike), whole)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, template, round(purity, 9) AS purity
FROM u JOIN named USING (host, form) JOIN pure USING (host, template)
"""
