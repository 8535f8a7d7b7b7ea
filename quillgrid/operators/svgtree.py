"""Vector documents as node tables and back.

A document is cut into tokens, and a token's container is found without a walk:
the running sum of opened and closed elements gives its level, and the container is
the last element that was opened on that level before it.  A node table goes back
to text by path keys: an element starts at the key of its ancestors' and its own
order and ends behind all keys that begin with it, so one sort makes the document.

Nodes are (doc_id, node, parent, ord, depth, kind, tag, namespace, attrs, text):
elements and texts; ``node`` is the token's place, which is also its order, and
the root has no parent and depth 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dropped, written
from .svgtext import SVG

TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z](?:[^>\[]++|\[.*?\])*+>|</[^>]*+>|<[^\s<>!?/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
NAME = r"^</?([^\s/>]+)"
ATTRIBUTE = r"""(?s)([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*')"""
#: Names of characters that XML itself knows (fixed values).
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
LAST = (1 << 63) - 1
ROUNDS = 64


def decoded(text: Column) -> Column:
    """Text with character references replaced; unknown ones stay as they are."""
    parts = F.split(text, "&")
    name = lambda p: F.substring_index(p, ";", 1)

    def number(n: Column) -> Column:
        decimal, hexadecimal = n.rlike("^#[0-9]{1,7}$"), n.rlike("^#x[0-9A-Fa-f]{1,6}$")
        return F.when(decimal, F.substring(n, 2, 7).cast("long")).when(hexadecimal, F.conv(F.substring(n, 3, 6), 16, 10).cast("long"))

    def one(s: Column) -> Column:
        known = F.coalesce(*(F.when(s["name"] == k, F.lit(v)) for k, v in ENTITIES.items()))
        ok = s["number"].between(1, 0x10FFFF) & ~s["number"].between(0xD800, 0xDFFF)
        char = F.coalesce(known, F.when(ok, F.decode(F.unhex(F.lpad(F.hex(s["number"]), 8, "0")), "UTF-32")))
        return F.coalesce(F.concat(F.when(F.instr(s["p"], ";") > 0, char), F.substr(s["p"], F.length(s["name"]) + 2)), F.concat(F.lit("&"), s["p"]))

    said = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(p.alias("p"), name(p).alias("name"), number(name(p)).alias("number")))
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.concat(F.element_at(parts, 1), F.array_join(F.transform(said, one), "")))


def escaped(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, kind, step, level): level counts the elements that are
    open before the token; step is 1 where it opens one, -1 where it closes one."""
    each = docs.select("doc_id", F.posexplode(F.regexp_extract_all("svg", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    t = F.col("token")
    kind = (
        F.when(t == "<", "stray").when(t.startswith("<!--"), "comment").when(t.startswith("<![CDATA["), "cdata").when(t.startswith("<?"), "instruction").when(t.startswith("<!"), "doctype")
        .when(t.startswith("</"), "close").when(t.startswith("<") & t.endswith("/>"), "empty").when(t.startswith("<"), "open").otherwise("text")
    )
    each = each.withColumn("kind", kind).withColumn("step", (F.col("kind") == "open").cast("int") - (F.col("kind") == "close").cast("int"))
    return each.withColumn("level", F.sum("step").over(Window.partitionBy("doc_id").orderBy("pos")) - F.col("step"))


def _held(docs: DataFrame) -> DataFrame:
    """Tokens with their tag and ``holder``, the place of the element that is open
    about them (for a closing tag the one that it closes) with its tag."""
    t = tokens(docs).withColumn("tag", F.when(F.col("kind").isin("open", "close", "empty"), F.regexp_extract("token", NAME, 1)))
    asks = F.struct(F.col("level").alias("at"), F.lit(None).cast("struct<pos: int, tag: string>").alias("opened"))
    opens = F.struct((F.col("level") + 1).alias("at"), F.struct("pos", "tag").alias("opened"))
    both = t.select("*", F.explode(F.when(F.col("kind") == "open", F.array(asks, opens)).otherwise(F.array(asks))).alias("x")).select("*", "x.*").drop("x")
    last = F.last("opened", ignorenulls=True).over(Window.partitionBy("doc_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("holder", last).where("opened IS NULL").drop("at", "opened")


def _attributes(token: Column) -> tuple[Column, Column, Column]:
    """Names and values of a tag, and what is left of it besides."""
    inner = F.regexp_replace(F.regexp_replace(token, r"^<[^\s/>]+", ""), r"/?>$", "")
    names = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(1))
    values = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(2)), lambda v: decoded(F.substring(v, 2, F.length(v) - 2)))
    return names, values, F.trim(F.regexp_replace(F.regexp_replace(inner, ATTRIBUTE, ""), r"\s+", " "))


def parsed(docs: DataFrame) -> DataFrame:
    """The nodes of the documents (doc_id, svg) in which ``problems`` finds nothing wrong.

    Comments, instructions and the document type give no node, nor does text
    outside of the root.  An attribute that a tag repeats makes a document wrong, so
    its nodes are left out.  Null documents have no nodes.
    """
    held = written(_held(docs), "tokens")
    wrong = _first_problem(held)
    names, values, _ = _attributes(F.col("token"))
    element = F.col("kind").isin("open", "empty")
    attrs = F.when(element, F.map_from_arrays(names, values))
    text = F.when(F.col("kind") == "text", decoded(F.col("token"))).when(F.col("kind") == "cdata", F.expr("substr(token, 10, length(token) - 12)"))
    inside = held.where((element | F.col("kind").isin("text", "cdata")) & ((F.col("level") > 0) | element)).join(wrong.select("doc_id"), "doc_id", "left_anti")
    nodes = inside.select("doc_id", F.col("pos").alias("node"), F.col("holder.pos").alias("parent"), F.col("level").cast("int").alias("depth"), F.when(element, "element").otherwise("text").alias("kind"), "tag", attrs.alias("attrs"), text.alias("text"))
    nodes = nodes.join(held.where("kind = 'close'").select("doc_id", F.col("holder.pos").alias("node"), F.col("pos").alias("end")), ["doc_id", "node"], "left").withColumn("end", F.coalesce("end", "node"))
    # a prefix means what the last declaration about an element says
    declared = F.map_filter("attrs", lambda k, _: (k == "xmlns") | k.startswith("xmlns:"))
    said = nodes.where("kind = 'element'").select("doc_id", F.col("node").alias("since"), F.col("end").alias("until"), F.explode(declared).alias("name", "uri"))
    said = said.withColumn("prefix", F.when(F.col("name") == "xmlns", "").otherwise(F.substring("name", 7, 1 << 20)))
    prefix = F.when(F.instr("tag", ":") > 0, F.substring_index("tag", ":", 1)).otherwise("")
    own = nodes.where("kind = 'element'").select("doc_id", "node", prefix.alias("prefix")).join(said, ["doc_id", "prefix"]).where("node BETWEEN since AND until")
    spaces = own.groupBy("doc_id", "node").agg(F.max_by("uri", "since").alias("namespace"))
    return nodes.join(spaces, ["doc_id", "node"], "left").select("doc_id", "node", "parent", F.col("node").cast("long").alias("ord"), "depth", "kind", "tag", F.nullif("namespace", F.lit("")).alias("namespace"), "attrs", "text")


def _first_problem(held: DataFrame) -> DataFrame:
    names, _, left = _attributes(F.col("token"))
    tag, level, kind = F.col("kind").isin("open", "empty"), F.col("level"), F.col("kind")
    what = (
        F.when(kind == "stray", "stray <")
        .when((kind == "close") & F.col("holder").isNull(), "closing tag without an opening one")
        .when((kind == "close") & (F.col("tag") != F.col("holder.tag")), "closing tag of another element")
        .when(tag & (left != ""), "attribute without a quoted value")
        .when(tag & (F.size(F.array_distinct(names)) < F.size(names)), "repeated attribute")
        .when(kind.isin("text", "cdata") & (level == 0) & (F.trim(F.regexp_replace("token", r"[\s﻿]+", " ")) != ""), "text outside of the root")
    )
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    roots = F.count_if(tag & (level == 0)).over(w)
    what = F.coalesce(what, F.when(tag & (level == 0) & (roots > 0), "second root"))
    return held.withColumn("what", what).groupBy("doc_id").agg(
        F.min_by("what", F.when(F.col("what").isNotNull(), F.col("pos"))).alias("first"), F.sum("step").alias("open"), F.count_if(tag & (level == 0)).alias("roots")
    ).select("doc_id", F.coalesce("first", F.when(F.col("roots") == 0, "no root"), F.when(F.col("open") > 0, "element that does not end")).alias("problem")).where("problem IS NOT NULL")


def problems(docs: DataFrame) -> DataFrame:
    """(doc_id, problem) of documents that are not well-formed: the first by place.
    A null or empty one has no root, and a root that is no svg element is named."""
    held = _held(docs)
    wrong = _first_problem(held)
    empty = docs.where("svg IS NULL OR svg = ''").select("doc_id", F.lit("no root").alias("problem"))
    roots = parsed(docs).where("depth = 0 AND kind = 'element'")
    local = F.substring_index("tag", ":", -1)
    alien = roots.where((local != "svg") | ~F.col("namespace").eqNullSafe(SVG)).select("doc_id", F.lit("root is no svg element").alias("problem"))
    return wrong.unionByName(empty).unionByName(alien)


def with_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, the orders of all ancestors and the node's own.

    Pointers double, so there are as many rounds as the depth has binary digits.
    Nodes whose ancestors do not lead to a root are left out, so taking an element
    out of a table takes all of its content; circles are an error.
    """
    now = nodes.select("doc_id", "node", F.col("parent").alias("up"), F.array(F.col("ord").cast("long")).alias("path"))
    before = None
    for _ in range(ROUNDS):
        now = written(now, "paths")
        if before is not None:  # its round is over
            dropped(before)
        before = now
        if now.where("up IS NOT NULL").isEmpty():
            return nodes.join(now.select("doc_id", "node", "path"), ["doc_id", "node"])
        above = now.select("doc_id", F.col("node").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        waits = now.where("up IS NOT NULL").join(above, ["doc_id", "up"]).select("doc_id", "node", F.col("further").alias("up"), F.concat("before", "path").alias("path"))
        now = now.where("up IS NULL").unionByName(waits)
    raise ValueError("nodes whose parents run in a circle")


def serialised(nodes: DataFrame) -> DataFrame:
    """(doc_id, document): the text of each document's root.  Texts are escaped
    anew, elements without content end in their tag."""
    keyed = with_paths(nodes)
    content = nodes.where("parent IS NOT NULL").select("doc_id", F.col("parent").alias("node"), F.lit(True).alias("filled")).distinct()
    keyed = keyed.join(content, ["doc_id", "node"], "left")
    attributes = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"'))), "")
    begin = F.concat(F.lit("<"), "tag", F.coalesce(attributes, F.lit("")), F.when(F.col("filled"), ">").otherwise("/>"))
    piece = lambda key, text: F.struct(key.alias("key"), text.alias("text"))
    end = piece(F.concat("path", F.array(F.lit(LAST))), F.concat(F.lit("</"), "tag", F.lit(">")))
    start = piece(F.col("path"), F.when(F.col("kind") == "element", begin).otherwise(escaped(F.coalesce("text", F.lit("")))))
    pieces = keyed.select("doc_id", F.explode(F.when((F.col("kind") == "element") & F.col("filled"), F.array(start, end)).otherwise(F.array(start))).alias("p"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("document"))


def without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without those of ``gone`` (doc_id, node); their content goes when the
    document is written, as its ancestors no longer lead to the root."""
    return nodes.join(gone.select("doc_id", "node"), ["doc_id", "node"], "left_anti")


def with_attribute(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Elements of ``values`` (doc_id, node, value) with the attribute set, in its
    place where they have it, else last."""
    joined = nodes.join(values.select("doc_id", "node", F.col("value").alias("__value")), ["doc_id", "node"], "left")
    has = F.map_contains_key("attrs", F.lit(name))
    put = F.when(has, F.transform_values("attrs", lambda k, v: F.when(k == name, F.col("__value")).otherwise(v))).otherwise(F.map_concat("attrs", F.create_map(F.lit(name), F.col("__value"))))
    return joined.withColumn("attrs", F.when(F.col("__value").isNotNull(), put).otherwise(F.col("attrs"))).select(*nodes.columns)


def with_text_layer(nodes: DataFrame, layer: DataFrame, group_id: str = "ocr_text_layer") -> DataFrame:
    """Nodes with a group of text elements put last into the root of each document
    that has rows in ``layer`` (doc_id, ord, x, y, font_size, fill, font_family, text)."""
    n = nodes.where("parent IS NULL AND kind = 'element'").select("doc_id", F.col("node").alias("root"), "namespace", F.col("depth").alias("d"))
    first = nodes.groupBy("doc_id").agg((F.max("node") + 1).alias("free"), (F.max("ord") + 1).alias("next"))
    into = layer.select("doc_id").distinct().join(n, "doc_id").join(first, "doc_id")
    row = "doc_id", "node", "parent", "ord", "depth", "kind", "tag", "namespace", "attrs", "text"
    no = F.lit(None).cast("string")
    pairs = lambda *p: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    group = into.select("doc_id", F.col("free").alias("node"), F.col("root").alias("parent"), F.col("next").alias("ord"), (F.col("d") + 1).alias("depth"), F.lit("element").alias("kind"), F.lit("g").alias("tag"), "namespace", pairs("id", group_id).alias("attrs"), no.alias("text"))
    # an element and its text take two places each
    lines = layer.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).join(into, "doc_id")
    at = F.col("free") + 2 * F.col("k") - 1
    attrs = pairs("x", F.col("x"), "y", F.col("y"), "font-size", F.col("font_size"), "fill", F.col("fill"), "font-family", F.col("font_family"))
    elements = lines.select("doc_id", at.alias("node"), F.col("free").alias("parent"), F.col("k").cast("long").alias("ord"), (F.col("d") + 2).alias("depth"), F.lit("element").alias("kind"), F.lit("text").alias("tag"), "namespace", attrs.alias("attrs"), no.alias("text"))
    texts = lines.select("doc_id", (at + 1).alias("node"), at.alias("parent"), F.lit(1).cast("long").alias("ord"), (F.col("d") + 3).alias("depth"), F.lit("text").alias("kind"), no.alias("tag"), no.alias("namespace"), F.lit(None).cast("map<string,string>").alias("attrs"), "text")
    out = nodes.select(*row)
    for more in (group, elements, texts):
        out = out.unionByName(more.select(*row))
    return out
