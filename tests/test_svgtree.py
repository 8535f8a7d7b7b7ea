"""Parsing of vector documents against an XML reader, and writing them back."""

import random
import xml.etree.ElementTree as ET

import pytest

from quillgrid.operators import svgtree
from quillgrid.plans import svg_queries, views

NS = "http://www.w3.org/2000/svg"


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, svg string")


def element(rnd, depth):
    tag = rnd.choice(["g", "path", "text", "x:box", "use"])
    attrs = "".join(f" {k}={q}{rnd.choice(['1 2', 'a&amp;b', '&#x3c;&#62;', 'ü é', '> /'])}{q}" for k in rnd.sample(["id", "d", "xlink:href", "data-a", "style"], rnd.randrange(0, 4)) for q in [rnd.choice(["'", '"'])])
    inner = "".join(rnd.choice([lambda: element(rnd, depth + 1), lambda: rnd.choice([" some text ", "a &lt; b &amp;amp; c", "\n  ", "<!-- <g> not one -->", "<![CDATA[<raw> & ]]>", "<?note <g>?>"])])() for _ in range(rnd.randrange(0, 5 if depth < 6 else 1)))
    return f"<{tag}{attrs}>{inner}</{tag}>" if inner or rnd.random() < 0.3 else f"<{tag}{attrs}{rnd.choice(['', ' '])}/>"


def drawing(seed):
    rnd = random.Random(seed)
    return f'<?xml version="1.0"?>\n<!DOCTYPE svg [<!ENTITY none "no">]>\n<svg xmlns="{NS}" xmlns:x="urn:x" xmlns:xlink="urn:l" width="5">{"".join(element(rnd, 1) for _ in range(4))}</svg>\n'


DOCS = [drawing(i) for i in range(40)]


def walked(doc):
    """(depth, tag with its namespace, attributes by local form, text and tails) in document order."""
    out = []

    def go(e, depth):
        out.append((depth, e.tag, {k.replace("{urn:l}", "xlink:"): v for k, v in e.attrib.items()}))
        if e.text:
            out.append((depth + 1, None, e.text))
        for kid in e:
            go(kid, depth + 1)
            if kid.tail:
                out.append((depth + 1, None, kid.tail))

    go(ET.fromstring(doc), 0)
    return out


def joined(rows):
    """Neighbouring texts as one, as an XML reader gives them."""
    out = []
    for r in rows:
        if r[1] is None and out and out[-1][1] is None and out[-1][0] == r[0]:
            out[-1] = (r[0], None, out[-1][2] + r[2])
        else:
            out.append(r)
    return out


def test_nodes_are_those_of_an_xml_reader(spark):
    nodes = {}
    for r in svgtree.parsed(frame(spark, DOCS)).orderBy("doc_id", "node").collect():
        attrs = {k: v for k, v in (r.attrs or {}).items() if k != "xmlns" and not k.startswith("xmlns:")}
        nodes.setdefault(r.doc_id, []).append((r.depth, f"{{{r.namespace}}}{r.tag.rpartition(':')[2]}", attrs) if r.kind == "element" else (r.depth, None, r.text))
    assert len(nodes) == len(DOCS)
    for i, doc in enumerate(DOCS):
        assert joined(nodes[i]) == walked(doc)


def test_parents_hold_their_nodes(spark):
    rows = svgtree.parsed(frame(spark, DOCS[:5])).collect()
    at = {(r.doc_id, r.node): r for r in rows}
    for r in rows:
        assert (r.parent is None) == (r.depth == 0)
        if r.parent is not None:
            up = at[r.doc_id, r.parent]
            assert up.kind == "element" and up.depth == r.depth - 1 and up.node < r.node


def test_documents_are_written_as_they_were_read(spark):
    nodes = svgtree.parsed(frame(spark, DOCS))
    written = {r.doc_id: r.document for r in svgtree.serialised(nodes).collect()}
    for i, doc in enumerate(DOCS):
        assert walked(written[i]) == walked(doc)
    again = svgtree.serialised(svgtree.parsed(spark.createDataFrame(list(written.items()), "doc_id long, svg string")))
    assert {r.doc_id: r.document for r in again.collect()} == written


def test_derived_drawings_against_xpath(spark):
    docs = views.svg_docs(spark, "/root/testdata/sf0.001")
    want = docs.selectExpr("doc_id", "xpath_string(regexp_replace(svg, '(?s)^.*?(?=<svg)', ''), '/svg/g/path/@d') AS d", "xpath_string(regexp_replace(svg, '(?s)^.*?(?=<svg)', ''), '/svg/g/@id') AS id", "xpath_string(regexp_replace(svg, '(?s)^.*?(?=<svg)', ''), '/svg/metadata') AS made")
    nodes = svgtree.parsed(docs).cache()
    got = nodes.groupBy("doc_id").agg(*(f.alias(c) for c, f in svg_columns().items()))
    assert sorted(map(tuple, got.select("doc_id", "d", "id", "made").collect())) == sorted(map(tuple, want.collect()))


def svg_columns():
    from pyspark.sql import functions as F

    return {"d": F.max(F.when(F.col("tag") == "path", F.col("attrs")["d"])), "id": F.max(F.when(F.col("tag") == "g", F.col("attrs")["id"])), "made": F.max(F.when(F.col("depth") == 2, F.col("text")))}


@pytest.mark.parametrize(
    ("svg", "problem"),
    [
        (None, "no root"), ("", "no root"), ("<!-- only -->", "no root"), (f'<svg xmlns="{NS}"/>', None), (f'<s:svg xmlns:s="{NS}"/>', None), ("<svg/>", "root is no svg element"), (f'<svg xmlns="{NS}"><g></svg>', "closing tag of another element"),
        (f'<svg xmlns="{NS}"><g/>', "element that does not end"), (f'<svg xmlns="{NS}"/></g>', "closing tag without an opening one"), (f'<svg xmlns="{NS}"/><g/>', "second root"), (f'<svg xmlns="{NS}"/>x', "text outside of the root"), (f'<svg xmlns="{NS}" a="1" a="2"/>', "repeated attribute"),
        (f'<svg xmlns="{NS}" a=1/>', "attribute without a quoted value"), (f'<svg xmlns="{NS}">a < b</svg>', "stray <"), (f'<svg xmlns="{NS}">{"<g>" * 300}{"</g>" * 300}</svg>', None), (f'<svg xmlns="{NS}" d="{"1 2 " * 100_000}"/>', None),
    ],
)
def test_problems(spark, svg, problem):
    got = svgtree.problems(frame(spark, [svg])).collect()
    assert [r.problem for r in got] == ([problem] if problem else [])
    assert bool(svgtree.parsed(frame(spark, [svg])).count()) == (problem in (None, "root is no svg element"))


def test_edits(spark):
    doc = f'<svg xmlns="{NS}"><g id="a" fill="blue"><path d="M 1 2"/><path d="M 3 4"/></g><g id="b"/></svg>'
    nodes = svgtree.parsed(frame(spark, [doc, doc]))
    gone = nodes.where("doc_id = 0 AND attrs['id'] = 'a'")
    fills = nodes.where("tag = 'g'").selectExpr("doc_id", "node", "concat('c', attrs['id']) AS value")
    layer = spark.createDataFrame([(1, 2, "1", "2", "3px", "#0", "F", "B & <b>"), (1, 1, "0", "0", "9px", "#0", "F", "A")], "doc_id long, ord int, x string, y string, font_size string, fill string, font_family string, text string")
    edited = svgtree.with_text_layer(svgtree.with_attribute(svgtree.without(nodes, gone), fills, "fill"), layer)
    got = {r.doc_id: r.document for r in svgtree.serialised(edited).collect()}
    assert got[0] == f'<svg xmlns="{NS}"><g id="b" fill="cb"/></svg>'
    texts = '<g id="ocr_text_layer"><text x="0" y="0" font-size="9px" fill="#0" font-family="F">A</text><text x="1" y="2" font-size="3px" fill="#0" font-family="F">B &amp; &lt;b&gt;</text></g>'
    assert got[1] == f'<svg xmlns="{NS}"><g id="a" fill="ca"><path d="M 1 2"/><path d="M 3 4"/></g><g id="b" fill="cb"/>{texts}</svg>'


def test_nodes_in_a_circle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(svgtree, "ROUNDS", 5)
    nodes = svgtree.parsed(frame(spark, [f'<svg xmlns="{NS}"><g/></svg>'])).selectExpr("doc_id", "node", "CASE WHEN node = 0 THEN 1 ELSE parent END AS parent", "ord", "depth", "kind", "tag", "namespace", "attrs", "text")
    with pytest.raises(ValueError, match="circle"):
        svgtree.serialised(nodes).count()


def test_the_conversion_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, svg string, view_box string")
    assert svg_queries.converted(docs, spark.createDataFrame([], "src long, content string")).count() == 0
