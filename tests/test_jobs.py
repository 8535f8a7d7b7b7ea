"""What the arguments of a run are compared with."""

import fnmatch

from quillgrid.operators import jobs


# F3
def test_inputs_are_compared_once_and_by_their_beginning(spark):
    paths = [f"/in/{k % 3}/{'abc'[k % 4 % 3]}{k}.png" for k in range(300)]
    args = ["/in/0/a*.png"] * 200 + ["/in/?/b1*"] * 100 + ["/in/1/*7.png", "/in/2/c5?.png"]
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = spark.createDataFrame(list(enumerate(args)), "ord int, arg string")
    want = {}
    for i, a in enumerate(args):
        for p in fnmatch.filter(paths, a):
            want.setdefault(p, i)
    assert {r.path: r.ord for r in jobs.expanded_inputs(asked, listed).collect()} == want
    assert jobs.expanded_inputs(asked, listed, duplicates=True).count() == sum(len(fnmatch.filter(paths, a)) for a in args)
    once = spark.createDataFrame([(i, a) for i, a in enumerate(args) if i in (0, 200, 300, 301)], "ord int, arg string")
    begins = {0: "/in/0/a", 200: "/in/", 300: "/in/1/", 301: "/in/2/c5"}
    assert sorted((r.ord, r.path) for r in jobs.compared_inputs(once, listed).collect()) == sorted((i, p) for i, b in begins.items() for p in paths if p.startswith(b))


def test_an_argument_said_often_is_compared_once(spark, monkeypatch):
    seen = []
    compared = jobs.compared_inputs

    def counted(*a):
        seen.append((out := compared(*a)).count())
        return out

    monkeypatch.setattr(jobs, "compared_inputs", counted)
    listed = spark.createDataFrame([(f"/a/{k}",) for k in range(50)], "path string")
    asked = spark.createDataFrame([(i, "/a/*") for i in range(40)], "ord int, arg string")
    assert jobs.expanded_inputs(asked, listed).count() == 50
    assert seen == [50]
