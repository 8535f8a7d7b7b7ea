"""Images that are traced as a whole against those that go through rounds."""

import random

import pytest

from quillgrid.operators import trace
from quillgrid.plans import views
from tests.compare import SMALL
from tests.test_trace import IMAGES, RGB


def noise(seed, width, height, colours):
    rnd = random.Random(seed)
    return {(y, x): (rnd.randrange(colours), 0, 0) for y in range(height) for x in range(width) if rnd.random() < 0.9}


# F5
@pytest.mark.parametrize(("colours", "speckle", "tolerance", "stack"), [(0, 0, 0.0, False), (3, 2, 1.5, True), (2, 1, 0.7, False)])
def test_whole_images_are_as_in_rounds(spark, monkeypatch, colours, speckle, tolerance, stack):
    images = IMAGES | {4: noise(4, 23, 19, 3), 5: {(y + 7, x - 3): c for (y, x), c in noise(5, 11, 13, 2).items()}}
    rows = spark.createDataFrame([(k, y, x, *c) for k, px in images.items() for (y, x), c in px.items() if x >= 0], RGB)
    calls = []
    rounds = trace._in_rounds
    monkeypatch.setattr(trace, "_in_rounds", lambda *a: calls.append(1) or rounds(*a))
    whole = sorted(map(tuple, trace.traced(rows, colours, speckle, tolerance, stack).collect()))
    assert not calls
    monkeypatch.setattr(trace, "CELLS", 900)
    assert sorted(map(tuple, trace.traced(rows, colours, speckle, tolerance, stack).collect())) == whole
    assert calls and len(whole) == len(images)


def test_colour_images_are_made_without_a_group_for_each_pixel(spark):
    plan = views.rgb(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
