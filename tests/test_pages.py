import random

import pyarrow as pa
import pytest
from test_hierarchy import LINES, machine

from lexmill.operators import chunking, hierarchy


@pytest.mark.parametrize("seed", [1, 2])
def test_headings_stay_open_over_many_pages(spark, seed):
    """Titles of short pages equal the state machine, and no window sorts the lines of a whole title."""
    rng = random.Random(seed)
    own = [(rng.choice(LINES if rng.random() < 0.5 else ["some text", None, "Sections:"]), p) for p in range(1, 200) for _ in range(rng.randint(1, 3))]
    pages = [(23, p, "\n".join(x or "" for x, q in own if q == p)) for p in range(1, 200)]
    lines = hierarchy.explode_lines(spark.createDataFrame(pages, "title_number int, page_number int, text string").repartition(4))
    carried = hierarchy.carry_forward(hierarchy.headings(lines))
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and not [x for x in windows if "[title_number#" in x.split("windowspec")[-1]]
    got = sorted((r.node, r.kind, r.number, r.title, r.start_page, r.text) for r in hierarchy.nodes(carried).collect())
    assert got == machine(own, 23)


def test_packing_by_slices(monkeypatch):
    """A whole Arrow batch used to be Python objects at once."""
    texts = [None, "", *(f"word{i} " * (i % 50) for i in range(400))]
    held = []
    monkeypatch.setattr(chunking, "SLICE", 2000)
    monkeypatch.setattr(chunking.pa, "concat_arrays", lambda parts, f=pa.concat_arrays: held.extend(map(len, parts)) or f(parts))
    got = chunking._pieces(pa.array(texts), lambda t: chunking._words(t, 40)).to_pylist()
    assert got == [chunking._words(t or "", 40) for t in texts]
    assert len(held) > 20 and max(held) < 60
    assert chunking._pieces(pa.array([], pa.string()), lambda t: [t]).to_pylist() == []
