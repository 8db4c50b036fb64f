"""Components of few links and of many are the same, and few links take no rounds of tables."""

import numpy as np
import pytest

from tidemark.llm import components as module
from tidemark.llm.common import Tables


def brute(links):
    root = {x: x for pair in links if pair[0] != pair[1] for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b and (x := top(a)) != (y := top(b)):
            root[max(x, y)] = min(x, y)
    return sorted((x, top(x)) for x in root)


def shapes():
    """A long path in mixed order, a star, a random graph, repeats and loops."""
    rng = np.random.default_rng(3)
    path = rng.permutation(200) - 100
    pairs = [*zip(path, path[1:], strict=False), *((1000, x) for x in range(1001, 1100)), *(rng.integers(2000, 2300, (150, 2))), (5, 5), (3000, 3000), (4000, 4001), (4001, 4000), (4000, 4001)]
    return [(int(a), int(b)) for a, b in pairs]


@pytest.mark.parametrize("few", [0, 1 << 17])
@pytest.mark.parametrize("name", [lambda x: x, lambda x: (x % (1 << 32)).to_bytes(4, "big")])
def test_components(spark, few, name, monkeypatch):
    monkeypatch.setattr(module, "FEW", few)
    links = [(name(a), name(b)) for a, b in shapes()]
    kind = "long" if isinstance(links[0][0], int) else "binary"
    frame = spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(5)
    found = [(x if kind == "long" else bytes(x), y if kind == "long" else bytes(y)) for x, y in module.components(frame).collect()]
    assert sorted(found) == brute(links)
    assert module.components(frame.where("false")).count() == 0


def test_few_links_take_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(Tables, "put", lambda self, name, df, put=Tables.put: written.append(name) or put(self, name, df))
    frame = spark.createDataFrame(shapes(), "a long, b long")
    assert module.components(frame).count() == len(brute(shapes()))
    assert not written
    monkeypatch.setattr(module, "FEW", len([1 for a, b in shapes() if a != b]) - 1)
    assert module.components(frame).count() == len(brute(shapes()))
    assert written
