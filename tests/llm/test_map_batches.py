"""A task gives back the Arrow memory that it has freed."""

from __future__ import annotations

from types import SimpleNamespace

from brindle.llm import common


def test_memory_is_released_after_the_last_batch(monkeypatch):
    order = []
    frame = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "1")), mapInArrow=lambda fn, schema: fn)
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: order.append("released")))

    def run(batches):
        for b in batches:
            order.append(b)
            yield b

    assert list(common.map_batches(frame, run, "x long")(iter([1, 2]))) == [1, 2]
    assert order == [1, 2, "released"]
