"""A worker that goes on to another operator's tasks drops what it remembers for the last one."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa

from brindle.llm import bpe, common, tokens


def test_tables_of_other_operators_go(monkeypatch):
    frame = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "1")), mapInArrow=lambda fn, schema: fn)
    monkeypatch.setattr(common, "_REMEMBERED", {bpe.__name__: {"words": 1}, tokens.__name__: {"pieces": 2}})

    def run(batches):
        yield from batches

    run.__module__ = bpe.__name__
    assert list(common.map_batches(frame, run, "x long")(iter([1]))) == [1]
    assert common._REMEMBERED == {bpe.__name__: {"words": 1}, tokens.__name__: {}}
    run.__module__ = "brindle.llm.language"
    assert list(common.map_batches(frame, run, "x long")(iter([1]))) == [1]
    assert common._REMEMBERED == {bpe.__name__: {}, tokens.__name__: {}}


def test_codecs_are_remembered_for_their_module():
    assert bpe._codecs is common.remembered(bpe.__name__) and tokens._encoders is common.remembered(tokens.__name__)


def test_a_task_of_op9_leaves_no_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "map_batches", lambda df, run, schema: run)
    column = SimpleNamespace(cast=lambda kind: column, alias=lambda name: column)
    frame = type("Frame", (), {"__getitem__": lambda self, name: column, "select": lambda self, *columns: self})()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["Some words", None]})
    (out,) = bpe.encode_documents(frame)(iter([batch]))
    codec = bpe.codec(bpe.VOCABULARY)
    assert out.column(2).to_pylist() != ["", ""] and not codec.pieces and not codec.known and codec.held == 0
