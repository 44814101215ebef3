"""Datasets of the user's own as Spark sources.

A dataset is a class that Spark can send to its tasks:

    class Mine:
        def __init__(self, options: dict): ...
        def schema(self) -> StructType: ...
        def partitions(self) -> list: ...                             # one task each
        def read(self, partition, columns, filters): ...              # yields tuples or Arrow batches

``register`` makes it ``spark.read.format(name)``. Partitions are read in parallel. Comparisons
of a column with a value reach ``read`` as (column, sign, value) and may be used to skip what
can't match; Spark applies them again, so a dataset may ignore them. The option ``columns``
names the columns that are wanted: ``read`` gets them, in the order of the schema, and yields
these only. Options come with lower-case names.
"""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
METHODS = ("schema", "partitions", "read")


class _Partition(InputPartition):
    def __init__(self, of: object):
        self.of = of


class _Reader(DataSourceReader):
    def __init__(self, dataset: object, columns: list[str]):
        self.dataset, self.columns, self.filters = dataset, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in SIGNS:
                self.filters.append((".".join(f.attribute), SIGNS[type(f)], f.value))
            yield f  # Spark applies all of them again

    def partitions(self) -> list[InputPartition]:
        return [_Partition(p) for p in self.dataset.partitions()]

    def read(self, partition: _Partition) -> Iterator:
        yield from self.dataset.read(partition.of, self.columns, self.filters)


def source(name: str, dataset: type) -> type[DataSource]:
    """A data source of this name over a dataset class."""
    missing = [m for m in METHODS if not callable(getattr(dataset, m, None))]
    if missing:
        raise TypeError(f"{dataset.__name__} lacks {missing}")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _made(self) -> object:
            return dataset({k.lower(): v for k, v in self.options.items()})

        def schema(self) -> StructType:
            whole = self._made().schema()
            wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
            unknown = sorted(set(wanted) - set(whole.names))
            if unknown:
                raise ValueError(f"{name} has no columns {unknown}")
            return StructType([f for f in whole if not wanted or f.name in wanted])

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(self._made(), schema.names)

    return Source


def register(spark: SparkSession, name: str, dataset: type) -> None:
    """Make ``spark.read.format(name)`` read a dataset class. Comparisons reach it only if
    the session lets Python sources have them, which is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(name, dataset))


def load(path: str, name: str) -> type:
    """A dataset class from a Python file. What the tasks need of it travels by value."""
    spec = importlib.util.spec_from_file_location("brindle_user_dataset", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, name, None)
    if not isinstance(found, type):
        raise AttributeError(f"{path} has no class {name}")
    sys.modules[module.__name__] = module
    cloudpickle.register_pickle_by_value(module)
    return found
