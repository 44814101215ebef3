"""The dataset of row groups reads each row once, however many there are."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from brindle.plans import record_queries as Q


def _table(first: int, n: int) -> pa.Table:
    return pa.table({"event_id": pa.array(range(first, first + n), pa.int64()), "user_id": pa.array([1] * n, pa.int64()), "value": pa.array([float(i % 200) for i in range(n)])})


def test_partitions_are_row_groups(tmp_path):
    path = f"{tmp_path}/one.parquet"
    pq.write_table(_table(0, 20_000), path, row_group_size=8_000)
    data = Q.RowGroups({"path": path})
    parts = data.partitions()
    assert len(parts) == 3
    got = [b.column(0).to_pylist() for p in parts for b in data.read(p, ["event_id"], [])]
    assert sum(got, []) == list(range(20_000))


def test_a_folder_of_files(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(3):
        pq.write_table(_table(i * 1000, 1000), folder / f"part-{i}.parquet")
    got = Q.custom_dataset(spark, str(tmp_path)).toPandas()
    assert sorted(got["event_id"]) == [i for i in range(3000) if i % 1000 % 200 > 100]
