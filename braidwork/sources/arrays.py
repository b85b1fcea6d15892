"""Array files of trajectories as a data source: ``{task}_{stratum}_{seed}_{Ot|Ct}.npy`` in a folder.

Keys come from the names, so a filter on them chooses files before any is opened; a large file is read in blocks of
rows, each a partition. Files are reached through Arrow's file systems, as tasks may run on any machine.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

KEYS = ("task", "stratum", "seed", "part")
SCHEMA = "task string, stratum string, seed long, part string, t long, x array<double>"
NAME = re.compile(r"([^_/]+)_([^/]+)_(\d+)_([OC]t)\.npy$")
#: Numbers of a block of rows.
BLOCK = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if fortran and len(shape) > 1:
        raise ValueError("arrays must lie row by row")
    return shape, kind, f.tell()


@dataclass
class Block(InputPartition):
    path: str
    keys: tuple
    first: int
    rows: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equalities on keys are met by the choice of files."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if name in KEYS:
                self.wanted.append((name, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Block]:
        from pyarrow import fs

        where, root = _filesystem(self.path)
        out = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and (m := NAME.search(info.path)):
                keys = (m[1], m[2], int(m[3]), m[4])
                if all(dict(zip(KEYS, keys, strict=True))[k] in values for k, values in self.wanted):
                    with where.open_input_file(info.path) as f:
                        shape, _, _ = _header(f)
                    step = max(1, self.block // max(1, int(np.prod(shape[1:]))))
                    out += [Block(info.path, keys, a, min(step, shape[0] - a)) for a in range(0, shape[0], step)]
        return out

    def read(self, partition: Block) -> Iterator[tuple]:
        if partition is None:
            return
        where, _ = _filesystem(self.path)
        with where.open_input_file(partition.path) as f:
            shape, kind, start = _header(f)
            width = int(np.prod(shape[1:]))
            f.seek(start + partition.first * width * kind.itemsize)
            x = np.frombuffer(f.read(partition.rows * width * kind.itemsize), kind).reshape(partition.rows, width).astype(float)
        for t, row in enumerate(x.tolist(), partition.first):
            yield (*partition.keys, t, row)


class Trajectories(DataSource):
    """``spark.dataSource.register(Trajectories)``, then ``spark.read.format("trajectories").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "trajectories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def write_arrays(rows: DataFrame, path: str) -> int:
    """A file for each trajectory of ``task, stratum, seed, part, t, x``; how many there are.

    A file is what one task writes: such arrays are whole by their format.
    """

    def write(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        where, root = _filesystem(path)
        out = io.BytesIO()
        np.save(out, np.stack([np.asarray(v, float) for v in own.sort_values("t")["x"]]))
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{key[0]}_{key[1]}_{key[2]}_{key[3]}.npy") as f:
            f.write(out.getvalue())
        return pd.DataFrame({"rows": [len(own)]})

    return rows.groupBy(*KEYS).applyInPandas(write, "rows long").agg(F.count("*")).first()[0]
