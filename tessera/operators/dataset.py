"""A catalogue of matrix versions, subsets of their axes and metadata."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dataset(MutableMapping):
    """Versions of one matrix (cells), named subsets (``obs`` or ``attr`` tables) and metadata of either axis."""

    def __init__(self, data: DataFrame, name: str = "dataset", version: str = "initial", obs_metadata: DataFrame | None = None, attr_metadata: DataFrame | None = None):
        self.name, self.default, self.target = name, version, None
        self.versions: dict[str, DataFrame] = {}
        self.notes: dict[str, str] = {}
        self.subsets: dict[str, dict[str, DataFrame]] = {"obs": {}, "attr": {}}
        self.metadata = {"obs": obs_metadata, "attr": attr_metadata}
        self.add_version(version, data)

    def add_version(self, version: str, data: DataFrame, notes: str = "") -> None:
        self.versions[version] = data
        self.notes[version] = notes
        data.createOrReplaceTempView(f"{self.name}__{version}")

    def add_subset(self, name: str, keys: DataFrame, axis: str = "obs") -> None:
        """A named subset; keys that no version's default has are an error."""
        self._known(keys, axis)
        self.subsets[axis][name] = keys.select(axis).distinct()

    def _known(self, keys: DataFrame, axis: str) -> None:
        if not keys.select(axis).distinct().join(self.versions[self.default].select(axis).distinct(), axis, "left_anti").isEmpty():
            raise KeyError(f"unknown labels on axis {axis!r}")

    def set_default(self, version: str) -> None:
        if version not in self.versions:
            raise KeyError(version)
        self.default = version

    def set_target(self, column: str) -> None:
        self.target = column

    def add_metadata(self, table: DataFrame, axis: str) -> None:
        old = self.metadata[axis]
        self.metadata[axis] = table if old is None else old.join(table, axis, "full")

    def _part(self, rows: DataFrame, part, axis: str) -> DataFrame:
        if part is None:
            return rows
        if isinstance(part, str):
            keys = self.subsets[axis][part]
        elif callable(part):
            return rows.where(part(F.col(axis)))
        elif isinstance(part, DataFrame):
            keys = part
        else:
            keys = rows.sparkSession.createDataFrame([(k,) for k in part], f"{axis} {dict(rows.dtypes)[axis]}")
        self._known(keys, axis)
        return rows.join(keys.select(axis).distinct(), axis, "left_semi")

    def get(self, version: str | None = None, obs=None, attr=None, with_target: bool = False):
        """Cells of a version, restricted by names, labels, tables or predicates; with the target, a pair."""
        rows = self._part(self._part(self.versions[version or self.default], obs, "obs"), attr, "attr")
        if not with_target:
            return rows
        y = self.metadata["obs"].select("obs", F.col(self.target).alias("class"))
        return rows, y.join(rows.select("obs").distinct(), "obs", "left_semi")

    def field(self, column: str, axis: str = "obs", where=None, change=None) -> DataFrame:
        """A metadata column, filtered and mapped."""
        rows = self.metadata[axis].select(axis, column)
        rows = rows.where(where(F.col(column))) if where else rows
        return rows.withColumn(column, change(F.col(column))) if change else rows

    def __getitem__(self, version: str) -> DataFrame:
        return self.versions[version]

    def __setitem__(self, version: str, data: DataFrame) -> None:
        self.add_version(version, data)

    def __delitem__(self, version: str) -> None:
        del self.versions[version]

    def __iter__(self) -> Iterator[str]:
        return iter(self.versions)

    def __len__(self) -> int:
        return len(self.versions)
