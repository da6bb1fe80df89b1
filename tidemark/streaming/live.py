"""A live query (X12): a stream of the versions of a store, and a view that is taken anew with each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Store


class _Versions(SimpleDataSourceStreamReader):
    """The offset is a version: the number of the newest list of a store. Lists are looked for through pyarrow, which reads shared disks, HDFS and S3."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        root = given["path"] if ":" in given["path"].split("/", 1)[0] else f"file://{given['path']}"
        self.system, self.root = fs.FileSystem.from_uri(root)
        self.after = int(given.get("after", 0))

    def _newest(self) -> int:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/_current", allow_not_found=True))
        return max((int(f.base_name) for f in found if f.base_name.isdigit() and f.size), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.after}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"version": max(start["version"], self._newest())}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The last version between: writes that come faster than they are looked for are seen as one."""
        return iter([(end["version"],)] if end["version"] > start["version"] else [])


class StoreVersions(DataSource):
    """``spark.readStream.format("store_versions").load(root)``: a row (version) when a store was written, those after the option ``after`` only."""

    @classmethod
    def name(cls) -> str:
        return "store_versions"

    def schema(self) -> str:
        return "version long"

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Versions(self.options)


def live(store: Store, view: Callable[[Store], DataFrame], show: Callable[[int, DataFrame], None], checkpoint: str, *, after: int = 0, every: str = "1 second") -> StreamingQuery:
    """Show (version, view) now and after each write that follows, until the query is stopped.

    A view is built anew from the store's tables only when their version changed. With its checkpoint a query goes on after the last version that
    it showed; that one may be shown again, if it died before it was done.
    """
    store.spark.dataSource.register(StoreVersions)
    versions = store.spark.readStream.format("store_versions").option("after", after).load(store.root)

    def run(batch: DataFrame, number: int) -> None:
        for version in [r[0] for r in batch.collect()]:  # one at most
            show(version, view(store))

    return versions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
