"""GeoParquet sink: a Python data source that writes the ``geo`` key to each file's footer.

    spark.dataSource.register(GeoParquetSource)
    features.write.format("geoparquet").mode("overwrite").save("file:///data/out")

The files are ordinary Parquet and are read with ``spark.read.parquet``. The path
names a store that all executors reach, by its scheme.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.encode import FIELD_METADATA, GEO_METADATA


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _store(self):
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator):
        store, root = self._store()
        store.create_dir(root, recursive=True)
        name, writer = f"part-{self.job}-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if writer is None:
                fields = [pa.field(f.name, f.type, f.nullable, FIELD_METADATA) if f.name == "geometry" else f for f in batch.schema]
                schema = pa.schema(fields, {"geo": GEO_METADATA})
                writer = pq.ParquetWriter(f"{root}/.{name}", schema, filesystem=store, compression="zstd")
            writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
        if writer is None:
            return _Written(None)
        writer.close()
        return _Written(name)

    def commit(self, messages):
        store, root = self._store()
        own = {m.name for m in messages if m is not None and m.name}
        old = [i for i in store.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if i.is_file] if self.overwrite else []
        for name in sorted(own):  # a file shows under its name only now
            store.move(f"{root}/.{name}", f"{root}/{name}")
        # The new files are there before any old one goes.
        for info in old:
            if info.base_name.lstrip(".") not in own:
                store.delete_file(info.path)
        self._clear(store, root)

    def abort(self, messages):
        store, root = self._store()
        self._clear(store, root)

    def _clear(self, store, root) -> None:
        """Hidden files of this job: those of tasks that failed or ran twice."""
        for info in store.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.startswith(f".part-{self.job}-"):
                store.delete_file(info.path)


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self):
        return "geometry binary, value double"

    def writer(self, schema, overwrite: bool):
        path = self.options["path"]
        if "://" not in path:
            raise ValueError("the path needs a scheme (file:// for a local folder): executors don't share local folders")
        return _Writer(path, overwrite)
