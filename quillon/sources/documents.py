"""JSON documents, one file a key, that change all at once or not at all.

Tasks write their documents under a temporary folder; when the last task is done the files are renamed over those of the same name. A rename replaces
in one step, so a reader finds the old document or the new one, never none and never a part. A failed job leaves every old file.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .arrays import Written, filesystem, finish


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, path = filesystem(self.path)
        folder = posixpath.join(path, f"_{self.job}", uuid.uuid4().hex)
        store.create_dir(folder, recursive=True)
        moves, last = [], None
        for key, document in rows:
            if not key or "/" in key or key in (".", ".."):
                raise ValueError(f"no name of a file: {key!r}")
            if key == last:  # rows come sorted by key
                raise ValueError(f"two documents of one key: {key!r}")
            last = key
            json.loads(document)
            with store.open_output_stream(posixpath.join(folder, f"{key}.json")) as out:
                out.write(document.encode())
            moves.append((posixpath.join(folder, f"{key}.json"), posixpath.join(path, f"{key}.json")))
        return Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        finish(self.path, self.job, [m for x in messages if x for m in x.moves])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        finish(self.path, self.job, [])


class Documents(DataSource):
    """The data source ``documents``: rows (key, document)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_json_atomic(rows: DataFrame, path: str, key: str) -> None:
    """A file ``<key>.json`` for each row of ``rows``, an object of its columns. Two rows of a key, a null one or one that is no file's name
    are refused, and then nothing changes."""
    rows.sparkSession.dataSource.register(Documents)
    own = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("document"))
    own.repartition("key").sortWithinPartitions("key").write.format("documents").mode("append").save(path)
