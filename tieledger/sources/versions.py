"""Tables that are replaced together: readers see all of one version or all of another.

A version is written to a folder of its own.  It counts from the moment that a small file with its number exists, which is created in one
step; until then, and if a writer dies before, readers keep to the version before.  Two writers that begin at the same version cannot both
commit.  A writer that runs again for the same ``token``, such as the number of a stream's batch, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Version(NamedTuple):
    number: int
    folder: str
    token: str | None


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def latest(self) -> Version | None:
        """The newest version; only the names of the commits are listed."""
        files, place = self._at(f"{self.path}/_commits")
        if not files.exists(place):
            return None
        numbers = [int(n) for s in files.listStatus(place) if (n := s.getPath().getName()).isdigit()]
        return self.get(max(numbers)) if numbers else None

    def get(self, number: int) -> Version:
        files, place = self._at(f"{self.path}/_commits/{number:012d}")
        stream = files.open(place)
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, f"{self.path}/{said['folder']}", said["token"])

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """A table of a version, by default the newest; None before the first."""
        version = version or self.latest()
        return version and self.spark.read.parquet(f"{version.folder}/{table}")

    def commit(self, tables: dict[str, DataFrame], token: str | None = None) -> Version:
        """Writes all tables, then makes them the newest version; they may be made from the one before."""
        before = self.latest()
        if token is not None and before is not None and before.token == token:
            return before
        number, folder = before.number + 1 if before else 0, uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        self._publish(number, folder, token)
        return Version(number, f"{self.path}/{folder}", token)

    def _publish(self, number: int, folder: str, token: str | None) -> None:
        commits = f"{self.path}/_commits"
        files, draft = self._at(f"{commits}/_{folder}")
        _, place = self._at(f"{commits}/{number:012d}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"folder": folder, "token": token}).encode()))
        out.close()
        # the rename is one step and does not replace a version that is there
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise RuntimeError(f"version {number} of {self.path} was committed by another writer")
