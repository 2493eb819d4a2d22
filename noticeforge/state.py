"""Versioned state: immutable tables of a version, published together by one manifest.

A commit writes the tables of the next version, then creates that version's
manifest; creation fails if another writer has published it, so nobody's work is
overwritten and readers see all tables of a version or none.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Version of the tables' layout. Older layouts are upgraded when read, newer ones refused.
SCHEMA_VERSION = 1

#: Columns of the state tables.
TABLES = {
    "processes": "id string, canonical_key string, source string, title string, title_signature string, organisation string, normalised_organisation string, locality string, province string, `group` string, positions int, access string, compatibility string, status string, priority int, publication_date date, deadline date, deadline_confirmed boolean, exam_date date, exam_time string, exam_place string, qualification string, summary string, special_process string, semantic_hash string, snapshot string, first_seen timestamp, last_seen timestamp, last_changed timestamp",
    "source_items": "source string, external_id string, process_id string, first_seen timestamp, last_seen timestamp",
    "official_references": "reference string, process_id string, first_seen timestamp",
    "process_urls": "process_id string, source string, url string, label string, first_seen timestamp",
    "notification_outbox": "event_id string, event_key string, process_id string, kind string, status string, attempts int, payload string, created_at timestamp, claimed_at timestamp, sent_at timestamp, message_id string",
    "reminders": "process_id string, deadline date, days_before int, created_at timestamp",
    "source_runs": "id long, source string, status string, found long, started_at timestamp, finished_at timestamp, covered_through date, message string",
    "followed_processes": "process_id string, followed_at timestamp",
    "source_checkpoints": "source string, covered_through date",
    "process_aliases": "alias_id string, process_id string",
}


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class State:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        #: Manifests that were read; they never change.
        self._manifests: dict[int, dict] = {}
        self._scratch: list[str] = []
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """The latest published version; 0 if there is none."""
        if not self._fs.exists(self._path("manifests")):
            return 0
        # A manifest that has no bytes yet is being written.
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("manifests")) if x.getLen()]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema_version": SCHEMA_VERSION, "tables": {}}
        if version not in self._manifests:
            with_stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
            text = bytes(with_stream.readAllBytes()).decode()
            with_stream.close()
            self._manifests[version] = json.loads(text)
        found = self._manifests[version]
        if found["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError(f"state has layout {found['schema_version']}, this code knows {SCHEMA_VERSION}")
        return found

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table; empty if it was never written. Columns that an older layout lacks are null."""
        empty = self.spark.createDataFrame([], TABLES[table])
        where = self.manifest(version)["tables"].get(table)
        if where is None:
            return empty
        stored = self.spark.read.parquet(f"{self.root}/{where}")
        return empty.unionByName(stored, allowMissingColumns=True) if stored.columns != empty.columns else stored

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Write tables and publish the version after base. Tables that aren't given stay as they are."""
        known = dict(self.manifest(base)["tables"])
        version, own = base + 1, f"data/{base + 1:012d}-{uuid.uuid4().hex[:8]}"

        def write(name: str) -> None:
            columns = [x.split()[0].strip("`") for x in TABLES[name].split(", ")]
            tables[name].select(*columns).write.parquet(f"{self.root}/{own}/{name}")

        # Tables are written side by side: most are small, and their plans are made while others run.
        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), tables))
        known |= {name: f"{own}/{name}" for name in tables}
        body = json.dumps({"version": version, "schema_version": SCHEMA_VERSION, "tables": known})
        self._fs.mkdirs(self._path("manifests"))
        # Only one writer can create the file; the others publish nothing.
        try:
            out = self._fs.create(self._path(f"manifests/{version:012d}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {version} has been published by another writer") from e
        out.write(bytearray(body.encode()))
        out.close()
        return version

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """A table written to the state's folder and read again: what follows doesn't compute it anew. forget() deletes it."""
        path = f"scratch/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{path}")
        self._scratch.append(path)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def forget(self) -> None:
        while self._scratch:
            self._fs.delete(self._path(self._scratch.pop()), True)
