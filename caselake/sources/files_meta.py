"""Small marker files beside a dataset: tenant claims, commit markers, table pointers.

They go through the Hadoop file system of the session, so they work on any storage the
data itself works on. A marker is created, never overwritten: the create call is the
atomic step that makes a finished write visible.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Markers:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.commons.io.IOUtils
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._Path(self.root).getFileSystem(conf)

    def _path(self, name: str):
        return self._Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def is_empty(self, name: str = "") -> bool:
        path = self._path(name)
        return not self._fs.exists(path) or len(self._fs.listStatus(path)) == 0

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write to a side name, then rename into place; refuse if the name is taken."""
        target = self._path(name)
        if self._fs.exists(target):
            raise FileExistsError(f"{name} is already committed")
        folder, _, base = name.rpartition("/")
        own = f"._{base}.{uuid.uuid4().hex}.tmp"     # two writers never share a side file
        side = self._path(f"{folder}/{own}" if folder else own)
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(side, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if not self._fs.rename(side, target):
            raise FileExistsError(f"{name} is already committed")

    def move(self, name: str, folder: str) -> None:
        """Into a folder, under its own name or, where that is taken, with its time; a file that is away already stays there."""
        source = self._path(name)
        if not self._fs.exists(source):
            return
        there = self._Path(folder)
        self._fs.mkdirs(there)
        target = self._Path(there, name)
        if self._fs.exists(target):
            target = self._Path(there, f"{name}.{self._fs.getFileStatus(source).getModificationTime()}")
        if not self._fs.rename(source, target):
            raise OSError(f"{name} could not be moved to {folder}")

    def remove(self, name: str) -> None:
        source = self._path(name)
        if self._fs.exists(source) and not self._fs.delete(source, False):
            raise OSError(f"{name} could not be deleted")

    def create_json(self, name: str, value: dict) -> None:
        self.create(name, json.dumps(value, sort_keys=True) + "\n")

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))

    def read_all_json(self, folder: str) -> list[dict]:
        return [self.read_json(f"{folder}/{n}") for n in self.names(folder)
                if n.endswith(".json") and not n.startswith((".", "_"))]


class TenantRefused(RuntimeError):
    pass


TENANT_MARKER = "_tenant"


def claim_tenant(spark: SparkSession, root: str, tenant: str) -> None:
    """A store belongs to the tenant that first wrote it, and unclaimed data belongs to nobody."""
    markers = Markers(spark, root)
    if markers.exists(TENANT_MARKER):
        owner = markers.read(TENANT_MARKER).strip()
        if owner != tenant:
            raise TenantRefused(f"the store belongs to '{owner}', not to '{tenant}'")
        return
    if not markers.is_empty():
        raise TenantRefused(f"the store holds data but names no owner; '{tenant}' cannot claim it")
    markers.create(TENANT_MARKER, tenant)
