"""Outputs that readers see together or not at all.

Tables, reports and models of one run are staged in a folder of their own. Publishing writes one small file, the manifest, which
names them all; readers follow the newest whole manifest. Whatever fails before leaves the release before it as it was, and staged
folders without a manifest are never read.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import SparkSession

from chartloom.session import file_system

_MANIFESTS = "_manifests"


def _numbered(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Number and path of every manifest, newest first."""
    system, folder = file_system(spark, f"{root}/{_MANIFESTS}")
    if not system.exists(folder):
        return []
    found = [(s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(folder)]
    return sorted(((int(name.removesuffix(".json")), path) for name, path in found if name.endswith(".json")), reverse=True)


def _read(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The outputs a manifest names; None if its writer did not finish."""
    system, target = file_system(spark, path)
    stream = system.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)["outputs"]
    except (ValueError, KeyError):
        return None


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """The paths of the newest release by name; empty before the first."""
    for _, path in _numbered(spark, root):
        outputs = _read(spark, path)
        if outputs is not None:
            return {name: f"{root}/{folder}" for name, folder in outputs.items()}
    return {}


class Release:
    """A set of outputs under ``root``: write each to ``path(name)``, then ``publish`` them as one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = f"release-{uuid4().hex}"
        self._names: list[str] = []

    def path(self, name: str) -> str:
        if name not in self._names:
            self._names.append(name)
        return f"{self.root}/{self._folder}/{name}"

    def publish(self) -> dict[str, str]:
        """Make the staged outputs the current ones. Every output must be there; of two publishers the later one wins."""
        for name in self._names:
            system, target = file_system(self.spark, self.path(name))
            if not system.exists(target):
                raise FileNotFoundError(f"{name} was never written")
        text = json.dumps({"outputs": {name: f"{self._folder}/{name}" for name in self._names}})
        while True:
            number = max((n for n, _ in _numbered(self.spark, self.root)), default=0) + 1
            system, target = file_system(self.spark, f"{self.root}/{_MANIFESTS}/{number:012d}.json")
            try:
                stream = system.create(target, False)  # fails if another publisher took the number
            except Exception:
                if not system.exists(target):
                    raise
                continue
            stream.write(bytearray(text, "utf-8"))
            stream.close()
            return {name: self.path(name) for name in self._names}
