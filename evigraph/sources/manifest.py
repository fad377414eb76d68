"""Numbered manifests: small JSON files that name the folders of a state, only ever created.

Readers take the whole manifest of the highest number; half of one (its writer has not ended, or died) is passed over.
Of two writers of one revision the second finds the file there and fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import Conflict


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def create(self, path: str, content: dict, replace: bool = False) -> None:
        """Write JSON to a path that, unless it may be replaced, isn't there yet."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(path), replace)
        except Py4JJavaError as e:
            raise Conflict(f"{path} is there already") from e
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time) of the files of a folder, or of a file, by name; the path may be in another store than the manifests."""
        at = self._path(path)
        fs = at.getFileSystem(self._conf)
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, highest first."""
        names = [n for n, _, _ in self.files(f"{self.root}/manifests")]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def read(self) -> dict | None:
        for n in self._numbers():
            try:
                return json.loads(self.text(f"{self.root}/manifests/{n:012d}.json"))
            except ValueError:
                continue
        return None

    def publish(self, manifest: dict) -> None:
        """Create the manifest of the next number; ``revision`` must be new."""
        number = max([*self._numbers()[:1], manifest["revision"] - 1]) + 1
        if number != manifest["revision"] and (self.read() or {"revision": 0})["revision"] >= manifest["revision"]:
            raise Conflict(f"revision {manifest['revision']} is there already")
        self.create(f"{self.root}/manifests/{number:012d}.json", manifest)
