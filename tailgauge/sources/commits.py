"""One commit file makes a set of written folders visible together."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

FOLDER = "_commits"


class CommitLog:
    """Numbered commit files below a root; the newest one names the folders that readers see.

    Folders are immutable and have names of their own, so readers of an older
    commit are not disturbed, a failure before the commit leaves only folders that
    nothing names, and tables that change together change in one step: the rename
    of the commit file.  One writer at a time; a second one fails instead of
    replacing a commit.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/{FOLDER}")
        if not self._files.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d{12}\.json", n))

    def _name(self, version: int) -> str:
        return f"{self.root}/{FOLDER}/v{version:012d}.json"

    def read(self, version: int | None = None) -> dict | None:
        """The newest commit, or the given one; None before the first."""
        known = self.versions()
        if not known:
            return None
        text = self.spark.read.text(self._name(known[-1] if version is None else version), wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, content: dict) -> int:
        """Make ``content`` the newest commit and return its number."""
        version = (self.versions() or [0])[-1] + 1
        draft = self._path(f"{self.root}/{FOLDER}/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        final = self._path(self._name(version))
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"commit {version} of {self.root} was made by someone else")
        return version

    def fresh_folder(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex}"
