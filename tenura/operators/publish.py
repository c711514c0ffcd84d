"""Versions of a set of tables: readers always find a whole one, and keep it while they read.

Below a root, versions/<name> holds a version's folders and its manifest, and
commits/<name> is an empty file that makes it count. The name begins with a number;
the commit of the highest number is current. Making one file is a single step, so that
there is no moment without a current version, nor one with half of it: what a crash
leaves has no commit and is never read.

A reader leases a version before it reads. Cleaning takes a version's commit away
first and looks for leases then; a reader makes its lease first and then looks whether
the commit is still there. One of the two sees the other.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from tenura.operators.promote import _fs, read_report, write_report

#: Seconds after which a lease that wasn't given back no longer counts.
LEASE_SECONDS = 3600


class Publication:
    """The versions below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.fs, self._path = _fs(spark, root)

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        with contextlib.suppress(Exception):  # a folder that isn't there, or goes meanwhile
            return sorted(s.getPath().getName() for s in self.fs.listStatus(place))
        return []

    def _empty(self, at: str) -> bool:
        """Whether this empty file could be made; it never takes the place of another."""
        try:
            self.fs.create(self._path(at), False).close()
        except Exception:
            if self.fs.exists(self._path(at)):
                return False
            raise
        return True

    def commits(self) -> list[str]:
        return [n for n in self._names("commits") if not n.startswith(("_", "."))]

    def current(self) -> str | None:
        """The version that counts now; None before the first."""
        found = self.commits()
        return found[-1] if found else None

    def folder(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def manifest(self, version: str) -> dict:
        return read_report(self.spark, f"{self.folder(version)}/manifest.json")

    def claimed(self, mark: str) -> str:
        """The name of a new version, under a number that no other writer has."""
        numbers = [int(n.split("-")[0]) for folder in ("claims", "commits") for n in self._names(folder)]
        number = max(numbers, default=0) + 1
        while not self._empty(f"{self.root}/claims/{number:08d}"):
            number += 1
        return f"{number:08d}-{mark[:12]}"

    def commit(self, version: str, manifest: dict) -> None:
        """Make a written version the current one."""
        write_report(self.spark, manifest, f"{self.folder(version)}/manifest.json")
        if not self._empty(f"{self.root}/commits/{version}"):
            raise OSError(f"{version} is committed already")

    @contextlib.contextmanager
    def writing(self, mark: str) -> Iterator[str]:
        """A new version, leased while it is written; what isn't committed at the end is deleted."""
        version = self.claimed(mark)
        lease = self._lease(version)
        try:
            yield version
        finally:
            if version not in self.commits():
                self.fs.delete(self._path(self.folder(version)), True)
            self.fs.delete(lease, True)

    def _lease(self, version: str, seconds: float = LEASE_SECONDS):
        at = f"{self.root}/leases/{version}/{int(time.time() + seconds)}-{uuid.uuid4().hex}"
        self._empty(at)
        return self._path(at)

    @contextlib.contextmanager
    def reading(self, seconds: float = LEASE_SECONDS) -> Iterator[str]:
        """The current version, which stays until the end, for as many seconds at most."""
        while True:
            version = self.current()
            if version is None:
                raise FileNotFoundError(f"{self.root} has no version")
            lease = self._lease(version, seconds)
            if version in self.commits():
                break
            self.fs.delete(lease, True)
        try:
            yield version
        finally:
            self.fs.delete(lease, True)

    def leased(self) -> set[str]:
        """Versions with a lease that hasn't run out."""
        now = time.time()
        return {v for v in self._names("leases") if any(int(n.split("-")[0]) > now for n in self._names(f"leases/{v}"))}

    def clean(self, keep: int = 2) -> list[str]:
        """Delete versions but for the last ones, those under a lease, and those whose folders they use; the names of the deleted."""
        commits = self.commits()
        last = commits[-keep:]
        for version in commits[:-keep]:
            self.fs.delete(self._path(f"{self.root}/commits/{version}"), False)
        wanted = {*last, *self.leased()}
        for version in list(wanted):
            if self.fs.exists(self._path(f"{self.folder(version)}/manifest.json")):
                wanted |= set(self.manifest(version).get("uses", []))
        number = last[-1] if last else ""
        gone = [v for v in self._names("versions") if v not in wanted and v < number]
        for version in gone:
            self.fs.delete(self._path(self.folder(version)), True)
            self.fs.delete(self._path(f"{self.root}/leases/{version}"), True)
        return gone
