"""Folders whose content changes by versions: new files in folders of their own, and a small record that names them, written last.

A record is one file, ``_versions/0000000012``: a line of JSON. Readers take the highest whole one, so a writer that stops
at any point leaves the version before it in force, and readers that began earlier keep their files. Records are
created, never renamed or overwritten, which holds in file systems and object stores alike. A record without its line end is one
that a writer didn't finish; it is passed over. Of two writers that start from the same version, the later one fails.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

RECORDS = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed since."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        """keep: how many versions' folders stay, the present one included."""
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/{RECORDS}")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _read(self, number: int) -> dict[str, Any] | None:
        stream = self._files.open(self._at(f"{self.path}/{RECORDS}/{number:010d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The number and record of the present version; 0 and an empty record where there is none."""
        for number in self._numbers():
            if (record := self._read(number)) is not None:
                return number, record
        return 0, {}

    def folder(self, label: str) -> str:
        """A name for a new folder; relative, as records name folders."""
        return f"{label}-{uuid.uuid4().hex}"

    def full(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def commit(self, base: int, record: dict[str, Any]) -> int:
        """Make record the present version, if base still is. Its ``folders`` are the folders it needs; folders that no kept version names are deleted."""
        if self.latest()[0] != base:
            raise Conflict(f"{self.path} is no longer at version {base}")
        number = max([base, *self._numbers()]) + 1
        self._write(number, json.dumps(record, ensure_ascii=False) + "\n")
        self._clean(number)
        return number

    def _write(self, number: int, line: str) -> None:
        name = self._at(f"{self.path}/{RECORDS}/{number:010d}")
        try:
            stream = self._files.create(name, False)
        except Exception as e:
            if self._files.exists(name):
                raise Conflict(f"version {number} of {self.path} is being written by another") from e
            raise
        stream.write(bytearray(line.encode()))
        stream.close()

    def _clean(self, number: int) -> None:
        """Delete folders that older versions name and kept ones don't. Folders that no record names may be a running writer's; they stay."""
        whole = [(n, r) for n in self._numbers() if n <= number and (r := self._read(n)) is not None]
        kept, gone = whole[: self.keep], whole[self.keep :]
        needed = {f for _, r in kept for f in r.get("folders", [])}
        for n, record in gone:
            for folder in set(record.get("folders", [])) - needed:
                self._files.delete(self._at(self.full(folder)), True)
            self._files.delete(self._at(f"{self.path}/{RECORDS}/{n:010d}"), False)
