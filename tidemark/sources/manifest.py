"""Versioned manifests: which files make up a dataset, in order, with their bounds; and its key-value metadata.

A version is one JSON file, numbered, that is created and never changed; a commit is the creation of the next number, which
only one writer can do. Readers take the highest number, so they neither lock nor see half a commit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import date, datetime

from tidemark.sources.fs import FileSystem

FOLDER = "_manifest"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this one read the dataset."""


def encode(value):
    """A JSON form that keeps the type of timestamps and dates."""
    if isinstance(value, datetime):
        return {"timestamp": value.isoformat()}
    if isinstance(value, date):
        return {"date": value.isoformat()}
    if isinstance(value, dict):
        return {"map": [[encode(k), encode(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return [encode(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if hasattr(value, "item"):
        return encode(value.item())
    raise TypeError(f"cannot keep a {type(value).__name__} as metadata")


def decode(value):
    if isinstance(value, list):
        return [decode(v) for v in value]
    if isinstance(value, dict):
        if "timestamp" in value:
            return datetime.fromisoformat(value["timestamp"])
        if "date" in value:
            return date.fromisoformat(value["date"])
        return {decode(k): decode(v) for k, v in value["map"]}
    return value


@dataclass(frozen=True)
class DataFile:
    """A parquet file: its path under the dataset, rows, and least and greatest value of the ordering column."""

    path: str
    rows: int
    low: object
    high: object


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    ordered_on: str | None = None
    schema: str | None = None
    files: tuple[DataFile, ...] = ()
    metadata: dict = field(default_factory=dict)

    def text(self) -> str:
        files = [{"path": f.path, "rows": f.rows, "low": encode(f.low), "high": encode(f.high)} for f in self.files]
        return json.dumps({"ordered_on": self.ordered_on, "schema": self.schema, "files": files, "metadata": encode(self.metadata)})

    @classmethod
    def parse(cls, version: int, text: str) -> Manifest:
        raw = json.loads(text)
        files = tuple(DataFile(f["path"], f["rows"], decode(f["low"]), decode(f["high"])) for f in raw["files"])
        return cls(version, raw["ordered_on"], raw["schema"], files, decode(raw["metadata"]))

    def with_metadata(self, changes: dict | None) -> Manifest:
        """Adds and updates keys; a value of None removes its key."""
        if not changes:
            return self
        merged = {**self.metadata, **changes}
        return replace(self, metadata={k: v for k, v in merged.items() if v is not None})

    def checked(self) -> Manifest:
        for a, b in zip(self.files, self.files[1:], strict=False):
            if a.low > a.high or b.low < a.high:
                raise ValueError(f"files {a.path} and {b.path} overlap")
        return self


def latest(fs: FileSystem, path: str) -> Manifest | None:
    versions = [n for n in fs.names(f"{path}/{FOLDER}") if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return None
    return Manifest.parse(int(versions[-1][:-5]), fs.read(f"{path}/{FOLDER}/{versions[-1]}"))


def commit(fs: FileSystem, path: str, manifest: Manifest) -> Manifest:
    """Makes the manifest the version after its own; ConcurrentCommit where that exists."""
    following = replace(manifest.checked(), version=manifest.version + 1)
    if not fs.create(f"{path}/{FOLDER}/{following.version:012d}.json", following.text()):
        raise ConcurrentCommit(f"{path} has a version {following.version} already")
    return following
