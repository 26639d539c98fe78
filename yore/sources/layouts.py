"""Finding exports on a disk by what they look like. A layout is a set of conditions on one folder or file; cheap ones are tried first.

This is for the machine that plans a job: it looks at names and at the first bytes of files, in whatever storage Spark
reads, and what it finds is then read by Spark.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

HEAD, LONG_HEAD, DEPTH = 4096, 65536, 8


class Place:
    """A folder or file of a storage, seen through the session's file systems."""

    def __init__(self, files, status, path: str):
        self._files, self._status, self.path = files, status, path
        self.name = status.getPath().getName()

    @classmethod
    def at(cls, session: SparkSession, path: str) -> Place:
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(session._jsc.hadoopConfiguration())
        return cls(files, files.getFileStatus(where), path.rstrip("/"))

    def is_dir(self) -> bool:
        return self._status.isDirectory()

    def is_link(self) -> bool:
        at = self._status.getPath()
        return self._status.isSymlink() or at.toUri().getScheme() == "file" and os.path.islink(at.toUri().getPath())

    def inner(self) -> list[Place]:
        """What is in a folder, by name."""
        found = [Place(self._files, x, f"{self.path}/{x.getPath().getName()}") for x in self._files.listStatus(self._status.getPath())] if self.is_dir() else []
        return sorted(found, key=lambda p: p.name)

    def holds(self, relative: str) -> bool:
        """Whether a folder has something at a path, in which * and ? stand for parts of names."""
        here = [self]
        for step in relative.split("/"):
            here = [x for p in here for x in p.inner() if fnmatch.fnmatchcase(x.name, step)]
        return bool(here)

    def head(self, size: int) -> str:
        """The text of a file's first bytes; of a folder none."""
        if self.is_dir():
            return ""
        stream = self._files.open(self._status.getPath())
        try:
            return bytes(stream.readNBytes(size)).decode("utf-8", "replace").removeprefix("\ufeff")
        finally:
            stream.close()


@dataclass(frozen=True)
class Condition:
    """cost orders conditions: 0 looks at the name, 1 at the folder, 2 at the first bytes, 3 at more of them."""

    cost: int
    holds: Callable[[Place], bool]


def name(glob: str) -> Condition:
    return Condition(0, lambda p: fnmatch.fnmatch(p.name.lower(), glob.lower()))


def holds_path(relative: str) -> Condition:
    """A folder with such a file or folder in it."""
    return Condition(1, lambda p: p.is_dir() and p.holds(relative))


def head(self, size: int) -> str:
        """The text of a file's first bytes; of a folder none."""
        if self.is_dir():
            return ""
        stream = self._files.open(self._status.getPath())
        try:
            return bytes(stream.readNBytes(size)).decode("utf-8", "replace").removeprefix("\ufeff")
        finally:
            stream.close()


@dataclass(frozen=True)
class Condition:
    """cost orders conditions: 0 looks at the name, 1 at the folder, 2 at the first bytes, 3 at more of them."""

    cost: int
    holds: Callable[[Place], bool]


def name(glob: str) -> Condition:
    return Condition(0, lambda p: fnmatch.fnmatch(p.name.lower(), glob.lower()))


def holds_path(relative: str) -> Condition:
    """A folder with such a file or folder in it."""
    return Condition(1, lambda p: p.is_dir() and p.holds(relative))


def _head(p: Path, size: int) -> str:
    if not p.is_file():
        return ""
    with open(p, "rb") as f:
        return f.read(size).decode("utf-8", "replace").removeprefix("﻿")


def head(pattern: str) -> Condition:
    """A file whose first bytes match; more are read only if the first few do not."""
    found = re.compile(pattern)
    return Condition(2, lambda p: any(found.search(p.head(n)) for n in (HEAD, LONG_HEAD)))


def columns(*names: str) -> Condition:
    """A CSV file with all of these columns."""
    return Condition(3, lambda p: set(names) <= set(next(csv.reader(io.StringIO(p.head(HEAD))), [])))


def mail(*headers: str) -> Condition:
    """An mbox file whose first message has all of these headers."""

    def holds(p: Place) -> bool:
        text = p.head(LONG_HEAD)
        first = re.split(r"\r?\n\r?\n", text, maxsplit=1)[0]
        return text.startswith("From ") and all(re.search(rf"(?im)^{re.escape(h)}:", first) for h in headers)

    return Condition(3, holds)


def either(*some: Condition) -> Condition:
    return Condition(max(c.cost for c in some), lambda p: any(c.holds(p) for c in sorted(some, key=lambda c: c.cost)))


def neither(one: Condition) -> Condition:
    return Condition(one.cost, lambda p: not one.holds(p))


def fits(path: Place, conditions: list[Condition]) -> bool:
    """Whether all conditions hold, the cheapest first."""
    return all(c.holds(path) for c in sorted(conditions, key=lambda c: c.cost))


def find(root: str, layouts: dict[str, list[Condition]], depth: int = DEPTH, session: SparkSession | None = None) -> Iterator[tuple[str, str]]:
    """(layout, path) of every folder and file under root that a layout fits, at most `depth` folders down, in the order of paths. What is in a folder that fits belongs to it and is not looked at; links are not followed."""

    def walk(place: Place, left: int) -> Iterator[tuple[str, str]]:
        found = [kind for kind, conditions in layouts.items() if fits(place, conditions)]
        if found:
            yield from ((kind, place.path) for kind in found)
        elif left and place.is_dir() and not place.is_link():
            for inner in place.inner():
                yield from walk(inner, left - 1)

    yield from walk(Place.at(session or SparkSession.active(), root), depth)
