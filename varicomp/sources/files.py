"""Commits in a file system that all nodes share: folders that appear whole, and locks that lapse."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from varicomp.errors import LedgerError


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _children(fs, folder, start: str) -> list:
    if not fs.exists(folder):
        return []
    return [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(start)]


@contextmanager
def replaced(spark: SparkSession, path: str, overwrite: bool, error: type[Exception]) -> Iterator[str]:
    """A folder to write to, which takes the place of path once the block has ended well.

    Until then whatever is at path stays. Without overwrite an existing path is an error, also where it came up meanwhile.
    With it the old folder is moved aside before the new one is moved in, and moved back should that fail; a writer that
    dies between these two leaves the old one beside path, from where restored() brings it back.
    """
    fs, to = at(spark, path)
    if fs.exists(to) and not overwrite:
        raise error(f"{path} exists")
    name = uuid.uuid4().hex
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{to.getName()}.{kind}-{name}") for kind in ("new", "old"))
    try:
        yield new.toString()
        if fs.exists(to):
            if not overwrite:
                raise error(f"{path} exists")
            if not fs.rename(to, old):
                raise error(f"{path} cannot be moved aside")
        if not fs.rename(new, to):
            if fs.exists(old):
                fs.rename(old, to)
            raise error(f"{path} cannot be put in place")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def restored(spark: SparkSession, path: str) -> None:
    """Brings back what a writer that died in replaced() had moved aside; nothing where path exists."""
    fs, to = at(spark, path)
    if not fs.exists(to):
        left = _children(fs, to.getParent(), f"_{to.getName()}.old-")
        if left:
            fs.rename(max(left, key=lambda p: fs.getFileStatus(p).getModificationTime()), to)


class Lease:
    """A numbered claim to a folder. The claim with the highest number holds; it lapses where it is not renewed in time."""

    def __init__(self, spark: SparkSession, folder: str, number: int, seconds: float):
        self.spark, self.number, self.seconds = spark, number, seconds
        self.fs, self.folder = at(spark, folder)
        self.file = spark._jvm.org.apache.hadoop.fs.Path(self.folder, f"{number:012d}")

    def renew(self) -> None:
        if self.fs.exists(self.file):
            self.fs.setTimes(self.file, _now(self.spark), -1)

    def check(self) -> None:
        """An error where another writer took the folder over, as it may after a lapse."""
        if _latest(self.fs, self.folder)[0] != self.number or not self.fs.exists(self.file):
            raise LedgerError(f"claim {self.number} on {self.folder.getParent().toString()} has lapsed and is another job's now")


def _now(spark: SparkSession) -> int:
    return spark._jvm.java.lang.System.currentTimeMillis()


def _latest(fs, folder) -> tuple[int, object]:
    """The highest number claimed, and its file; 0 and None without claims."""
    found = {int(p.getName()): p for p in _children(fs, folder, "") if p.getName().isdigit()}
    return (max(found), found[max(found)]) if found else (0, None)


@contextmanager
def leased(spark: SparkSession, path: str, seconds: float = 600.0) -> Iterator[Lease]:
    """Holds path/_lock for one writer at a time.

    A claim is a file named by the next number, which only one writer can create: the number fences off those before it. It is
    renewed in the background; one that was not renewed for some seconds is taken to be a dead writer's. A claim that was
    given up stays as an empty record with the extension done until the next writer has claimed, so that numbers only rise.
    """
    fs, folder = at(spark, f"{path}/_lock")
    fs.mkdirs(folder)
    done = {int(p.getName().split(".")[0]) for p in _children(fs, folder, "") if p.getName().endswith(".done")}
    number, file = _latest(fs, folder)
    if file is not None and number not in done and _now(spark) - fs.getFileStatus(file).getModificationTime() < 1000 * seconds:
        raise LedgerError(f"another job works on {path}")
    lease = Lease(spark, f"{path}/_lock", number + 1, seconds)
    if not fs.createNewFile(lease.file):
        raise LedgerError(f"another job works on {path}")
    ended = threading.Event()

    def keep() -> None:
        while not ended.wait(seconds / 4):
            lease.renew()

    renewing = threading.Thread(target=keep, daemon=True)
    renewing.start()
    try:
        for p in _children(fs, folder, ""):
            if int(p.getName().split(".")[0]) < lease.number:
                fs.delete(p, False)
        yield lease
    finally:
        ended.set()
        renewing.join()
        fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{lease.number:012d}.done"))
