"""Written results named by what they are made of, each built by one process.

An artifact (a prepared table, a fitted model with its search) lies under
``<checkpoint folder>/store/<key>``. The key is a hash of the input files, the
settings and the code, so any session that sees the folder finds the result of
any other, and changed inputs or code give another key.

* ``claim``: created only if it is not there, by the process that builds. It
  holds the owner's name and a beat, rewritten while the owner lives. Others
  wait for the result; if the beat stands still for ``LEASE_S`` seconds of
  their own clock, the owner is taken for dead and the claim is free again.
* ``data-<owner>``: what the owner writes.
* ``published``: the name of the finished folder, written to a temporary name and
  renamed, after everything else. Only what it names is ever read. Two builders
  (possible after a claim was taken over) cost time and nothing else: the first
  published folder stays.

Folders that no ``published`` names are left by dead owners; the next owner of
the key removes them, and ``sweep`` does so for the whole store.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from importlib import resources

from pyspark.sql import SparkSession

from retentio.session import ensure_checkpoint_dir

BEAT_S, LEASE_S, POLL_S = 2.0, 30.0, 0.5


# Another folder than the shared one, if set: the bench times stages that are really built.
ROOT: str | None = None


def store_root(spark: SparkSession) -> str:
    """``store`` in the configured checkpoint folder, above the folder Spark made in it for this session."""
    return ROOT or f"{os.path.dirname(ensure_checkpoint_dir(spark).rstrip('/'))}/store"


def code_version() -> str:
    """Hash of the package's own sources, the training-data subpackage left out."""
    h = hashlib.sha256()

    def walk(folder, name: str) -> None:
        for item in sorted(folder.iterdir(), key=lambda i: i.name):
            if item.is_dir():
                if item.name not in ("llm", "__pycache__"):
                    walk(item, f"{name}/{item.name}")
            elif item.name.endswith(".py"):
                h.update(f"{name}/{item.name}".encode())
                h.update(item.read_bytes())

    walk(resources.files("retentio"), "")
    return h.hexdigest()


_CODE: list[str] = []


def artifact_key(*parts) -> str:
    """A key of the given parts and the code version."""
    if not _CODE:
        _CODE.append(code_version())
    return hashlib.sha256(json.dumps([*parts, _CODE[0]], default=str).encode()).hexdigest()[:32]


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None, lease_s: float = LEASE_S):
        self.root = (root or store_root(spark)).rstrip("/")
        self.lease_s, self.beat_s = lease_s, min(BEAT_S, lease_s / 8)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _local(self, path: str) -> str | None:
        """The path on a local disk, whose Hadoop file system has no atomic create; None for any other."""
        return str(self._path(path).toUri().getPath()) if self._fs.getScheme() == "file" else None

    def _read(self, path: str) -> str | None:
        local = self._local(path)
        if local:
            try:
                with open(local) as f:
                    return f.read()
            except FileNotFoundError:
                return None
        try:
            stream = self._fs.open(self._path(path))
        except Exception as e:  # noqa: BLE001
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str, overwrite: bool) -> bool:
        """Whether the file was written; without ``overwrite`` only if it was not there."""
        local = self._local(path)
        if local:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                with open(local, "w" if overwrite else "x") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = self._fs.create(self._path(path), overwrite)
        except Exception as e:  # noqa: BLE001
            if not overwrite and "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _rename(self, source: str, target: str) -> None:
        if self._local(source):
            os.replace(self._local(source), self._local(target))
        else:
            self._fs.rename(self._path(source), self._path(target))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def published(self, key: str) -> str | None:
        """The folder of a finished artifact, or None."""
        name = self._read(f"{self.root}/{key}/published")
        path = f"{self.root}/{key}/{name}" if name else None
        return path if path and self._fs.exists(self._path(path)) else None

    def get(self, key: str, build: Callable[[str], None]) -> str:
        """The folder of ``key``; if nobody has built it, ``build(folder)`` here, else wait for who does."""
        folder, owner = f"{self.root}/{key}", uuid.uuid4().hex
        seen, since = None, time.monotonic()
        while True:
            done = self.published(key)
            if done:
                return done
            if self._write(f"{folder}/claim", f"{owner} 0", overwrite=False):
                return self._build(key, owner, build)
            beat = self._read(f"{folder}/claim")
            if beat != seen:
                seen, since = beat, time.monotonic()
            elif time.monotonic() - since > self.lease_s:
                self._delete(f"{folder}/claim")
                seen, since = None, time.monotonic()
            time.sleep(POLL_S)

    def _build(self, key: str, owner: str, build: Callable[[str], None]) -> str:
        folder = f"{self.root}/{key}"
        data, ended = f"{folder}/data-{owner}", threading.Event()

        def beat() -> None:
            n = 0
            while not ended.wait(self.beat_s):
                n += 1
                held = self._read(f"{folder}/claim")
                if held is not None and not held.startswith(owner):
                    return  # taken over
                self._write(f"{folder}/claim", f"{owner} {n}", overwrite=True)

        beats = threading.Thread(target=beat, daemon=True)
        beats.start()
        try:
            if not self.published(key):  # finished between the look and the claim
                build(data)
                if not self.published(key):
                    self._write(f"{folder}/pointer-{owner}", f"data-{owner}", overwrite=True)
                    self._rename(f"{folder}/pointer-{owner}", f"{folder}/published")
        finally:
            ended.set()
            beats.join()
            done = self.published(key)
            if done != data:
                self._delete(data)
            self._leave(folder, owner, done)
        if done is None:
            raise OSError(f"{folder}: nothing was published")
        return done

    def _leave(self, folder: str, owner: str, done: str | None) -> None:
        """Remove what dead owners left, then the claim; nothing if the claim is another's by now."""
        held = self._read(f"{folder}/claim")
        if held is not None and not held.startswith(owner):
            return
        if done:
            self._remove_unnamed(folder, os.path.basename(done))
        self._delete(f"{folder}/claim")

    def _remove_unnamed(self, folder: str, name: str | None) -> list[str]:
        gone = []
        for item in self._fs.listStatus(self._path(folder)):
            base = str(item.getPath().getName())
            if base.startswith(("data-", "pointer-")) and base != name:
                self._delete(f"{folder}/{base}")
                gone.append(f"{folder}/{base}")
        return gone

    def sweep(self) -> list[str]:
        """Remove all folders without a claim that no ``published`` names; returns them.

        A claim whose beat does not move for the lease counts as none.
        """
        if not self._fs.exists(self._path(self.root)):
            return []
        folders = [f"{self.root}/{item.getPath().getName()}" for item in self._fs.listStatus(self._path(self.root))]
        beats = {f: self._read(f"{f}/claim") for f in folders}
        held = [f for f in folders if beats[f] is not None]
        if held:
            time.sleep(self.lease_s)
        gone = []
        for f in folders:
            now = self._read(f"{f}/claim")
            if now is not None and now != beats[f]:
                continue  # a living owner
            if now is not None:
                self._delete(f"{f}/claim")
            gone += self._remove_unnamed(f, self._read(f"{f}/published"))
        return gone
