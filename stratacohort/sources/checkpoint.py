"""Model checkpoints: a folder on the driver becomes an archive in the shared folder under the hash of its content, which each executor fetches once."""
from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from . import scratch


def _files(path: str) -> Iterator[tuple[str, str]]:
    """(name within the folder, path) of each file, in order; a file stands for itself."""
    if os.path.isfile(path):
        yield os.path.basename(path), path
    for folder, folders, names in os.walk(path):
        folders.sort()
        for name in sorted(names):
            full = os.path.join(folder, name)
            yield os.path.relpath(full, path), full


def content_hash(path: str) -> str:
    """A hash of the names and contents of all files below path, wherever that lies."""
    found, out = list(_files(path)), hashlib.sha256()
    if not found:
        raise FileNotFoundError(f"no checkpoint at {path}")
    for name, full in found:
        with open(full, "rb") as file:
            out.update(name.encode() + b"\0" + hashlib.file_digest(file, "sha256").digest())
    return out.hexdigest()


class _Out:
    """A Hadoop stream as a file that zipfile can write."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def ship(spark: SparkSession, path: str) -> str:
    """The name under which executors find the folder's files: one archive in the shared folder, fetched once by each executor; the same content is shipped once."""
    name = f"checkpoint-{content_hash(path)[:24]}"
    archive = f"{scratch.shared(spark)}/{name}.zip"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(archive).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop(archive)):
        part = hadoop(f"{archive}.{uuid.uuid4().hex}")
        stream = system.create(part, True)
        with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED) as out:
            for inner, full in _files(path):
                out.write(full, inner)
        stream.close()
        system.rename(part, hadoop(archive))
    if not any(x.endswith(f"/{name}.zip") for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(archive)
    return name


def opened(name: str) -> str:
    """The folder of a shipped checkpoint on this machine, unpacked by whichever worker comes first."""
    archive = SparkFiles.get(f"{name}.zip")
    folder = os.path.join(os.path.dirname(archive), name)
    if not os.path.isdir(folder):
        own = tempfile.mkdtemp(dir=os.path.dirname(archive))
        with zipfile.ZipFile(archive) as packed:
            packed.extractall(own)
        try:
            os.rename(own, folder)
        except OSError:  # another worker was first
            shutil.rmtree(own, ignore_errors=True)
    return folder


def with_folder(load: Callable, path: str) -> Callable:
    """load(folder, device) as a load(device) that finds its folder where it runs."""
    name = ship(SparkSession.active(), path)
    return lambda device: load(opened(name), device)
