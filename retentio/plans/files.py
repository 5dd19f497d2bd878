"""Files of the shared folder, as tasks reach them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # runs in Python workers


def filesystem(uri: str):
    """(file system, path) of a folder that all executors reach (local, HDFS or object store)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def parquet_files(uri: str) -> tuple[object, list[str]]:
    """The file system and the Parquet files of a written table, in the order of their names."""
    from pyarrow import fs as pafs

    fs, folder = filesystem(uri)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet"))
