"""Files that tasks write to, and memory-map from, the folder all nodes share.

The folder is the one that ``spark.checkpoint.dir`` names.  On a mounted share (``file:``
or no scheme) the files are mapped in place.  In any other store they are read through
``pyarrow.fs`` once per Python worker into an anonymous map.  Each file is written under a
temporary name and renamed, so a task that is run twice, or is lost half-way, leaves one
whole file.  Results read these folders when they are computed, so the driver removes them as
it ends.
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession


_made: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder.  Where none is named, local mode makes one of its own and a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cadenza-")
        _made.append(base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    uri = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (path := local(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    _made.append(uri)
    return uri


@atexit.register
def remove_folders() -> None:
    """Delete the folders that this driver has made."""
    while _made:
        uri = _made.pop()
        if (path := local(uri)) is not None:
            shutil.rmtree(path, ignore_errors=True)
            continue
        from pyarrow import fs

        try:
            store, path = fs.FileSystem.from_uri(uri)
            store.delete_dir(path)
        except OSError:  # gone already, or the store is
            pass


def local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write(uri: str, arrays: dict[str, np.ndarray], meta: dict | None = None) -> None:
    """Write named arrays as one file: a JSON header, then the arrays at 8-byte steps."""
    at, index = 0, {}
    for k, v in arrays.items():
        index[k] = [v.dtype.str, at, len(v)]
        at += -(-v.nbytes // 8) * 8
    head = json.dumps({"arrays": index, "meta": meta or {}}).encode()
    head += b" " * (-len(head) % 8)
    path = local(uri)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        out = store.open_output_stream(temp := f"{path}.{uuid.uuid4().hex}")
    else:
        store, out = None, open(temp := f"{path}.{uuid.uuid4().hex}", "wb")
    with out:
        out.write(np.int64(len(head)).tobytes())
        out.write(head)
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes())
            out.write(bytes(-v.nbytes % 8))
    if store is None:
        os.replace(temp, path)
    else:
        store.move(temp, path)


_held: OrderedDict = OrderedDict()  # uri: (arrays, meta, bytes of memory)
HELD_FILES, HELD_BYTES = 4096, 256 << 20


def mapped(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, meta) of a file, memory-mapped.

    A worker keeps the files used last, at most HELD_FILES of them, and of those that had to be read HELD_BYTES.
    """
    if uri in _held:
        _held.move_to_end(uri)
        return _held[uri][:2]
    arrays, meta, size = _open(uri)
    _held[uri] = arrays, meta, size
    total = sum(x[2] for x in _held.values()) if size else 0
    while len(_held) > 1 and (len(_held) > HELD_FILES or total > HELD_BYTES):
        total -= _held.popitem(last=False)[1][2]
    return arrays, meta


def _open(uri: str) -> tuple[dict[str, np.ndarray], dict, int]:
    path, size = local(uri), 0
    if path is not None:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        data = store.open_input_file(path).read()
        size = len(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: np.frombuffer(data, np.dtype(t), count, 8 + n + at) for k, (t, at, count) in head["arrays"].items()}, head["meta"], size
