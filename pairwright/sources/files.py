"""Byte ranges of files in a shared store, for drivers and executors alike."""

from __future__ import annotations

import os
from contextlib import contextmanager


def _local(path: str) -> str | None:
    scheme, _, rest = path.partition(":")
    if not rest:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


@contextmanager
def opened(path: str, mode: str = "rb"):
    """A file: by plain IO where the store is mounted, by Arrow's file systems elsewhere."""
    if (local := _local(path)) is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, mode) as f:
            yield f
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        if mode == "wb":
            store.create_dir(os.path.dirname(name), recursive=True)
        with store.open_output_stream(name, compression=None) if mode == "wb" else store.open_input_file(name) as f:
            yield f


def listed(path: str) -> list[tuple[str, int]]:
    """Files of a folder, by name, with their sizes; or the one file itself. Hidden files don't count."""
    if (local := _local(path)) is not None:
        found = [local]
        if os.path.isdir(local):
            found = [os.path.join(local, n) for n in sorted(os.listdir(local)) if n[0] not in "._"]
        return [(f, os.path.getsize(f)) for f in found]
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    scheme = path.partition("://")[0]
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [(f"{scheme}://{x.path.lstrip('/')}" if scheme != "hdfs" else path.partition(name)[0] + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


class Joined:
    """The files of a folder as one run of bytes."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files, self.size = files, sum(n for _, n in files)

    def read(self, at: int, n: int) -> bytes:
        out, n = [], max(0, min(n, self.size - at))
        for path, size in self.files:
            if at < size and n:
                with opened(path) as f:
                    f.seek(at)
                    out.append(f.read(min(n, size - at)))
                n -= len(out[-1])
                at += len(out[-1])
            at -= size
            if not n:
                break
        return b"".join(out)
