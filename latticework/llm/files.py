"""Files that tasks write to and read from the shared folder, by any scheme that pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def attempt_name(folder: str, partition: int, suffix: str) -> str:
    """A name of its own for each attempt of a task: only the files that the kept attempts report count."""
    return f"{folder}/part-{partition:06d}-{uuid.uuid4().hex[:12]}.{suffix}"


def write_all(path: str, data: bytes) -> None:
    system, where = opened(path)
    with system.open_output_stream(where, compression=None) as out:
        out.write(data)


def read_range(path: str, at: int, size: int) -> bytes:
    system, where = opened(path)
    with system.open_input_file(where) as f:
        return f.read_at(size, at)


def made_folder(folder: str) -> str:
    system, where = opened(folder)
    system.create_dir(where, recursive=True)
    return folder
