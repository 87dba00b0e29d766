"""Files that tasks write to and read from the shared folder, whatever store it lies in.

A task writes under a name of its own attempt and reports it in the rows that it returns. Only names in the stored manifest count,
so a second attempt of a lost task never meets the first one's file.
"""

import uuid

from pyarrow import fs


def create_folder(uri: str) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)


def attempt_name(folder: str, task: int, suffix: str) -> str:
    return f"{folder}/part-{task:06d}-{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path)


def open_input(uri: str):
    """Random access: `read_at(nbytes, offset)` and `size()`."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
