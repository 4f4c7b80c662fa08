"""Small documents and plain files in the shared folder, from the driver or a task, whatever store it is in."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def read(path: str) -> dict | None:
    """The document, or None if there is none."""
    files, place = store(path)
    if files.get_file_info(place).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(place) as f:
        return json.loads(f.read())


def write(path: str, document: dict) -> None:
    """Puts the document in place in one step."""
    files, place = store(path)
    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(json.dumps(document, sort_keys=True).encode())
    files.move(part, place)


def names(path: str) -> list[str]:
    """Names in a folder, sorted; none if it doesn't exist."""
    files, place = store(path)
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(place, allow_not_found=True)))
