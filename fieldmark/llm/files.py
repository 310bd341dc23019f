"""Binary files in the shared folder that workers write whole and map into memory."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(path: str) -> str | None:
    """The path that the operating system knows, if the shared folder is mounted."""
    if "://" not in path and not path.startswith("file:"):
        return path
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else None


def write_file(path: str, data: bytes) -> None:
    """Put in place whole, so that a repeated attempt does no harm."""
    local = local_path(path)
    if local is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    temporary = f"{local}.{os.urandom(8).hex()}"
    with open(temporary, "wb") as out:
        out.write(data)
    os.replace(temporary, local)


def map_file(path: str) -> np.ndarray | None:
    """The bytes of a file: mapped, or read whole if the store is not mounted; None if there is
    no such file."""
    local = local_path(path)
    if local is not None:
        return np.memmap(local, np.uint8, "r") if os.path.exists(local) else None
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(inner) as f:
        return np.frombuffer(f.read(), np.uint8)
