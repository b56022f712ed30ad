"""Sorted hash arrays in files of the shared folder, which workers map into memory."""

from __future__ import annotations

import functools
import io as bytes_io

import numpy as np


def put(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays to the shared folder, each as one file that appears whole."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    for key, array in arrays.items():
        buffer = bytes_io.BytesIO()
        np.save(buffer, array)
        part = f"{path}/.{name}.{key}.{np.random.default_rng().integers(2**62)}"
        with store.open_output_stream(part) as out:
            out.write(buffer.getbuffer())
        store.move(part, f"{path}/{name}.{key}.npy")


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


@functools.lru_cache(maxsize=16)
def _fetched(folder: str, path: str) -> np.ndarray:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as source:
        return np.load(bytes_io.BytesIO(source.read()))


def get(folder: str, name: str, key: str) -> np.ndarray:
    """An array of the shared folder: mapped into memory where the folder is mounted, else read, a few at a time."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}.{key}.npy"
    return _mapped(path) if isinstance(store, fs.LocalFileSystem) else _fetched(folder, path)


def spread(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key: equal shares of the 64-bit space."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def find(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and which of them are there."""
    if not len(held):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.searchsorted(held, keys)
    place[place == len(held)] = 0
    return place, held[place] == keys
