"""Bytes of an address, whole or an error: sizes are checked, broken transfers go on where they ended, three tries."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from urllib.parse import urlsplit

#: Tries of a request, seconds before the second one (doubled each time), and seconds without an answer.
TRIES, WAIT, TIMEOUT = 3, 0.5, 60.0


class Incomplete(OSError):
    """Fewer bytes than the server had announced."""


def _web(url: str, have: bytearray, timeout: float) -> None:
    """Append to ``have`` what is missing; what an unwilling server sends from the start takes its place."""
    begin = len(have)
    request = urllib.request.Request(url, headers={"Range": f"bytes={begin}-"} if begin else {})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if begin and answer.status != 206:
            have.clear()
        length = answer.headers.get("Content-Length")
        whole = len(have) + int(length) if length else None
        while part := answer.read(1 << 20):
            have += part
    if whole is not None and len(have) != whole:
        raise Incomplete(f"{url}: {len(have)} of {whole} bytes")


def _stored(url: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url) if re.match(r"\w+:", url) else (fs.LocalFileSystem(), url)
    info = store.get_file_info(path)
    if info.type == fs.FileType.Directory:
        parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
        return b"\n".join(_whole(store, p) for p in parts)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(url)
    return _whole(store, path)


def _whole(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        data = f.read()
    if (size := store.get_file_info(path).size) is not None and len(data) != size:
        raise Incomplete(f"{path}: {len(data)} of {size} bytes")
    return data


def fetch(url: str, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT) -> bytes | None:
    """All bytes of a web address, a file, or the files of a folder (joined by line ends) in any store that Arrow reads; None where there is nothing (404, no such file).

    A transfer that ends early is asked for the rest (a range request); whatever still fails after ``tries`` is an error.
    """
    have = bytearray()
    for left in range(tries - 1, -1, -1):
        try:
            if urlsplit(url).scheme in ("http", "https"):
                _web(url, have, timeout)
                return bytes(have)
            return _stored(url)
        except FileNotFoundError:
            return None
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code == 416:  # nothing is left to send
                return bytes(have)
            if not left or e.code < 500 and e.code != 429:
                raise
        except (OSError, EOFError):
            if not left:
                raise
        time.sleep(wait)
        wait *= 2
    return None


def opened(url: str):
    """A file of a store that Arrow reads, for random access; nothing of it is read as yet."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url) if re.match(r"\w+:", url) else (fs.LocalFileSystem(), url)
    return store.open_input_file(path)


def fetch_range(url: str, begin: int, size: int, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT) -> bytes:
    """``size`` bytes from ``begin`` on (fewer at the end) of a web address or a stored file: only these are asked for.

    A server that answers with another range, or whole, is an error if it sends too little, and read up to what was asked for.
    """
    if urlsplit(url).scheme not in ("http", "https"):
        with opened(url) as f:
            f.seek(begin)
            return f.read(size)
    for left in range(tries - 1, -1, -1):
        try:
            request = urllib.request.Request(url, headers={"Range": f"bytes={begin}-{begin + size - 1}"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                skip = 0 if answer.status == 206 else begin
                data = answer.read(skip + size)[skip:]
                length = answer.headers.get("Content-Length")
                if length and len(data) < min(size, int(length) - skip):
                    raise Incomplete(f"{url}: {len(data)} bytes from {begin} on")
                return data
        except urllib.error.HTTPError as e:
            if not left or e.code < 500 and e.code != 429:
                raise
        except (OSError, EOFError):
            if not left:
                raise
        time.sleep(wait)
        wait *= 2
    return b""


def listed(url: str, suffix: str) -> list[str]:
    """The files of a folder whose names end so, in order; a web address or a file is its own."""
    from pyarrow import fs

    if urlsplit(url).scheme in ("http", "https"):
        return [url]
    store, path = fs.FileSystem.from_uri(url) if re.match(r"\w+:", url) else (fs.LocalFileSystem(), url)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(url)
    if info.type != fs.FileType.Directory:
        return [url]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.lower().endswith(suffix) and f.base_name[0] not in "._")
    return [f"{url.rstrip('/')}/{n}" for n in names]
