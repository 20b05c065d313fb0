"""Places of bytes: local files, memory, HTTP; and random access to them."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (parent, leaf): the leaf is what follows the last inner slash (fixed pattern).
SPLIT = r"^(.*)/([^/]+/?)$"


def split_path(path: str) -> tuple[str, str] | None:
    m = re.match(SPLIT, path)
    return (m[1], m[2]) if m else None


def split_path_column(path: Column) -> Column:
    """Struct (parent, leaf), null where there is no slash to split at."""
    return F.when(path.rlike(SPLIT), F.struct(F.regexp_extract(path, SPLIT, 1).alias("parent"), F.regexp_extract(path, SPLIT, 2).alias("leaf")))


class Access:
    """Random access to bytes."""

    def length(self) -> int:
        raise NotImplementedError

    def _read(self, offset: int, length: int) -> bytes:
        raise NotImplementedError

    def read(self, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``offset`` on; fewer at the end."""
        if offset < 0 or length < 0:
            raise ValueError("offset and length aren't negative")
        n = max(0, min(length, self.length() - offset))
        return self._read(offset, n) if n else b""


class MemoryAccess(Access):
    def __init__(self, data: bytes):
        self.data = bytes(data)

    def length(self) -> int:
        return len(self.data)

    def _read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


class FileAccess(Access):
    def __init__(self, path: str | Path):
        self.path = Path(path)
        if not self.path.is_file():
            raise FileNotFoundError(path)

    def length(self) -> int:
        return self.path.stat().st_size

    def _read(self, offset: int, length: int) -> bytes:
        with self.path.open("rb") as f:
            f.seek(offset)
            return f.read(length)


class HttpAccess(Access):
    """Ranged GETs. The server must give a length, allow ranges, and answer with just what was asked for."""

    def __init__(self, uri: str, retries: int = 3, wait: float = 0.1, timeout: float = 30.0):
        self.uri, self.retries, self.wait, self.timeout = uri, max(1, retries), wait, timeout
        self._length: int | None = None

    def _try(self, request: urllib.request.Request, use):
        for k in range(self.retries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return use(r)
            except (urllib.error.URLError, TimeoutError, ConnectionError, EOFError) as e:
                if k + 1 == self.retries or isinstance(e, urllib.error.HTTPError) and e.code < 500:
                    raise
                time.sleep(self.wait * 2**k)

    def length(self) -> int:
        if self._length is None:
            self._length = self._try(urllib.request.Request(self.uri, method="HEAD"), self._head)
        return self._length

    @staticmethod
    def _head(r) -> int:
        if (r.headers.get("Accept-Ranges") or "").lower() == "none":
            raise ValueError("the server doesn't allow ranges")
        if r.headers.get("Content-Length") is None:
            raise ValueError("the server gives no length")
        return int(r.headers["Content-Length"])

    def _read(self, offset: int, length: int) -> bytes:
        def use(r) -> bytes:
            if r.status != 206:
                raise ValueError(f"status {r.status}, not 206")
            m = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+|\*)", r.headers.get("Content-Range") or "")
            if not m or int(m[1]) != offset or int(m[2]) != offset + length - 1:
                raise ValueError(f"asked for {offset}+{length}, got {r.headers.get('Content-Range')!r}")
            data = r.read()
            if len(data) != length:
                raise EOFError("a short answer")
            return data

        return self._try(urllib.request.Request(self.uri, headers={"Range": f"bytes={offset}-{offset + length - 1}"}), use)


class Locator:
    """A place with a parent and relatives."""

    def parent(self) -> Locator | None:
        raise NotImplementedError

    def relative(self, path: str) -> Locator:
        raise NotImplementedError

    def access(self) -> Access:
        raise NotImplementedError


class FileLocator(Locator):
    def __init__(self, path: str | Path):
        self.path = Path(path)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FileLocator) and self.path == other.path

    def __hash__(self) -> int:
        return hash(self.path)

    def parent(self) -> FileLocator | None:
        return None if self.path.parent == self.path else FileLocator(self.path.parent)

    def relative(self, path: str) -> FileLocator:
        return FileLocator(self.path / path)

    def access(self) -> FileAccess:
        return FileAccess(self.path)


class MemoryLocator(Locator):
    def __init__(self, data: bytes):
        self.data = data

    def parent(self) -> None:
        return None

    def relative(self, path: str) -> MemoryLocator:
        return self

    def access(self) -> MemoryAccess:
        return MemoryAccess(self.data)


class HttpLocator(Locator):
    def __init__(self, uri: str, retries: int = 3):
        self.uri, self.retries = uri, retries

    def parent(self) -> HttpLocator | None:
        cut = split_path(self.uri.rstrip("/"))
        return HttpLocator(cut[0], self.retries) if cut and not cut[0].endswith((":", ":/", "//")) else None

    def relative(self, path: str) -> HttpLocator:
        return HttpLocator(f"{self.uri.rstrip('/')}/{path}", self.retries)

    def access(self) -> HttpAccess:
        return HttpAccess(self.uri, self.retries)


def locate(uri: str) -> Locator:
    return HttpLocator(uri) if uri.startswith(("http://", "https://")) else FileLocator(uri.removeprefix("file://"))
