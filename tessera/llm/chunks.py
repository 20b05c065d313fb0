"""Exact whole-text encoding with the tokenizers library through a bounded cache of text chunks.

Both public tokenizers split a text at fixed places before any merge, so a text may be cut at some
of these places, equal chunks encoded once, and the ids joined:

* word BPE: normalised text is split at white space, and white space is dropped. Cuts: every run of
  ASCII white space; A-Z may be lower-cased first (the normaliser does so); a comma or full stop
  between an ASCII letter and white space is a piece of its own.
* byte BPE: a non-space character followed by white space always ends a piece, so a text is cut into
  ``white space* non-space+``. With white space outside ASCII in the text, runs of it may span such a
  cut, and the text is encoded whole instead. So is a text that holds a special token.

Chunks new to the worker are encoded by the library in batches. The cache has two generations of
``limit / 2`` chunks: when the young one is full it becomes the old one, and what is asked for again moves
back. So frequent chunks stay, and memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LIMIT = 1_000_000
#: Chunks longer than this are not kept.
LONG = 256

_STOP = re.compile(rb"(?<=[a-z])([,.])(?=[ \n])")
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MARKS = re.compile(rb"[\x00-\x09\x0b-\x1f]")
_CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Chunked:
    """Maps texts to the joined values of their chunks.

    ``value``: list of chunk strings to list of values (bytes); ``specials``: strings of special tokens.
    """

    def __init__(self, value: Callable[[list[str]], list[bytes]], specials: Iterable[str], limit: int = LIMIT):
        self.value, self.limit = value, limit
        self.specials = [s.encode() for s in specials]
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        """Chunks for a tokenizer that drops white space."""
        if not any(s in text for s in self.specials) and b"<|" not in text:
            text = _STOP.sub(rb" \1", text.lower())
        return text.split()

    def pieces(self, text: bytes) -> list[bytes]:
        """Chunks for a tokenizer that keeps white space. A chunk is written as marked in ``plain``."""
        if any(s in text for s in self.specials) or not text.isascii() and _ODD_SPACE.search(text):
            return [b"\x04" + text]
        if b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or text[:1] in b" \n" or text[-1:] in b" \n" or _MARKS.search(text):
            return [b"\x04" + c for c in _CHUNK.findall(text)]
        # from here on chunks are words after one space, words after nothing (\x01), and line ends (\x02)
        return (b"\x01" + _STOP.sub(b" \x01\\1", text).replace(b"\n", b" \x02 \x01")).split(b" ")

    @staticmethod
    def plain(chunk: bytes) -> str:
        """The text of a chunk made by ``pieces``."""
        mark = chunk[:1]
        if mark == b"\x04" or mark == b"\x01":
            text = chunk[1:]
        elif mark == b"\x02":
            text = b"\n"
        else:
            text = b" " + chunk
        return text.decode("utf-8", "replace")

    def look_up(self, texts: list[list[bytes]], plain: Callable[[bytes], str]) -> list[list[bytes]]:
        """The value of each chunk of each text."""
        if 2 * len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        get = self.cache.get
        found, holes = [], []
        new: set[bytes] = set()
        for k, chunks in enumerate(texts):
            values = list(map(get, chunks))
            found.append(values)
            at = -1
            try:
                while True:
                    at = values.index(None, at + 1)
                    holes.append((k, at))
                    new.add(chunks[at])
            except ValueError:
                pass
        if not new:
            return found
        old = self.old
        fresh = {c: old[c] for c in new if c in old}
        order = [c for c in new if c not in fresh]
        for k in range(0, len(order), 50_000):
            part = order[k : k + 50_000]
            fresh.update(zip(part, self.value([plain(c) for c in part])))
        for k, at in holes:
            found[k][at] = fresh[texts[k][at]]
        self.cache.update((c, v) for c, v in fresh.items() if len(c) <= LONG)
        return found


#: Letters that normalising and splitting leave alone, but for their case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]{1,64}")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 for
    itself, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_CHARS = {b: c for b, c in enumerate(byte_chars()) if chr(b) != c}


def as_bytes(letters: str) -> str:
    """Letters in the byte alphabet."""
    return letters if letters.isascii() else letters.encode().decode("latin-1").translate(_CHARS)


def id_bytes(tokenizer, space: str = "") -> Callable[[list[str]], list[bytes]]:
    """Chunks to their ids as little-endian unsigned 32-bit integers.

    A chunk of Latin letters, after one space or none, is one piece: the library's model takes it in the
    byte alphabet, a space written as ``space``; without one, in lower case. The others go through all steps.
    """
    from array import array

    def value(chunks: list[str]) -> list[bytes]:
        model, out, rest = tokenizer.model, [], []
        for k, c in enumerate(chunks):
            own = c[1:] if space and c[:1] == " " else c
            if _LETTERS.fullmatch(own):
                piece = as_bytes(own if space else own.lower())
                out.append(array("I", [t.id for t in model.tokenize(piece if own is c else space + piece)]).tobytes())
            else:
                out.append(b"")
                rest.append(k)
        for k, e in zip(rest, tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out

    return value


_KEPT: dict[tuple[str, str, int], object] = {}


def word_ids(path: str, limit: int = LIMIT) -> Callable[[list[bytes]], list[bytes]]:
    """Encoder of whole texts (UTF-8) for a tokenizer that drops white space; one for each worker."""
    c = _KEPT.get(("word", path, limit))
    if c is None:
        t = load(path)
        c = _KEPT["word", path, limit] = Chunked(id_bytes(t), [x.content for x in t.get_added_tokens_decoder().values()], limit)
    return lambda texts: [b"".join(v) for v in c.look_up([c.words(x) for x in texts], lambda x: x.decode("utf-8", "replace"))]


def byte_ids(path: str, limit: int = LIMIT) -> Callable[[list[bytes]], list[bytes]]:
    """Encoder of whole texts (UTF-8) for the byte-level tokenizer; one for each worker."""
    c = _KEPT.get(("byte", path, limit))
    if c is None:
        t = load(path)
        c = _KEPT["byte", path, limit] = Chunked(id_bytes(t, "Ġ"), [x.content for x in t.get_added_tokens_decoder().values()], limit)
    return lambda texts: [b"".join(v) for v in c.look_up([c.pieces(x) for x in texts], c.plain)]


def utf8(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
