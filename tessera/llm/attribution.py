"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. The character spans of its tokens are joined with the intervals of its
sections (sorted and disjoint, so the join is one binary search for all tokens). A token that crosses a
boundary is counted once, by an explicit rule: ``start`` gives it to the section of its first
character, ``end`` to that of its last, ``most`` to the section that holds most of its characters (the
earlier of equals). So sections always add up to the document.

Sections are lines, a line end belonging to the line that it ends, unless a column names the edges: then the text is cut
at those that lie in it, and where none does (or the array is empty) it is one section.

Defined cases: null or empty text is one empty section without tokens; a null doc_id is kept; null edges are lines; a token without characters of
its own (part of a character's bytes) counts where that character is; repeated rows give repeated
results; an empty table gives no rows; other columns, whatever their names, are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from . import common
from .chunks import Chunked, load, utf8

RULES = ("start", "end", "most")
COUNTS = "doc_id long, section int, start long, end long, n_tokens long"


def line_edges(text: bytes):
    """Edges of the lines of a text, in code points: 0, after each line end, and the length."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    first = (raw & 0xC0) != 0x80  # bytes that begin a code point
    if first.all():
        n, ends = len(raw), np.flatnonzero(raw == 10) + 1
    else:
        at = np.cumsum(first)
        n, ends = int(at[-1]), at[raw == 10]
    edges = np.concatenate([[0], ends, [n]])
    return edges[:-1] if len(edges) > 2 and edges[-1] == edges[-2] else edges


def given_edges(own: list, n: int):
    """Edges of the sections that a text of n code points is cut into at the places given, in any order: sections cover the
    text, so 0 and its length are edges too, and what is outside or null is left out."""
    import numpy as np

    return np.array(sorted({0, n, *(x for x in own if x is not None and 0 < x < n)}) if n else [0, 0], np.int64)


def allocate(starts, ends, edges, rule: str):
    """Tokens of each section; spans are half open, edges sorted."""
    import numpy as np

    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    n = len(edges) - 1
    last = np.maximum(ends - 1, starts)
    find = lambda x: np.clip(np.searchsorted(edges, x, "right") - 1, 0, n - 1)
    at = find(last if rule == "end" else starts)
    if rule == "most":
        to = find(last)
        for k in np.flatnonzero(to > at):  # the few that cross
            parts = np.arange(at[k], to[k] + 1)
            held = np.minimum(ends[k], edges[parts + 1]) - np.maximum(starts[k], edges[parts])
            at[k] = parts[np.argmax(held)]
    return np.bincount(at, minlength=n)


def chunk_spans(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """Chunks to unsigned 32-bit integers: characters, then start and end of each token in the chunk."""
    from array import array

    def value(chunks: list[str]) -> list[bytes]:
        model, out, rest = tokenizer.model, [], []
        for k, c in enumerate(chunks):
            own = c[1:] if c[:1] == " " else c
            if len(own) < 64 and own.isascii() and own.isalpha():
                out.append(array("I", [len(c), *[x for t in model.tokenize(own if own is c else "Ġ" + own) for x in _plain(t.offsets, own is c)]]).tobytes())
            else:
                out.append(b"")
                rest.append(k)
        for k, e in zip(rest, tokenizer.encode_batch([chunks[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", [len(chunks[k]), *[x for o in e.offsets for x in o]]).tobytes()
        return out

    def _plain(span: tuple[int, int], same: bool) -> tuple[int, int]:
        # the model counts bytes, and the character that stands for a space has two
        return span if same else (max(0, span[0] - 1), span[1] - 1)

    return value


_KEPT: dict[str, Chunked] = {}


def spans(chunks: list[bytes]):
    """(starts, ends) of the tokens of a text, from the values of its chunks."""
    import numpy as np

    flat = np.frombuffer(b"".join(chunks), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4
    heads = np.cumsum(sizes) - sizes
    base = np.cumsum(flat[heads]) - flat[heads]
    inner = np.ones(len(flat), bool)
    inner[heads] = False
    flat = flat[inner] + np.repeat(base, sizes - 1)
    return flat[::2], flat[1::2]


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "start", edges: str | None = None) -> DataFrame:
    """One row for each section of each document. ``edges``: a column of section edges (array of long)."""
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    limit = common.cached_chunks(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = _KEPT.get(tokenizer)
        if c is None:
            t = load(tokenizer)
            c = _KEPT[tokenizer] = Chunked(chunk_spans(t), [x.content for x in t.get_added_tokens_decoder().values()], limit)
        for b in batches:
            texts = utf8(b.column(1))
            given = b.column(2).to_pylist() if edges else [None] * len(texts)
            doc, section, start, end, n = [], [], [], [], []
            for d, text, own, values in zip(b.column(0).to_pylist(), texts, given, c.look_up([c.pieces(x) if x else [] for x in texts], c.plain)):
                cuts = line_edges(text) if own is None else given_edges(own, len(text.decode()))
                s, e = spans(values) if values else (np.zeros(0, np.int64),) * 2
                k = len(cuts) - 1
                doc.append([d] * k)
                section.append(np.arange(k))
                start.append(cuts[:-1])
                end.append(cuts[1:])
                n.append(allocate(s, e, cuts, rule))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for y in doc for x in y], pa.int64()), pa.array(flat(section), pa.int32()), *(pa.array(flat(x), pa.int64()) for x in (start, end, n))], ["doc_id", "section", "start", "end", "n_tokens"]
            )

    common.tune(docs.sparkSession)
    return docs.select("doc_id", "text", *([edges] if edges else [])).mapInArrow(run, COUNTS)


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; no shuffle."""
    return token_counts(common.documents(spark, sf_dir), common.tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op7_token_attribution": op7_token_attribution}
ORACLE: dict[str, str] = {}
