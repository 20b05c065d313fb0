"""BPE by a segment tree over the ranks of adjacent pairs.

The leaves of a tree hold, for each symbol of a piece, the rank of the pair that starts there; an
inner node holds the least (rank, place) below it. The root is therefore the leftmost pair of the
lowest rank: it is merged, three leaves change, and their paths to the root are updated, in
logarithmic time, until the root says that no pair is left. Pieces of at most ``WIDE`` symbols go
through a forest of equal trees in numpy, one merge of every tree at a time; longer ones through
one tree each.

What stands around the merges (normalisation, splitting, byte symbols, special tokens) follows the
tokenizer's file. Texts are cut at ASCII white space, and equal chunks are encoded once.

Defined cases: null is an empty text, which has no tokens and decodes to nothing; texts of any length
are encoded whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import common
from .chunks import Chunked, byte_chars, load, utf8

WIDE = 64
NONE = 1 << 60
#: Letters of which lower case and composition are the same everywhere, besides ASCII.
_SIMPLE = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-įı-ſßÿ]+|[0-9]|[^\\x20\\x09-\\x0da-z0-9à-öø-įı-ſßÿ]+")


class Tree:
    """Minimum of a fixed number of places, with point updates."""

    def __init__(self, keys: list[int]):
        self.size = 1
        while self.size < len(keys):
            self.size *= 2
        self.node = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def root(self) -> int:
        return self.node[1]

    def update(self, place: int, key: int) -> None:
        node, k = self.node, place + self.size
        node[k] = key
        while k > 1:
            k >>= 1
            low = min(node[2 * k], node[2 * k + 1])
            if node[k] == low:
                break
            node[k] = low


class Merger:
    """Merges symbols by ranked pairs. ``pairs``: rank to (left id, right id, merged id)."""

    def __init__(self, pairs: list[tuple[int, int, int]], n_ids: int):
        import numpy as np

        self.n_ids = n_ids
        self.ranks = {}
        for rank, (a, b, _) in enumerate(pairs):
            self.ranks.setdefault(a * n_ids + b, rank)
        self.merged = np.array([c for *_, c in pairs], np.int64)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.rank_of = np.append(np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order], -1)

    def one(self, symbols: list[int]) -> list[int]:
        """One piece of any length, by one tree."""
        n, get, ids = len(symbols), self.ranks.get, self.n_ids
        if n < 2:
            return symbols
        key = lambda i, j: NONE if i < 0 or j >= n or (r := get(sym[i] * ids + sym[j])) is None else r * n + i
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        tree = Tree([key(i, i + 1) for i in range(n)])
        while (low := tree.root()) < NONE:
            rank, i = divmod(low, n)
            j = after[i]
            sym[i] = int(self.merged[rank])
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            tree.update(j, NONE)
            tree.update(i, key(i, k))
            if before[i] >= 0:
                tree.update(before[i], key(before[i], i))
        return [s for s in sym if s >= 0]

    def _rank(self, a, b):
        """Ranks of pairs, NONE where they don't merge."""
        import numpy as np

        want = a * self.n_ids + b
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.rank_of[at], NONE)

    def forest(self, symbols):
        """Rows of symbols, padded with -1 to a power of two of columns: rows with merged symbols, -1 elsewhere."""
        import numpy as np

        n, width = symbols.shape
        sym = np.full((n, width + 2), -1, np.int64)  # one more place at either end, never a symbol
        sym[:, 1:-1] = symbols
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self._rank(sym[:, 1:-1], sym[:, 2:])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + np.arange(width), NONE)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        row = np.arange(n)
        while True:
            low = tree[row, 1]
            left = low < NONE
            if not left.all():
                row, low = row[left], low[left]
            if not len(row):
                break
            i = low % width + 1
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            sym[row, i] = made = self.merged[low // width]
            sym[row, j] = -1
            after[row, i] = k
            k_in = np.minimum(k, width + 1)
            before[row, k_in] = i
            right, past = sym[row, k_in], sym[row, np.maximum(h, 0)]
            rank = self._rank(np.concatenate([made, past]), np.concatenate([right, made]))
            for place, key in ((j, None), (i, rank[: len(row)]), (h, rank[len(row) :])):
                at = np.maximum(place - 1, 0)
                if key is None:
                    new = np.full(len(row), NONE)
                else:
                    new = np.where(key < NONE, key * width + at, NONE)
                if place is h:  # the first symbol has none before it
                    new = np.where(h >= 1, new, tree[row, width + at])
                node = at + width
                tree[row, node] = new
                node = node >> 1
                while node[0] >= 1:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
        return sym[:, 1:-1]


class TreeBpe:
    """Encoder and decoder of a word BPE file (end-of-word symbols, byte alphabet, no decoder)."""

    def __init__(self, path: str):
        import numpy as np

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.merger = Merger([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], n)
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.text = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.out = {i: (str(i).encode(), t.encode()) for i, t in self.text.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = load(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer

    def pieces(self, text: str) -> list[bytes]:
        """The pieces of a text without special tokens, as bytes."""
        if _SIMPLE.fullmatch(text):
            return [p.encode() for p in _SPLIT.findall(text.lower())]
        return [bytes(self.byte_of[c] for c in p) for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        import numpy as np

        out: list = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 1:
                out[i] = [int(self.last[p[0]])]
            elif len(p) > WIDE:
                out[i] = self.merger.one([*self.inner[np.frombuffer(p[:-1], np.uint8)].tolist(), int(self.last[p[-1]])])
            else:
                widths.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, of in widths.items():
            step = max(1, (1 << 16) // width)
            for k in range(0, len(of), step):
                part = of[k : k + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                n = np.array([len(pieces[i]) for i in part])
                symbols = np.where(np.arange(width) < n[:, None], self.inner[raw], -1)
                symbols[np.arange(len(part)), n - 1] = self.last[raw[np.arange(len(part)), n - 1]]
                done = self.merger.forest(symbols)
                kept = done >= 0
                ends = np.cumsum(kept.sum(1)).tolist()
                ids, at = done[kept].tolist(), 0
                for i, e in zip(part, ends):
                    out[i] = ids[at:e]
                    at = e
        return out

    def values(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """For each chunk its ids in decimal and its tokens' strings, both joined by spaces."""
        cut, known, new = [], {}, []
        for c in chunks:
            own: list = []
            for part in self.cut.split(c) if self.cut and "<|" in c else (c,):
                if part in self.special:
                    own.append(self.special[part])
                elif part:
                    own += self.pieces(part)
            cut.append(own)
            for p in own:
                if not isinstance(p, int) and p not in known:
                    known[p] = None
                    new.append(p)
        for p, ids in zip(new, self.merge(new)):
            known[p] = [self.out[i] for i in ids]
        done = []
        for own in cut:
            tokens = [t for p in own for t in ([self.out[p]] if isinstance(p, int) else known[p])]
            done.append((b" ".join([a for a, _ in tokens]), b" ".join([b for _, b in tokens])))
        return done

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [int(i) for c in text.encode().split() for a, _ in self.values([c.decode()]) for i in a.split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces: what a tokenizer without a decoder gives."""
        return " ".join(self.text[i] for i in ids)


_KEPT: dict[str, Chunked] = {}


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""

    limit = common.cached_chunks(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = _KEPT.get(tokenizer)
        if c is None:
            bpe = TreeBpe(tokenizer)
            c = _KEPT[tokenizer] = Chunked(bpe.values, bpe.special, limit)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids, decoded = [], [], []
            for values in c.look_up([c.words(x) for x in utf8(b.column(1))], lambda x: x.decode("utf-8", "replace")):
                text = b" ".join([a for a, _ in values if a])
                n.append(text.count(b" ") + 1 if text else 0)
                ids.append(sha(text))
                decoded.append(sha(b" ".join([t for _, t in values if t])))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; no shuffle."""
    return encode_decode(common.documents(spark, sf_dir), common.tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op6_segment_tree_bpe": op6_segment_tree_bpe}
ORACLE: dict[str, str] = {}
