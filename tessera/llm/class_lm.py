"""Class-based bigram language model (Brown): exchange clustering, class transitions, word emissions.

All training text is counted. Seeds: the ``CLUSTERED`` most frequent words are moved between ``CLASSES`` classes,
one word at a time to the class that raises the likelihood of the class bigrams most, until no word moves (or
``ROUNDS`` rounds); their bigram counts are one dense matrix of fixed size, summed over the corpus. Then every other word of a
count of ``LEAST_COUNT``, however many there are, goes to the class that raises the likelihood most. That gives each such word a
class; ``EXCHANGES`` rounds of exchange follow, in which all of them, seeds too, are taken out of their class and put where they
raise the likelihood of the class bigrams of the whole corpus most. For both, the counts of classes before and after each
word are summed up by Spark, sparse, and the words are dealt to tasks; the words of a round move at once, each against the
class bigrams of the round before (a word next to itself isn't counted in its own gain). Class bigrams are counted anew over
all words. Words of a smaller count, and unseen ones, are one class; the end of a text is one.

    log P(text) = sum of log P(class | class before) + log P(word | class)

The perplexity of a text is ten to the power of minus its score a token. Transitions are smoothed towards the class's share of all tokens. In the class of rare words each has its
count plus one, and all unseen words together have one; elsewhere emissions are relative counts.

The ``FREQUENT`` most frequent words have ids in a dictionary that is sent to workers; that bounds memory, not the
vocabulary: counts and classes of all other words are joined, (text, word) pairs with tables of words.

Defined cases: null and empty texts have the end token alone; a null doc_id counts as the empty string in the
choice of training rows; repeated rows are scored each; very long texts are scored whole; with no training
text every count is zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import utf8

FREQUENT = 200_000
#: Words of a smaller count are rare at any rank: the class of rare words has mass for unseen ones only if it has words.
LEAST_COUNT = 5
CLUSTERED, CLASSES, ROUNDS = 1024, 64, 6
#: Rounds of exchange over all words of the least count.
EXCHANGES = 1
#: Pairs of a word and a class beside it whose gains are worked out at once.
PAIRS = 1 << 15
#: Weight of a class's share of all tokens in the transition from any class, in tokens.
SMOOTH = 50.0
#: Words that a counting task holds before it passes them on.
HELD_WORDS = 400_000


#: A key and a count, packed.
PAIR = __import__("numpy").dtype([("key", "<u2"), ("n", "<u4")])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over column ``text``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(c: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        count: Counter = Counter()
        for b in batches:
            for t in utf8(b.column(0)):
                count.update(t.lower().split())
            if len(count) > HELD_WORDS:
                yield rows(count)
                count = Counter()
        if count:
            yield rows(count)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(words: DataFrame, most: int, least: int = LEAST_COUNT) -> list[tuple[bytes, int]]:
    """(word, count) of the most frequent words, ``most`` at most, by count and word.

    Counts are summed up in buckets, 1024 to a doubling, which are few for any corpus; the bucket from which on no more
    than ``most`` words are left is the cut. So the driver gets those words alone, not a share from each task.
    """
    shift = "greatest(length(bin(c)) - 11, 0)"
    low = F.expr(f"shiftleft(shiftright(c, {shift}), {shift})").alias("low")
    cut, n = None, 0
    for r in sorted(words.where(F.col("c") >= least).groupBy(low).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > most:
            break
        cut = r["low"]
    if cut is None:
        return []
    rows = words.where((F.col("c") >= max(cut, least)) & (F.col("c") >= least)).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def classes_by_rank(n_words: int, clustered: int, classes: int) -> list[tuple[int, int]]:
    """Bounds of the ranks of the classes of words that aren't clustered."""
    out, at, width = [], clustered, 3 * clustered
    while at < n_words:
        out.append((at, min(n_words, at + width)))
        at, width = at + width, 4 * width
    return out


def exchange(matrix, n_clustered: int, classes: int, fixed: list[int], rounds: int = ROUNDS):
    """Classes of the symbols of a bigram count matrix.

    The first ``n_clustered`` symbols are moved between classes 0 .. classes - 1; ``fixed`` has the classes of the
    others. Returns (class of each symbol, class bigram counts).
    """
    import numpy as np

    n = len(matrix)
    n_all = classes + (max(fixed) - classes + 1 if fixed else 0)
    of = np.array([k % classes for k in range(n_clustered)] + fixed, np.int64)
    m = matrix.astype(np.float64)
    one_hot = np.zeros((n, n_all))
    one_hot[np.arange(n), of] = 1
    to, by = m @ one_hot, m.T @ one_hot  # counts of (symbol, class after), (symbol, class before)
    big = one_hot.T @ to
    left, right = m.sum(1), m.sum(0)
    c_left, c_right = one_hot.T @ left, one_hot.T @ right
    f = lambda x: np.where(x > 0.5, x * np.log(np.maximum(x, 1)), 0.0)
    t = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(n_clustered):
            s = of[w]
            out, inn, own = to[w].copy(), by[w].copy(), m[w, w]
            out[s] -= own
            inn[s] -= own  # with others only
            big[s] -= out
            big[:, s] -= inn
            big[s, s] -= own
            c_left[s] -= left[w]
            c_right[s] -= right[w]
            rows, columns = big[:classes], big[:, :classes].T
            gain = (f(rows + out) - f(rows)).sum(1) + (f(columns + inn) - f(columns)).sum(1)
            d = big[t, t]
            gain -= f(d + out[:classes]) - f(d) + f(d + inn[:classes]) - f(d)
            gain += f(d + out[:classes] + inn[:classes] + own) - f(d)
            gain -= f(c_left[:classes] + left[w]) - f(c_left[:classes]) + f(c_right[:classes] + right[w]) - f(c_right[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[s] + 1e-9:
                best = s
            big[best] += out
            big[:, best] += inn
            big[best, best] += own
            c_left[best] += left[w]
            c_right[best] += right[w]
            if best != s:
                moved += 1
                of[w] = best
                to[:, s] -= m[:, w]
                to[:, best] += m[:, w]
                by[:, s] -= m[w]
                by[:, best] += m[w]
        if not moved:
            break
    return of, np.rint(big).astype(np.int64)


def _bigrams(encoded: DataFrame, n_symbols: int, symbol_of) -> DataFrame:
    """(row, counts): rows of the bigram matrix over symbols, as compressed 64-bit counts, summed."""

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        symbols = symbol_of.value
        m = np.zeros(n_symbols * n_symbols, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids = symbols[np.maximum(np.frombuffer(raw, "<i4"), -1)]
                pairs = np.concatenate([[n_symbols - 1], ids]) * n_symbols + np.concatenate([ids, [n_symbols - 1]])
                if len(pairs) > 20_000:
                    m += np.bincount(pairs, minlength=len(m))
                else:
                    np.add.at(m, pairs, 1)
        rows = [k for k, r in enumerate(m.reshape(n_symbols, n_symbols)) if r.any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([zlib.compress(m[k * n_symbols : (k + 1) * n_symbols].tobytes(), 1) for k in rows], pa.binary())], ["row", "counts"])

    def total(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["row", "counts"])

    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "row int, counts binary"
    return encoded.where("not held_out").select("ids").mapInArrow(partial, schema).repartition(n, "row").mapInArrow(total, schema)


def place_all(big, classes: int, owner, key, n, n_words: int, current=None):
    """The class, of the first ``classes``, in which each word raises the likelihood of the class bigrams most.

    Word ``owner`` (ascending) has ``n`` tokens of class ``key`` before it, or of class ``key - len(big)`` after it. ``current``: the
    class that each word is taken out of first, and stays in if no other is better; -1 for none.
    """
    import numpy as np

    f = lambda x: np.where(x > 0.5, x * np.log(np.maximum(x, 1)), 0.0)
    k = len(big)
    # what each word brings: counts (words, classes) of what is before and after it
    if not n_words:
        return np.zeros(0, np.int64)
    both = np.bincount(owner * 2 * k + key, weights=n, minlength=2 * k * n_words).reshape(n_words, 2 * k)
    inn, out = both[:, :k], both[:, k:]
    t, w = np.arange(classes), np.arange(n_words)
    of = np.full(n_words, -1) if current is None else np.asarray(current, np.int64)
    has = np.flatnonzero(of >= 0)
    gain = np.zeros((n_words, classes))
    cells = np.concatenate([big[:, :classes], big[:classes].T])  # cells of each key with each class
    for a in range(0, len(owner), PAIRS):
        o, c, m = owner[a : a + PAIRS], key[a : a + PAIRS], n[a : a + PAIRS, None]
        old = cells[c]
        s = of[o]
        own = s >= 0
        old[np.flatnonzero(own), s[own]] -= n[a : a + PAIRS][own]
        beside = np.flatnonzero(own & (c % k == s))  # the other side of the cell is the word's own class
        old[beside] -= np.where((c[beside] < k)[:, None], out[o[beside], :classes], inn[o[beside], :classes])
        old = np.maximum(old, 0)
        added = f(old + m) - f(old)
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        np.add.at(gain, o[first], np.add.reduceat(added, first))
    d = np.repeat(big[t, t][None], n_words, 0)
    d[has, of[has]] -= inn[has, of[has]] + out[has, of[has]]
    d = np.maximum(d, 0)
    x, y = out[:, :classes], inn[:, :classes]
    gain += f(d + x + y) - f(d + x) - f(d + y) + f(d)  # the cell of a class with itself was added to twice
    for sums, more in ((big[:classes].sum(1), out.sum(1)), (big[:, :classes].sum(0), inn.sum(1))):
        side = np.repeat(sums[None], n_words, 0)
        side[has, of[has]] -= more[has]
        side = np.maximum(side, 0)
        gain -= f(side + more[:, None]) - f(side)
    best = gain.argmax(1)
    stays = has[gain[has, best[has]] <= gain[has, of[has]] + 1e-9]
    best[stays] = of[stays]
    return best


def place(big, classes: int, after, before) -> int:
    """``place_all`` of one word, whose counts are (classes, counts) of what follows it and what it follows."""
    import numpy as np

    key = np.concatenate([before[0], np.asarray(after[0]) + len(big)]).astype(np.int64)
    return int(place_all(big, classes, np.zeros(len(key), np.int64), key, np.concatenate([before[1], after[1]]).astype(float), 1)[0])


def _flat(raws: list):
    """Ids of texts one after another: (ids, text of each, length of each text)."""
    import numpy as np

    ids = np.frombuffer(b"".join(raws), "<i4").astype(np.int64)
    n = np.array([len(r) // 4 for r in raws], np.int64)
    return ids, np.repeat(np.arange(len(raws)), n), n


def _contexts(encoded: DataFrame, k: int, n_seeds: int, n_classes: int, sent) -> DataFrame:
    """(id, word, c, pairs): counts of words that aren't seeds, several rows for each, and packed pairs (key, n): how often a class
    stands before (key < n_classes) or after it, and how often the word itself stands before it (key = 2 * n_classes).

    Words of the dictionary have their id and no word, all others -1 and the word.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        class_of = sent.value  # of each word of the dictionary, of other words, of the end
        wide = 2 * n_classes + 1

        def summed(keys: list, counts: list):
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

        def rows(key, n, words=None):
            """``key``: a word's place times ``wide`` and the key, ascending."""
            owner, key = key // wide, key % wide
            packed = np.empty(len(key), PAIR)
            packed["key"], packed["n"] = key, n
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(key) else np.zeros(0, np.int64)
            edges = np.concatenate([first, [len(key)]]) * PAIR.itemsize
            pairs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(packed)])
            c = np.add.reduceat(np.where((key < n_classes) | (key == 2 * n_classes), n, 0), first) if len(first) else first
            of = owner[first]
            ids = of if words is None else np.full(len(of), -1)
            word = pa.nulls(len(of), pa.binary()) if words is None else words.take(pa.array(of))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), word, pa.array(c, pa.int64()), pairs], ["id", "word", "c", "pairs"])

        keys, counts, held = [], [], 0
        for b in batches:
            ids, text, n = _flat(b.column(0).to_pylist())
            if not len(ids):
                continue
            c = class_of[np.where(ids < 0, k, ids)]
            first, last = np.ones(len(ids), bool), np.ones(len(ids), bool)
            first[1:] = last[:-1] = text[1:] != text[:-1]
            end = class_of[k + 1]
            before, after = np.where(first, end, np.roll(c, 1)), np.where(last, end, np.roll(c, -1)) + n_classes
            # a word beside itself tells nothing of where it belongs
            same = (ids[1:] == ids[:-1]) & ~first[1:]
            left, right = np.ones(len(ids), bool), np.ones(len(ids), bool)
            left[1:], right[:-1] = ~same, ~same
            on = ids >= n_seeds
            key = ids * wide
            u, times = np.unique(np.concatenate([(key + np.where(left, before, 2 * n_classes))[on], (key + after)[on & right]]), return_counts=True)
            keys.append(u)
            counts.append(times)
            held += len(u)
            if held > 1_000_000:
                key, times = summed(keys, counts)
                if len(key) > HELD_WORDS:
                    yield rows(key, times)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [key], [times], len(key)
            on = ids < 0
            if on.any():
                lists = b.column(1)
                words = lists.flatten().field("word")
                starts = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
                key = (starts[text[on]] - 1 - ids[on]) * wide
                u, times = np.unique(np.concatenate([key + before[on], key + after[on]]), return_counts=True)
                yield rows(u, times, words)
        if keys:
            yield rows(*summed(keys, counts))

    return encoded.where("not held_out").select("ids", "rare").mapInArrow(run, "id long, word binary, c long, pairs binary")


def _placed(contexts: DataFrame, classes: int, sent, least: int = LEAST_COUNT) -> DataFrame:
    """(id, word, c, class) of each word of ``contexts`` that has the least count. ``sent``: class bigrams, and the class that
    each word of the dictionary is in (-1 for none). Rows of a word come one after another and are summed as they come, so
    a word of any number of rows takes no more room than its keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        big, current = sent.value
        wide = 2 * len(big) + 1
        open_: dict = {}  # the last word, which may go on

        def words_of(part: list, last: bool):
            table = pa.Table.from_batches(part).combine_chunks()
            ids, words, c, pairs = (table.column(j).combine_chunks() for j in range(4))
            id_ = ids.to_numpy()
            new = np.ones(len(id_), bool)
            other = pc.fill_null(pc.not_equal(words[1:], words[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] = (id_[1:] != id_[:-1]) | other
            if open_ and open_["id"] == id_[0] and open_["word"] == words[0].as_py():
                new[0] = False
            owner = np.cumsum(new) - new[0]
            shift = 1 if open_ and new[0] else 0  # the open word is one of its own, before these
            owner += shift
            raw = pairs.to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // PAIR.itemsize
            flat = np.frombuffer(b"".join(raw), PAIR)
            at = np.repeat(owner, sizes) * wide + flat["key"]
            n = flat["n"].astype(float)
            total = np.bincount(owner, weights=c.to_numpy(), minlength=int(owner[-1]) + 1)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            ids, words = ids.take(pa.array(first)), words.take(pa.array(first))
            if open_:
                at, n = np.concatenate([open_["key"], at]), np.concatenate([open_["n"], n])
                total[0] += open_["c"]
                if shift:
                    ids, words = pa.concat_arrays([pa.array([open_["id"]], pa.int64()), ids]), pa.concat_arrays([pa.array([open_["word"]], pa.binary()), words])
            at, place = np.unique(at, return_inverse=True)
            n = np.bincount(place, weights=n, minlength=len(at))
            owner, key = at // wide, at % wide
            done = len(ids) if last else len(ids) - 1
            open_.clear()
            if not last:
                mine = owner == done
                open_.update(id=ids[done].as_py(), word=words[done].as_py(), c=total[done], key=key[mine], n=n[mine])
            wanted = np.flatnonzero(total[:done] >= least)
            slot = np.full(len(ids), -1)
            slot[wanted] = np.arange(len(wanted))
            take = (slot[owner] >= 0) & (key < 2 * len(big))
            ids, words = ids.take(pa.array(wanted)), words.take(pa.array(wanted))
            id_ = ids.to_numpy()
            of = np.where(id_ >= 0, current[np.maximum(id_, 0)], -1) if len(current) else np.full(len(id_), -1)
            found = place_all(big, classes, slot[owner[take]], key[take], n[take], len(wanted), of)
            return pa.RecordBatch.from_arrays([ids, words, pa.array(total[wanted].astype(np.int64)), pa.array(found, pa.int32())], ["id", "word", "c", "class"])

        held: list = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PAIRS:
                yield words_of(held, False)
                held, rows = [], 0
        if held:
            yield words_of(held, True)
        elif open_:
            empty = pa.RecordBatch.from_arrays([pa.array([open_["id"]], pa.int64()), pa.array([open_["word"]], pa.binary()), pa.array([0], pa.int64()), pa.array([b""], pa.binary())], ["id", "word", "c", "pairs"])
            yield words_of([empty], True)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "id", "word").sortWithinPartitions("id", "word").mapInArrow(run, "id long, word binary, c long, class int")


def _coded(encoded: DataFrame, classes_of) -> DataFrame:
    """(classes, held_out) of texts: the classes of their words as 16-bit integers, by ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        class_of = classes_of.value
        k = len(class_of) - 2
        for b in batches:
            out = []
            for raw in b.column(0).to_pylist():
                ids = np.frombuffer(raw, "<i4")
                out.append(class_of[np.where(ids < 0, k, ids)].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], ["classes", "held_out"])

    return encoded.where("not held_out").select("ids", "held_out").mapInArrow(run, "classes binary, held_out boolean")


def _class_bigrams(classed: DataFrame, n_classes: int):
    """Class bigrams of the training texts, summed."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = np.zeros(n_classes * n_classes, np.int64)
        end = n_classes - 1
        for b in batches:
            for raw in b.column(0).to_pylist():
                c = np.concatenate([[end], np.frombuffer(raw, "<i2"), [end]]).astype(np.int64)
                np.add.at(m, c[:-1] * n_classes + c[1:], 1)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(m[at], pa.int64())], ["cell", "n"])

    m = np.zeros(n_classes * n_classes, np.int64)
    for r in classed.where("not held_out").select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        m[r["cell"]] = r["n"]
    return m.reshape(n_classes, n_classes)


def score(docs: DataFrame, frequent: int = FREQUENT, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS, exchanges: int = EXCHANGES) -> DataFrame:
    """Learns from the rows of ``docs`` that aren't held out, and scores all: the contract's columns, and ``perplexity``."""
    import numpy as np

    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    words = common.materialised(word_counts(docs.where("not held_out")), "words")
    n_docs = docs.where("not held_out").count()
    n_words, n_types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, v = n_words + n_docs, n_types + (1 if n_docs else 0)
    top = frequent_words(words, frequent)
    count = np.array([c for _, c in top], np.int64)
    k = len(top)
    clustered = min(clustered, k)
    bounds = classes_by_rank(k, clustered, classes)
    # symbols of the seeds' bigrams: seeds, other words by rank, words outside the dictionary, the end
    n_symbols = clustered + len(bounds) + 2
    symbol_of = np.full(k + 2, n_symbols - 2, np.int64)
    symbol_of[:clustered] = np.arange(clustered)
    for j, (a, z) in enumerate(bounds):
        symbol_of[a:z] = clustered + j
    symbol_of[k + 1] = n_symbols - 1
    sent_words = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(top)})

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get = sent_words.value.get
        kind = pa.list_(pa.struct([("word", pa.binary()), ("j", pa.int32())]))
        for b in batches:
            ids, rare, n = [], [], []
            for t in utf8(b.column(2)):
                words = t.lower().split()
                found = np.array([get(w, -1) for w in words], "<i4")
                places: dict = {}  # the j-th other word of a text has the id -1 - j
                for i in np.flatnonzero(found < 0).tolist():
                    found[i] = -1 - places.setdefault(words[i], len(places))
                ids.append(found.tobytes())
                rare.append([{"word": w, "j": j} for w, j in places.items()])
                n.append(len(words) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, kind)], ["uid", "doc_id", "held_out", "n_tokens", "ids", "rare"])

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    encoded = common.materialised(
        numbered.mapInArrow(encode, "uid long, doc_id long, held_out boolean, n_tokens long, ids binary, rare array<struct<word: binary, j: int>>"), "encoded", compression="zstd"
    )
    matrix = np.zeros((n_symbols, n_symbols), np.int64)
    for r in _bigrams(encoded, n_symbols, spark.sparkContext.broadcast(symbol_of[: k + 1])).collect():
        matrix[r["row"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    classes = min(classes, max(1, clustered))
    of, big = exchange(matrix, clustered, classes, [classes + j for j in range(len(bounds) + 2)], rounds)
    # all words of the least count that aren't seeds, each to the class of the greatest gain
    contexts = _contexts(encoded, k, clustered, len(big), spark.sparkContext.broadcast(of[symbol_of]))
    placed = common.materialised(_placed(contexts, classes, spark.sparkContext.broadcast((big.astype(np.float64), np.zeros(0, np.int64)))), "placed")
    n_classes = classes + 2  # then rare words, the end
    class_of = np.concatenate([of[:clustered], np.full(k - clustered, classes), [classes, classes + 1]]).astype(np.int64)
    for r in placed.where("id >= 0").select("id", "class").collect():
        class_of[r["id"]] = r["class"]
    # and all of them, each from where it is; those outside the dictionary are rare words to their neighbours
    for _ in range(exchanges):
        sent_classes = spark.sparkContext.broadcast(class_of)
        big = _class_bigrams(_coded(encoded, sent_classes), n_classes).astype(np.float64)
        contexts = _contexts(encoded, k, 0, n_classes, sent_classes)
        before, placed = placed, common.materialised(_placed(contexts, classes, spark.sparkContext.broadcast((big, class_of[:k]))), "placed")
        common.discard(before)
        for r in placed.where("id >= 0").select("id", "class").collect():
            class_of[r["id"]] = r["class"]
    class_of = class_of[:k]
    size = np.bincount(class_of, weights=count, minlength=n_classes)
    more, n_more = 0, 0
    for r in placed.where("id < 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        size[r["class"]] += r["c"]
        more, n_more = more + r["c"], n_more + r["n"]
    emit = np.log10(count / size[class_of]) if k else np.zeros(0)
    total = float(n_train + v + 1)
    base = np.log10((count + 1) / total)
    base_end = float(np.log10((n_docs + 1) / total))
    n_rare, v_rare = int(n_words - count.sum() - more), int(n_types - k - n_more)
    sent = spark.sparkContext.broadcast((class_of, emit, base, size))
    known_end = bool(n_docs)

    def classify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        class_of, emit, base, size = sent.value
        for b in batches:
            ids, text, n = _flat(b.column(4).to_pylist())
            lists = b.column(5)
            flat = lists.flatten()
            starts = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
            owner = np.repeat(np.arange(len(n)), np.diff(starts))
            at = starts[owner] + flat.field("j").to_numpy(zero_copy_only=False)
            c, own = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            c[at] = flat.field("c").fill_null(0).to_numpy(zero_copy_only=False)
            own[at] = flat.field("class").fill_null(len(size) - 2).to_numpy(zero_copy_only=False)
            classes, seen, b_sum, e_sum = (np.zeros(len(ids), t) for t in (np.int64, bool, float, float))
            on = ids >= 0
            i = ids[on]
            classes[on], seen[on], b_sum[on], e_sum[on] = class_of[i], True, base[i], emit[i]
            i = starts[text[~on]] - 1 - ids[~on]
            ci, ki = c[i], own[i]
            rare = ki == len(size) - 2
            classes[~on], seen[~on], b_sum[~on] = ki, ci > 0, np.log10((ci + 1) / total)
            e_sum[~on] = np.log10(np.where(rare, ci + 1, ci) / np.where(rare, n_rare + v_rare + 1, size[ki]))
            per = lambda x: np.bincount(text, weights=x, minlength=len(n))
            ends = np.cumsum(n)
            raw = [classes[a:z].astype("<i2").tobytes() for a, z in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:4], pa.array(per(seen).astype(np.int64) + known_end), pa.array(per(b_sum) + base_end), pa.array(per(e_sum)), pa.array(raw, pa.binary())], ["doc_id", "held_out", "n_tokens", "known", "base", "emit", "classes"]
            )

    others = encoded.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.j").join(words, "word", "left").join(placed.where("id < 0").select("word", "class"), "word", "left")
    others = others.groupBy("uid").agg(F.collect_list(F.struct("j", "c", "class")).alias("others"))
    kind = "array<struct<j: int, c: bigint, class: int>>"
    both = encoded.select("uid", "doc_id", "held_out", "n_tokens", "ids").join(others, "uid", "left")
    both = both.select("uid", "doc_id", "held_out", "n_tokens", "ids", F.coalesce("others", F.expr(f"cast(array() as {kind})")).alias("others"))
    classed = common.materialised(both.mapInArrow(classify, "doc_id long, held_out boolean, n_tokens long, known long, base double, emit double, classes binary"), "classed", compression="zstd")
    for old in (encoded, placed, words):
        common.discard(old)
    big = _class_bigrams(classed, n_classes)
    share = (big.sum(0) + 1.0) / (big.sum() + n_classes)
    move = np.log10((big + SMOOTH * share) / (big.sum(1, keepdims=True) + SMOOTH))
    sent_move = spark.sparkContext.broadcast(move)

    def rate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        move = sent_move.value
        end = len(move) - 1
        for b in batches:
            out = []
            for raw, e in zip(b.column(6).to_pylist(), b.column(5).to_pylist()):
                c = np.concatenate([[end], np.frombuffer(raw, "<i2"), [end]]).astype(np.int64)
                out.append(float(move[c[:-1], c[1:]].sum()) + e)
            n = pa.array([n_train] * len(out), pa.int64())
            score = np.array(out, float)
            perplexity = 10 ** (-score / b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], n, b.column(4), pa.array(score), pa.array(perplexity)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
            )

    rated = classed.mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return common.reads(rated, classed)


def op3_class_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score(common.documents(spark, sf_dir))


QUERIES = {"op3_class_ngram_lm": op3_class_ngram_lm}
ORACLE: dict[str, str] = {}
