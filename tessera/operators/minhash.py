"""MinHash signatures, banded candidate joins, exact pairs, and signatures of whole datasets.

A signature's position i is the least of (seed i XOR h) over an item's shingle hashes h, signed, and the largest
integer for an item without any. Seeds come from a 48-bit linear congruential generator (the one of the JVM).
Items of equal signatures are one class: candidate pairs are made between classes' representatives, and
membership says who is in which, so copies are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1
#: Items that meet each other in one task of the exact join.
BLOCK = 512
#: Constants of the 48-bit generator (fixed values).
_MULTIPLIER, _INCREMENT, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


def hash_family(n: int, seed: int) -> list[int]:
    """n signed 32-bit integers of the generator from a seed."""
    if n < 1:
        raise ValueError("a signature has one position at least")
    state, out = (seed ^ _MULTIPLIER) & _MASK, []
    for _ in range(n):
        state = (state * _MULTIPLIER + _INCREMENT) & _MASK
        x = state >> 16
        out.append(x - (1 << 32) if x >> 31 else x)
    return out


def _signed(x: Column) -> Column:
    """The low 32 bits of a long, as a signed integer."""
    return (F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def string_hash(text: Column) -> Column:
    """31-polynomial hash of a string's code points in 32 bits: the JVM's, for text without surrogates."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return _signed(F.aggregate(F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(codes), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32))))


def shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of the k-grams of a string, in order; a shorter string is one gram."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    power = [pow(31, k - 1 - j, 1 << 32) for j in range(k)]

    def grams(c: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: _signed(sum((F.get(c, i + j) * F.lit(p) for j, p in enumerate(power)), F.lit(0).cast("long"))))
        return sums

    long = F.get(F.transform(F.array(codes), grams), F.lit(0))
    return F.when(F.length(text) < k, F.array(string_hash(text))).otherwise(long)


def signature(hashes: Column, seeds: list[int]) -> Column:
    """Signature of an array of hashes, by built-in functions."""
    return F.transform(F.array(*(F.lit(s) for s in seeds)), lambda s: F.coalesce(F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))), F.lit(INT_MAX)))


def text_signatures(df: DataFrame, key: str, text: str, k: int, seeds: list[int]) -> DataFrame:
    """(key, sig) of whole texts: the same as ``signature(shingle_hashes(text, k), seeds)``, in Arrow batches.

    For long texts: hashing all grams and all seeds in numpy costs a fiftieth of nested lambdas. Null texts are empty.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        family = np.array(seeds, np.int32)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                c = np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.uint32)
                h = np.zeros(max(1, len(c) - k + 1), np.uint32)
                for j in range(min(k, len(c))):
                    h = h * np.uint32(31) + c[j : j + len(h)]
                h = h.view(np.int32)
                out.append([int((h ^ s).min()) for s in family])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "sig"])

    found = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return found.mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, sig array<int>").withColumnRenamed("key", key)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    same = F.aggregate(F.zip_with(a, b, lambda p, q: (p == q).cast("int")), F.lit(0), lambda m, n: m + n)
    return same.cast("double") / F.size(a)


def bands(sig: Column, n: int, length: int) -> Column:
    """Array of (band, keys): consecutive slices of a signature; n divides its length."""
    if n < 1 or length % n:
        raise ValueError(f"{n} bands don't divide a signature of {length}")
    r = length // n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("band"), F.slice(sig, i * r + 1, r).alias("keys")))


def first_band(a: Column, b: Column, n: int, length: int) -> Column:
    """The first band in which two signatures agree, -1 if none."""
    if n < 1 or length % n:
        raise ValueError(f"{n} bands don't divide a signature of {length}")
    r = length // n
    same = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(a, i * r + 1, r) == F.slice(b, i * r + 1, r))
    return (F.array_position(same, F.lit(True)) - 1).cast("int")


def to_vector(sig: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(sig.cast("array<double>"))


def exact_pairs(sigs: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b, sim) of all ordered pairs, an item with itself too: n squared rows, for small collections."""
    return all_pairs(sigs, key).select("id_a", "id_b", similarity(F.col("sig_a"), F.col("sig_b")).alias("sim"))


def all_pairs(sigs: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b, sig_a, sig_b) of all ordered pairs.

    Items are dealt into blocks; a pair of blocks is one group of an equality join, so the work spreads evenly.
    """
    n = sigs.count()
    parts = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = sigs.select(F.col(key).alias("id_a"), F.col("sig").alias("sig_a"), own.alias("i")).withColumn("j", every)
    b = sigs.select(F.col(key).alias("id_b"), F.col("sig").alias("sig_b"), own.alias("j")).withColumn("i", every)
    return a.join(b, ["i", "j"]).select("id_a", "id_b", "sig_a", "sig_b")


def classes(sigs: DataFrame, key: str) -> DataFrame:
    """(sig, id, n): items of equal signatures under the smallest key."""
    return sigs.groupBy("sig").agg(F.min(key).alias("id"), F.count("*").alias("n"))


def membership(sigs: DataFrame, key: str) -> DataFrame:
    """(key, class_id) of every item."""
    return sigs.join(classes(sigs, key).select("sig", F.col("id").alias("class_id")), "sig").select(key, "class_id")


def lsh_pairs(sigs: DataFrame, key: str, n: int, length: int) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b: representatives of classes that share a band, each pair once.

    A pair is emitted in its first common band, so nothing has to be made distinct afterwards. A band that many classes
    share is dealt out: each class is in one part as the lower of a pair, and in all parts as the higher.
    """
    rows = classes(sigs, key).select("id", "sig", F.explode(bands(F.col("sig"), n, length)).alias("b"))
    rows = rows.select("id", "sig", F.col("b.band").alias("band"), F.col("b.keys").alias("keys"))
    shared = rows.groupBy("band", "keys").agg(F.count("*").alias("n")).where("n > 1").select("band", "keys", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(shared, ["band", "keys"])
    a = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumnsRenamed({"id": "id_a", "sig": "sig_a"}).drop("parts")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnsRenamed({"id": "id_b", "sig": "sig_b"}).drop("parts")
    met = a.join(b, ["band", "keys", "part"]).where("id_a < id_b")
    met = met.where(F.col("band") == first_band(F.col("sig_a"), F.col("sig_b"), n, length))
    return met.select("id_a", "id_b", similarity(F.col("sig_a"), F.col("sig_b")).alias("sim"))


def dataset_signature(df: DataFrame, hashes: Column, seeds: list[int], zero_init: bool = False) -> DataFrame:
    """One row with ``sig``: the signature of all rows' hashes (an integer column) together, by partial minima.

    ``zero_init`` starts from zero, so that no position is above it.
    """
    least = df.select(hashes.alias("h")).agg(*(F.min(F.col("h").bitwiseXOR(F.lit(s))).alias(f"s{i}") for i, s in enumerate(seeds)))
    done = [F.coalesce(F.col(f"s{i}"), F.lit(INT_MAX)) for i in range(len(seeds))]
    return least.select(F.array(*((F.least(c, F.lit(0)) if zero_init else c) for c in done)).alias("sig"))


def jaccard(df: DataFrame, key: str, shingles: str) -> DataFrame:
    """(id_a, id_b, jaccard) of items that share a shingle: an inverted join on distinct shingles, for checks."""
    one = df.select(key, F.explode(F.array_distinct(shingles)).alias("s"))
    sizes = one.groupBy(key).agg(F.count("*").alias("n"))
    a, b = one.withColumnRenamed(key, "id_a"), one.withColumnRenamed(key, "id_b")
    both = a.join(b, "s").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.count("*").alias("k"))
    both = both.join(sizes.withColumnsRenamed({key: "id_a", "n": "na"}), "id_a").join(sizes.withColumnsRenamed({key: "id_b", "n": "nb"}), "id_b")
    return both.select("id_a", "id_b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))
