"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for
each rule that fails. A policy is a set of rules with a version: applying it is one ``AND`` over the
bits, and ablations (what would be dropped without a rule, what a rule alone drops) are sums over the
distinct bit patterns, of which there are at most two to the number of rules. Nothing is shuffled but
those sums; all expressions are built-in.

Repeated windows are found within the row: hashes of all windows of five words are made, and only if
some hash repeats are the hashes sorted, the windows with an equal hash compared as text, and the words
that they cover counted.

Defined cases: a null text has no words (so it fails ``few_words``); a null doc_id is kept; empty
tables give empty results; repeated rows are judged each; very long texts are judged whole. Other columns are kept, whatever
their names; those of the input that the ledger also makes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bits of a key that hold the place of a window, which no array exceeds; the others hold its hash.
PLACE_BITS = 31
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule: (bit, what makes a document fail, over the measurements; the same text is Spark SQL and ANSI SQL).
RULES = {
    "few_words": (1, "n_words < 10"),
    "repeated_words": (2, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (4, "10 * n_symbols > n_words"),
    "short_words": (8, "word_chars < 2 * n_words"),
    "long_words": (16, "word_chars > 12 * n_words"),
    "repeated_lines": (32, "n_dup_lines >= 3 AND 10 * n_dup_lines > 6 * n_lines"),
}
BASE = RULES["few_words"][0] | RULES["repeated_words"][0]
#: Policy version: mask of the rules that count. A version never changes; a new policy gets a new one.
POLICIES = {"v1": BASE, "v2": sum(bit for bit, _ in RULES.values())}
CURRENT = "v2"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements to every row."""
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c not in MEASURES]
    low = (1 << PLACE_BITS) - 1
    # the input's columns travel inside one, so that no name clashes
    t = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    packed = t.withColumn("__packed", F.translate("__t", " \t\n\x0b\x0c\r", ""))
    words = packed.withColumn("__w", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    words = words.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)))
    grams = words.withColumn(
        "__g", F.expr(f"if(size(__w) >= {WINDOW}, transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({', '.join(f'get(__w, i + {k})' for k in range(WINDOW))})), cast(array() as array<bigint>))")
    )
    grams = grams.withColumn("__again", F.size(F.array_distinct("__g")) < F.size("__g"))
    # windows whose hash repeats, as text, sorted with their places
    keys = grams.withColumn("__k", F.expr(f"if(__again, sort_array(transform(__g, (h, i) -> (h & {~low}L) | i)), cast(array() as array<bigint>))"))
    hits = keys.withColumn(
        "__hit",
        F.expr(f"""if(__again, sort_array(transform(filter(
            transform(__k, (k, i) -> if(coalesce(k & {~low}L = get(__k, i - 1) & {~low}L, false) or coalesce(k & {~low}L = get(__k, i + 1) & {~low}L, false), k & {low}L, null)),
            p -> p is not null), p -> named_struct('g', array_join(slice(__w, cast(p as int) + 1, {WINDOW}), ' '), 'p', p))),
          cast(array() as array<struct<g: string, p: bigint>>))"""),
    )
    covered = F.expr(f"""if(__again, aggregate(array_sort(filter(
            transform(__hit, (x, i) -> if(coalesce(x.g = get(__hit, i - 1).g, false) or coalesce(x.g = get(__hit, i + 1).g, false), x.p, null)),
            p -> p is not null)),
          named_struct('n', 0L, 'at', 0L),
          (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.at), 'at', p + {WINDOW}), a -> a.n), 0L)""")
    # a row number keeps filters on the measurements above this point; below, each would be expanded many times over
    hits = hits.withColumn("__row", F.monotonically_increasing_id())
    return hits.select(
        *keep,
        F.when(F.col("__row") >= 0, F.size("__w")).cast("long").alias("n_words"),
        F.length("__packed").cast("long").alias("word_chars"),
        (F.length("__packed") - F.length(F.translate("__packed", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__row") >= 0, covered).alias("n_repeat_words"),
    )


def fail_bits(rules: dict = RULES) -> Column:
    """The bits of the rules that fail, over the measurements."""
    return sum((F.when(F.expr(rule), F.lit(bit)).otherwise(0) for bit, rule in rules.values()), F.lit(0)).cast("long")


def ledger(docs: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The input's columns, the measurements, and ``fail_bits``."""
    found = measure(docs, text)
    return found.withColumn("fail_bits", fail_bits(rules))


def apply_policy(of: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails."""
    return of.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def keep(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the input's columns, whatever their names."""
    packed = docs.select(F.col(f"`{text}`").alias("text"), F.struct("*").alias("row"))
    return apply_policy(ledger(packed), version).where("kept").select("row.*")


def ablation(of: DataFrame, version: str = CURRENT, rules: dict = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail nothing else, and are dropped without it.

    One aggregation to distinct bit patterns, then one over those; both with partial sums.
    """
    mask = POLICIES[version]
    patterns = of.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, (b, _) in rules.items() if b & mask))).alias("r")
    return (
        patterns.select("bits", "n", rule)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_fail_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_dropped_without"),
        )
    )


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document; no shuffle, no Python."""
    found = apply_policy(ledger(common.documents(spark, sf_dir).select("doc_id", "text")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits"
    )


def sql_measures(table: str = "documents") -> str:
    """The measurements of a table in DuckDB SQL."""
    return rf"""
      (WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
      split AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM base),
      word AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM split),
      gram AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, x1, x2, x3, x4) AS n FROM (
                 SELECT rid, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
                 FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE x4 IS NOT NULL),
      again AS (SELECT rid, count(DISTINCT i + k) AS n FROM gram, range(5) AS r(k) WHERE n > 1 GROUP BY rid)
      SELECT s.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words
      FROM split s LEFT JOIN again a ON s.rid = a.rid)"""  # fmt: skip


def sql_bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {bit} ELSE 0 END" for bit, rule in RULES.values())


QUERIES = {"op8_rule_ledger": op8_rule_ledger}
ORACLE = {
    "op8_rule_ledger": f"""
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed,
             (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept, fail_bits
      FROM (SELECT *, CAST({sql_bits()} AS BIGINT) AS fail_bits FROM {sql_measures()} AS m) AS l"""
}
