"""Quality rules with host-level verdicts (DataFrame functions only).

Every document is measured by five rules. Failures are summed by host (the
``source`` column), each host's failure rate is shrunk by a beta prior that is
fitted to all hosts' rates, and the host's verdict is joined back:

* a document that fails a base rule is rejected;
* a document that fails one of the softer rules is rejected if its host is not
  trusted, that is if the host's shrunken failure rate exceeds ``tolerance``;
* everything from a host whose shrunken rate exceeds ``ban`` is rejected.

Defined cases: a null text counts as empty (no words, so the base rule rejects
it); rows with a null source form one host; repeated rows are measured each;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOLERANCE, BAN = 0.05, 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at these ascending places."""
    steps = F.transform(places, lambda p, k: F.least(F.lit(3), p - F.get(places, k - 1)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _repeated_words(words: Column, windows: Column, mask: Column) -> Column:
    """windows: 64-bit hashes of the 3-word windows of words, in text order; mask: ones in as many bits as their number takes.

    The upper bits of a hash and, in as many lower bits as the text needs, its
    place are packed in one long. A primitive sort brings equal windows
    together, so those that agree with a neighbour in the upper bits are all that can repeat.
    They alone are sorted by their whole hashes and words, where neighbours are equal or differ.
    """
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    upper = lambda p: p.bitwiseOR(mask)
    close = common.let(
        packed, lambda x: F.filter(x, lambda p, k: (upper(p) == upper(F.get(x, k + 1))) | (upper(p) == upper(F.get(x, k - 1))))
    )

    def window(p):
        i = p.bitwiseAND(mask).cast("int")
        word = lambda k: F.get(words, i + k)
        return F.struct(F.struct(F.get(windows, i).alias("h"), word(0).alias("a"), word(1).alias("b"), word(2).alias("c")).alias("w"), i.cast("long").alias("i"))

    again = common.let(
        F.sort_array(F.transform(close, window)),
        lambda x: F.filter(x, lambda p, k: (p["w"] == F.get(x, k + 1)["w"]) | (p["w"] == F.get(x, k - 1)["w"])),
    )
    return common.let(F.sort_array(F.transform(again, lambda p: p["i"])), _covered)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and its counts, COUNTS; columns of df that have these names are replaced."""
    text = common.whole_text(df, text_col)
    keep = [F.col(f"_in.{c}").alias(c) for c in df.columns if c not in COUNTS]
    base = df.select(F.struct(*[df[c] for c in df.columns]).alias("_in"), text.alias("_text"))
    base = base.select(
        "_in",
        F.array_remove(F.split("_text", common.SPACE), "").alias("_words"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    words = F.col("_words")
    base = base.select(
        "_in",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") > 3,
            F.slice(
                F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                1,
                F.greatest(F.size("_words") - 2, F.lit(0)),
            ),
        ).alias("_windows"),
        "_words",
        (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("_words").cast("long")))) - 1).alias("_mask"),
    )
    many = F.size("_windows") > F.size(F.array_distinct("_windows"))
    repeated = F.when(many, _repeated_words(F.col("_words"), F.col("_windows"), F.col("_mask")))
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines",
    )
    # A filter on the counts that sank below this would put them together anew for each word; it can't pass a generator.
    out = base.select("_in", F.inline(F.array(counts)))
    return out.select(*keep, *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """Symbols beside a fifth of the words, three lines in ten repeated, words of over 20 code points on average."""
    return (
        (5 * F.col("n_symbols") > F.col("n_words"))
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (F.col("word_chars") > 20 * F.col("n_words"))
    )


def host_rates(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """host, host_rate: failure rates shrunk by a beta prior that the moments of all hosts' rates give.

    Moments need two hosts with different rates; else the prior is that of one
    failure in ten at a weight of ten documents. Sums are made before the
    shuffle, so a host with a third of all rows sends one row from each task.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((base_failed() | soft_failed()).cast("long")).alias("bad")
    )
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    fits = (F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v"))
    weight = F.when(fits, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(10.0))
    prior = prior.select(
        weight.alias("weight"), F.when(fits, F.col("m")).otherwise(F.lit(0.1)).alias("mean")
    )
    # The prior is one row.
    return hosts.join(F.broadcast(prior)).select(
        "host", ((F.col("bad") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight"))).alias("host_rate")
    )


def verdicts(measured: DataFrame, rates: DataFrame, host_col: str = "source", tolerance: float = TOLERANCE, ban: float = BAN) -> DataFrame:
    """measured, host_rate, base_failed and kept. Spark broadcasts the hosts if they are few, else it splits hot ones."""
    out = measured.join(rates, measured[host_col].eqNullSafe(rates["host"]), "left").drop("host")
    return out.withColumn("base_failed", base_failed()).withColumn(
        "kept",
        ~F.col("base_failed") & ~(soft_failed() & (F.col("host_rate") > tolerance)) & ~(F.col("host_rate") > ban),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    measured = common.materialize(measure(docs).drop("text"))
    return verdicts(measured, host_rates(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_stage(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones, in the same columns.

    Texts are measured once: rows that pass the base rules are written with their
    counts, of the others only the host, and the verdicts are joined to that table.
    A table without rows gives none; a null text or host is handled as above.
    """
    names = docs.columns
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["text"].alias("text"), docs["source"].alias("source"))
    measured = measure(wide).drop("text").withColumn("doc", F.when(~base_failed(), F.col("doc")))
    measured = common.materialize(measured)
    # Written, the rates' size is known, and few hosts are broadcast.
    kept = verdicts(measured, common.materialize(host_rates(measured))).where("kept")
    return kept.select(*[F.col("doc")[c].alias(c) for c in names])


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (
  SELECT *, CASE WHEN len(words) < 3 THEN [] ELSE
    list_transform(range(0, len(words) - 2), lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END AS grams
  FROM w),
k AS (SELECT row_number() OVER () AS id, * FROM g),
e AS (SELECT id, unnest(grams) AS gram, unnest(range(0, len(grams))) AS pos FROM k),
d AS (SELECT id, pos, count(*) OVER (PARTITION BY id, gram) AS n FROM e),
c AS (
  SELECT id, CAST(sum(least(3, coalesce(pos - prev, 3))) AS BIGINT) AS n FROM (
    SELECT id, pos, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS prev FROM d WHERE n > 1) GROUP BY id),
m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(len(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS word_chars_,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM k LEFT JOIN c USING (id)),
f AS (
  SELECT *, coalesce(word_chars_, 0) AS word_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    5 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR coalesce(word_chars_, 0) > 20 * n_words AS soft
  FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR soft THEN 1 ELSE 0 END) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v FROM h),
q AS (SELECT CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10.0 END AS weight,
             CASE WHEN v > 0 AND m * (1 - m) > v THEN m ELSE 0.1 END AS mean FROM p),
r AS (SELECT source, (bad + weight * mean) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (soft AND rate > 0.05) AND NOT (rate > 0.9) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
