"""Quality rules with host verdicts, in DataFrame functions only.

Every document gets its counts and rule failures; failures are summed per host, each host's
rates are shrunk towards the corpus by a beta prior fitted to the hosts (method of moments),
and the verdict of the host is joined back to its documents.

Defined results: a null text is an empty one; a null host is a host of its own; repeated rows
are repeated results; without rows there are no hosts and no results. Only the named columns
are read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

MIN_WORDS = 50
MAX_HOST_RATE = 0.5
#: bounds of the prior's weight in documents: a host is never judged by its own few rows alone
MIN_PRIOR, MAX_PRIOR = 1.0, 1000.0
RULES = ("short", "repeats", "symbols", "same_lines")


def counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host and the counts of each text; one pass without a shuffle.

    Words in repeated windows: hashes of all 3-word windows are made in the row. Only where two
    are equal they are sorted with their places, and the union of equal windows is measured.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    split = base.withColumn(
        "words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    ).withColumn("lines", F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")) != ""))
    windows = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", "")))
        .cast("long")
        .alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > 2,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ).alias("hashes"),
    )
    placed = windows.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(
                F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
            ),
        ),
    )

    def hash_at(i: Column) -> Column:
        return F.get("placed", i)["h"]

    starts = placed.withColumn(
        "starts",
        F.sort_array(
            F.filter(
                F.transform(
                    "placed",
                    lambda p, i: F.when(
                        F.coalesce(p["h"] == hash_at(i - 1), F.lit(False))
                        | F.coalesce(p["h"] == hash_at(i + 1), F.lit(False)),
                        p["at"],
                    ),
                ),
                lambda at: at.isNotNull(),
            )
        ),
    )
    # F.get of index -1 is null, as is the place after the last
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return starts.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def failures(counted: DataFrame) -> DataFrame:
    """The rules, each a boolean column named after it, decided on whole numbers."""
    return (
        counted.withColumn("short", F.col("n_words") < MIN_WORDS)
        .withColumn("repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        .withColumn("symbols", 10 * F.col("n_symbols") > F.col("word_chars"))
        .withColumn("same_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    )


def host_verdicts(failed: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, rate_<rule> (shrunk) and host_kept; partial sums before the shuffle."""
    hosts = failed.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    )
    raw = [(F.col(r) / F.col("host_docs")) for r in RULES]
    prior = hosts.agg(
        *[F.avg(x).alias(f"m_{r}") for r, x in zip(RULES, raw)],
        *[F.var_pop(x).alias(f"v_{r}") for r, x in zip(RULES, raw)],
    )  # one row

    def shrunk(rule: str) -> Column:
        m, v = F.col(f"m_{rule}"), F.col(f"v_{rule}")
        weight = F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(MAX_PRIOR))
        weight = F.least(F.greatest(weight, F.lit(MIN_PRIOR)), F.lit(MAX_PRIOR))
        return ((F.col(rule) + m * weight) / (F.col("host_docs") + weight)).alias(f"rate_{rule}")

    rated = hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", *map(shrunk, RULES))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return rated.withColumn("host_kept", worst <= max_rate)


def host_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """One row per document with its counts, base_failed, the host's verdict and kept.

    The counts are staged, so texts are read once. The join with the hosts moves narrow rows;
    a hot host is split by adaptive skew handling or broadcast, as its measured size allows.
    """
    failed = failures(cut_lineage(counts(docs, id_col, text_col, host_col)))
    verdicts = host_verdicts(failed, max_rate).withColumnRenamed("host", "_host")
    joined = failed.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    base = F.col("short") | F.col("repeats")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & F.col("host_kept"))
