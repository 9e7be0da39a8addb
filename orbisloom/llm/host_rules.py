"""Quality rules with a verdict for each host, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, join_groups, once

#: Fixed rules: a document fails with fewer words than MIN_WORDS or more than MAX_REPEAT percent of its words repeated.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A host fails when its failure rate, shrunk towards that of all hosts, is above this.
MAX_HOST_RATE = 0.6
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def window_hash(words: list[Column]) -> Column:
    """A hash that brings equal windows together; it decides nothing."""
    return F.xxhash64(*words)


def repeated_words(df: DataFrame, words: str, name: str, n: int = 3) -> DataFrame:
    """Adds how many words stand in a window of n words that the row's array `words` has twice or more.

    Within the row: each window gets one long, a hash whose low bits hold its position. Sorting these longs puts windows of
    one hash side by side, in the order of their positions. Two neighbours of one hash that are equal word by word repeat
    each other. Where neighbours share a hash and differ, something else may stand between equal windows: the windows of
    such a row that share a hash are sorted by their words instead, which puts equal ones side by side for certain. So hashes
    alone decide nothing, either way, and a row costs n log n steps whatever its words are.
    """
    w, size = F.col(words), F.size(words)
    df = once(df, "_bits", F.greatest(F.lit(1), F.length(F.bin(size))))
    df = once(df, "_mask", F.expr("shiftleft(1L, _bits)") - 1)
    mask, keys = F.col("_mask"), F.col("_keys")
    at = lambda i, k: F.get(w, (i + F.lit(k)).cast("int"))
    hashed = lambda i: window_hash([at(i, k) for k in range(n)])
    key = lambda i: hashed(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))
    df = once(df, "_keys", F.when(size >= n, F.sort_array(F.transform(F.sequence(F.lit(0), size - n), key))))
    pos = lambda x: x.bitwiseAND(mask)
    near = lambda x, y: (x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0)

    def equal(x: Column, y: Column) -> Column:
        found = F.lit(True)
        for k in range(n):
            found = found & (at(pos(x), k) == at(pos(y), k))
        return found

    def same(x: Column, j: Column) -> Column:
        y = F.get(keys, j)
        return F.coalesce(near(x, y) & equal(x, y), F.lit(False))

    # only windows that share their hash with a neighbour go on: in most texts a few
    shared = F.filter(keys, lambda x, i: F.coalesce(near(x, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(near(x, F.get(keys, i + 1)), F.lit(False)))
    df = once(df, "_shared", shared).drop("_keys")
    keys = F.col("_shared")
    mixed = F.exists(F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))), lambda i: F.coalesce(near(F.get(keys, i), F.get(keys, i - 1)) & ~equal(F.get(keys, i), F.get(keys, i - 1)), F.lit(False)))
    whole = lambda x: F.struct(*[at(pos(x), k).alias(f"w{k}") for k in range(n)], pos(x).alias("p"))
    df = once(df, "_sorted", F.when(mixed, F.sort_array(F.transform(keys, whole))))
    by_words = F.col("_sorted")

    def alike(x: Column, j: Column) -> Column:
        y, found = F.get(by_words, j), F.lit(True)
        for k in range(n):
            found = found & (x[f"w{k}"] == y[f"w{k}"])
        return F.coalesce(found, F.lit(False))

    again = F.transform(F.filter(by_words, lambda x, i: alike(x, i - 1) | alike(x, i + 1)), lambda x: x["p"])
    plain = F.transform(F.filter(keys, lambda x, i: same(x, i - 1) | same(x, i + 1)), pos)
    df = once(df, "_found", F.sort_array(F.when(by_words.isNotNull(), again).otherwise(plain)))
    found = F.col("_found")
    fewer = F.greatest(F.size(found) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(found, 2, fewer), F.slice(found, 1, fewer), lambda b, a: F.least(b - a, F.lit(n).cast("long")))
    total = F.aggregate(gaps, F.lit(n).cast("long"), lambda s, g: s + g)
    return df.withColumn(name, F.when(F.coalesce(F.size(found), F.lit(0)) > 0, total).otherwise(F.lit(0)).cast("long")).drop("_bits", "_mask", "_shared", "_sorted", "_found")


def document_metrics(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), a row per document."""
    df = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = once(df, "words", F.array_remove(F.split("text", SPACE + "+"), ""))
    df = once(df, "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0))
    df = df.select(
        "id", "host", "words", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = repeated_words(df, "words", "n_repeat_words").drop("words")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def host_verdicts(metrics: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_failed): failure rates shrunk with a beta prior that the hosts' own rates give.

    The prior's mean is the rate of all documents and its weight comes from how much more the hosts' rates differ than
    chance would make them (method of moments, between 1 and 1000 pseudo-documents). rate = (failed + a) / (n + a + b).
    One host alone, or hosts that do not differ, are shrunk fully towards the common rate.
    """
    hosts = metrics.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg(F.sum("n").alias("docs"), F.sum("failed").alias("fails"), F.count(F.lit(1)).alias("hosts"), F.sum(F.pow(F.col("failed"), F.lit(2)) / F.col("n")).alias("sq"))
    mean = F.col("fails") / F.col("docs")
    prior = prior.select("docs", "hosts", mean.alias("m"), (F.col("sq") / F.col("docs") - mean * mean).alias("between"))
    noise = F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("docs")
    spread = F.col("between") - noise
    weight = F.when(spread > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    prior = prior.select("m", weight.alias("weight"))
    rate = (F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    A document stays when it passes the rules itself and its host's shrunk failure rate is at most max_rate. A null text
    has no words, so it fails; documents of a null host form one host of their own. Repeated rows are judged each. An
    empty table gives an empty result; other columns are ignored.
    """
    metrics = cut(document_metrics(docs, id_col, text_col, host_col))
    hosts = cut(host_verdicts(metrics, max_rate))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit("n"))
    joined = join_groups(metrics.withColumn("key", key), hosts.select(key.alias("key"), "n", "rate", "host_failed"), "key", "n", total)
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.round("rate", 9).alias("host_rate"),
    )
