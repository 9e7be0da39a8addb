"""Fill-in-the-middle by escaped marker injection, with DataFrame functions only.

A text becomes a string in which MARK stands after each unit (a run of ASCII letters, or any other character). MARK and
ESCAPE that the text itself holds are escaped first, each as one unit, so marks count the units exactly, substring_index
takes the ranked parts, and unescaping gives the text's own characters back. Each row is handled by itself: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

MARK, ESCAPE = "\x02", "\x01"
#: What the two characters become in an escaped text: ESCAPE and a digit.
ESCAPED_ESCAPE, ESCAPED_MARK = ESCAPE + "1", ESCAPE + "2"
UNIT = f"[A-Za-z]+|{ESCAPE}[12]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that stay plain, and percent of the others that are suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))


def unescaped(marked: Column) -> Column:
    """The characters of a marked text, without its marks."""
    plain = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPED_MARK), F.lit(MARK)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def marked_units(text: Column) -> Column:
    return F.regexp_replace(escaped(text), f"({UNIT})", "$1" + MARK)


def first_units(marked: Column, n: Column) -> Column:
    """The first n units of a marked text, with the marks between them."""
    return F.call_function("substring_index", marked, F.lit(MARK), n.cast("int"))


def last_units(marked: Column, n: Column) -> Column:
    """The last n units of a text in which a mark stands after every unit but the last."""
    return F.when(n > 0, F.call_function("substring_index", marked, F.lit(MARK), (-n).cast("int"))).otherwise(F.lit(""))


def _draw(digest: str, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
    plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, prefix: str = "fim_",
) -> DataFrame:
    """docs with five more columns, named with `prefix`: n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain) and output.

    Two cuts, the form and the order come from the sha256 of seed, a colon and the id, so a rerun gives the same output.
    A null text counts as empty and so is plain; a text that spells out a marker is plain, as its parts couldn't be told
    apart. A null id draws as an empty one; rows that repeat an id are each cut at that id's draws. An empty table stays
    empty. Other columns pass through, whatever their names: only a column named as one of the five is refused.
    """
    added = [prefix + c for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already: choose another prefix")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    df = docs.select(
        *own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256).alias("_digest"),
    )
    df = once(df, "_marked", marked_units(F.col("_text")))
    df = df.withColumn("_n", (F.length("_marked") - F.length(F.replace("_marked", F.lit(MARK), F.lit("")))).cast("long"))
    x, y = _draw("_digest", 0) % (F.col("_n") + 1), _draw("_digest", 1) % (F.col("_n") + 1)
    spelled = [F.contains("_text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("_text") == "") | spelled[0] | spelled[1] | spelled[2] | (_draw("_digest", 2) % 100 >= 100 - plain_share)
    form = F.when(plain, "plain").when(_draw("_digest", 3) % 100 < spm_share, "spm").otherwise("psm")
    df = df.withColumns({"_a": F.least(x, y), "_b": F.greatest(x, y), "_form": form})
    marked, a, b, n = F.col("_marked"), F.col("_a"), F.col("_b"), F.col("_n")
    parts = F.when(
        F.col("_form") != "plain",
        F.struct(
            unescaped(first_units(marked, a)).alias("p"),
            unescaped(last_units(first_units(marked, b), b - a)).alias("m"),
            unescaped(last_units(marked, n - b + 1)).alias("s"),  # what follows the last mark is empty and counts as one
        ),
    )
    df = once(df, "_parts", parts)
    p, m, s = (F.col("_parts")[c] for c in "pms")
    output = (
        F.when(F.col("_form") == "plain", F.col("_text"))
        .when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    )
    values = (n, F.col("_form"), F.length(p).cast("long"), F.length(m).cast("long"), output)
    return df.select(*back, *[v.alias(c) for v, c in zip(values, added)])


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from the output and its form alone. No part holds a marker, and none of the markers can overlap
    another string's end and start, so each is found where it was put."""
    first, second = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    rest = F.substr(output, F.length(first) + 1)
    head, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    one = F.call_function("substring_index", head, second, F.lit(1))
    two = F.call_function("substring_index", head, second, F.lit(-1))
    prefix, suffix = F.when(form == "psm", one).otherwise(two), F.when(form == "psm", two).otherwise(one)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
