"""URL filters: fixed rules first, then a tree of path templates for each host with smoothed shares of bad labelled pages.

All of it works on counts by (host, generalised path): pages are aggregated once and joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_groups

#: Fixed rules of the registered query: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Children whose share of bad pages is within this many standard errors of their siblings' are merged.
SIMILAR_Z = 1.96
#: Weight of the parent's share, in labelled pages, and the share from which a template is blocked.
SMOOTHING, BLOCK_FROM = 5.0, 0.5


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is this host or a parent domain of it and whose path begins this path; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # each longer one overrides
        h, _, p = rule.partition("/")
        found = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The path's segments with what plainly varies made a wildcard: runs of digits, long hexadecimal names."""
    parts = F.array_remove(F.split(path, "/"), "")
    return F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{12,}$"), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "*")))


def ancestors(host: Column, names: Column) -> Column:
    """Digests of a path's ancestors, from the host on, the whole path last: each that of the one above and a name."""
    top = F.struct(F.sha2(F.coalesce(host, F.lit("")), 256).alias("h"), F.array().cast("array<string>").alias("out"))

    def below(acc: Column, name: Column) -> Column:
        return F.struct(F.sha2(F.concat_ws("/", acc["h"], name), 256).alias("h"), F.concat(acc["out"], F.array(acc["h"])).alias("out"))

    return F.aggregate(names, top, below, lambda acc: F.concat(acc["out"], F.array(acc["h"])))


def generalised(paths: DataFrame) -> DataFrame:
    """Adds `template` (an array) to (key, host, segments, n, labelled, bad): children that the labels can't tell from their
    siblings become `*`, an only child keeps its name. Parents are aggregated, never gathered.

    A pass judges all segments of all paths at once, below the templates of the pass before; the first takes the segments
    themselves. A level is right when those above it were, so passes go on until none changes a name: one more than there
    are levels at which a merger above has changed a verdict, however long the paths are."""
    now = cut(paths.withColumn("template", F.col("segments")))
    while True:
        rows = now.select("key", "labelled", "bad", F.posexplode(F.arrays_zip(
            F.col("segments").alias("seg"), F.slice(ancestors(F.col("host"), F.col("template")), 1, F.size("segments")).alias("parent"),
        )).alias("at", "_s")).select("key", "labelled", "bad", "at", "_s.seg", "_s.parent")
        children = cut(rows.groupBy("parent", "seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
        parents = children.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
        rest, rest_bad = F.col("pl") - F.col("labelled"), F.col("pb") - F.col("bad")
        pooled = F.try_divide("pb", "pl")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest)))
        apart = F.abs(F.try_divide("bad", "labelled") - F.try_divide(rest_bad, rest)) > SIMILAR_Z * error
        different = F.coalesce((F.col("labelled") > 0) & (rest > 0) & (error > 0) & apart, F.lit(False))
        name = F.when(different | (F.col("children") == 1), F.col("seg")).otherwise("*")
        named = children.join(parents, "parent").select("parent", "seg", name.alias("name"))
        found = rows.join(named, ["parent", "seg"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_names"))
        joined = now.join(found, "key", "left").withColumn("_new", F.coalesce("_names.name", "template")).drop("_names")
        after = cut(joined.withColumn("_moved", F.col("_new") != F.col("template")).withColumn("template", F.col("_new")).drop("_new"))
        if after.filter("_moved").isEmpty():
            return after.drop("_moved")
        now = after.drop("_moved")


def template_shares(paths: DataFrame) -> DataFrame:
    """(host, template, share): the share of bad pages among a template's labelled ones, smoothed towards its parent's, the
    host's and at last that of all hosts. Every template asks for the counts of its ancestors at once and folds them."""
    total = paths.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1.0)).first()[0]
    templates = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    templates = templates.withColumn("_up", ancestors(F.col("host"), F.col("template")))
    asked = cut(templates.select(F.element_at("_up", -1).alias("id"), "host", "template", "labelled", "bad", F.posexplode("_up").alias("at", "node")))
    nodes = asked.groupBy("node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    counts = asked.select("id", "at", "node").join(nodes, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "labelled", "bad"))).alias("_c"))
    share = F.aggregate("_c", F.lit(total).cast("double"), lambda up, c: (c["bad"] + SMOOTHING * up) / (c["labelled"] + SMOOTHING))
    return asked.filter(F.col("node") == F.col("id")).join(counts.select("id", share.alias("share")), "id").select("host", "template", "share")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, share.

    labels holds (id, bad 0/1); ids labelled twice count as bad if any row says so, and unknown ids are ignored. A page is
    judged by the longest rule that fits, else by its template: blocked when the smoothed share of bad pages is at least
    BLOCK_FROM. Hosts and templates without labels take their parents' share, so they are allowed as long as most labelled
    pages are good. A null url, or one without ://, has an empty host and path. Repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut(rows.withColumn("segments", segments(F.col("path"))).withColumn("key", F.sha2(F.concat_ws("\n", "host", F.concat_ws("/", "segments")), 256)))
    known = labels.groupBy("id").agg(F.max("bad").alias("bad"))
    tagged = rows.join(known, "id", "left")
    paths = cut(tagged.groupBy("key", "host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    paths = generalised(paths)
    full = F.concat(F.lit("/"), F.concat_ws("/", "template"))
    templates = paths.join(template_shares(paths), ["host", "template"]).select("key", "n", full.alias("template"), "share")
    out = join_groups(rows, cut(templates), "key", "n", rows.count())
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules:
        by_rule = F.when(rule == name, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("share") >= BLOCK_FROM, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", F.round("share", 9).alias("share"))
