"""Near-duplicate groups by DartMinHash signatures, banded joining and exact checks.

DartMinHash: every element owns a region as high as its weight, at which darts are thrown by hashing. A dart has a
position in the region's height, a rank and one of k coordinates. The darts that hit below the element's weight count,
and a signature keeps, for each coordinate, the dart of the earliest rank. Two weighted sets agree in a coordinate with
the probability of their weighted Jaccard similarity. Darts are thrown rank interval by rank interval, each twice as long
as the one before it, until no coordinate is empty: a large set needs a fraction of the first, a small one a few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, join_groups, mixed, small_batches, texts_of, windows, written

SHINGLE, SIMILARITY = 5, 0.8
#: k coordinates in BANDS bands of ROWS: at similarity 0.8 a pair shares no band once in 2e7 times.
BANDS, ROWS = 32, 4
#: A block of a pivot's members has about so many members and shingles at most.
BLOCK, BLOCK_SHINGLES = 512, 150_000
#: Cumulative probabilities of 0, 1, 2 ... darts where one is expected (Poisson), scaled to 2^53.
_POISSON = np.cumsum([np.exp(-1.0) / x for x in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def shingles(text: bytes, memo: Memo, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words, A-Z lower-cased; of all words together where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = memo.of(words)
    return np.unique(windows(h, min(n, len(h))))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k dart hashes for every non-empty set of 64-bit elements; weights (1 where not given) are positive.

    An element of weight w owns cells of height 1, the last of the remaining height."""
    signature = np.zeros((len(sets), k), np.uint64)
    if not sets:
        return signature
    sizes = np.array([len(s) for s in sets])
    owner, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets).astype(np.uint64)
    height = np.ones(len(element))
    if weights is not None:
        w = np.concatenate(weights).astype(np.float64)
        cells = np.ceil(w).astype(np.int64)
        number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        height = np.minimum(1.0, np.repeat(w, cells) - number)
        owner, element = np.repeat(owner, cells), mixed(np.repeat(element, cells) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    level = 0
    while len(owner):
        best = np.full((len(sets), k), np.inf)
        # interval `level` of the ranks: [2^level - 1, 2^(level + 1) - 1), one expected dart per unit of rank and height
        repeat = 1 << level
        cell = mixed(np.repeat(element, repeat) + np.tile(np.arange(repeat, 2 * repeat, dtype=np.uint64), len(element)) * np.uint64(0xD1B54A32D192ED03))
        n = np.searchsorted(_POISSON, _unit(mixed(cell ^ np.uint64(0x2545F4914F6CDD1D))))
        at = np.repeat(np.arange(len(cell)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mixed(cell[at] + (nth + 1).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        source = at // repeat
        hit = _unit(mixed(dart ^ np.uint64(0xA0761D6478BD642F))) < height[source]
        dart, source, at = dart[hit], source[hit], at[hit]
        rank = repeat - 1 + at % repeat + _unit(mixed(dart ^ np.uint64(0xE7037ED1A0B428DB)))
        slot = owner[source] * k + (mixed(dart ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(k)).astype(np.int64)
        empty = (signature == 0).ravel()
        new = empty[slot]
        slot, rank, dart = slot[new], rank[new], dart[new]
        np.minimum.at(best.ravel(), slot, rank)
        first = rank == best.ravel()[slot]
        signature.ravel()[slot[first]] = dart[first] | np.uint64(1)
        open_ = (signature == 0).any(1)
        keep = open_[owner]
        owner, element, height, level = owner[keep], element[keep], height[keep], level + 1
    return signature


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h ^ mixed(np.arange(1, bands + 1, dtype=np.uint64))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def set_hash(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, same, bands): `same` is a hash of the set of shingles, equal where nothing but order of repeats or case differs;
    key is a hash of the text, which tells rows of one id apart."""

    def run(batches):
        memo = Memo()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                sets = [shingles(t, memo) for t in texts_of(part.column("text"))]
                same = [set_hash(s) for s in sets]
                at = [i for i, s in enumerate(sets) if len(s)]
                bands = bands_of(dart_signatures([sets[i] for i in at])).view(np.int64)
                lens = np.zeros(len(sets), np.int64)
                lens[at] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(same, pa.int64()), lists], ["id", "key", "same", "bands"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, same long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, size, shingles binary) from (node, text); texts of another set than the node's (of a repeated id) are left out."""

    def run(batches):
        memo = Memo()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [shingles(t, memo) for t in texts_of(part.column("text"))]
                own = [set_hash(x) == node for x, node in zip(found, part.column("node").to_pylist())]
                part, found = part.filter(pa.array(own, pa.bool_())), [x for x, mine in zip(found, own) if mine]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "size", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, shingles binary")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the exact Jaccard similarity to (a, b, ...) pairs. A set is sent once for each pair that needs it and compared where it arrives."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    names = pairs.columns

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("_sa").to_pylist(), batch.column("_sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64())], [*names, "similarity"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), "similarity double"])
    return joined.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b), root the smallest node; for nodes with edges only.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of the longest path and a node with
    many neighbours only ever links them to its smallest one. A node's least neighbour comes from an aggregate, which
    adds up before its shuffle, and is held before it goes back to the node's edges: a small table of them is broadcast,
    and a large one meets the edges in a join whose skewed parts Spark splits. It ends when all that is left are stars.
    """

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(cut(least), "u")

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        role = lambda node, up, top: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(top).alias("top"))
        roles = now.select(F.inline(F.array(role("u", 1, 0), role("v", 0, 1))))
        roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
        if roles.filter("up > 1 or up = 1 and top = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        joined = with_least(large, large.groupBy("u").agg(F.min("v").alias("m")))
        now = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def dealt_cells(members: DataFrame, similarity: float) -> DataFrame:
    """Deals (pivot, node, mask, d, root, size) to cells: adds `cell`, and `side` (1, 2 or both, 3). Every two of a pivot's
    members that differ in root meet in a cell, except where their distances d from the pivot say that they can't be similar.

    A pivot with few members has one cell. Else its members form blocks by root (small roots together) and distance, which
    are dealt on by a hash, and two blocks make a cell; so no cell is large, and none has two blocks of one root."""
    total = members.count()
    pivots = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    open_ = cut(join_groups(members, cut(pivots), "pivot", "n", total).filter("n is not null"))
    fits = (F.col("n") <= BLOCK) & (F.col("s") <= BLOCK_SHINGLES)
    few = open_.filter(fits).withColumn("cell", F.struct("pivot", F.lit(0).alias("x"), F.lit(0).alias("y"))).withColumn("side", F.lit(3))
    many = open_.filter(~fits).drop("n", "s").withColumn("key", F.struct("pivot", "root"))
    own = many.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= BLOCK).withColumn("own", F.lit(True))
    many = join_groups(many, cut(own), "key", "m", total)
    part = F.struct("pivot", F.when(F.col("own"), F.col("root")).alias("root"), F.floor(F.col("d") / (1 - similarity + 1e-9)).alias("bin"))
    many = cut(many.withColumn("part", part).drop("key", "own", "m"))
    parts = many.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    parts = cut(parts.select("part", "m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("k")))
    many = join_groups(many, parts, "part", "m", total).withColumn("block", F.struct("part", F.pmod(F.xxhash64("node"), F.col("k")).alias("j"))).drop("part", "m", "k")
    blocks = parts.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).select(F.col("part.pivot").alias("pivot"), F.struct("part", "j").alias("block"))
    numbered = blocks.groupBy("pivot").agg(F.array_sort(F.collect_set("block")).alias("all")).select("pivot", F.posexplode("all").alias("x", "block"))  # a row per block, not per member
    numbered = cut(numbered)
    other = numbered.select("pivot", F.col("x").alias("y"), F.col("block").alias("other"))
    apart = ~F.coalesce(F.col("block.part.root") == F.col("other.part.root"), F.lit(False))
    cells = numbered.join(other, "pivot").filter((F.col("x") <= F.col("y")) & apart & (F.abs(F.col("block.part.bin") - F.col("other.part.bin")) <= 1))
    cells = cut(cells.select("block", "other", F.struct("pivot", "x", "y").alias("cell")))
    sides = cells.select("block", "cell", F.when(F.col("cell.x") == F.col("cell.y"), 3).otherwise(1).alias("side"))
    sides = sides.union(cells.filter("cell.x < cell.y").select("other", "cell", F.lit(2)))
    names = ["node", "mask", "d", "root", "size", "cell", "side"]
    return few.select(names).union(many.join(sides, "block").select(names))


def links_of_cell(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): roots that the cell's similar pairs of members link, as few as connect the same roots."""
    node, mask, d, root, size, side = (table.column(c).to_numpy() for c in ("node", "mask", "d", "root", "size", "side"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
    a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    pair = node[a][:, None] < node[b] if (side == 3).any() else np.ones((len(a), len(b)), bool)
    pair &= (root[a][:, None] != root[b]) & (np.abs(d[a][:, None] - d[b]) <= 1 - similarity + 1e-9)
    pair &= np.minimum(size[a][:, None], size[b]) >= (similarity - 1e-9) * np.maximum(size[a][:, None], size[b])
    seen, mine = np.zeros_like(pair), np.zeros_like(pair)
    for k in range(BANDS):  # a pair belongs to the pivot of the first band that it shares
        equal = bands[a, k][:, None] == bands[b, k]
        mine |= equal & ~seen & (mask[a] >> k & 1).astype(bool)[:, None]
        seen |= equal
    x, y = np.nonzero(pair & mine)
    x, y = a[x], b[y]
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()] if len(x) else []
    if len(x) <= 200:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    else:
        owner = np.repeat(np.arange(len(sets)), size)
        _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        keep = times[word] > 1
        owner, word = owner[keep], number[word[keep]]
        order = np.argsort(word, kind="stable")
        owner, word = owner[order], word[order]
        common = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
            lo, hi = np.searchsorted(word, [at, at + 4096])
            tile = np.zeros((len(sets), 4096), np.float32)
            tile[owner[lo:hi], word[lo:hi] - at] = 1
            common += tile[a] @ tile[b].T
        both = common[np.searchsorted(a, x), np.searchsorted(b, y)].astype(np.int64)
    near = both / np.maximum(1, size[x] + size[y] - both) >= similarity if len(x) else np.zeros(0, bool)
    up, links = {}, []

    def top(i):
        while i in up:
            i = up[i]
        return i

    for i, j in {*zip(root[x[near]].tolist(), root[y[near]].tolist())}:
        u, v = sorted((top(i), top(j)))
        if u != v:
            up[v] = u
            links.append((u, v))
    return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})


def compared_cells(cells: DataFrame, sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between roots from all cells. A set is sent once for each cell that needs it."""
    rows = cells.join(sets.select("node", "shingles"), "node").join(classes.select("node", "bands"), "node")
    return rows.groupBy("cell").applyInArrow(lambda table: links_of_cell(table, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its group), class_size, kept (whether it is that document).

    Documents are linked when the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased; a shorter
    text is one shingle) is at least `similarity`; groups are the connected components. Documents with the same set,
    texts without words too, are one class from the start and stand for it with one representative, so copies are never
    paired. A null id is its class's id only where the class has no other; rows that repeat an id are each decided by their
    own text, and those that repeat the text too share its decision.
    Columns other than the two named are ignored; an empty table gives an empty result.

    Candidates share a band. In each band's bucket all members are compared with one of them, the pivot. The pivot is the
    smallest, so the buckets of a large group share a few. Then all pairs of a bucket's members are compared that are still
    in different groups, in cells of two blocks of members of a pivot. Left out are only pairs that can't be similar: by
    their sizes, or as their distances from the pivot differ by more than 1 - similarity (the distance is a metric). So
    two documents at `similarity` are missed only where they share no band.
    """
    return decided(docs, id_col, text_col, similarity).drop("key")


def decided(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """near_duplicates() with the hash of each row's text as `key`."""
    rows = written(signed(docs, id_col, text_col), "signed")
    classes = cut(rows.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")).withColumnRenamed("same", "node"))
    spread = classes.filter(F.size("bands") > 0).select("node", F.posexplode("bands").alias("band", "h"))
    shared = spread.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot")).filter("m > 1").drop("m")
    pairs = spread.join(shared, "h").filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "rep"), "node")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    sets = written(shingle_sets(texts.join(ids, texts["rep"].eqNullSafe(ids["rep"])).select("node", "text")).dropDuplicates(["node"]), "shingles")

    checked = cut(similarities(pairs, sets))
    roots = cut(components(checked.filter(F.col("similarity") >= similarity).select("a", "b")))
    members = checked.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "mask", (1 - F.col("similarity")).alias("d"))
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets.select("node", "size"), "node")
    more = cut(compared_cells(dealt_cells(cut(members), similarity), sets, classes, similarity))

    found = classes.join(roots, "node", "left").select("node", "rep", "n", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():
        found = cut(found)
        moved = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = cut(moved.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root"))
        found = join_groups(found, moved, "root", "m", found.count()).select("node", "rep", "n", F.coalesce("top", "root").alias("root"))
    total = found.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    found = cut(found.join(total, "root").select(F.col("node").alias("same"), "n", "class_id", "class_size"))
    out = join_groups(rows.select("id", "key", "same"), found, "same", "n", rows.count())
    return out.select(F.col("id").alias(id_col), "key", "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their group, with all their columns.

    Texts without words, null or empty, are one group. Rows that repeat an id are each decided by their own text; those that
    repeat the text too stay or go together. A null id stays only where its group has no other. An empty table stays empty,
    and columns may have any names.
    """
    out = decided(docs.select(id_col, text_col), id_col, text_col, similarity).filter("not kept")
    gone = out.select(F.col(id_col).alias("gone_id"), F.col("key").alias("gone_key"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (text_key(docs[text_col]) == gone["gone_key"]), "left_anti")
