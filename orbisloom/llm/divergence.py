"""Source divergence audit: how far the words of each source of a language differ from those of the others.

Counts of (language, source, term) are added up in the tasks that read the texts and then by one shuffle. The terms of a
language are dealt into vocabulary chunks and its sources into blocks, both by hash and of bounded size. A source's counts
in a chunk are one packed row. Each pair of blocks is a tile: packed rows go to all tiles of their block, where they arrive
sorted by chunk, so a tile holds two blocks of one chunk at a time and adds up its submatrix. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, join_groups, pieces, small_batches, texts_of, written

#: Fixed: p and q are shares in units of 1 / UNIT, and a kept term stands in at least LEAST_DOCS documents of its language.
UNIT, LEAST_DOCS = 1_000_000_000, 3
#: Terms in a vocabulary chunk and sources in a block, on average: bounds of what a tile holds.
CHUNK_TERMS, BLOCK_SOURCES = 8_192, 32
#: Successive chunks that one task adds up; the sums of a tile's spans are added by a small shuffle.
SPAN = 8
#: Entries that a task adds up before it passes them on.
HELD_ENTRIES = 300_000
#: Ranks of the part `term`.
TOP_TERMS = 200

#: ASCII letters stay, in lower case; other ASCII characters separate terms; bytes of 0x80 and above belong to terms.
_TERM_BYTES = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b) in LOWER else 0x20 for b in range(256)
)


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents. A group also gives a row of a null term, with its documents."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        rows: Counter = Counter()

        def flushed():
            for key, (n, docs) in held.items():
                terms = list(n)
                columns = [[key[0]] * len(terms), [key[1]] * len(terms), terms, list(n.values()), [docs[t] for t in terms]]
                yield columns
            if rows:
                yield [[k[0] for k in rows], [k[1] for k in rows], [None] * len(rows), [0] * len(rows), list(rows.values())]
            held.clear()
            rows.clear()

        def batch(columns):
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for whole in batches:
            for piece in pieces(whole, "text"):
                langs, sources = piece.column("lang").to_pylist(), piece.column("source").to_pylist()
                for lang, source, text in zip(langs, sources, texts_of(piece.column("text"))):
                    found = Counter(text.translate(_TERM_BYTES).split())
                    rows[lang, source] += 1
                    n, docs_with = held[lang, source]
                    n.update(found)
                    docs_with.update(found.keys())
                if len(rows) + sum(len(n) for n, _ in held.values()) > HELD_ENTRIES:
                    yield from map(batch, flushed())
        yield from map(batch, flushed())

    small_batches(docs.sparkSession)
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col)]
    texts = docs.select(names[0].alias("lang"), names[1].alias("source"), F.col(f"`{text_col}`").alias("text"))
    partial = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / total) of two columns of longs, by exact decimals."""
    return F.expr(f"1L + ((cast({count} + 1 as decimal(20, 0)) * {UNIT}) div cast({total} as decimal(20, 0)))")


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """share() of arrays. As count + 1 never exceeds the total, three steps of a long division by thousands stay within 64 bits
    up to totals of 9 * 10^15."""
    rest, quotient = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // total
        rest %= total
    return quotient + 1


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of p and each row of q, floor((p - q)^2 / q) summed over the columns."""
    out = np.empty((len(p), len(q)), np.int64)
    for i, row in enumerate(p):
        step = row - q
        step *= step
        step //= q
        out[i] = step.sum(axis=1)
    return out


class _Tile:
    """The sources of two blocks of a language and the sums of their pairs over the chunks that have come by.

    Rows arrive by chunk: first those of the roster (no terms), then each chunk's packed counts."""

    def __init__(self, key: tuple):
        self.key, self.names, self.totals, self.sums = key, {}, {}, None
        self.chunk, self.width, self.rows = None, 0, []

    def add(self, side: int, source: str, total: int, chunk: int, width: int, at: np.ndarray | None, n: np.ndarray | None) -> None:
        if at is None:
            mine = self.names.setdefault(side, {})
            mine[source] = len(mine)
            self.totals.setdefault(side, []).append(total)
            return
        if chunk != self.chunk:
            self.close()
            self.chunk, self.width = chunk, width
        self.rows.append((side, source, at, n))

    def close(self) -> None:
        """Adds the chunk at hand to the sums."""
        sides = (0, 0) if self.key[1] == self.key[2] else (0, 1)
        if self.sums is None:
            size = [len(self.names.get(s, ())) for s in sides]
            self.sums = [np.zeros((size[0], size[1]), np.int64), np.zeros((size[1], size[0]), np.int64)]
        if not self.rows:
            return
        shares = []
        for side in sorted(set(sides)):
            counts = np.zeros((len(self.names.get(side, ())), self.width), np.int64)
            for s, source, at, n in self.rows:
                if s == side:
                    counts[self.names[side][source], at] = n
            shares.append(_shares(counts, np.array(self.totals.get(side, []), np.int64)[:, None]))
        self.sums[0] += _differences(shares[0], shares[-1])
        if len(shares) > 1:
            self.sums[1] += _differences(shares[1], shares[0])
        self.rows = []

    def result(self) -> pa.RecordBatch:
        self.close()
        sides = (0, 0) if self.key[1] == self.key[2] else (0, 1)
        names = [list(self.names.get(s, ())) for s in sides]
        found = [(a, b, int(v)) for a, line in zip(names[0], self.sums[0]) for b, v in zip(names[1], line) if a != b]
        if sides == (0, 1):
            found += [(b, a, int(v)) for b, line in zip(names[1], self.sums[1]) for a, v in zip(names[0], line)]
        columns = [[self.key[0]] * len(found), *([r[c] for r in found] for c in range(3))]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "item", "value"])


def tiled_pairs(packed: DataFrame, roster: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    packed: lang, source, chunk, width, at (places in the chunk), n. roster: lang, source, block, blocks, chunks, total. Rows
    go to the tiles (least block, greatest block) that their block is in, side 0 or 1; in a tile of a block with itself once.
    """
    group = ["lang", "source", "block", "blocks", "total"]
    rows = packed.join(roster, ["lang", "source"]).select(
        *group, F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "width", "at", "n"
    )
    spans = F.greatest(F.ceil(F.col("chunks") / SPAN), F.lit(1)).cast("int")
    names = roster.select(
        *group, F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"), F.lit(-1).alias("chunk"), F.lit(0).alias("width"),
        F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<bigint>").alias("n"),
    )
    rows = rows.unionByName(names).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "span",
        (F.col("block") > F.col("other")).cast("int").alias("side"), "source", "total", "chunk", "width", "at", "n",
    )
    key = ["lang", "low", "high", "span"]

    def run(batches):
        tile = None
        for batch in batches:
            at, n = batch.column("at"), batch.column("n")
            places, counts = at.values.to_numpy(), n.values.to_numpy()
            starts = at.offsets.to_numpy()
            present = at.is_valid().to_numpy(zero_copy_only=False)
            plain = [batch.column(c).to_pylist() for c in (*key, "side", "source", "total", "chunk", "width")]
            for i, (lang, low, high, span, *rest) in enumerate(zip(*plain)):
                if tile is None or tile.key != (lang, low, high, span):
                    if tile:
                        yield tile.result()
                    tile = _Tile((lang, low, high, span))
                x, y = starts[i], starts[i + 1]
                tile.add(*rest, *((places[x:y], counts[x:y]) if present[i] else (None, None)))
        if tile:
            yield tile.result()

    dealt = rows.repartition(*key).sortWithinPartitions(*key, "chunk")
    sums = dealt.mapInArrow(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group that occurs.

    Part `pair`: each other source of the language and the summed difference to it. Part `term`: the group's top_terms terms
    above the language's share. Ranks count from 1 by descending value and then by the item's bytes. Nulls in text, language
    and source count as empty, so they form groups of their own; a group without kept terms has pairs only, of value 0 where
    its language keeps no term. Repeated rows count each. Long texts count whole. An empty table gives an empty result; other
    columns are ignored.
    """
    counts = written(term_counts(docs, lang_col, source_col, text_col), "terms")
    terms = counts.filter("term is not null")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    vocabulary = cut(vocabulary.filter(F.col("docs") >= least_docs).drop("docs"))
    # a row per language: V, N and the numbers of chunks and blocks
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sources = counts.filter("term is null").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    sizes = sources.join(sizes, "lang", "left").select(
        "lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("lang_total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"),
        F.ceil(F.col("v") / chunk_terms).cast("int").alias("chunks"), F.ceil(F.col("sources") / block_sources).cast("int").alias("blocks"),
    )
    sizes = cut(sizes)
    every = sizes.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("sources"), F.lit(0))).first()
    placed = join_groups(vocabulary, sizes.select("lang", "v", "chunks"), "lang", "v", every[0])
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    in_chunk = Window.partitionBy("lang", "chunk")
    placed = placed.select(
        "lang", "term", "lang_n", "chunk", (F.row_number().over(in_chunk.orderBy("term")) - 1).alias("at"),
        F.count(F.lit(1)).over(in_chunk).cast("int").alias("width"),
    )
    kept = written(terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept_terms")
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("n_terms"))
    roster = join_groups(counts.filter("term is null").select("lang", "source"), sizes, "lang", "sources", every[1])
    roster = roster.join(used, ["lang", "source"], "left")
    roster = cut(roster.select(
        "lang", "source", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks", "chunks", "lang_total",
        (F.coalesce("used", F.lit(0)) + F.col("v")).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
    ))

    packed = kept.groupBy("lang", "source", "chunk").agg(
        F.first("width").alias("width"), F.collect_list(F.struct("at", "n")).alias("held")
    )
    packed = packed.select("lang", "source", "chunk", "width", F.col("held.at").alias("at"), F.col("held.n").alias("n"))
    pairs = tiled_pairs(packed, roster.select("lang", "source", "block", "blocks", "chunks", "total"))

    keyed = roster.select(F.to_json(F.array("lang", "source")).alias("key"), "total", "lang_total", "n_terms")
    rows = kept.select("lang", "source", "term", "n", "lang_n", F.to_json(F.array("lang", "source")).alias("key"))
    rows = join_groups(rows, keyed, "key", "n_terms", keyed.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0])
    rows = rows.withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")})
    value = F.expr("(p - q) * (p - q) div q")
    found = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank"
    )
