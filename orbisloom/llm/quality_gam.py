"""Quality as a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Each feature of a text is cut into bins. Boosting goes round the features, each time adding a small tree on one feature only,
so what it learns is a table with a number per bin; after that it goes round the pairs of features that explain most of what
is left, and learns a table per pair on coarser bins. The model is a few thousand numbers, whatever the corpus. A text's
score is the logistic of the intercept plus one entry of each table, added for a whole batch of texts at a time where they
are read: scoring shuffles nothing.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, texts_of

#: At most so many labelled training rows are learned from: those with the smallest hash of the id.
EXAMPLES = 12_000
BINS, PAIR_BINS, PAIRS, LEAVES = 32, 8, 10, 3
#: Share of each tree's fit that is added, most rounds, rounds without improvement that end the boosting, and models averaged.
RATE, ROUNDS, PATIENCE, BAGS = 0.15, 150, 10, 4
#: Added to sums of second derivatives, and the least such sum of a leaf.
RIDGE, LEAST_WEIGHT = 1.0, 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_bytes", "word_bytes_spread", "distinct_words", "top_word", "repeated_next", "upper_letters", "digits", "symbols",
    "bars", "shouts", "stops", "commas", "not_ascii", "short_words", "duplicate_lines", "line_words", "ended_lines",
)
_SYMBOLS = np.array([chr(b) in "#*$%&<>{}[]=~^\\@_+/" for b in range(256)])


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(text: bytes) -> tuple[float, ...]:
    """FEATURES of a whole text; all but the first two are shares or rates of its words, characters or lines."""
    words = text.split()
    if not words:
        return (0.0,) * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    count, chars = len(words), int(sizes.sum())
    times = Counter(words)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        float(np.log1p(count)), chars / count, float(sizes.std()), len(times) / count, max(times.values()) / count,
        sum(map(bytes.__eq__, words, words[1:])) / count, upper / max(1, upper + lower), int(seen[48:58].sum()) / chars,
        int(seen[_SYMBOLS].sum()) / chars, int(seen[124]) / count, int(seen[33] + seen[63]) / count, int(seen[46]) / count,
        int(seen[44]) / count, int(seen[128:].sum()) / chars, int((sizes <= 3).sum()) / count, 1 - len(set(lines)) / len(lines),
        float(np.log1p(count / len(lines))), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _loss(y: np.ndarray, margin: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margin, margin)).mean()) if len(y) else 0.0


def _strength(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins in two; 0 where none gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT), _strength(gl, hl) + _strength(gr, hr) - _strength(g.sum(), h.sum()), 0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def step_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree on one feature: sums of first and second derivatives by bin in, a value per bin out."""
    bounds = [0, len(g)]
    while len(bounds) <= leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(bounds, bounds[1:])]
        gain, at, start = max(found)
        if gain <= 0:
            break
        bounds = sorted([*bounds, start + at])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _cut_gains(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bins, the strength of its best two parts (or of the whole, where no cut gains) and the place of the cut."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
    parts = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT), _strength(gl, hl) + _strength(gr, hr), 0)
    parts[:, -1] = _strength(gl[:, -1], hl[:, -1])
    at = parts.argmax(axis=1)
    return parts[np.arange(len(g)), at], at + 1


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two on a grid: a cut on one feature and, on each side, one on the other. Its gain and the value per cell."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if len(a) < 2:
            continue
        ga, hb = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        sides = [(ga[:-1], hb[:-1]), (ga[-1] - ga[:-1], hb[-1] - hb[:-1])]
        (first, at), (second, to) = (_cut_gains(*side) for side in sides)
        total = first + second - _strength(a.sum(), b.sum())
        cut = int(total.argmax())
        if total[cut] > best[0]:
            value = np.zeros_like(a)
            for rows, (x, y), k in ((slice(0, cut + 1), sides[0], at[cut]), (slice(cut + 1, None), sides[1], to[cut])):
                for columns in (slice(0, k), slice(k, None)):
                    value[rows, columns] = x[cut, columns].sum() / (y[cut, columns].sum() + RIDGE)
            best = (float(total[cut]), value.T if turned else value)
    return best


class Gam:
    """Bins, tables and intercept; margins() adds up the entries of a matrix of features, a row per text."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], tables: list[np.ndarray], grids: list[np.ndarray], intercept: float):
        self.edges, self.coarse, self.pairs = edges, coarse, pairs
        self.tables, self.grids, self.intercept = tables, grids, intercept

    @staticmethod
    def binned(values: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, values[:, j], "right") for j, e in enumerate(edges)]

    def margins(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.intercept)
        for table, at in zip(self.tables, self.binned(values, self.edges)):
            out += table[at]
        at = self.binned(values, self.coarse)
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[at[i], at[j]]
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        return _logistic(self.margins(values))


def _edges(values: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts at quantiles; a value that many rows share gets a bin of its own."""
    found = []
    for column in values.T:
        marks = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.empty(0)
        found.append(np.unique(np.concatenate([marks, np.nextafter(marks, np.inf)])))
    return found


def _cyclic(y: np.ndarray, margin: np.ndarray, check: np.ndarray, tables: list[np.ndarray], at: list[np.ndarray], grow) -> None:
    """Boosts the tables in turn, on the rows that aren't to check with, and leaves them as they were at the round that did best on
    those. at: each row's place in each flattened table."""
    learn = ~check
    best, kept, since = _loss(y[check], margin[check]), [t.copy() for t in tables], 0
    for _ in range(ROUNDS):
        for table, place in zip(tables, at):
            p = _logistic(margin[learn])
            g = np.bincount(place[learn], y[learn] - p, minlength=table.size).reshape(table.shape)
            h = np.bincount(place[learn], p * (1 - p), minlength=table.size).reshape(table.shape)
            step = RATE * grow(g, h)
            table += step
            margin += step.ravel()[place]
        loss = _loss(y[check], margin[check])
        if loss < best - 1e-6:
            best, kept, since = loss, [t.copy() for t in tables], 0
        elif (since := since + 1) >= PATIENCE:
            break
    for table, good, place in zip(tables, kept, at):
        margin -= (table - good).ravel()[place]
        table[...] = good


def fit_gam(values: np.ndarray, y: np.ndarray, names: int = len(FEATURES)) -> Gam:
    """The average of BAGS models, each checked on another share of the rows. Rows of one label only give its smoothed rate."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    values = values.reshape(-1, names)
    edges, coarse = _edges(values, BINS), _edges(values, PAIR_BINS)
    at, low = Gam.binned(values, edges), Gam.binned(values, coarse)
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < y.sum() < len(y):
        return Gam(edges, coarse, [], tables, [], intercept)
    fold = np.arange(len(y)) % BAGS
    learned, margins = [], []
    for bag in range(BAGS):
        mine, margin = [np.zeros_like(t) for t in tables], np.full(len(y), intercept)
        _cyclic(y, margin, fold == bag, mine, at, step_tree)
        learned.append(mine)
        margins.append(margin)
    tables = [np.mean([mine[j] for mine in learned], axis=0) for j in range(len(tables))]
    p = _logistic(np.mean(margins, axis=0))
    gains = []
    for i, j in combinations(range(len(edges)), 2):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        place = low[i] * shape[1] + low[j]
        g = np.bincount(place, y - p, minlength=shape[0] * shape[1]).reshape(shape)
        h = np.bincount(place, p * (1 - p), minlength=shape[0] * shape[1]).reshape(shape)
        gains.append((pair_tree(g, h)[0], (i, j)))
    pairs = [pair for gain, pair in sorted(gains, key=lambda x: (-x[0], x[1]))[:PAIRS] if gain > 0]
    shapes = [(len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in pairs]
    places = [low[i] * shape[1] + low[j] for (i, j), shape in zip(pairs, shapes)]
    grids = [np.zeros(shape) for shape in shapes]
    for bag in range(BAGS):
        mine = [np.zeros(shape) for shape in shapes]
        _cyclic(y, margins[bag], fold == bag, mine, places, lambda g, h: pair_tree(g, h)[1])
        grids = [grid + m / BAGS for grid, m in zip(grids, mine)]
    return Gam(edges, coarse, pairs, tables, grids, intercept)


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", examples: int = EXAMPLES) -> Gam:
    """The model of the labelled rows that aren't held out: at most `examples` ids, of which the features alone, 18 numbers each,
    come to the driver. Ids labelled both ways, or otherwise than 0 and 1, are left out; of rows that repeat an id one counts."""
    train = labels.filter(~held_out(f"`{id_col}`") & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id"))
    train = train.agg(F.min(f"`{label_col}`").alias("y"), F.max(f"`{label_col}`").alias("y2")).filter("y = y2 and y in (0, 1)")
    total = train.count()
    # by a cut on the hash first, so that the last sort sees about twice as many rows as it keeps, however many labels there are
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    picked = train.filter(part < int((1 << 40) * min(1.0, (2 * examples + 1000) / max(1, total))))
    picked = picked.orderBy(part, "id").limit(examples).select("id", "y")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(picked), "id")  # picked has at most `examples` rows

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                values = pa.FixedSizeListArray.from_arrays(pa.array(_matrix(texts_of(part.column("text"))).ravel()), len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y").cast(pa.int32()), values.cast(pa.list_(pa.float64()))], ["id", "y", "x"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, y int, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    found = found.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").select("y", "x").toArrow()  # bounded by `examples`
    values = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit_gam(values, np.array(found.column("y").to_pylist(), np.float64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prefix: str = "quality_") -> DataFrame:
    """docs with two more columns: quality_score (0 to 1) and quality_predicted (1 from THRESHOLD on); the prefix keeps their
    names apart from those of docs, and a clash is refused.

    An empty or null text, or one of blanks only, has 0 for every feature and gets the score of such a row. Whole texts count,
    however long. Equal texts get equal scores; repeated rows are scored each. Without labels of both kinds every score is the
    smoothed rate of the one there is (0.5 without any). Ids and columns other than the text are never inputs of a score. An
    empty table stays empty.
    """
    added = [f"{prefix}{c}" for c in ("score", "predicted")]
    if clash := set(added) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already: choose another prefix")
    model = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of BINS and PAIR_BINS
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(len(names))])
            for part in pieces(batch, f"c{at}"):
                scores = shared.value.scores(_matrix(texts_of(part.column(at))))
                flags = (scores >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(flags)], [*names, *added])

    small_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{added[0]}` double, `{added[1]}` int"])
    return docs.mapInArrow(run, schema)
