"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Examples are a bounded sample of the labelled training rows. Every word, and every beginning of a word, that two examples
or more hold is a feature. Its weight in a text is (1 + ln count) * idf * s, where s, from 0 to 1, says how far the examples'
labels differ on the feature: it rises with G, the likelihood-ratio statistic, from 0 where G is below CHANCE_G2 (the 0.1 %
level) to 1 at LABEL_G2. So no number of features is set, rare ones count a little, and topic words don't drown those that
matter. The index is as large as the sample, whatever the corpus, and is broadcast; every document is then scored where it
is read, with no shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Memo, pieces, small_batches, windows

#: At most so many training examples of each label are used: those with the smallest hash of the id.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 1500, 3000
#: Longer texts are no examples (they are scored whole like all others), so that what comes to the driver has a bound.
EXAMPLE_CHARS = 2_000_000
#: The likelihood-ratio statistics up to which a feature has no weight, as chance explains it, and from which it has its full idf.
CHANCE_G2, LABEL_G2 = 10.83, 25.0
#: Blocks of the index that are read at a time.
GROUP = 8
NEIGHBOURS, BLOCK, PRIOR_WEIGHT, THRESHOLD = 15, 128, 1.0, 0.7
_EDGES = ".,;:!?\"'()[]{}<>*_-#$%&|"


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def word_features(word: str) -> list[str]:
    word = word.strip(_EDGES)
    return [f"={word}", f"^{word[:4]}"] if len(word) >= 4 else [f"={word}"] if word else []


class Known(dict):
    """Maps words to the numbers of their features; emptied when large."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)
        return found

    def counts(self, text: str) -> dict[int, int]:
        return Counter(f for fs in map(self.__getitem__, text.lower().split()) if fs for f in fs)


def label_weights(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """idf times s of features that so many of n1 toxic and n0 clean examples hold."""

    def term(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    share = (toxic + clean) / max(1, n1 + n0)
    g2 = 2 * (term(toxic, share * n1) + term(clean, share * n0) + term(n1 - toxic, (1 - share) * n1) + term(n0 - clean, (1 - share) * n0))
    idf = np.log((1 + n1 + n0) / (1 + toxic + clean)) + 1
    return idf * np.clip((g2 - CHANCE_G2) / (LABEL_G2 - CHANCE_G2), 0.0, 1.0) ** 2


class Index:
    """Examples' unit vectors as inverted lists cut into blocks of examples, with each list's greatest weight in each block.

    The examples' features come as three arrays: the example, the feature and its count in the example."""

    def __init__(self, owner: np.ndarray, feature: np.ndarray, count: np.ndarray, toxic: np.ndarray, ids: list, votes: np.ndarray, weights: np.ndarray, prior: float, empty_rate: float, block: int = BLOCK):
        n, self.term_weight = len(ids), weights
        value = (1 + np.log(count)) * weights[feature]
        norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
        value = value / np.where(norm > 0, norm, 1.0)[owner]
        live = value > 0
        owner, feature, value = owner[live], feature[live], value[live]
        first = np.lexsort((-value, owner))  # the heaviest feature of each example: like examples share blocks
        heads = first[np.flatnonzero(np.diff(owner[first], prepend=-1))]
        head = np.full(n, -1, np.int64)
        head[owner[heads]] = feature[heads]
        order = np.lexsort((np.arange(n), head))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.toxic, self.ids, self.votes = toxic[order], [ids[i] for i in order.tolist()], votes[order]
        self.prior, self.empty_rate, self.blocks = prior, empty_rate, max(1, -(-n // block))
        at = place[owner]
        by = np.lexsort((at, feature))
        self.example, self.weight = at[by].astype(np.int32), value[by]
        lists = feature[by].astype(np.int64) * self.blocks + self.example // block
        self.starts = np.searchsorted(lists, np.arange(len(weights) * self.blocks + 1))
        self.most = np.zeros((len(weights), self.blocks))
        np.maximum.at(self.most.ravel(), lists, self.weight)

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k greatest cosines above 0 and their examples, by descending cosine and then example number. Exact: blocks are
        read by descending upper bound until none can hold a better one."""
        features = np.fromiter(counts, np.int64, len(counts))
        values = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.term_weight[features]
        live = values > 0
        features, values = features[live], values[live]
        if not len(values):
            return []
        values /= np.sqrt(values @ values)
        bound = values @ self.most[features]
        order = np.argsort(-bound, kind="stable")
        best, who = np.empty(0), np.empty(0, np.int64)
        for g in range(0, self.blocks, GROUP):
            group = order[g : g + GROUP]
            if bound[group[0]] <= 0 or len(best) == k and bound[group[0]] < best[-1] - 1e-9:
                break
            lists = (features[:, None] * self.blocks + group).ravel()
            starts, lens = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
            at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            scores = np.bincount(self.example[at], self.weight[at] * np.repeat(np.repeat(values, len(group)), lens), minlength=len(self.ids))
            hit = np.flatnonzero(scores)
            if len(hit) > 4 * k:  # those that can't be among the k best go before the sort
                hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k] - 1e-9]
            best, who = np.append(best, scores[hit]), np.append(who, hit)
            top = np.lexsort((who, -np.round(best, 12)))[:k]
            best, who = best[top], who[top]
        return list(zip(best.tolist(), who.tolist()))

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """A vote of the neighbours, each with its cosine and the weight of its label's sampling, with the prior as one more voter."""
        near = self.nearest(counts) if counts else []
        if not near:
            return self.empty_rate, []
        at = np.array([i for _, i in near])
        vote = np.array([s for s, _ in near]) * self.votes[at]
        return float((vote @ self.toxic[at] + PRIOR_WEIGHT * self.prior) / (vote.sum() + PRIOR_WEIGHT)), near


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES) -> tuple[dict[str, int], Index]:
    """Vocabulary and index from the rows that are not held out. Labels other than 0 and 1, and ids labelled both ways, are left out."""
    train = labels.filter(~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2 and y in (0, 1)").select("id", "y")
    total = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    picked = None
    for y, most in ((1, toxic_examples), (0, clean_examples)):
        some = train.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most toxic_examples + clean_examples ids; of rows that repeat an id one is the example
    examples = texts.filter(F.length("text") <= EXAMPLE_CHARS).join(F.broadcast(picked), "id")

    def run(batches):
        memo = Memo()
        for batch in batches:
            for part in pieces(batch, "text"):
                kept = []
                for i, y, text in zip(part.column("id").to_pylist(), part.column("y").to_pylist(), part.column("text").to_pylist()):
                    words = text.lower().split()
                    h = windows(memo.of([w.encode() for w in words]), min(5, len(words))) if words else np.zeros(1, np.uint64)
                    found = Counter(f for w in words for f in word_features(w))
                    kept.append((i, int(y), int(h.min().view(np.int64)), list(found), list(found.values())))
                columns = [pa.array([r[c] for r in kept], t) for c, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.list_(pa.string())), (4, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "y", "sketch", "features", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    rows = examples.mapInArrow(run, f"id {kind}, y int, sketch long, features array<string>, counts array<int>")
    one = rows.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct("sketch", "features", "counts")).alias("_s"))
    found = one.select("id", "y", "_s.*").toArrow()  # bounded by the sample
    # one example stands for its copies and most near copies: they share the least hash of their five-word runs
    rows = sorted(zip(found.column("y").to_pylist(), found.column("sketch").to_pylist(), found.column("id").to_pylist(), range(found.num_rows)), key=lambda r: (r[0], r[1], str(r[2])))
    chosen = sorted((str(i), at) for k, (y, sketch, i, at) in enumerate(rows) if k == 0 or rows[k - 1][:2] != (y, sketch))
    found = found.take(pa.array([at for _, at in chosen], pa.int64())).combine_chunks()
    toxic = np.array(found.column("y").to_pylist(), np.int64)
    n = {1: int(toxic.sum()), 0: int(len(toxic) - toxic.sum())}
    lists, count = found.column("features").combine_chunks(), found.column("counts").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(toxic)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(lists.flatten())
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    c1 = np.bincount(code, toxic[owner], minlength=len(names))
    c0 = np.bincount(code, minlength=len(names)) - c1
    weights = label_weights(c1, c0, n[1], n[0]) if n[0] and n[1] else np.zeros(len(names))
    used = (c1 + c0 >= 2) & (weights > 0)
    number = np.cumsum(used) - 1
    vocabulary = {f: i for i, f in enumerate(names.filter(pa.array(used)).to_pylist())}
    weights, keep = weights[used], used[code]
    # 1 on average over the examples, so that they stand to the prior's one vote alike on tables of any size
    scale = max(1, n[0] + n[1]) / max(1, total.get(0, 0) + total.get(1, 0))
    label_weight = {y: scale * total.get(y, 0) / max(1, n[y]) for y in (0, 1)}
    mass = {y: label_weight[y] * n[y] for y in (0, 1)}
    prior = mass[1] / max(1e-9, mass[0] + mass[1])
    votes = np.where(toxic == 1, label_weight[1], label_weight[0])
    blank = np.bincount(owner[keep], minlength=len(toxic)) == 0  # examples without a feature that counts
    empty_rate = float((votes[blank & (toxic == 1)].sum() + prior) / (votes[blank].sum() + 1))
    return vocabulary, Index(owner[keep], number[code[keep]], count[keep], toxic, found.column("id").to_pylist(), votes, weights, prior, empty_rate)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prefix: str = "toxic_") -> DataFrame:
    """docs with three more columns: toxic_score (0 to 1), toxic_predicted (1 from THRESHOLD on) and toxic_evidence (the
    nearest three examples as structs of id and cosine); the prefix keeps their names apart from those of docs.

    A document without any feature that the labels differ on, an empty or null text too, gets the rate at which such
    examples are toxic. Ties in cosine go by example. Long texts are scored whole. Repeated rows are scored each; without labels of both kinds every score is that of the prior. Ids, and columns other than the
    text, are never inputs of a score. An empty table stays empty.
    """
    vocabulary, index = fit(docs, labels, id_col, text_col, label_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, index))  # bounded by the sample of examples
    names, at = docs.columns, docs.columns.index(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    added = [f"{prefix}{c}" for c in ("score", "predicted", "evidence")]

    def run(batches):
        vocabulary, index = shared.value
        known, done = Known(vocabulary), {}
        for batch in batches:
            for part in pieces(batch, text_col):
                scores, evidence = [], []
                for text in part.column(at).to_pylist():
                    key = xxhash.xxh3_128_digest(text or "")
                    if key not in done:
                        if len(done) > 20_000:
                            done.clear()
                        s, near = index.score(known.counts(text) if text else {})
                        done[key] = s, [{"id": index.ids[i], "cosine": c} for c, i in near[:3]]
                    scores.append(done[key][0])
                    evidence.append(done[key][1])
                columns = [*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.struct([("id", arrow_id), ("cosine", pa.float64())])))]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{added[0]}` double, `{added[1]}` int, `{added[2]}` array<struct<id: {kind}, cosine: double>>"])
    return docs.mapInArrow(run, schema)
