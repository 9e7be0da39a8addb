"""Language-model scoring with a weighted backoff automaton over smoothed trigrams.

States are the contexts that training texts have: the root, one word (or the text's beginning), and two words. A state's
arcs are the words that followed it, each with the smoothed log probability; every other word takes the state's failure
arc, which has a weight of its own, to the state without the context's first word, and at last to the root, which knows
every word. A text is read once from left to right: the automaton stands in one state, takes an arc at each token, after
as many failure arcs as it needs, adds up their weights and carries on from where the arc leads.

The automaton grows with the corpus, so nobody holds it whole: a block of documents counts its own n-grams, buckets of
n-grams add up the counts of all blocks and answer each block for what it asked (exchange.py), and the block compiles
the answers into the part of the automaton that its own texts can reach.

Probabilities (c: training counts, N tokens, V distinct ones): P(w) = (c(w) + 1) / (N + V + 1), which leaves one share for
all unknown words; P(w | v) = (c(vw) + K P(w)) / (c(v) + K); P(w | uv) = (c(uvw) + K P(w | v)) / (c(uv) + K). So the
failure arc of a context h weighs K / (c(h) + K), and what follows any context adds up to one. All n-grams count,
those seen once too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import mixed, written

#: K: the weight of the shorter context, in tokens.
BACKOFF = 2.0
#: Places of a text's end and beginning among a block's words; their names can't be words, which hold no line ends.
END, BEGIN = 0, 1
#: Bytes of keys (words, bigrams and trigrams) that a byte of text gives, for the number of buckets.
KEYS_PER_BYTE = 2.0
#: Bytes of text in a block, whose n-grams and automaton one task holds.
BLOCK_BYTES = 4_000_000


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(texts: list[bytes | None], rows=None) -> list[bytes]:
    """A block's columns: hashes of its distinct words, each token's place among these, and tokens per text."""
    numbers = Numbers({b"\n": END, b"\n\n": BEGIN})
    tokens, sizes = [], []
    for t in texts:
        words = (t or b"").lower().split()
        tokens += [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.array([END], np.int32)]
        sizes.append(len(words) + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    word = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
    return [hashes.tobytes(), exchange.pack_array(word), exchange.pack_array(np.array(sizes, np.int32))]


class Block:
    """A block's tokens and its distinct words, bigrams and trigrams, in each order sorted by (context, word)."""

    def __init__(self, words: bytes, tokens: bytes, sizes: bytes, train: np.ndarray):
        self.hashes = np.frombuffer(words, np.uint64)
        self.word, self.sizes = exchange.unpack_array(tokens, np.int32), exchange.unpack_array(sizes, np.int32).astype(np.int64)
        self.starts, self.train = np.cumsum(self.sizes) - self.sizes, np.asarray(train, bool)
        w = self.w = len(self.hashes)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = BEGIN
        self.bigrams, pair = np.unique(before.astype(np.int64) * w + self.word, return_inverse=True)
        inside = np.ones(len(self.word), bool)
        inside[self.starts] = False
        inside = np.flatnonzero(inside)
        self.trigrams, first, triple = np.unique(pair[inside - 1] * w + self.word[inside], return_index=True, return_inverse=True)
        self.suffix = pair[inside[first]]  # of each trigram, the bigram that ends it
        learn = np.repeat(self.train, self.sizes)
        self.counts = [np.bincount(self.word[learn], minlength=w), np.bincount(pair[learn], minlength=len(self.bigrams)), np.bincount(triple[learn[inside]], minlength=len(self.trigrams))]
        self.counts[0][BEGIN] = self.train.sum()
        del before, learn, inside, triple
        follow = lambda h, k, odd: mixed(h * np.uint64(odd) + mixed(self.hashes[k]))
        two = follow(self.hashes[self.bigrams // w], self.bigrams % w, 0x9E3779B97F4A7C15)
        three = follow(two[self.trigrams // w], self.trigrams % w, 0xD1B54A32D192ED03)
        # 56 bits each; the last one tells words from longer n-grams and from the beginning
        one = self.hashes >> np.uint64(8) | np.uint64(1)
        one[BEGIN] ^= np.uint64(1)
        longer = np.concatenate([two, three]) >> np.uint64(9) << np.uint64(1)
        self.keys, self.place = np.unique(np.concatenate([one, longer]), return_inverse=True)

    def own(self) -> np.ndarray:
        """The training counts of the block's sorted distinct keys."""
        return np.bincount(self.place, np.concatenate(self.counts), minlength=len(self.keys)).astype(np.int64)

    def told(self, answers: np.ndarray) -> list[np.ndarray]:
        """Counts over the corpus of words, bigrams and trigrams, from the answers for the keys."""
        return np.split(answers[self.place], [self.w, self.w + len(self.bigrams)])


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. State 0 is the root, then come words, then bigrams.

    codes holds the arcs, sorted, as state * words + word; weight and target belong to them. The root's arcs stand apart
    (root and root_target, by word), as it has one for every word. fail and fail_weight are the states' failure arcs."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, types: int, backoff: float = BACKOFF):
        w, (one, two, three) = block.w, counts
        p1 = (one + 1) / (tokens + types + 1)
        context, word = block.bigrams // w, block.bigrams % w
        p2 = (two + backoff * p1[word]) / (one[context] + backoff)
        context3 = block.trigrams // w
        p3 = (three + backoff * p2[block.suffix]) / (two[context3] + backoff)
        self.words, self.known = w, one > 0
        self.root, self.root_target = np.log10(p1), np.where(self.known, np.arange(w) + 1, 0)
        kept2, kept3 = two > 0, three > 0
        self.codes = np.concatenate([(block.bigrams + w)[kept2], (block.trigrams + (1 + w) * w)[kept3], [np.iinfo(np.int64).max]])
        self.weight = np.log10(np.concatenate([p2[kept2], p3[kept3], [1.0]]))
        state2 = np.arange(len(two)) + 1 + w
        self.target = np.concatenate([state2[kept2], state2[block.suffix[kept3]], [0]])
        self.fail = np.concatenate([np.zeros(1 + w, np.int64), 1 + word])
        self.fail_weight = np.concatenate([[0.0], np.log10(backoff / (one + backoff)), np.log10(backoff / (two + backoff))])
        self.start = 1 + BEGIN if one[BEGIN] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens lead from states, and the log weights on the way."""
        code = state * self.words + word
        at = np.searchsorted(self.codes, code)
        found = self.codes[at] == code
        to, weight = self.target[at], self.weight[at]
        left = np.flatnonzero(~found)
        if len(left):
            now, spent = state[left], np.zeros(len(left))
            weight[left] = 0.0
            while len(left):
                top = now == 0
                i = left[top]
                weight[i] += self.root[word[i]] + spent[top]
                to[i] = self.root_target[word[i]]
                left, now, spent = left[~top], now[~top], spent[~top]
                spent += self.fail_weight[now]
                now = self.fail[now]
                code = now * self.words + word[left]
                at = np.searchsorted(self.codes, code)
                hit = self.codes[at] == code
                i = left[hit]
                weight[i], to[i] = self.weight[at[hit]] + spent[hit], self.target[at[hit]]
                left, now, spent = left[~hit], now[~hit], spent[~hit]
        return to, weight

    def walk(self, block: Block) -> np.ndarray:
        """The log probability of every text: all of a block's texts advance by a token at a time, each in its own state."""
        order = np.argsort(-block.sizes, kind="stable")
        sizes, starts = block.sizes[order], block.starts[order]
        state, total = np.full(len(order), self.start), np.zeros(len(order))
        alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        for t, n in enumerate(alive.tolist()):
            state[:n], weight = self.step(state[:n], block.word[starts[:n] + t].astype(np.int64))
            total[:n] += weight
        out = np.empty_like(total)
        out[order] = total
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per document.

    The model learns from the documents that are not held out. A null or empty text is its end token alone. Repeated
    rows count, and are scored, each; ties need no rule. An empty table gives an empty result; a table without training
    texts scores every token as unknown. Long texts are blocks of their own. Columns other than the two named are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), (~held_out(id_col)).alias("train"), F.col(text_col).alias("text"))
    table = exchange.block_table(source, ["id", "train"], "text", encode, "words binary, tokens binary, sizes binary", "coded", BLOCK_BYTES)
    size = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    count = exchange.buckets_for(size * KEYS_PER_BYTE)

    def block_of(row: pa.RecordBatch | pa.Table) -> Block:
        value = lambda c: row.column(c)[0].as_py()
        return Block(value("words"), value("tokens"), value("sizes"), np.array(value("train"), bool))

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                b = block_of(row)
                yield exchange.request(row.column("block")[0].as_py(), b.keys, b.own(), count)

    lean = table.select("block", F.col("rows.train").alias("train"), "words", "tokens", "sizes")
    # keys of words are odd: their counts give N, and how many of them are above 0 gives V
    totals = lambda keys, counts: [counts[keys & np.uint64(1) == 1].sum(), (counts[keys & np.uint64(1) == 1] > 0).sum()]
    answers = written(exchange.answered(lean.mapInArrow(ask, exchange.REQUEST), lambda keys, counts: counts, totals), "counts")
    tokens = types = 0
    for r in answers.filter("block = -1").select("answer").toLocalIterator():  # a row of two numbers per bucket
        n, v = np.frombuffer(r.answer, np.int64).tolist()
        tokens, types = tokens + n, types + v
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = block_of(left)
        counts = b.told(exchange.read_answers(right, b.keys, count, np.int64))
        model = Automaton(b, counts, tokens, types, backoff)
        per_text = lambda x: np.add.reduceat(x[b.word], b.starts)
        return pa.table({
            "id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(~b.train), "n_tokens": pa.array(b.sizes),
            "n_known": pa.array(per_text(model.known.astype(np.int64))), "train_tokens": pa.array(np.full(len(b.train), tokens)),
            "base_score": pa.array(per_text(model.root)), "score": pa.array(model.walk(b)),
        })

    texts = table.select(F.col("block").alias("_block"), F.col("rows.id").alias("ids"), F.col("rows.train").alias("train"), "words", "tokens", "sizes")
    out = texts.groupBy("_block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
