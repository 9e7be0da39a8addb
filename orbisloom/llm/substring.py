"""Substring dedup with repeated-phrase automata.

The corpus is written once as blocks of documents (exchange.py). Each run of WINDOW words has an anchor: the run of ANCHOR
words in it whose hash is the smallest. Neighbouring runs mostly share theirs, so a document falls into spans of runs with one
anchor, and equal runs have equal anchors wherever they stand.

1. Route: anchors are counted over the corpus. A span whose anchor stands nowhere else can't repeat and stays where it
   is; each other one goes to the shard of its anchor. A span with a hot anchor is cut into its single runs, which are
   dealt by the hash of the whole run, so no shard holds more than HOT spans of one anchor and equal runs are one row for
   each block. Every document thus meets every shard that can concern it.
2. Confirm: a shard finds the runs that its spans hold twice or more; neighbouring ones make up its passages.
3. Compile: the passages become the shard's Aho-Corasick automaton over word numbers (pyahocorasick).
4. Stream: all spans of the shard run through the automaton, whose matches are the occurrences.

The matches, and nothing else, say which words a document loses. They are by words; hashes only route and confirm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Memo, mixed, windows

WINDOW = 35
#: Words in an anchor, and how often one must occur to be hot.
ANCHOR, HOT = 8, 4096
#: Bytes of spans in one shard on average; bounds an automaton's memory.
SHARD_BYTES = 4_000_000


def spans(words: list[bytes], memo: Memo, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes of a document's spans and the first run of each; a span goes on to the next one's first run.

    A span's runs have their anchor at one place (the leftmost, where it stands in a run twice), so equal runs are never in
    one span, and a span that has its anchor for itself holds no run that repeats."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = windows(memo.of(words), anchor) >> np.uint64(8)
    width, low, done = window - anchor + 1, h, 1
    while done < width:  # minima of runs of `width` anchors, by doubling
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (h[: n - 1] == low[:-1])
    first = np.flatnonzero(new)
    return low[first], first


def confirm(texts: list[list[bytes]], times: list[int], window: int) -> set[tuple[bytes, ...]]:
    """The shard's passages: the longest stretches of a span whose every run of `window` words occurs twice or more in all."""
    memo = Memo()
    hashes = [windows(memo.of(w), window) for w in texts]
    sizes = [len(h) for h in hashes]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    several = np.bincount(place, np.repeat(times, sizes)) > 1
    found, at = set(), 0
    for words, n in zip(texts, sizes):
        edges = np.flatnonzero(np.diff(several[place[at : at + n]].astype(np.int8), prepend=0, append=0))
        found.update(tuple(words[a : b + window - 1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
        at += n
    return found


def compile_shard(passages: Iterable[tuple[bytes, ...]]) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """The automaton of passages, and the numbers of their words."""
    numbers: dict[bytes, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        found.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in p))
    if not numbers:
        return None, numbers
    found.make_automaton()
    return found, numbers


def occurrences(automaton: ahocorasick.Automaton | None, numbers: dict[bytes, int], words: list[bytes]) -> list[tuple[int, int]]:
    """Where passages stand in words, as (first word, end), merged where they touch."""
    if automaton is None:
        return []
    out: list[tuple[int, int]] = []
    for end, size in automaton.iter(tuple(numbers.get(w, 0) for w in words)):
        start = end - size + 1
        while out and start <= out[-1][1]:
            start = min(start, out.pop()[0])
        out.append((start, end + 1))
    return out


def located(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """(block, hits) of one shard's spans (block, text, places): confirms, compiles and streams."""
    texts, owners = [], defaultdict(list)
    number: dict[bytes, int] = {}
    for block, text, places in zip(*(table.column(c).to_pylist() for c in ("block", "text", "places"))):
        k = number.setdefault(text, len(number))
        owners[k].append((block, np.frombuffer(places, np.int32).reshape(-1, 2)))
    texts = [t.split(b" ") for t in number]
    automaton, numbers = compile_shard(confirm(texts, [sum(len(p) for _, p in owners[k]) for k in range(len(texts))], window)) if texts else (None, {})
    hits: dict[int, list[np.ndarray]] = defaultdict(list)
    for k, words in enumerate(texts):
        for a, b in occurrences(automaton, numbers, words):
            for block, places in owners[k]:  # a row per block, whatever the number of copies
                hits[block].append(np.column_stack([places[:, 0], places[:, 1] + a, places[:, 1] + b]))
    packed = [exchange.pack_array(np.concatenate(x).astype(np.int32)) for x in hits.values()]
    return pa.table({"block": pa.array(list(hits), pa.int64()), "hits": pa.array(packed, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, keep_text: bool = False, prefix: str = "", anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(id, [keep columns, the text,] n_words, n_removed, kept): kept is the text of the words that stay, joined by single spaces.

    A word goes when it stands in a run of `window` words that also starts anywhere else, in this document or another;
    every occurrence goes, the first too, judged on the input. Documents with fewer words lose nothing. A null text has
    no words. Repeated rows repeat each other's runs. A long text is a block of its own. An empty table stays empty. A
    prefix goes before the three new names, so that they can't clash with columns kept.
    """
    keep = keep or []
    if not 0 < anchor <= window:
        raise ValueError("an anchor must fit into the window")

    def encode(data, rows):
        memo, owner, found, first = Memo(), [], [], []
        for i, t in enumerate(data):
            h, at = spans((t or b"").split(), memo, window, anchor)
            owner.append(np.full(len(h), i, np.int32))
            found.append(h)
            first.append(at.astype(np.int32))
        sizes = np.array([-1 if t is None else len(t) for t in data], np.int64)
        return [exchange.pack_bytes(b"".join(t or b"" for t in data)), *map(exchange.pack_array, (sizes, np.concatenate(owner), np.concatenate(first))), np.concatenate(found).tobytes()]

    table = exchange.block_table(docs, [id_col, *keep], text_col, encode, "texts binary, sizes binary, owners binary, starts binary, anchors binary", "texts")
    total = table.agg(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    count = exchange.buckets_for(total[0])
    shards = max(1, int(total[1] / SHARD_BYTES))

    def ask(batches):
        for batch in batches:
            for block, anchors in zip(batch.column("block").to_pylist(), batch.column("anchors").to_pylist()):
                keys, counts = np.unique(np.frombuffer(anchors, np.uint64), return_counts=True)
                yield exchange.request(block, keys, counts, count)

    answers = exchange.answered(table.select("block", "anchors").mapInArrow(ask, exchange.REQUEST), lambda keys, counts: np.minimum(counts, hot).astype(np.int32))

    def texts_in(row: pa.Table) -> list[bytes | None]:
        data, sizes = exchange.unpack_bytes(row.column("texts")[0].as_py()), exchange.unpack_array(row.column("sizes")[0].as_py(), np.int64)
        ends = np.cumsum(np.maximum(sizes, 0)).tolist()
        return [None if n < 0 else data[e - n : e] for n, e in zip(sizes.tolist(), ends)]

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        owner, first = (exchange.unpack_array(left.column(c)[0].as_py(), np.int32) for c in ("owners", "starts"))
        anchors = np.frombuffer(left.column("anchors")[0].as_py(), np.uint64)
        keys, inverse = np.unique(anchors, return_inverse=True)
        times = exchange.read_answers(right, keys, count, np.int32)[inverse]
        memo, doc, words = Memo(), -1, []
        shard_of = lambda h: (mixed(h) % np.uint64(shards)).astype(np.int64)
        places: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
        texts, shard = texts_in(left), shard_of(anchors).tolist()
        next_first = np.append(first[1:], 0)
        next_first[np.flatnonzero(np.diff(owner, append=-1))] = -1
        for k in np.flatnonzero(times > 1).tolist():
            if owner[k] != doc:
                doc = int(owner[k])
                words = texts[doc].split()
            a = int(first[k])
            b = int(next_first[k]) if next_first[k] >= 0 else len(words) - window + 1
            part = words[a : b + window - 1]
            if times[k] < hot:
                places[shard[k], b" ".join(part)].append((doc, a))
            else:
                own = shard_of(windows(memo.of(part), window)).tolist()
                for i in range(b - a):
                    places[own[i], b" ".join(part[i : i + window])].append((doc, a + i))
        return pa.table({
            "shard": pa.array([s for s, _ in places], pa.int64()), "block": pa.array([block] * len(places), pa.int64()), "text": pa.array([t for _, t in places], pa.binary()),
            "places": pa.array([np.array(p, np.int32).tobytes() for p in places.values()], pa.binary()),
        })

    blocks = table.select("block", "texts", "sizes", "owners", "starts", "anchors")
    routed = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(route, "shard long, block long, text binary, places binary")
    hits = routed.groupBy("shard").applyInArrow(lambda t: located(t, window), "block long, hits binary")

    passed = [id_col, *keep, *([text_col] if keep_text else [])]
    names = [*passed, *(f"{prefix}{c}" for c in ("n_words", "n_removed", "kept"))]
    kinds = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed), f"`{prefix}n_words` long", f"`{prefix}n_removed` long", f"`{prefix}kept` string"]

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("hits of a block that isn't there")
        texts = texts_in(left)
        found = [exchange.unpack_array(x, np.int32).reshape(-1, 3) for x in right.column("hits").to_pylist()]
        found = np.concatenate(found) if found else np.empty((0, 3), np.int32)
        found = found[np.argsort(found[:, 0], kind="stable")]
        at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
        total, removed, kept = [], [], []
        for i, t in enumerate(texts):
            words = (t or b"").split()
            gone = 0
            if at[i] < at[i + 1]:
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, found[at[i] : at[i + 1], 1], 1)
                np.add.at(change, found[at[i] : at[i + 1], 2], -1)
                stay = (np.cumsum(change[:-1]) == 0).tolist()
                left_over = [w for w, s in zip(words, stay) if s]
                gone = len(words) - len(left_over)
            total.append(len(words))
            removed.append(gone)
            kept.append(b" ".join(left_over if gone else words))
        rows = left.column("rows").combine_chunks().flatten()
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col and keep_text else rows.field(c) for c in passed]
        return pa.table([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return table.select("block", "rows", "texts", "sizes").groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(cut_out, ", ".join(kinds))
