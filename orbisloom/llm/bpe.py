"""BPE encoding and decoding with a minimal acyclic transducer of frequent words and exact merges for all others.

Texts are cut into pieces at single spaces and each distinct piece is encoded once in a worker. Its words go through the
lexicon, a minimal automaton whose arcs carry integer outputs: their sum along a word is the word's row in a table of
token ids. The driver compiles it from word counts over all documents; the file reaches the executors with addFile and
is memory-mapped there. Words that it doesn't have are merged by the vocabulary's ranks, many at a time.
"""

from __future__ import annotations

import atexit
import functools
import heapq
import itertools
import json
import os
import re
import shutil
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, written

#: A word of at least this share of all words is in the lexicon, so there are at most 1 / LEXICON_SHARE of them whatever the
#: corpus; its file has a few tens of bytes for each.
LEXICON_SHARE = 1 / 200_000
#: Distinct pieces that a worker remembers before it starts afresh, and bytes of text that it takes at a time (which may add
#: some 250,000 more). An executor has a worker per core, which lives on between runs, so both count for all of them at once.
MEMO, BYTES = 400_000, 1_500_000
_NONE = np.int64(-1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be printed, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b not in rest else chr(256 + rest.index(b)) for b in range(256)]


class Probe:
    """An open-addressing table from int64 keys (0 or more) to their row numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None, rows: np.ndarray | None = None):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length()) if slots is None else int(len(slots) - 1).bit_length()
        size = 1 << self.bits
        if slots is None:
            slots, rows = np.full(size, _NONE), np.full(size, -1, np.int32)
            todo, at = np.arange(len(keys)), self._home(keys)
            while len(todo):
                free = slots[at] == _NONE
                first = np.zeros(len(todo), bool)
                first[np.unique(at, return_index=True)[1]] = True
                put = free & first
                slots[at[put]], rows[at[put]] = keys[todo[put]], todo[put]
                todo, at = todo[~put], (at[~put] + 1) & (size - 1)
        self.slots, self.rows, self.mask = slots, rows, size - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.rows[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != _NONE))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (found != _NONE)]
        return out.reshape(shape)


class Csr:
    """Rows of int32 of any length, appended and gathered by row number."""

    def __init__(self):
        self.flat, self.lens, self.starts, self.n, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.n + len(lens) > len(self.lens):
            self.lens, self.starts = np.concatenate([self.lens, self.lens]), np.concatenate([self.starts, self.starts])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(flat)] = flat
        self.lens[self.n : self.n + len(lens)] = lens
        self.starts[self.n : self.n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.n, self.used = self.n + len(lens), self.used + len(flat)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[rows]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(total)], lens


class Codes(dict):
    """Numbers keys in order of first sight; `new` holds those not yet resolved."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of a byte matrix, and their lengths."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lens.max(initial=1))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lens


class Merges:
    """Byte-pair merges of a vocabulary file of the tokenizers library (model BPE over byte-level characters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        model = self.file["model"]
        vocab, suffix, chars = model["vocab"], model["end_of_word_suffix"] or "", _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b if not suffix else a.removesuffix(suffix) + b]) for a, b in model["merges"]]
        self.pairs = {(a, b): (rank, to) for rank, (a, b, to) in enumerate(pairs)}
        self.to = np.array([x[2] for x in pairs], np.int64)
        self.probe = Probe(np.array([a * self.size + b for a, b, _ in pairs], np.int64))
        self.vocab = vocab

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.probe(np.where((a < 0) | (b < 0), np.int64(self.size) * self.size, a * self.size + b))
        return np.where(rank < 0, np.int32(2**31 - 1), rank).astype(np.int32)

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        b, lens = padded(words)
        col = np.arange(b.shape[1])
        return np.where(col < lens[:, None] - 1, self.first[b], np.where(col == lens[:, None] - 1, self.last[b], -1)), lens

    def _long(self, word: bytes) -> list[int]:
        """One word by a heap of pairs: n log n for words of any length."""
        ids = [*self.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        left, right, alive = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1], [True] * len(ids)
        heap = [(*self.pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heap = [(r, i, to, p) for r, to, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, to, p = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], right[i] = to, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (q := (ids[k], ids[right[k]])) in self.pairs:
                    r, t = self.pairs[q]
                    heapq.heappush(heap, (r, k, t, q))
        return [x for x, a in zip(ids, alive) if a]

    def _block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sym, lens = self._symbols(words)
        if sym.shape[1] < 2:
            return sym, lens
        rank = self._ranks(sym[:, :-1], sym[:, 1:])
        out, lens, rows = sym.copy(), lens.copy(), np.arange(len(words))
        col = np.arange(sym.shape[1])
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            go = best < 2**31 - 1
            if not go.all():
                out[rows[~go]] = sym[~go]
                sym, rank, at, best, rows = sym[go], rank[go], at[go], best[go], rows[go]
            if not len(rows):
                return out, lens
            n = np.arange(len(rows))
            sym[n, at] = self.to[best]
            moved = np.concatenate([sym[:, 1:], np.full((len(rows), 1), -1)], 1)
            sym = np.where(col > at[:, None], moved, sym)
            ranks = np.concatenate([rank[:, 1:], np.full((len(rows), 1), 2**31 - 1, np.int32)], 1)
            rank = np.where(col[:-1] > at[:, None], ranks, rank)
            following = sym[n, np.minimum(at + 1, sym.shape[1] - 1)]
            rank[n, np.minimum(at, rank.shape[1] - 1)] = self._ranks(sym[n, at], np.where(at + 1 < sym.shape[1], following, -1))
            before = at > 0
            rank[n[before], at[before] - 1] = self._ranks(sym[n[before], at[before] - 1], sym[n[before], at[before]])
            lens[rows] -= 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and how many each has."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        counts, parts, at = np.zeros(len(words), np.int64), [None] * len(words), 0
        while at < len(order):
            width = len(words[order[at]])
            if width > 200:
                for i in order[at:]:
                    parts[i] = np.array(self._long(words[i]), np.int32)
                    counts[i] = len(parts[i])
                break
            to = at
            while to < len(order) and to - at < 20_000 and len(words[order[to]]) <= width + 2:
                to += 1
            if width:
                ids, lens = self._block([words[i] for i in order[at:to]])
                ids = ids.astype(np.int32)
                for i, row, n in zip(order[at:to], ids, lens.tolist()):
                    parts[i] = row[:n]
                    counts[i] = n
            else:
                for i in order[at:to]:
                    parts[i] = np.empty(0, np.int32)
            at = to
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), counts


class Lexicon:
    """A minimal acyclic transducer from words to rows of token ids, over memory-mapped arrays."""

    def __init__(self, path: str):
        data = np.load(path, mmap_mode="r")
        self.parts, at = [], 6
        for n in data[:6]:
            self.parts.append(data[at : at + int(n)])
            at += int(n)
        slots, rows, self.target, self.output, self.final, self.table = self.parts
        self.probe = Probe(np.empty(0), slots, rows)
        n = int(self.table[0])
        self.starts, self.ids = self.table[1 : n + 2], self.table[n + 2 :]

    @staticmethod
    def compile(words: list[bytes], ids: list[list[int]], path: str) -> dict:
        """Builds the automaton from distinct words, in one pass over their sorted order: a state is merged with an
        equal one (same finality, arcs and targets) as soon as no later word can change it."""
        order = sorted(range(len(words)), key=words.__getitem__)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path_states, previous = [0], b""

        def settle(down_to: int) -> None:
            for depth in range(len(path_states) - 1, down_to, -1):
                state = path_states.pop()
                signature = (final[state], *arcs[state].items())
                arcs[path_states[-1]][previous[depth - 1]] = register.setdefault(signature, state)

        for i in order:
            word = words[i]
            same = len(os.path.commonprefix([word, previous]))
            settle(same)
            for b in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[path_states[-1]][b] = len(arcs) - 1
                path_states.append(len(arcs) - 1)
            final[path_states[-1]] = True
            previous = word
        settle(0)
        number, stack, accepted = {0: 0}, [0], {}
        states = [0]
        while stack:
            for t in arcs[stack.pop()].values():
                if t not in number:
                    number[t] = len(number)
                    states.append(t)
                    stack.append(t)

        def paths(root: int) -> None:
            todo = [root]
            while todo:
                s = todo[-1]
                missing = [t for t in arcs[s].values() if t not in accepted]
                if missing:
                    todo += missing
                else:
                    accepted[s] = final[s] + sum(accepted[t] for t in arcs[s].values())
                    todo.pop()

        paths(0)
        keys, target, output = [], [], []
        for s in states:
            before = int(final[s])
            for b, t in sorted(arcs[s].items()):
                keys.append(number[s] * 256 + b)
                target.append(number[t])
                output.append(before)
                before += accepted[t]
        probe = Probe(np.array(keys, np.int64))
        lens = np.cumsum([0, *(len(ids[i]) for i in order)])
        table = np.concatenate([[len(order)], lens, *(ids[i] for i in order)]).astype(np.int64)
        fin = np.zeros(len(states), np.int64)
        fin[[number[s] for s in states if final[s]]] = 1
        parts = [probe.slots, probe.rows.astype(np.int64), np.array(target, np.int64), np.array(output, np.int64), fin, table]
        np.save(path, np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]))
        return {"states": len(states), "arcs": len(keys), "words": len(order)}

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Each word's row in the table of ids, -1 where the automaton doesn't accept it."""
        out = np.full(len(words), -1)
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for part in np.array_split(order, max(1, len(words) // 20_000)):
            if not len(part) or not len(self.target):
                continue
            live = [i for i in part.tolist() if 0 < len(words[i]) <= 64]
            if not live:
                continue
            b, lens = padded([words[i] for i in live])
            state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for j in range(b.shape[1]):
                on = np.flatnonzero((state >= 0) & (lens > j))
                arc = self.probe(state[on] * 256 + b[on, j])
                total[on] += np.where(arc >= 0, self.output[np.maximum(arc, 0)], 0)
                state[on] = np.where(arc >= 0, self.target[np.maximum(arc, 0)], -1)
            good = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
            out[np.array(live)[good]] = total[good]
        return out

    def lookup(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lens = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lens)
        return self.ids[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.int32), lens


class ByteBpe:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file, add_special_tokens=False."""

    #: Fixed value: the pattern that splits text before the merges.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: White space other than single spaces and line ends; texts that have it, or spaces beside white space, are split as a whole.
    ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")

    def __init__(self, path: str, lexicon: str | None = None):
        self.merges = Merges(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.special = {x["content"]: x["id"] for x in self.merges.file["added_tokens"]}
        chars = {c: bytes([b]) for b, c in enumerate(_byte_chars())}
        self.bytes = [b""] * (max([self.merges.size - 1, *self.special.values()]) + 1)
        for token, i in [*self.merges.vocab.items(), *self.special.items()]:
            self.bytes[i] = b"".join(chars[c] for c in token)
        self.reset()

    def reset(self) -> None:
        self.words, self.word_ids = Codes(), Csr()
        self.pieces, self.piece_ids = Codes(), Csr()

    def split(self, text: str) -> list[str]:
        return self.PATTERN.findall(text)

    def spaced(self, piece: str) -> list[str]:
        """Splits a piece with a space before it; ASCII letters alone are one word."""
        return [" " + piece] if piece.isascii() and piece.isalpha() else self.split(" " + piece)

    def keys(self, text: str) -> list:
        """What to look up for a text: pieces (strings, each with a space before it), and tuples (text without one, or a special token)."""
        if self.special and any(s in text for s in self.special):
            cut = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            return [k for i, x in enumerate(cut) for k in ([(x, "special")] if i % 2 else self.keys(x))]
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or self.ODD.search(text):
            return [(text,)] if len(text) < 200 else [(x, "word") for x in self.split(text)]
        first, *rest = text.split(" ")
        return [(first,), *rest]

    def _resolve_words(self) -> None:
        new, self.words.new = [w.encode() for w in self.words.new], []
        if not new:
            return
        rows = self.lexicon.rows(new) if self.lexicon else np.full(len(new), -1)
        flat, lens = self.merges.encode([w for w, r in zip(new, rows.tolist()) if r < 0])
        counts = np.zeros(len(new), np.int64)
        counts[rows < 0] = lens
        if (rows >= 0).any():
            known, known_lens = self.lexicon.lookup(rows[rows >= 0])
            counts[rows >= 0] = known_lens
            merged = np.empty(len(flat) + len(known), np.int32)
            from_lexicon = np.repeat(rows >= 0, counts)
            merged[from_lexicon], merged[~from_lexicon] = known, flat
            flat = merged
        self.word_ids.extend(flat, counts)

    def _resolve(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        words = [["\0special"] if len(k) == 2 and k[1] == "special" and type(k) is tuple else self.spaced(k) if type(k) is str else [k[0]] if len(k) == 2 else self.split(k[0]) for k in new]
        special = [k[0] if w == ["\0special"] and type(k) is tuple else None for k, w in zip(new, words)]
        codes = self.words.of([x for w, s in zip(words, special) if s is None for x in w])
        self._resolve_words()
        flat, lens = self.word_ids.gather(codes)
        sizes = np.array([0 if s is not None else len(w) for w, s in zip(words, special)])
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(sizes)] if len(sizes) else np.empty(0, np.int64)
        counts = np.diff(ends, prepend=0)
        if any(s is not None for s in special):
            at = [i for i, s in enumerate(special) if s is not None]
            flat = np.insert(flat, ends[at], [self.special[special[i]] for i in at])
            counts[at] = 1
        self.piece_ids.extend(flat, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.pieces) > MEMO or len(self.words) > MEMO:
            self.reset()
        keys, sizes = [], []
        for t in texts:
            k = self.keys(t)
            keys += k
            sizes.append(len(k))
        codes = self.pieces.of(keys)
        self._resolve()
        flat, lens = self.piece_ids.gather(codes)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(sizes)] if sizes else np.empty(0, np.int64)
        return flat, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class WordBpe(ByteBpe):
    """As ByteBpe for files that lower-case, drop white space and mark word ends. Unusual characters are left to the library."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD = re.compile("[\x1c-\x1f]")
    PLAIN = re.compile("[\x00-įĲ-ſ]*")

    def __init__(self, path: str, lexicon: str | None = None):
        super().__init__(path, lexicon)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def keys(self, text: str) -> list:
        if self.ODD.search(text) or any(s in text for s in self.special):
            return [(text, "whole")]
        return text.split()

    def _resolve(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        plain = [type(k) is str and self.PLAIN.fullmatch(k) is not None for k in new]
        words = [[k.lower()] if p and k.isascii() and k.isalpha() else self.split(unicodedata.normalize("NFC", k).lower()) if p else [] for k, p in zip(new, plain)]
        codes = self.words.of([x for w in words for x in w])
        self._resolve_words()
        flat, lens = self.word_ids.gather(codes)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([len(w) for w in words])]
        counts = np.diff(ends, prepend=0)
        parts, at = [], 0
        for i, (k, p) in enumerate(zip(new, plain)):
            if not p:
                ids = self.library.encode(k if type(k) is str else k[0], add_special_tokens=False).ids
                parts += [flat[at : ends[i]], np.array(ids, np.int32)]
                at, counts[i] = ends[i], len(ids)
        self.piece_ids.extend(np.concatenate([*parts, flat[at:]]), counts)


@functools.lru_cache(1)
def codec(kind: type, path: str, lexicon: str | None = None) -> ByteBpe:
    """One for each worker process, which keeps the vocabulary across tasks. What it has encoded goes at a task's end, as the
    worker lives on while other stages run."""
    return kind(path, lexicon)


def word_counts(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """(word binary, n): how often each word, as the vocabulary's pattern splits it, stands in all documents."""

    def count(batches):
        codec.cache_clear()  # a worker that has encoded before: its lexicon isn't asked for again
        tool, times = ByteBpe(path), np.zeros(1 << 16, np.int64)

        def flush():
            split = lambda k: [] if type(k) is tuple and k[1:] == ("special",) else tool.spaced(k) if type(k) is str else [k[0]] if len(k) == 2 else tool.split(k[0])
            keys, n, at = iter(tool.pieces), np.zeros(0), 0
            while words := [split(k) for k in itertools.islice(keys, 20_000)]:
                found = tool.words.of([w for ws in words for w in ws])
                more = np.bincount(found, np.repeat(times[at : at + len(words)], [len(ws) for ws in words]), minlength=len(tool.words))
                more[: len(n)] += n
                n, at = more, at + len(words)
            n = n.astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in tool.words], pa.binary()), pa.array(n)], ["word", "n"])
            tool.reset()
            times[:] = 0
            return out

        for batch in batches:
            for part in pieces(batch, text_col, BYTES):
                codes = tool.pieces.of([k for t in part.column(text_col).to_pylist() if t for k in tool.keys(t)])
                while len(tool.pieces) > len(times):
                    times = np.concatenate([times, np.zeros(len(times), np.int64)])
                seen = np.bincount(codes, minlength=len(tool.pieces))
                times[: len(seen)] += seen
                if len(tool.pieces) > MEMO:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    counted = docs.select(text_col).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text_col: str, path: str, share: float = LEXICON_SHARE) -> str:
    """Compiles the words with at least `share` of all words and ships the file to all executors; returns its name for
    SparkFiles. There can't be more than 1 / share such words, so what comes to the driver is bounded."""
    counts = written(word_counts(docs, text_col, path), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = [bytes(r.word) for r in counts.filter(F.col("n") >= F.lit(max(2.0, total * share))).select("word").collect()]
    flat, lens = Merges(path).encode(top)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] if top else []
    folder = os.path.realpath(tempfile.mkdtemp(prefix="orbisloom-"))  # the driver serves it to executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.npy")
    Lexicon.compile(top, ids, file)
    docs.sparkSession.sparkContext.addFile(file)
    return os.path.basename(file)


def encode(docs: DataFrame, path: str, text_col: str = "text", lexicon: str | None = None, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Replaces the text column by `ids` (array<int>) and, where decoded_col is given, adds the text decoded from these ids.

    A null text counts as empty and has no ids. Special tokens that a text spells out get their ids, as in the library.
    An empty table stays empty; every other column passes through, but for one of a new column's name; repeated rows are
    encoded each.
    """
    others = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{ids_col}` array<int>", *([f"`{decoded_col}` string"] if decoded_col else [])])

    def run(batches):
        tool = codec(ByteBpe, path, SparkFiles.get(lexicon) if lexicon else None)
        for batch in batches:
            for part in pieces(batch, text_col, BYTES):
                flat, lens = tool.encode([t or "" for t in part.column(text_col).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(lens)])
                columns = [part.column(c) for c in others] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded_col:
                    columns.append(pa.array([tool.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*others, ids_col, *([decoded_col] if decoded_col else [])])
        tool.reset()

    small_batches(docs.sparkSession)
    return docs.select(*others, text_col).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replaces a column of ids by the text they spell; null ids give an empty text."""
    others = [c for c in ids.columns if c not in (ids_col, text_col)]
    schema = ", ".join([*(f"`{c}` {ids.schema[c].dataType.simpleString()}" for c in others), f"`{text_col}` string"])

    def run(batches):
        tool = codec(ByteBpe, path)
        for batch in batches:
            texts = [tool.decode(np.array(x or [], np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, text_col])

    return ids.select(*others, ids_col).mapInArrow(run, schema)
