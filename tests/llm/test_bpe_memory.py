"""What a worker of the encoder keeps, which counts for each core of an executor."""

import pyarrow as pa
import pytest

import public_tokenizers
from orbisloom.llm import bpe, packing


class _Docs:
    """Stands for a table: takes the function that a worker would run."""

    columns, sparkSession = ["text"], None

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        return self


BYTES_FILE, WORDS_FILE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture
def local(monkeypatch, spark):
    for module in (bpe, packing):
        monkeypatch.setattr(module, "small_batches", lambda *_: None)
    bpe.codec.cache_clear()


def _batches(texts):
    yield pa.RecordBatch.from_pydict({"text": texts})


def test_what_was_encoded_goes_with_the_task(local):
    docs = _Docs()
    bpe.encode(docs, BYTES_FILE)
    out = list(docs.run(_batches([f"one two {i}" for i in range(50)])))
    assert sum(b.num_rows for b in out) == 50
    tool = bpe.codec(bpe.ByteBpe, BYTES_FILE, None)
    assert not len(tool.pieces) and not len(tool.words) and not tool.piece_ids.n


def test_a_worker_holds_one_encoder_and_none_while_it_counts(local, spark):
    for kind, path in ((bpe.ByteBpe, BYTES_FILE), (bpe.WordBpe, WORDS_FILE)):
        bpe.codec(kind, path)
    assert bpe.codec.cache_info().currsize == 1
    docs = _Docs()
    bpe.word_counts(docs, "text", BYTES_FILE)
    list(docs.run(_batches(["one"])))
    assert bpe.codec.cache_info().currsize == 0


def test_counts_are_whole_when_the_memo_is_emptied_often(local, spark, monkeypatch):
    texts = [f"one two {i % 7} {i} <|endoftext|>  x\n" for i in range(30_000)]

    def counted(memo, size):
        monkeypatch.setattr(bpe, "MEMO", memo)
        monkeypatch.setattr(bpe, "BYTES", size)
        docs, found = _Docs(), {}
        bpe.word_counts(docs, "text", BYTES_FILE)
        for b in docs.run(_batches(texts)):
            for w, n in zip(*(c.to_pylist() for c in b.columns)):
                found[w] = found.get(w, 0) + n
        return found

    assert counted(100, 1000) == counted(10**9, 10**9)
