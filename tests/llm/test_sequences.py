import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import frame
from tidewatch.llm import packing, queries, training_order
from tidewatch.llm.tokens import Encoder, default_files, document_pieces


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_pieces(tokenizer, rows, size):
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((i, number, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return out


STRANGE = [
    "", " ", "  a  b ", "a\n\n b\t\tc \n", "don't we'll I'M", "x\u00a0y\u2003z\x85w\x1cq", "日本語 テキスト 🙂🙂 é̀", "<|endoftext|> a<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "x" * 2000 + " <|endoftext|>\n\n 語",
    "Ωμέγα привет שלום", "a" * 3000, " " * 500 + "end ", "1234567890 3.14,15",
]


def test_ids_are_those_of_the_tokenizer(spark, tokenizer, sf_dir):
    texts = STRANGE + [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    encoder = Encoder(*default_files())
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    encoder = test_ids_of_any_text.encoder = getattr(test_ids_of_any_text, "encoder", None) or Encoder(*default_files())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    """Sequences are gapless from 0 and hold no more than they may."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing(odd_docs, odd_rows, tokenizer, capacity):
    got = packing.pack(odd_docs, capacity).collect()
    wanted = plain_pieces(tokenizer, odd_rows, capacity)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(wanted)
    tokens = sum(w[3] for w in wanted)
    assert check_packing(got, capacity) <= -(-tokens // capacity) * 1.05 + 1


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_supersteps_are_best_fit_decreasing(counts):
    plan = packing.supersteps(counts, 40)
    rows = []
    for interval in plan:
        nexts = [i.first for i in plan if i.length == interval.length and i.first > interval.first]
        for rank in range(interval.first, min(nexts, default=counts[interval.length])):
            nth = rank - interval.first
            rows.append({"sequence_id": interval.sequence + nth // interval.each, "offset": interval.offset + nth % interval.each * interval.length, "length": interval.length})
    assert Counter(r["length"] for r in rows) == Counter(counts)
    assert check_packing(rows, 40) == best_fit_decreasing(counts, 40)


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097, 70_000])
def test_slots_are_a_keyed_permutation(n):
    one = training_order.slots_of(np.arange(n), n, key=1)
    assert sorted(one.tolist()) == list(range(n))
    two = training_order.slots_of(np.arange(n), n, key=2)
    if n > 50:
        assert (one != two).mean() > 0.9 and abs(np.corrcoef(one, np.arange(n))[0, 1]) < 0.2


def test_shards_are_read_back_from_any_slot(spark, odd_docs, odd_rows, tokenizer, no_docs, tmp_path):
    out = str(tmp_path / "shards")
    rows = training_order.materialise(odd_docs, out, stride=64, shard_slots=50).collect()
    wanted = plain_pieces(tokenizer, odd_rows, 64)
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == Counter((w[0], w[1], w[3], w[4]) for w in wanted)
    assert sorted(r["slot"] for r in rows) == list(range(len(wanted)))
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert len(ids) == 64 and zlib.crc32(ids[: r["length"]].tobytes()) == r["ids_crc32"]
        assert (ids[r["length"] :] == training_order.PAD).all() and r["shard"] == r["slot"] // 50
    for folder in (tmp_path / "shards").glob("shard=*"):
        files = list(folder.glob("*.parquet"))
        slots = [r["slot"] for r in spark.read.parquet(str(files[0])).collect()]
        assert len(files) == 1 and slots == sorted(slots)
    rest = [r["slot"] for r in training_order.read_from(spark, out, 73, 50).collect()]
    assert rest == list(range(73, len(wanted)))
    assert training_order.materialise(no_docs, str(tmp_path / "none")).count() == 0


def test_pieces_of_a_document():
    files = default_files()
    assert [len(p) // 4 for p in document_pieces(None, files, 8)] == [1]
    assert [len(p) // 4 for p in document_pieces("a b c d e f g", files, 8)] == [8]
    assert [len(p) // 4 for p in document_pieces("a b c d e f g h", files, 8)] == [1, 8]


def test_pipeline_stages(spark, odd_docs, odd_rows, sf_dir, no_docs):
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "simhash_near_dedup" and len(corpus_pipeline.STAGES) == 5
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 100 < len({r["doc_id"] for r in packed}) < documents.count()
    check_packing(packed, 1024)


def test_each_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert frame is not None
