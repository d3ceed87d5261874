import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from treequill.llm import media, packing, tokens

ODD = [(1, "a b " * 3000), (2, None), (3, ""), (4, "é世🙂 x"), (5, "a b " * 3000), (None, "tail"), (5, "a b " * 3000), (6, "x" * 64), (7, "<|endoftext|> 'twas  \n 12345")]
SCHEMA = "doc_id long, text string"


def test_chunks_rebuild_and_move_with_the_text():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(b"shift" + data)
    assert b"".join(a) == data and b"".join(b) == b"shift" + data
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert max(map(len, a)) <= media.MOST and min(map(len, a[:-1])) >= media.LEAST


def test_media_round_trip(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("digest", docs_extra())
    records, shared = media.write_store(docs)
    got = media.read_media(media.reconstruct(records, shared), with_media=True).collect()
    expected = []
    for doc_id, text in ODD:
        raw = (text or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        p = raw.ljust(size, b"\0")
        expected.append((doc_id, len(raw), size, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(repr, [tuple(r[:5]) for r in got])) == sorted(map(repr, expected))
    for r in got:
        assert r["media"][:4] == b"RIFF" and len(r["media"]) == r["media_bytes"] == r["payload_bytes"] + 44
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
    assert len({r["digest"] for r in shared.collect()}) == shared.count()
    assert media.read_media(media.reconstruct(*media.write_store(spark.createDataFrame([], SCHEMA)))).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def _unigram():
    vocabulary = tokens.rank_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return vocabulary, t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdethe  ▁\n<0x41>é世🙂\x00"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_counts_equal_the_tokenizer(text):
    counter, t = _unigram.cache if hasattr(_unigram, "cache") else _made()
    assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids)


def _made():
    vocabulary, t = _unigram()
    _unigram.cache = tokens.Counter(vocabulary), t
    return _unigram.cache


def test_ties_go_to_the_tokenizer_rule():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0), ("b", -2.0), ("ab", -3.0)]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = tokens.Counter(vocabulary)
    for text in ("aaaa", "aab", "abab", "ba aa", "aaab aab b"):
        assert counter.count(text) == len(t.encode(text).ids), text


def test_count_tokens_rows(spark):
    got = tokens.count_tokens(spark.createDataFrame(ODD, SCHEMA), public_tokenizers.path("piece_bpe_32k.model")).collect()
    counter, _ = _unigram.cache if hasattr(_unigram, "cache") else _made()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(i, counter.count(t)) for i, t in ODD]))


def test_ids_equal_the_tokenizers_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encoder = packing.Encoder(path)
    added = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext", " <|endoftext|>!", "it's <|endoftext|>'s"]
    for text in [*[text for _, text in ODD], *added]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert encoder.ids(text or "") == struct.pack(f"<{len(ids)}I", *ids)


def _check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(packing.cut_pieces(spark.createDataFrame(ODD, SCHEMA), path)).collect()
    _check(got, 2048)
    expected = []
    for doc_id, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, expected))
    empty = packing.pack(packing.cut_pieces(spark.createDataFrame([], SCHEMA), path))
    assert empty.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_its_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, rng.choice([30, 60, 100]) + 1, 400)
    bins = packing.best_fit_decreasing(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100
    bound = packing.lower_bound(sizes, 100)
    assert -(-sizes.sum() // 100) <= bound <= len(fill) <= bound + 3
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 7), 100) == 4


def test_repacking_partitions_with_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(s)) for i, s in enumerate(rng.integers(300, 1200, 600))]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").selectExpr("*", "'x' AS _salt", "1 AS _part", "true AS _open")
    got = packing.pack(pieces, per_partition=60).collect()
    assert all((r["_salt"], r["_part"], r["_open"]) == ("x", 1, True) for r in got)
    assert sorted((r["doc_id"], r["length"]) for r in got) == rows
    alone = len(np.unique(packing.best_fit_decreasing(np.array([s for _, s in rows]), 2048)))
    assert _check(got, 2048) <= alone + 6


def test_store_is_written_and_repeats_within_a_document_are_stored_once(spark):
    import random

    from treequill.llm import media

    body = "".join(random.Random(5).choices("abcdefghijklmnop ", k=60_000))
    records, shared = media.write_store(spark.createDataFrame([(1, body + body)], "doc_id long, text string"))
    assert records.inputFiles() and shared.inputFiles()
    assert shared.count() > 5
    assert media.read_media(media.reconstruct(records, shared)).first()["n_bytes"] == 120_000
