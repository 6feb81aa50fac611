"""Tokens, packing, pieces, licenses, quality and exact copies on small tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hybridq.llm import byte_cnn, license_markup as lm
from hybridq.llm.exact_dedup import exact_dedup, run_stream
from hybridq.llm.packing import pack, plan, step_groups
from hybridq.llm.piece_lattice import decode_documents, encode_documents
from hybridq.llm.quality import fit, good_documents, held_out, score_documents
from hybridq.llm.token_files import decode_values, encode_values, read_tokens, write_tokens
from hybridq.llm.tokens import PieceEncoder
from hybridq.plans.stages import stage_path

ODD = [
    "", None, " ", "  a  b ", "x \n y\tz  ", "don't I'll 100 2000 0", "é́ ça  ", "<|endoftext|> hi", "a  　b", "日本語 テスト 123 😀",
    "tail ", "a b " * 300, "Word " * 40 + "0", "same text", "same text", "x" * 5000, "1" * 700,
]
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "own", b"x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens int, ids string, data binary").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string")


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("cached", [10, 100_000])
def test_encoder_equals_library(path, cached):
    encoder, library = PieceEncoder(path, cached), Tokenizer.from_file(path)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(ODD, pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_values_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 500, 500, 0, 3])
    values = rng.choice(np.array([0, 3, 300, 70_000, 2**31]), counts.sum()) + rng.integers(0, 200, counts.sum())
    control, first, data, start = encode_values(values, counts)
    assert (decode_values(control, data, counts) == values).all()
    # each run is coded by itself
    firsts, starts = np.append(first, len(control)), np.append(start, len(data))
    for i, own in enumerate(np.split(values, np.cumsum(counts)[:-1])):
        parts = control[firsts[i] : firsts[i + 1]], data[starts[i] : starts[i + 1]]
        assert (decode_values(*parts, counts[i : i + 1]) == own).all()
        assert len(parts[1]) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in own)


def test_rows_of_one_document_id_spread(spark):
    """Places within a repeated id follow the ranges, wherever a range ends."""
    rows = [(5, f"text number {i}") for i in range(300)] + [(1, "first"), (9, "last"), (None, "none")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = read_tokens(*write_tokens(frame, BYTE, 0, parts=6)).collect()
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert [s for s, _, _ in spans] == [sum(n for _, n, _ in spans[:i]) for i in range(len(spans))]
    assert [d for _, _, d in spans] == [None, 1, *[5] * 300, 9]


def test_token_files(spark, docs, nothing):
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in read_tokens(*write_tokens(docs, BYTE, 0, parts=4)).collect()}
    at = 0
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc)
        at += len(ids)
    assert read_tokens(*write_tokens(nothing, BYTE, 0)).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = read_tokens(*write_tokens(twice, BYTE, 0)).collect()
    assert sorted((r.doc_id or -1, r.start) for r in rows) == [(-1, 0), (1, 2), (1, 4)]


def test_plan_covers_and_fills():
    lengths = (np.random.default_rng(2).lognormal(6.5, 1.3, 2000)).astype(int).tolist()
    windows = plan(lengths)
    pieces = defaultdict(list)
    for size, parts in windows:
        assert sum(n for _, _, n in parts) <= size <= 4096
        for doc, start, n in parts:
            pieces[doc].append((start, n))
    for doc, n in enumerate(lengths):
        assert sorted(p for s, k in pieces[doc] for p in range(s, s + k)) == list(range(n))
    used = sum(size for size, _ in windows)
    assert used - sum(lengths) < 256
    steps = step_groups(windows, 65536)
    totals = np.bincount(steps, [size for size, _ in windows])
    assert (totals[:-1] == 65536).all()


@pytest.mark.parametrize("group_tokens", [4_000_000, 1000])
def test_packing(docs, nothing, group_tokens):
    library = Tokenizer.from_file(WORD)
    rows = pack(docs, WORD, 2, group_tokens=group_tokens).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(ODD):
        ids, at = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack(nothing, WORD, 2).collect() == []


def test_pieces_equal_library(spark, docs, nothing, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    more = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, more):
        texts = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
        rows = decode_documents(encode_documents(table, PIECE), PIECE).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
    assert decode_documents(encode_documents(nothing, PIECE), PIECE).collect() == []


def test_licenses(spark, nothing):
    texts = [
        None, "", "MIT License", "the mit\nlicense, MIT-LICENSE", "Released under the terms of the MIT License.", "released under terms of the MIT License",
        "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "this work is licensed under the GNU General Public License, version 3.",
        "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "mit énlicense", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version",
    ]
    rows = {r.doc_id: r for r in lm.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = lm.WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        at = [k for p in lm.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (rows[i].n_words, rows[i].n_base) == (len(words), len(at))
        assert (rows[i].first_word, rows[i].last_word) == (min(at, default=None), max(at, default=None))
    labels = [rows[i].labels for i in range(len(texts))]
    assert labels == ["", "", "mit", "mit", "mit,mit-notice", "mit", "apache,apache-2.0-notice", "gpl", "gpl,gpl-3.0-notice", "", "cc-by-nc-notice", "", "gpl,gpl-or-later-notice"]
    assert rows[4].score == 1 and rows[5].score == 0.5 and rows[0].score == 0
    assert lm.scan_licenses(nothing).collect() == []
    with pytest.raises(ValueError):
        lm.compile_template("open", "a <<beginOptional>> b")


def test_network_gradients():
    m = byte_cnn.new_model()
    texts, y = [b"hello world " * 30, b"", b"AAA!! BBB!! " * 40, bytes(range(256))], np.array([1, 0, 1, 0], np.float32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def loss():
        p = byte_cnn.score_bytes(m, np.frombuffer(b"".join(texts), np.uint8), offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for a, g in zip(m.arrays(), byte_cnn.gradients(m, texts, y)):
        at = np.unravel_index(np.abs(g).argmax(), a.shape)
        old, step = a[at], 1e-2
        a[at] = old + step
        high = loss()
        a[at] = old - step
        low = loss()
        a[at] = old
        assert abs((high - low) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-3


def test_quality(spark, docs, nothing, sf):
    big = sf.replace("sf0.001", "sf0.1")
    rows, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = fit(rows, labels, sample_rows=300)
    found = score_documents(rows, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    good, bad = ([r.predicted for r in found if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert all(0 <= r.score <= 1 for r in score_documents(docs, model).collect())
    assert good_documents(docs, model).columns == docs.columns
    assert score_documents(nothing, model).collect() == []
    # no labels, or labels of one class, still give scores
    few = spark.createDataFrame([(1, None), (3, 1), (3, 0), (5, 1)], "doc_id long, quality int")
    assert score_documents(docs, fit(docs, few)).where(held_out()).count() >= 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, docs, nothing, weak):
    texts = ["a  b", "a\tb", "a b", None, "", "c", "c ", "d", "d", " ", "\n\n"] + ["hot"] * 40
    ids = [9, 3, 5, 8, 7, 2, 1, 4, 4, 30, 31, *range(100, 139), None]
    rows = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, digest string").repartition(4)
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).cast("string"))) if weak else None
    got = exact_dedup(rows, digest=digest, bytes_per_trigger=2000).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = sorted((str(i), min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(nothing, digest=digest).collect() == []


def test_state_goes_on(spark):
    """A second run on the same checkpoint only reads what is new and remembers what was."""
    feed, checkpoint = stage_path(spark, "feed"), stage_path(spark, "state")
    schema = "digest binary, doc_id long, _file string, _row long"
    for batch in ([(b"a", 5, "f", 0), (b"b", 6, "f", 1)], [(b"a", 2, "g", 0), (b"c", 9, "g", 1), (b"a", 7, "g", 2)]):
        made = spark.createDataFrame(batch, schema)
        made.write.mode("append").parquet(feed)
        state = {bytes(r.digest): (r.first.doc_id, r.n) for r in run_stream(spark, feed, made.schema, checkpoint).collect()}
    assert state == {b"a": (2, 3), b"b": (6, 1), b"c": (9, 1)}
