"""SentencePiece codec, chat rotation, archives and the pipeline."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from weft.llm import chat_format, piece_codec, warc
from weft.runtime import shared_path

PATH = piece_codec.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = piece_codec.PieceCodec(piece_codec.read_model(PATH))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinrst  \n.,=-_▁\t\x00"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_encoding_equals_the_library(text):
    ids = [1, *LIBRARY.encode(text), 2]
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, LIBRARY.get_piece_size() - 1), max_size=12))
def test_decoding_equals_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_long_runs():
    for text in ("a" * 5000, "=-" * 3000, " " * 999, "日本" * 800, "the " * 4000):
        assert CODEC.encode(text) == [1, *LIBRARY.encode(text), 2]


def test_encoded_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello wörld"), (3, "hello wörld")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(piece_codec.encoded(docs, PATH).collect(), key=lambda r: r["doc_id"])
    for r, (_, t) in zip(got, rows, strict=True):
        ids = [1, *LIBRARY.encode(t or ""), 2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    back = piece_codec.decode(piece_codec.encode(docs, PATH), PATH).where("doc_id = 3").first()
    assert back["decoded"] == "hello wörld"
    assert piece_codec.encoded(docs.limit(0), PATH).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, 1, "ann", "?"), (1, 300, "ann", "bye")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = chat_format.rotate(turns).collect()
    dialogue = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "bob"), key=lambda r: r["start"])
    whole = "".join(r["rendered"] for r in dialogue)
    assert [r["speaker"] for r in dialogue] == ["system", "user name=ann", "assistant", "user name=ann", "user name=ann"]
    for r in dialogue:
        assert whole[r["start"] : r["end"]] == r["rendered"]
        assert whole[r["content_start"] : r["end"]] == (r["text"] or "") + "<|end|>\n"
        assert r["masked"] == (r["role"] == "bob")
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    assert chat_format.rotate(turns.limit(0)).count() == 0


def test_archive_directories(monkeypatch):
    records = [(f"k{i}", warc.record(i, f"http://x/{i}", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, False)) for i in range(50)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(records)) == 50
    plain = out.getvalue()
    with monkeypatch.context() as m:
        m.setattr(zipfile, "ZIP64_LIMIT", 10)
        m.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        warc.write_archive(out, iter(records))
        wide = out.getvalue()
    for data, is_wide in ((plain, False), (wide, True), (b"", None)):
        reads = []

        def read(at, n, data=data, reads=reads):
            reads.append(n)
            return data[at : at + n]

        if is_wide is None:
            with pytest.raises(ValueError):
                warc.ArchiveReader(read, 0)
            continue
        reader = warc.ArchiveReader(read, len(data))
        assert reader.zip64 == is_wide
        assert [raw for _, raw in reader.records()] == [r for _, r in records]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read(warc.INDEX) == reader.member(warc.INDEX)


def test_pages_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a b/", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "y" * 3_000_000), (2, None, big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    uri = shared_path(spark, "warc-test")
    archives = warc.write_archives(warc.classify(pages), uri)
    got = sorted(warc.read_archives(archives, uri).collect(), key=lambda r: r["page_id"])
    assert [r["page_id"] for r in got] == [1, 2, 2, 3, 4, 5, 6]
    assert all(r["intact"] for r in got)
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("revisit", 2)] + [("response", None)] * 6
    for r in got:
        html = dict((i, h) for i, _, h in rows)[r["page_id"]] or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert r["html"] == (html if r["record_type"] == "response" else None)
    none = warc.write_archives(warc.classify(pages.limit(0)), uri)
    assert warc.read_archives(none, uri).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    rows, labels = [], []
    for i in range(80):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(100, rows[1][1], "en", "s0", 1), (101, rows[2][1] + " more", "en", "s0", 1), (102, None, None, None, None), (103, "short", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    good = {i for i, q, _ in labels if q}
    assert kept[0] == good | {100, 101}
    assert kept[1] == kept[0] - {1}
    assert kept[2] == kept[1] - {101}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} <= kept[2]
    texts = {i: t for i, t, *_ in rows}
    for x in out:
        assert x["n_tokens"] == len(LIBRARY.encode(texts[x["doc_id"]])) + 2
