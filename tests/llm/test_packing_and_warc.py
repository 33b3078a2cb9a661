"""Packing and archives: exact round trips and edge cases."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from moodspark.llm import common, packing, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = [(1, "hello world"), (1, "hello world"), (2, ""), (3, None), (None, "no id"), (4, "lorem ipsum dolor " * 1500), (5, "a" * 50_000), (6, "naïve façade – 你好 <|endoftext|>")]


def test_ids_are_those_of_the_tokenizer():
    rng = np.random.default_rng(0)
    parts = ["the ", " été", "\n\n", "  ", "don't", "123", "ß", "Ünïcode", "!?", "\t", "\xa0", "中", "x" * 30, " <|endoftext|>", "İ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)]
    for a, b in zip(packing.tokenizer(JSON, RANKS)(texts), packing.tokenizer(JSON)(texts)):
        assert a.tolist() == b.tolist()


def test_pieces_are_whole_and_sequences_have_no_gaps(spark):
    docs = spark.createDataFrame([(*r, 3) for r in ROWS], "doc_id long, text string, length int")
    found = packing.pack_documents(docs, JSON, RANKS).toPandas()
    ids = dict(zip([r[0] for r in ROWS], packing.tokenizer(JSON)([r[1] or "" for r in ROWS])))
    for doc in (2, 3, 4, 5, 6):
        whole = np.r_[ids[doc], 2].astype("<u4")
        mine = found[found["doc_id"] == doc].sort_values("piece")
        assert mine["length"].sum() == len(whole)
        for _, r in mine.iterrows():
            assert r["ids_crc32"] == zlib.crc32(whole[int(r["start"]):int(r["start"] + r["length"])].tobytes())
        assert (mine["length"].iloc[1:] == 1024).all() or len(mine) == 1
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["length"].sum() <= 1024
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all()
    assert packing.pack_documents(docs.limit(0), JSON, RANKS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 200))
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, limit + 1, 60), rng.integers(1, 50, 60))}
    plan = packing.plan_packing(counts, limit)
    used: dict[int, int] = {}
    for pattern, number in plan:
        assert number > 0 and sum(pattern) <= limit
        for n in pattern:
            used[n] = used.get(n, 0) + number
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    big = sum(c for n, c in counts.items() if 2 * n > limit)
    assert sum(number for _, number in plan) <= max(1.25 * total / limit, big) + 2


def test_exact_complements():
    assert sorted(packing.plan_packing({6: 2, 4: 1, 3: 1, 1: 1}, 10)) == [((6, 3, 1), 1), ((6, 4), 1)]


PAGES = [
    (3, "http://a", "x" * 200), (1, "http://b\r\nX: y", "x" * 200), (2, None, "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
    (8, "u", "é" * 120), (9, "u", "é" * 120), (9, "u", "é" * 120), (None, "u", "x" * 200), (10, "u", "line\r\n\r\n" * 50_000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, first_id int")
    found = warc.archive_pages(pages, str(tmp_path / "w")) if (tmp_path / "w").mkdir() is None else None
    rows = found.collect()
    first = {"x" * 200: 1, "é" * 120: 8}
    expected = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        start = first.get(html)
        again = start is not None and page != start
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", start if again else None))
    assert sorted(map(repr, expected)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "w")).count() == 0


def archive(*contents):
    out = io.BytesIO()
    for c in contents:
        warc.write_record(out, {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>"}, c)
    return out.getvalue()


def test_reader_takes_members_in_any_chunks():
    data = archive(b"a" * 10, b"", b"b" * 100_000)
    for chunk in (1, 7, 1000, 1 << 20):
        assert [r.content for r in warc.read_records(io.BytesIO(data), chunk)] == [b"a" * 10, b"", b"b" * 100_000]
    assert warc.records_of(b"") == []


@pytest.mark.parametrize("broken", [
    archive(b"abc")[:-5], b"not gzip", gzip.compress(b"no header"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha256:00\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\n\r\n\r\n\r\n"),
])
def test_broken_archives_are_refused(broken):
    with pytest.raises(warc.WarcError):
        warc.records_of(broken)


def test_the_tokenizer_is_gone_before_memory_is_given_back(spark, monkeypatch):
    seen = []

    class Encoder:
        def __call__(self, texts):
            return [np.array([7], np.uint32) for _ in texts]

        def __del__(self):
            seen.append("gone")

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, shape):
            return run

    monkeypatch.setattr(packing, "tokenizer", lambda *paths: Encoder())
    monkeypatch.setattr(common, "_give_back", lambda: seen.append("given back"))
    made = list(packing.pieces(Rows(), "none", None)(iter([pa.record_batch({"doc_id": [1, 2], "text": ["a", "b"]})])))
    assert sum(batch.num_rows for batch in made) == 2
    assert seen.count("gone") == 1 and seen[-1] == "given back"
