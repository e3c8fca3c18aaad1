import hashlib
import random

import numpy as np
import pytest

from placewise.llm import suffix_dedup as S


def brute(rows, depth=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            if i is not None:
                w = b[p:p + depth]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if i is not None and first[b[p:p + depth]] < i:
                gone[p:p + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(c for c, x in zip(b, gone) if not x)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(5)
    parts = ["".join(r.choices("abcdé ", k=r.randint(30, 140))) for _ in range(25)] + ["x" * 60, "short"]
    return [(r.choice([i, i // 3, None]) if i % 9 == 0 else i,
             None if i % 31 == 0 else "".join(r.choices(parts, k=r.randint(0, 7)))) for i in range(300)]


@pytest.mark.parametrize("block, hot, depth", [(4 << 20, 32, 50), (2000, 3, 50), (2000, 1000, 50), (3000, 2, 7), (3000, 5, 64)])
def test_mixed_documents(spark, as_plain, mixed, block, hot, depth):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    assert as_plain(S.suffix_dedup(df, block_bytes=block, hot=hot, depth=depth)) == brute(mixed, depth)


@pytest.mark.parametrize("block, near, hot", [(2000, 1, 1000), (2000, 3, 20), (60, 2, 1000)])
def test_digits_of_many_blocks(spark, as_plain, mixed, block, near, hot):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    assert as_plain(S.suffix_dedup(df, block_bytes=block, near=near, hot=hot)) == brute(mixed)


def shared_passage(n, length):
    """Documents of a block each, all with one passage."""
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=length))
    return [(i, "".join(r.choices("ijklmnop ", k=200)) + passage) for i in range(n)]


def test_common_passages_travel_as_runs(spark, as_plain, monkeypatch, tmp_path):
    rows, plain_pack = shared_passage(150, 600), S.pack_segments

    def noted(ids, start, length, text):
        with open(tmp_path / "bytes", "a") as f:
            f.write(f"{len(text)}\n")
        return plain_pack(ids, start, length, text)

    monkeypatch.setattr(S, "pack_segments", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_plain(S.suffix_dedup(df, block_bytes=400)) == brute(rows)
    sent = sum(map(int, (tmp_path / "bytes").read_text().split()))
    assert sent < 16 * 600 * 150  # window by window it is 50 times the passage for each block


def test_blocks_exchange_digits_in_groups(spark, as_plain, monkeypatch, tmp_path):
    rows, plain_expand = shared_passage(150, 600), S.expand

    def noted(blob, ascend=True):
        with open(tmp_path / "lists", "a") as f:
            f.write("x")
        return plain_expand(blob, ascend)

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lists = []
    for group in (1, S.GROUP):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "expand", noted)
        (tmp_path / "lists").write_text("")
        assert as_plain(S.suffix_dedup(df, block_bytes=400)) == brute(rows)
        lists.append(len((tmp_path / "lists").read_text()))
    assert lists[1] < 0.8 * lists[0]


def test_blocks_exchange_windows_in_groups(spark, as_plain, monkeypatch, tmp_path):
    rows, plain_pack = shared_passage(150, 600), S.pack_segments

    def noted(*args):
        with open(tmp_path / "pieces", "a") as f:
            f.write("x")
        return plain_pack(*args)

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(S, "pack_segments", noted)
    pieces = []
    for group in (1, S.GROUP):
        monkeypatch.setattr(S, "GROUP", group)
        (tmp_path / "pieces").write_text("")
        assert as_plain(S.suffix_dedup(df, block_bytes=400)) == brute(rows)
        pieces.append(len((tmp_path / "pieces").read_text()))
    assert pieces[1] < 0.8 * pieces[0]


def test_positions_by_source():
    r = np.random.default_rng(3)
    source, position = r.integers(0, 30, 5000), r.integers(0, 400, 5000)
    for more in (0, 1 << 60):  # as one number, and as two
        found = S.by_source(source, position + more)
        assert [i for i, _ in found] == list(range(30))
        assert all(p.tolist() == sorted({*(position[source == i] + more).tolist()}) for i, p in found)
    assert S.by_source(source[:0], position[:0]) == []


def test_windows_whose_shortened_hashes_meet():
    """Hashes that differ in their low bits only are one class until the bytes are compared."""
    data = np.frombuffer(b"".join(bytes([65 + i % 7]) * 60 for i in range(40)), np.uint8)
    starts = np.arange(40) * 60
    names = np.uint64(1 << 40) + (np.arange(40) % 7).astype(np.uint64)
    assert S.equal_windows(data, starts, names, 50).tolist() == [i % 7 for i in range(40)]


def test_documents(spark, as_plain, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert as_plain(S.suffix_dedup(documents)) == brute(rows)


def test_odd_rows(spark, as_plain, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert as_plain(S.suffix_dedup(odd, block_bytes=200)) == brute(rows)
    assert S.suffix_dedup(none).count() == 0


def test_texts_keep_their_rows_and_columns(spark, odd, none):
    out = S.remove_repeats(odd, length_col="n_chars")
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = out.collect()
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or len(r.text) == r.n_chars) for r in rows)
    assert {r.text for r in rows if r.doc_id == 7} == {"the CAT"}
    assert S.remove_repeats(none).count() == 0


def test_a_cut_character_goes(spark):
    tail = "".join(chr(0x4E00 + i) for i in range(40))
    df = spark.createDataFrame([(1, "é" + tail), (2, "à" + tail)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.remove_repeats(df).collect()} == {1: "é" + tail, 2: "à"}
    # the second text shares the first one's last byte of a character, and all that follows
    shared = "q" * 60
    df = spark.createDataFrame([(1, "é" + shared), (2, "ĩ" + shared)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.remove_repeats(df).collect()} == {1: "é" + shared, 2: ""}


def test_packed_numbers():
    up, any_order = np.array([3, 3, 9, 1 << 40]), np.array([5, 0, -7, 1 << 50, 2])
    assert S.expand(S.squeeze(up)).tolist() == up.tolist()
    assert S.expand(S.squeeze(any_order, ascend=False), ascend=False).tolist() == any_order.tolist()
    assert S.expand(S.squeeze(up[:0])).tolist() == []
    text = np.frombuffer(b"some text", np.uint8)
    ids, start, length, back = S.unpack_segments(S.pack_segments(any_order[:2], up[:2], np.array([4, 5]), text))
    assert (ids.tolist(), start.tolist(), length.tolist(), back.tobytes()) == ([5, 0], [3, 3], [4, 5], b"some text")


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"A" * 60 + b"B" * 60 + b"A" * 60, np.uint8)
    starts = np.array([0, 60, 120, 61])
    head = S.equal_windows(data, starts, np.zeros(4, np.uint64), 50)
    assert head.tolist() == [0, 1, 0, 1]
