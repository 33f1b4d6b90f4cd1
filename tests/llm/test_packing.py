import zlib
from collections import Counter

import numpy as np
import pytest

from tracekit.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", "  \n\t", "Hello  World's 1234 été ß\n a|b", "x <|endoftext|> y", "漢字 😀 don't I'LL _ab_", "\x00\x1c\x85", "word " * 2047, "word " * 6000,
         "a1 " * 1500, "same text", "same text"]


def library_pieces(text):
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = library.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) - (len(ids) - 1) // 2048 * 2048
    bounds = [0, *range(first, len(ids) + 1, 2048)]
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def best_fit(lengths, capacity):
    """Best-fit decreasing piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return bins


def check_sequences(rows, capacity):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_bin.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return by_bin


def test_pieces_are_the_library_s(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1)], "doc_id long, text string, length int").repartition(3)
    got = {}
    for r in packing.pieces(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in [*enumerate(TEXTS), (None, "no id")]:
        want, start = library_pieces(text), 0
        rows = sorted(got.pop(i), key=lambda r: r.piece)
        assert [r.ids for r in rows] == want
        for k, (r, ids) in enumerate(zip(rows, want)):
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
    assert not got


def test_every_code_point_class_as_the_library():
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))

    class Spec:
        value = open(packing.default_path(), "rb").read()

    coder = packing._encoding(Spec)
    for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700, 7)]:
        text = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1{chr(c)}!"
        assert coder.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity,seed", [(1, 0), (10, 1), (64, 2), (64, 3), (257, 4), (2048, 5)])
def test_plan_is_best_fit_decreasing(capacity, seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, capacity + 1, 150), rng.integers(1, max(2, capacity // 3), 250), np.full(90, max(1, capacity // 7))]).tolist()
    moves = packing.plan(Counter(lengths), capacity)
    used = Counter()
    for length, n in Counter(lengths).items():
        mine = sorted(m.tolist() for m in moves if m[0] == length)
        for rank in range(n):
            _, first, each, start, offset = [m for m in mine if m[1] <= rank][-1]
            i = (rank - first) // each
            used[start + i] += length
            assert offset + (rank - first) % each * length + length <= capacity
    assert sorted(capacity - v for v in used.values()) == sorted(best_fit(lengths, capacity))
    assert len(moves) <= (3 * capacity + 1) * (2 * capacity) ** 0.5 + 1


def test_tightest_bin():
    bins, rooms = packing.OpenBins(20), Counter()
    rng = np.random.default_rng(1)
    for _ in range(300):
        room = int(rng.integers(0, 21))
        change = -1 if rooms[room] and rng.random() < 0.6 else 1
        rooms[room] += change
        bins.add(room, change)
        for wanted in range(1, 21):
            assert bins.tightest(wanted) == min((r for r, n in rooms.items() if n and r >= wanted), default=None)


def test_packed_documents_read_back(spark):
    texts = TEXTS * 9 + ["short one"] * 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    packed = packing.pack(packing.pieces(df))
    rows = packed.collect()
    by_bin = check_sequences(rows, 2048)
    assert len(by_bin) == len(best_fit([r.length for r in rows], 2048))
    back = {}
    for s in packing.sequences(packed).collect():
        for p in s.parts:
            back[p.doc_id, p.piece] = s.ids[p.offset : p.offset + p.length]
    for i, text in enumerate(TEXTS):
        want = library_pieces(text)
        assert [back[i, k] for k in range(len(want))] == want
    assert len(back) == len(rows)


def test_taken_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, 30, "x", "y")], "doc_id long, length int, sequence_id string, pack_slot string")
    row = packing.pack(df, 30).first()
    assert (row.sequence_id, row.sequence_id_, row.offset, row.pack_slot) == ("x", 0, 0, "y")
    assert packing.pack(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 29)
