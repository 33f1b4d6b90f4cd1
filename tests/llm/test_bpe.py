import pytest

from tracekit.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", "  \n\t", "Hello  World's 1234 été ÉTÉ*** ß\n a|b", "x <|endoftext|> y<|startoftext|>", "İstanbul ΑΣ Σ 漢字 😀 don't I'LL _ab_",
         "\x00\x1c\x85​", "word " * 3000, "abcdefgh" * 500, "é" * 700, "same", "same"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_same_ids_and_text_as_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(library):
    coder = bpe.WordBpe(open(bpe.default_path(), encoding="utf-8").read())
    for word in ("thethinginthe" * 9, "aaaaaaaaaaaaaaaa", "internationalisation", "zzzéé"):
        parts = [coder.inner[b] for b in word.encode()]
        parts[-1] = coder.last[word.encode()[-1]]
        assert coder._scan(list(parts)) == coder._heap(list(parts)) == library.encode(word, add_special_tokens=False).ids


def test_taken_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, ids string")
    row = bpe.decode(bpe.encode(df), "ids_").first()
    assert row.ids == "mine" and len(row.ids_) == 2 and row.decoded == "a</w> b</w>"
    assert bpe.decode(bpe.encode(df.limit(0), out_col="t"), "t").count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nothing).first().decoded == ""


def test_batches_are_converted_in_bounded_slices(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    pc = pytest.importorskip("pyarrow.compute")
    monkeypatch.setattr(bpe, "PART_BYTES", 100)
    texts = ["x" * 40] * 7 + [None, "", "y" * 500, "z"] + [""] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(bpe._parts(batch, pc.binary_length(batch.column(1))))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts)
    assert not list(bpe._parts(batch.slice(0, 0), pc.binary_length(batch.column(1).slice(0, 0))))


def test_decoding_loads_no_merges():
    class Spec:
        value = open(bpe.default_path(), encoding="utf-8").read()

    assert bpe._loaded(Spec, bpe._strings) == bpe._loaded(Spec, bpe.WordBpe).tokens
