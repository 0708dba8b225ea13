"""BPE, token files, WARC: against the tokenizers library, round trips, damage."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import bpe, rans, warc
from cloakframe.llm.common import written

LETTERS = "ab  \n\t'stdrevml.!?,éÉßñ中文😀0159  \x1c\x1f\x85́٣²Ⅷ<|>ΣİÀ\xa0"


def odd_texts(n=800, seed=1):
    r = random.Random(seed)
    texts = ["".join(r.choices(LETTERS, k=r.randint(0, 50))) for _ in range(n)]
    return texts + ["", "a" * 9000, " " * 5000 + "x", "'" * 5000 + "re", "x<|endoftext|>" + " y  <|endoftext|>  z", "<|endo", "1" * 6000 + "ab",
                    "\n" * 5000, " \n" * 4000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12000))]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.production_path())


@pytest.mark.parametrize("piece", [1, 7, 1000, 1 << 16])
def test_bpe_is_the_librarys(merges, piece):
    library, encoder, decoder = Tokenizer.from_file(bpe.production_path()), bpe.Encoder(merges), bpe.Decoder(merges)
    for text in odd_texts(300 if piece == 1 else 800):
        want = library.encode(text, add_special_tokens=False).ids
        out = [encoder.feed(text[s : s + piece]) for s in range(0, len(text), piece)]
        got = b"".join([*out, encoder.finish()])
        assert np.frombuffer(got, "<u4").tolist() == want
        back = "".join(decoder.feed(got[s : s + 40]) for s in range(0, len(got), 40)) + decoder.finish()
        assert back == library.decode(want, skip_special_tokens=False)


def test_columns_are_the_librarys(merges, monkeypatch):
    """Many texts at once, with a store that forgets, and with texts that are too long for it."""
    library = Tokenizer.from_file(bpe.production_path())
    texts = [*odd_texts(400, 3), "a b  c", " x", "x ", "one", "one one two one", "\xa0 a \x85b", None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for store, piece in ((3, 1 << 20), (1000, 50)):
        monkeypatch.setattr(bpe, "STORE", store)
        monkeypatch.setattr(bpe, "SLICE", piece)
        encoder = bpe.ColumnEncoder(merges)
        for s in range(0, len(texts), 100):
            ids, at = encoder.column(pa.array(texts[s : s + 100], pa.string()))
            assert [x.tolist() for x in np.split(ids, at[1:-1])] == want[s : s + 100]
    assert encoder.column(pa.array([], pa.string()))[1].tolist() == [0]


def test_lookahead_is_sufficient(merges):
    """Tokens that end the lookahead before a prefix's end are those of the whole word."""
    r = random.Random(2)
    for _ in range(60):
        word = "".join(r.choices("etaoinshrdlu", k=2 * merges.lookahead)).encode()
        cut = r.randint(merges.lookahead + 1, len(word))
        ends = lambda ids: set(np.cumsum([len(merges.bytes_of[i]) for i in ids]).tolist())
        safe = cut - merges.lookahead
        assert {e for e in ends(merges.word(word[:cut])) if e <= safe} == {e for e in ends(merges.word(word)) if e <= safe}


def test_constant_memory(merges):
    stream, most = bpe.WordStream(merges), 0
    for _ in range(300):
        stream.feed(b"abcdefgh" * 50)
        most = max(most, len(stream.held))
    assert most < 2 * stream.window


def test_bpe_query(spark):
    docs = spark.createDataFrame([(1, "Hello  world", "x"), (2, None, "y"), (3, "", "z"), (None, "a<|endoftext|>", "w"), (1, "Hello  world", "x")], "doc_id long, text string, ids string")
    got = bpe.digests(bpe.round_trip(docs, bpe.production_path())).collect()
    library = Tokenizer.from_file(bpe.production_path())
    want = []
    for i, t, _ in [(1, "Hello  world", 0), (2, None, 0), (3, "", 0), (None, "a<|endoftext|>", 0), (1, "Hello  world", 0)]:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(bpe.round_trip(docs.limit(0), bpe.production_path())).count() == 0


def test_library_encoder():
    library, encoder = Tokenizer.from_file(rans.production_path()), rans.LibraryEncoder(rans.production_path())
    texts = odd_texts() + ["é. Foo, bar) x..", "<|startoftext|> a"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_added_tokens_in_other_case():
    library, encoder = Tokenizer.from_file(rans.production_path()), rans.LibraryEncoder(rans.production_path())
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "É <|STARTOFTEXT|>", "<|endoftext|> <|ENDOFTEXT|>", "ж <|ENDOFTEXT|>"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_library_encoder_forgets_and_takes_other_vocabularies(monkeypatch):
    """A small store, and a vocabulary whose form isn't known, give the library's ids too."""
    monkeypatch.setattr(rans.LibraryEncoder, "CACHE", 5)
    for path in (rans.production_path(), bpe.production_path()):
        library, encoder = Tokenizer.from_file(path), rans.LibraryEncoder(path)
        for texts in (odd_texts(200, 7), ["(ab)c", "x--y'd", "Äö.ü", "a's b!s"], [None, "", " "], []):
            want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_wide_ids(spark):
    """Ids over 16 bits take 32; an id that doesn't fit is refused."""
    assert rans.id_type(1 << 16).itemsize == 2 and rans.id_type((1 << 16) + 1).itemsize == 4
    ids = {k: np.array([70_000, k, 3] * (k + 1), "<u4") for k in range(20)}
    rows = written(spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in ids.items()], "id int, ids binary"), "test-ids")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rans.read_ids(*rans.write_ids(rows, 70_001), "int").collect()}
    assert got == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in ids.items()}
    with pytest.raises(ValueError, match="doesn't fit"):
        rans.fitted(np.array([3, 70_000]), rans.id_type(10))


def test_writer_keeps_no_ids():
    """What a writer holds doesn't grow with what it was fed."""
    ids = np.arange(rans.BLOCK * rans.GROUP // 2, dtype=np.uint32) % 1000
    writer = rans.Writer(io.BytesIO(), rans.Table.scaled(np.bincount(ids)))
    for _ in range(9):
        writer.feed(ids)
        assert writer.size <= rans.BLOCK * rans.GROUP


@pytest.mark.parametrize("n", [0, 1, 31, 8192, 8193, 32768, 32769, 32768 * 33 + 7])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49000).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids, minlength=49408))
    data, cut = io.BytesIO(), n // 3
    rans.write_file(data, table, [(1, cut), (None, 0), (3, n - cut)], iter([ids[:cut], ids[cut:]]), pa.int64())
    got = list(rans.read_file(data, len(data.getvalue()), table))
    assert [i for i, _ in got] == [1, None, 3] and (np.concatenate([x for _, x in got]) == ids).all()


def test_rans_finds_damage():
    ids = np.arange(20000, dtype=np.uint32) % 50
    table, data = rans.Table.scaled(np.bincount(ids)), io.BytesIO()
    rans.write_file(data, table, [(1, len(ids))], iter([ids]), pa.int64())
    for at in (1500, len(data.getvalue()) - 30):
        broken = bytearray(data.getvalue())
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(rans.read_file(io.BytesIO(broken), len(broken), table))
    with pytest.raises(ValueError):
        list(rans.read_file(data, len(data.getvalue()), rans.Table.scaled(np.bincount(ids[:70], minlength=50))))


def test_token_files(spark):
    texts = [(5, "Hello, world"), (2, None), (9, ""), (None, "x"), (5, "again and again"), (1, "long " * 20000)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, start string")
    rows = written(rans.encoded(docs, rans.production_path()), "test-ids")
    got = rans.read_ids(*rans.write_ids(rows, 49408)).collect()
    library = Tokenizer.from_file(rans.production_path())
    coded = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts]
    want, start = [], 0
    for i, x in sorted(coded, key=lambda c: (c[0] is not None, c[0] or 0, c[1])):
        want.append((i, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    none = written(rans.encoded(docs.limit(0), rans.production_path()), "test-ids")
    assert rans.read_ids(*rans.write_ids(none, 49408)).count() == 0


def test_warc_normaliser():
    records = [warc.record(k, f"http://a/{k}", bytes([k]) * (k * 5000), hashlib.sha256(bytes([k]) * (k * 5000)).hexdigest(), None, False) for k in range(6)]
    whole = gzip.compress(b"".join(records))
    for piece in (17, 1 << 20):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(whole), out, piece=piece))
        data = out.getvalue()
        assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == records
        again = io.BytesIO()  # members already: the same records
        assert len(list(warc.normalise(io.BytesIO(data), again))) == 6 and gzip.decompress(again.getvalue()) == b"".join(records)
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(whole[:-20]), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-4000])), io.BytesIO()))


def test_warc_pages(spark):
    big, other = "x" * 100, "é" * 60
    pages = [(3, "http://a/ b\r\nc", big), (1, None, big), (2, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", other), (1, "u", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.write_archives(df)).collect()
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        revisit = len(data) >= 100 and first is not None and first != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
