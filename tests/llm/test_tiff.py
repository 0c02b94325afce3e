import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import media_tiff, tiff


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_come_back(kind, predictor, tile):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((70, 33, 3), (1, 1, 1), (300, 64, 3))]
    got = list(tiff.read_pages(tiff.write(pages, kind, predictor, rows=32, tile=tile)))
    assert [p.number for p in got] == [0, 1, 2]
    for a, b in zip(pages, got, strict=True):
        assert (a == b.pixels).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.binary(min_size=1, max_size=3).map(lambda b: b * 4000))
def test_codecs_invert(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_table_refills():
    data = np.random.default_rng(2).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_no_tiff_is_refused():
    with pytest.raises(ValueError):
        list(tiff.read_pages(b"GIF89a  "))


def test_operator(spark):
    long = "é" * 500_000
    docs = spark.createDataFrame([(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (1, "abc", "x"), (None, "q", "x")], "doc_id long, text string, media string")
    media = media_tiff.text_media(docs)
    back: dict = {}
    for r in sorted(media_tiff.tiff_pages(media).collect(), key=lambda r: (r.doc_id or 0, r.page)):
        back[r.doc_id] = back.get(r.doc_id, b"") + bytes(r.pixels)
    assert back[4].rstrip() == long.encode() and back[2] == back[3] == b" " * 192
    assert back[1] == b"abc".ljust(192) * 2 and len(back) == 5
    assert media_tiff.tiff_pages(media.limit(0)).count() == 0
