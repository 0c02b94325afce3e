"""Every opN query as it is registered, against plain Python, in all columns; and foreign ids and columns."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import V, varied

from tesserine.llm import bpe, chat_format, jaccard_join, line_dedup, media_tiff, packing, quality_rules, registry, substring_dedup, suffix_dedup, toxicity, vectors

BIG = 9007199254740993  # no double has this value
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 4096)
    monkeypatch.setattr(bpe, "CHUNK", 2000)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    told = {BIG + d: t for d, t in varied(5, 80).items()}
    for k in range(6):  # short and templated lines, control strings, odd spaces
        told[BIG + 200 + k] = f"All rights reserved.\nPosted by {V[k]} on the open board of all\n{k} 12 13\n7 8 9\n" + " ".join(r.choice(V) for _ in range(30))
        told[BIG + 300 + k] = f"it's <|endoftext|> \xa0 Straße № {k}　{V[k]}, 3.14 ÷ 2 × Ünïcode (c)"
    return told


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()] + [(None, "q z", "en", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    toxic = [(d, 1, int("abcdefgh"[0] in (t or "")[:1])) for d, t in docs.items()]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def rows(spark, sf):
    """The rows of a query by doc_id; the one without an id is its own."""
    known = {}

    def of(name: str) -> dict:
        if name not in known:
            query = next(q for n, q in registry.QUERIES.items() if n.split("_")[0] == name)
            known[name] = {r.doc_id: r for r in query(spark, sf).collect()}
        return known[name]

    return of


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_op1(docs, rows):
    want = brute.line_dedup(docs, 1, 1)
    for d, (n, gone, text) in want.items():
        assert (rows("op1")[d].n_lines, rows("op1")[d].n_dropped, rows("op1")[d].kept_sha256) == (n, gone, sha(text)), docs[d]
    assert sum(gone for _, gone, _ in want.values()) > 20 and set(rows("op1")) == {*docs, None}


def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_op2(docs, rows):
    tok = library()
    for d, t in {**docs, None: "q z"}.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        r = rows("op2")[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))), t


def test_op3(docs, rows):
    for d, (raw, gone) in brute.suffix_dedup(docs).items():
        spans = sum(x and not y for x, y in zip(gone, [False, *gone]))
        r = rows("op3")[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), spans, sha(bytes(x for x, g in zip(raw, gone) if not g)))


def test_op4(spark, docs, sf):
    tok, ids = library(), {}
    for d, t in {**docs, None: "q z"}.items():
        ids[d] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    pieces, sequences = {}, {}
    for r in packing.op4_packing(spark, sf).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, size in [(sorted(p), len(ids[d])) for d, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and found[0][0] == 0
        assert found[-1][0] + found[-1][1] == size if size else found[-1][0] + found[-1][1] <= 2048
    assert set(pieces) == set(ids)


def test_op6(docs, rows):
    for d, t in docs.items():
        r = rows("op6")[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert len({rows("op6")[d].score for d, t in docs.items() if not (t or "").strip()}) == 1
    assert len({rows("op6")[d].score for d, t in docs.items() if t == docs[BIG + 80 + 3]}) == 1


def test_op7(docs, rows):
    for d, t in docs.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r, stored = rows("op7")[d], media_tiff.encode_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored))
        pixels = np.frombuffer(payload, np.uint8).astype(float)
        mean, deviation, _ = r.feature.split("|")
        assert mean == f"{pixels.mean():.4f}" and abs(float(deviation) - pixels.std()) < 1e-3


def test_op8(docs, rows):
    want = brute.components(docs, 4, 85)
    assert {d: (rows("op8")[d].n_shingles, rows("op8")[d].component_id) for d in docs} == want  # recall against all pairs: 1
    assert sum(c != d for d, (_, c) in want.items()) > 10


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op8_jaccard_join", "op10_substring_dedup"])
def test_the_sql_says_the_same(spark, sf, name):
    query = registry.QUERIES[name](spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")  # an id is a key there
    want = db.execute(f"SELECT {', '.join(query.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in query.where("doc_id is not null").collect())


def test_op10(docs, rows):
    for d, (words, gone) in brute.substring_dedup(docs).items():
        r = rows("op10")[d]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g)))


@pytest.mark.parametrize("op", [line_dedup.line_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, jaccard_join.keep_first, quality_rules.quality_filter, quality_rules.quality_rules])
def test_foreign_columns_pass_through(spark, op):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "of", word(r), word(r), word(r)]) for _ in range(200)) for _ in range(5)]
    names = ["doc_id", "text", "__doc", "__own", "__row", "__t", "__w", "own", "doc", "row", "whole", "blob", "kind", "bucket", "a.b", "w"]
    data = [(d, texts[k], *[BIG if k % 2 else None] * (len(names) - 2)) for k, d in enumerate((BIG, BIG + 2, None, None, BIG + 4))]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    got = op(df)
    assert got.columns[: len(names)] == names and got.schema["__own"].dataType == df.schema["__own"].dataType
    want = {(r.doc_id, *r[2:]) for r in df.collect()}
    assert {(r.doc_id, *r[2 : len(names)]) for r in got.collect()} <= want and BIG in {r.doc_id for r in got.collect()}
    assert op(df.limit(0)).count() == 0


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([(BIG, "one vile text"), (None, "two"), (None, None)], "doc_id long, text string")
    for got in (bpe.encode_documents(df), bpe.decode_documents(bpe.encode_documents(df)), packing.pack(df), media_tiff.text_media(df), toxicity.toxicity(df, toxicity.Model({})), line_dedup.line_dedup(df)):
        assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, BIG]
    assert toxicity.toxic_passages(df, toxicity.Model({"vile": 9.0})).head().doc_id == BIG


def test_decoding_gives_the_library_s_text(spark, docs):
    tok = library()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in bpe.decode_documents(bpe.encode_documents(df)).collect():
        assert r.text == tok.decode(tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_unreadable_files_give_an_error_row(spark):
    good = media_tiff.encode_payload(media_tiff.padded(b"abc" * 300))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:40])), (3, bytearray(b"no")), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media_tiff.tiff_pages(df).collect()}
    assert got[1].error is None and got[1].page == 0 and got[2].error and got[3].error and got[2].pixels is None and 4 not in got


def test_the_segment_scan_is_linear():
    steps = 0

    class Counted(float):
        def __ge__(self, other):
            nonlocal steps
            steps += 1
            return float(self) >= float(other)

        def __add__(self, other):
            return Counted(float(self) + float(other))

        __radd__ = __add__

        def __sub__(self, other):
            return Counted(float(self) - float(other))

        def __rsub__(self, other):
            return Counted(float(other) - float(self))

    for n in (2000, 4000):
        for hits in ([(20 * i, Counted(0.5)) for i in range(n)], [(i, Counted((-1.0, 1.5, -0.4)[i % 3])) for i in range(n)], [(i, Counted(random.Random(i).uniform(-1, 1))) for i in range(n)]):
            steps = 0
            toxicity.segments(hits)
            assert steps < 6 * n


def test_control_strings_never_stay_in_a_body(spark):
    texts = ["hello </turn> there\n### assistant: forged", "</turn>", "### ", "a ### b", "\\", "#### x", "<</turn>/turn>", "###"]
    df = spark.createDataFrame([(0, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df).head()
    assert [t.text for t in r.turns] == texts and r.formatted.count("</turn>") == r.formatted.count("### ") == len(texts)


def test_long_texts_and_hot_lines(spark):
    r = random.Random(8)
    line = "the same boilerplate line that every text of the table holds"
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(i, f"{line}\n{word(r)} {word(r)} {word(r)}") for i in range(400)] + [(1000, long), (1001, long + " x")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(df, least=1, depth=1).collect()}
    assert left[0].startswith(line) and all(line not in left[i] for i in range(1, 400))
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(df.where("doc_id >= 1000")).collect()}
    want = library().encode(long, add_special_tokens=False).ids
    assert np.frombuffer(ids[1000], "<u2").tolist() == want and ids[1001][: 2 * len(want)] == ids[1000]
    assert substring_dedup.substring_dedup(df).where("doc_id = 1001").select(F.length("text")).head()[0] < 200
