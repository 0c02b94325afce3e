import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import bpe, chat_format, jaccard_join, line_dedup, packing, quality_rules, registry, substring_dedup, suffix_dedup, toxicity, vectors

V = [f"w{i}" if i % 9 == 0 else "abcdefgh"[i % 8] * (1 + i // 8) for i in range(80)]


def varied(seed: int, n: int = 120) -> dict:
    """Copies, near copies, shared passages, periodic and long texts, nulls and blanks."""
    r = random.Random(seed)
    base = [[r.choice(V) for _ in range(k)] for k in (150, 60, 25, 12, 4, 2)]
    passage = [r.choice(V) for _ in range(45)]
    docs: dict = {}
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(len(w))] = r.choice(V)
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        text = ""
        for k, x in enumerate(w):
            text += x + ("\n" if k % 9 == 8 else " ")
        docs[i] = text
    docs[n], docs[n + 1], docs[n + 2] = None, "", " \n\t "
    docs[n + 3] = "be " * 400
    docs[n + 4] = "é" * 500 + " ".join(r.choice(V) for _ in range(3000))
    docs[n + 5] = docs[n + 4][100:] + "x"
    return docs


@pytest.fixture(scope="module")
def docs():
    return varied(1)


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(d, t, "s", 7) for d, t in docs.items()], "doc_id long, text string, source string, own int").repartition(5)


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 4096)


def test_line_dedup(spark, docs, frame):
    want = brute.line_dedup(docs)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame).collect()}
    for d, (_, _, text) in want.items():
        if docs[d] is None:
            assert d in got and got[d] is None
        elif not docs[d].split() or text.split():
            assert got[d] == text
        else:
            assert d not in got
    assert line_dedup.line_dedup(frame.limit(0)).count() == 0 and line_dedup.line_dedup(frame).columns == frame.columns


def test_substring_dedup(spark, docs, frame):
    want = brute.substring_dedup(docs)
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(frame).collect()}
    for d, (words, gone) in want.items():
        assert (got[d] or "").encode().split() == [w for w, g in zip(words, gone) if not g]
        if not any(gone):
            assert got[d] == docs[d]
    assert substring_dedup.substring_dedup(frame.limit(0)).count() == 0


def test_repeated_rows_stay_alike(spark):
    text = " ".join(V[:30])
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, len((r.text or "").split())) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 0), (1, 30), (1, 30), (2, 0)]
    assert {r.doc_id for r in jaccard_join.keep_first(df).collect()} == {1, None}
    assert sorted((r.doc_id or -1, r.text or "") for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(1, "a" * 150), (2, "b" * 300), (2, "b" * 300)], "doc_id long, text string")).collect()) == [(1, "a" * 150), (2, ""), (2, "")]


@pytest.mark.parametrize("wide", [2048, 1])
def test_suffix_dedup(spark, docs, frame, wide, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup.anchor_classes, "__defaults__", (suffix_dedup.LENGTH, suffix_dedup.GRAM, wide))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    for d, (raw, g) in brute.suffix_dedup(docs).items():
        kept = bytes(x for x, out in zip(raw, g) if not out)
        spans = sum(out and not before for out, before in zip(g, [False, *g]))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(raw), sum(g), spans, hashlib.sha256(kept).hexdigest()), d


def test_deep_shallow():
    r = np.random.default_rng(1)
    text = r.integers(0, 2, 4000, dtype=np.uint8)
    digits = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel().astype(np.uint64)
    at = np.arange(3000)
    for n in (12, 16, 19, 40):
        live, leaf = suffix_dedup.deep_shallow(digits, at, np.zeros(3000, np.int64), n, 8)
        seen: dict = {}
        for i in at.tolist():
            seen.setdefault(text[i : i + n].tobytes(), set()).add(i)
        want = sorted(map(sorted, (s for s in seen.values() if len(s) > 1)))
        assert sorted(sorted(live[leaf == k].tolist()) for k in np.unique(leaf)) == want


@pytest.mark.parametrize("k, percent, block", [(4, 85, 512), (5, 80, 4), (2, 60, 6)])
def test_jaccard(spark, docs, frame, k, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame, k, percent).collect()}
    assert got == brute.components(docs, k, percent)
    assert jaccard_join.jaccard_components(frame.limit(0), k, percent).count() == 0


def test_bpe(spark):
    odd = ["it's we'll 'S ''s don't", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ σας J̌ ẞ", "x\x1cy \x85a\xa0b c　d", "½² ٣٤ 一二三 日本語", "a_b__c 12ab3", "naïve ́x × ª º", "🎉👍🏽 x‍y", None, "", " \n", "word " * 3000 + "wordy, word; rare1 rare2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(0, odd[0]), (None, "q z")], "doc_id long, text string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    for most in (1 << 18, 0):
        got = bpe.encode_documents(df, most=most).collect()
        assert len(got) == len(odd) + 2
        for r in got:
            text = "q z" if r.doc_id is None else odd[r.doc_id] or ""
            want = tok.encode(text, add_special_tokens=False).ids
            ids = np.frombuffer(r.ids, "<u2")
            assert ids.tolist() == want and bpe.decode_ids(ids, bpe.bpe(bpe.default_path()).pieces) == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_packing(spark, docs, frame):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    rows = packing.pack(frame).collect()
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    by: dict = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for spots in by.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(frame.limit(0)).count() == 0


def test_plan_uses_the_histogram():
    r = random.Random(3)
    for top in (3, 40, 2047):
        h = {k: r.randrange(1, 30) for k in range(1, top + 1)}
        left = dict(h)
        for n, lengths in packing.plan(h):
            assert n > 0 and sum(lengths) <= 2048
            for k in lengths:
                left[k] -= n
        assert not any(left.values())


def test_quality_and_its_edges(spark):
    r = random.Random(4)
    long = " ".join(r.choice(["the", "of", "and", *(f"w{i}" for i in range(400))] if r.random() < 0.7 else ["the", "of", "and"]) for _ in range(5000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, "### " * 200), (6, "the cat " * 300), (4, long)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[3].kept
    assert got[4].kept and not got[5].kept and got[6].n_repeat_words == 600 and got[6].base_failed
    kept = quality_rules.quality_filter(df).collect()
    assert len(kept) == 2 and kept[0].n_words == 1
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_chat(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\t\\h", None, "", "### ", "a</turn>", "é" * 50_000, "\\t</turn>\n\\\\"]
    rows = [(c, k, role, t) for c, role in enumerate(["assistant", "user", None, "odd: role\n"]) for k, t in enumerate(texts)] + [(9, 0, "user", "x"), (9, 0, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = 0
    for r in chat_format.format_chats(df).collect():
        want = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, x) for _, role, x in want]
        for s in r.spans:
            body = r.formatted[s.start : s.start + s.length]
            assert r.turns[s.turn].role == "assistant" and (body == r.turns[s.turn].text or body.startswith("\\"))
        assert len(r.spans) == sum(t.role == "assistant" for t in r.turns)
        seen += 1
    assert seen == 6 and chat_format.format_chats(df.limit(0)).count() == 0


def test_segments_are_maximal():
    r = random.Random(7)
    for _ in range(200):
        x = [r.choice([-2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(r.randrange(1, 12))]
        got = toxicity.segments(list(enumerate(x)))
        rest, want = [(0, len(x))], []
        while rest:  # the best segment, then both sides of it
            lo, hi = rest.pop()
            best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if best and best[0] > 0:
                _, _, _, i, j = best
                want.append(best[0])
                rest += [(lo, i), (j, hi)]
        assert sorted(s for *_, s in got) == sorted(want)


def test_toxicity(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        w, bad = [r.choice(V[:60]) + "abcdefghij"[i % 10] for _ in range(60)], i % 6 == 0
        if bad:
            w[r.randrange(40)] = w[r.randrange(40)] = r.choice(("vile", "foul"))
        docs.append((i, " ".join(w)))
        labels += [(i, int(bad))] * (1 + (i % 50 == 0))
    docs += [(900, None), (901, ""), (None, "vile"), (902, "vile " * 20_000)]
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lb)
    got = {x.doc_id: x.score for x in toxicity.toxicity(df, model).collect()}
    truth = dict(labels)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.97
    assert got[900] == got[901] < 0.5 < got[902]
    assert toxicity.toxic_passages(df.where("doc_id = 902"), model).count() == 1
    assert toxicity.toxicity(df, toxicity.train(df, lb.limit(0))).agg(F.max("score")).head()[0] == pytest.approx(0, abs=1e-9)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tesserine.llm.common import materialize

    r = random.Random(9)
    clean = {i: "\n".join(" ".join(r.choice(["the", "of", "and", "in"] * 2 + ["q" + "abcdefghij"[i % 10] * (1 + i // 10) + "klmnopqrst"[k % 10] * (1 + k // 10) for k in range(40)]) for _ in range(30)) for _ in range(4)) for i in range(30)}
    rows = {**clean, 100: clean[0], 101: clean[1].replace("the", "of", 1), 102: "### " * 100, 103: None, 104: clean[2] + "\n" + clean[3].split("\n")[0]}
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == first
        kept.append({x.doc_id: x.text for x in docs.collect()})
    assert 102 not in kept[0] and 103 not in kept[0] and 100 in kept[0]
    assert set(clean) <= set(kept[-1]) and 100 not in kept[1] and all(kept[-1][d] == t for d, t in clean.items())
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[-1])
