"""Each operator over a whole shared table against SQL, brute force, the library or held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pricetide.llm import (
    ann_search, bpe_chunks, entropy_mix, html_text, language_id, minhash_dedup, secret_scan, token_file, tokens, toxicity,
)
from pricetide.llm.common import table, written
from pricetide.llm.queries import QUERIES, SQL

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return table(spark, data_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data_dir, name):
    frame = QUERIES[name](spark, data_dir)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_in_a_large_group(spark):
    """One text with few or many words changed, 300 times: the links are those of all pairs."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 8, 12])):
            words[at] = f"x{i}_{at}" if rng.random() < 0.7 else f"y{at}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(minhash_dedup.shingle_set(t).tolist()) for _, t in rows]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(300):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.75:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame).collect()}
    assert got == {i: find(i) for i in range(300)}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_secrets(docs, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secret_scan.op8_secret_scan(docs).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_markov_adds_random_strings_only(spark):
    rng = random.Random(2)
    letters = secret_scan.ALPHABET[:62]

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = [(i, f"some ordinary words_and_identifiers here token={noise(40)} end") for i in range(300)]
    rows += [(1000, f"alone {noise(44)} stands"), (1001, "a_very_long_ordinary_identifier_of_words stands")]
    got = {r.doc_id: r for r in secret_scan.op8_secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].n_markov == 1 and got[1000].spans == "markov:6:50" and got[1001].n_markov == 0


def test_mix(docs):
    rows = entropy_mix.op4_entropy_mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, want, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else share
        open_ -= over or open_
    for s in names:
        assert by[s][0].target == pytest.approx(want[s], rel=1e-12) and by[s][0].source_size == size[s]
        assert sum(r.taken for r in by[s]) == pytest.approx(want[s], rel=0.01)
    again = {r.doc_id: r.taken for r in entropy_mix.op4_entropy_mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    # Rates rise or fall with size within a source: the tilt of one source is the same for all its documents.
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)


def test_language(docs):
    got = language_id.op10_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_is_not_learned_from_held_out_rows(docs):
    held = language_id.crc_of_id("doc_id", 5) == 0
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert language_id.train(other).langs == language_id.train(docs).langs


def test_toxicity(spark, data_dir, docs):
    labels = table(spark, data_dir, "labels")
    got = toxicity.op7_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    clean, toxic = [r.score for r in held if not r.toxic], [r.score for r in held if r.toxic]
    assert sum(s >= 0.7 for s in clean) / len(clean) < 0.02
    assert np.mean([t > c for t in toxic for c in clean]) > 0.85


def test_token_file(docs, texts):
    library, at = Tokenizer.from_file(BYTE), 0
    for r in sorted(token_file.op6_token_file(docs, BYTE).collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_bpe(docs, texts):
    library = Tokenizer.from_file(WORD)
    for r in bpe_chunks.op9_bpe_chunks(docs, WORD).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


ODD = [
    "", " ", "  a", "a \n b  c\n\n d ", "It's don't we'll <|endoftext|> x", "x<|startoftext|> y  z\x1c q", "\x85 a\xa0 b", "é à́ ḃ",
    "İstanbul ΣΑΣ Σας ", "12 34.5 a1b2 ###x ***", "a\t b\r\nc", "日本 語 x", "(a b) \"c d\" 'e f'", "... . ,.", "x" * 9000 + " y " * 900, "ab\x0bcd \x00 e",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_texts(path):
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    rng = random.Random(1)
    more = ["".join(rng.choice(["the ", "é", "X", ", ", "\n", "'s ", "9", " ", "word", "##", "ﬁ", "ñ"]) for _ in range(3000)) for _ in range(20)]
    want = [library.encode(t, add_special_tokens=False).ids for t in ODD + more]
    got = bpe_chunks.Coder(definition).encode(ODD + more)
    assert [g[1] for g in got] == [" ".join(map(str, w)) for w in want]
    assert [g[2] for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    coder = token_file.Coder(definition, np.dtype("<u2"))
    assert [np.frombuffer(coder.encode(t), "<u2").tolist() for t in ODD + more] == want
    assert tokens.Pieces(tokens.load(definition)).whole is not None


def test_chunks_follow_content():
    rng = random.Random(3)
    passage = " ".join(f"word{rng.randrange(5000)}" for _ in range(4000))
    one, two = bpe_chunks.split("head " + passage), bpe_chunks.split("another head of other length " + passage)
    assert "".join(p for p, _ in one) == "head " + passage
    shared = {p for p, core in one if core} & {p for p, core in two if core}
    assert sum(map(len, shared)) > 0.8 * len(passage)


def test_ann_recall(spark, data_dir):
    rows = table(spark, data_dir, "embeddings")
    got = {}
    for r in ann_search.op3_ann_search(rows).collect():
        got.setdefault(r.query_id, []).append(r)
    local = rows.select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        true = set(ids[np.lexsort((ids, -scores))[:20]])
        own = sorted(got[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert all(r.score == pytest.approx(vectors[q] @ vectors[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12) for r in own)
        hits, total = hits + len(true & {r.vec_id for r in own}), total + 20
    assert hits / total >= 0.9


def test_ann_recall_beyond_full_visits(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "PACK_ROWS", 100)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(40, size=4000)] + 0.3 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_search.op3_ann_search(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (200 * 20) >= 0.9


def test_pages(spark, data_dir):
    pages = table(spark, data_dir, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    wrong = 0
    for r in html_text.op5_html_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        wrong += r["text"] != "\n".join(p for p in parts if p)
    assert wrong <= len(source) // 100


def test_pipeline(spark, data_dir, docs, texts):
    stages, rows = dict(corpus_pipeline.STAGES), docs
    sizes = {}
    for name, stage in stages.items():
        before, rows = rows, written(stage(spark, rows, data_dir), name)
        sizes[name] = rows.count()
        if name != "bpe_chunks":
            assert rows.columns == docs.columns
        if name == "language_id":
            gone = before.join(rows, "doc_id", "left_anti").collect()
            assert len(gone) <= 0.01 * before.count()
        if name == "minhash_dedup":
            assert sizes[name] == minhash_dedup.near_duplicates(before).where("kept").count()
        if name == "secret_scan":
            assert sizes[name] == before.count() and secret_scan.op8_secret_scan(rows).where("n_assign + n_access + n_hex > 0").count() == 0
        if name == "entropy_mix":
            assert sizes[name] == entropy_mix.mixed(before).agg(F.sum("copies")).first()[0]
    assert sizes["bpe_chunks"] == sizes["entropy_mix"] == corpus_pipeline.run(spark, data_dir).count()
