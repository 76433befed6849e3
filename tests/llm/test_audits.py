"""Spelling groups, licence scans and the filter audit: brute force, retractions, hot groups and odd rows."""

import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm import filter_audit, license_scan, spelling
from pricetide.llm.common import prepared

ODD = "doc_id long, text string, source string, word string, n long, line string, part string, mask int, `a.b` string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(rows, least_length=6, least_count=5):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=9), min_size=1, max_size=12, unique=True))
def test_near_pairs_of_blocks(words):
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    got = Counter()
    for longer in range(5, 11):
        for kind in range(3):
            for i, j in zip(*spelling.near_pairs(words, words, longer, kind, True)):
                got[frozenset((words[i], words[j]))] += 1
    assert set(got) == want and set(got.values()) <= {1}
    half = len(words) // 2
    across = Counter()
    for longer in range(5, 11):
        for kind in range(3):
            for i, j in zip(*spelling.near_pairs(words[:half], words[half:], longer, kind, False)):
                across[frozenset((words[i], words[half + j]))] += 1
    assert set(across) == {p for p in want if len(p & set(words[:half])) == 1} and set(across.values()) <= {1}


def spelled(rng, words):
    return [(i if i % 50 else None, " ".join(rng.choices(words, k=60))) for i in range(240)]


def test_spelling_groups(spark, monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcéü", k=rng.randint(6, 9))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(4):
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]]))
    # Many words that share their first two thirds: one bucket of several blocks. Chains of forms: heavier words are repeated.
    words += ["hhhhhhhh" + a + b for a in "abcdefghij" for b in "klmnopqr"] + ["stones"] * 250 + ["stoness"] * 45 + ["stonesse"] * 6
    rows = spelled(rng, words) + [(1, "x" * 3000 + " " + "STONES Stones"), (1, None), (2, ""), (2, "   ")] + [(900 + i, "y" * 9000 + " " + "y" * 9001) for i in range(5)]
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 16)
    frame = spark.createDataFrame([(i, t, *(None,) * 7) for i, t in rows], ODD)
    got = spelling.op11_spelling_groups(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == brute_variants(rows)
    assert any(r[2] not in (r[0], r[1]) for r in have), "a chain of two forms"
    blocks = spelling.tiles(spelling.counted_words(frame)).agg({"blocks": "max"}).first()[0]
    assert blocks > 1
    assert spelling.op11_spelling_groups(frame.limit(0)).count() == 0


def brute_phrases(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_places(spark):
    rng = random.Random(3)
    pieces = ["gnu general public license", "GNU-General", "public", "license", "apache license", "CC BY", "cc", "by", "MIT license", "mit", "café", "中", "--", "\n", "x.y", "İ", "2"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(400)]
    texts += [" ".join(rng.choices(pieces, k=30)) for _ in range(200)] + [None, "", " ", "mit license mit license", "mit license" * 3, "a b " * 50_000 + "apache license", "cc by " * 40_000]
    frame = spark.createDataFrame([(i, t, *(None,) * 7) for i, t in enumerate(texts)], ODD)
    for r in license_scan.op12_license_scan(frame).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(texts[r.doc_id]), texts[r.doc_id]
        assert r.score == 1 if r.n_base else 0 <= r.score < 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.op12_license_scan(frame.limit(0)).count() == 0


def brute_shares(words, idf):
    """Every start of every template, without an index."""
    best = {}
    for t, (_, text, keys) in enumerate(license_scan.TEMPLATES):
        own = text.split()
        rare = sorted({w for w in own if w in words}, key=lambda w: (-idf[w], w))[:license_scan.ANCHORS]
        if len(rare) < license_scan.ANCHORS:
            continue
        for start in range(-len(own), len(words)):
            at = lambda j: words[start + j] if 0 <= start + j < len(words) else None
            agree = all(any(own[j] == w and at(j) == w for j in range(len(own))) for w in rare)
            stands = lambda key, j: [at(j + k) for k in range(len(key))] == key
            firsts = [(k.split(), next(j for j in range(len(own)) if own[j:j + len(k.split())] == k.split())) for k in keys]
            if agree and all(stands(k, j) for k, j in firsts):
                share = sum(idf[w] for j, w in enumerate(own) if at(j) == w) / sum(idf[w] for w in own)
                best[t] = max(best.get(t, 0), share)
    return best


def test_license_labels(spark):
    rng = random.Random(5)
    filler = "code file the a of to copy license public software word other".split()
    texts = []
    for label, text, _ in license_scan.TEMPLATES:
        for _ in range(6):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(filler)
            words = words[rng.choice([0, 0, 2]):]
            texts.append(" ".join(rng.choices(filler, k=rng.randint(0, 30)) + words + rng.choices(filler, k=rng.randint(0, 30))))
        texts.append(f"Intro. {text.upper()}, {text}!")
    texts += [" ".join(rng.choices(license_scan.VOCABULARY, k=200)) for _ in range(20)] + ["permission is hereby granted " * 3000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [t.lower().replace(",", " ").replace(".", " ").replace("!", " ").split() for t in texts]
    n, counted = license_scan.frequencies(frame.select(license_scan.flat(frame.text).alias("line")))
    assert n == len(texts) and counted == {w: c for w in license_scan.VOCABULARY if (c := sum(w in h for h in held))}
    idf = license_scan.weights(n, counted)
    found = 0
    for r in license_scan.op12_license_scan(frame).collect():
        shares = brute_shares(held[r.doc_id], idf) if len(held[r.doc_id]) < 5000 else {}
        added = {license_scan.TEMPLATES[t][0] for t, s in shares.items() if s >= license_scan.LEAST_SHARE}
        assert set(filter(None, r.labels.split(","))) == added | set(filter(None, r.base_labels.split(","))), texts[r.doc_id]
        assert r.score == (1 if r.n_base else pytest.approx(max(shares.values(), default=0), abs=1e-6))
        found += bool(added)
    assert found >= 60


def brute_audit(rows, labels):
    least = {}
    for ident, text, _ in rows:
        if ident is not None:
            least[text or ""] = min(ident, least.get(text or "", ident))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = defaultdict(list)
    for ident, text, source in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": ident is not None and ident > least[text],
        }
        docs[source or ""].append(({f for f, x in fails.items() if x}, ident in good, ident in toxic))
    out = {}
    for part, held in docs.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for fails, *_ in held:
                shapley.update([f for f in order if f in fails][:1])
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [d for d in held if f in d[0] and not d[0] & before]
                out[part, "".join(order), step] = (
                    sum(not d[0] & (before | {f}) for d in held), len(gone), sum(f in d[0] and bool(d[0] & before) for d in held),
                    sum(d[0] == {f} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[f],
                )
    return out


def audited(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def audit_rows(rng):
    long = [" ".join(rng.choices([f"word{i}" for i in range(90)], k=60)) for _ in range(40)]
    texts = long + ["", None, "short", "A B C", " ".join(["same"] * 60), " ".join(f"w{i}" for i in range(55)) + " $5", "x" * 30_000 + " y" * 100]
    rows = [(rng.randrange(500), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(400)]
    rows += [(None, long[0], "a")] * 3 + [(i, long[1], "b") for i in range(300, 700)]  # a hot text
    return rows


@pytest.mark.parametrize("descending", [False, True])
def test_audit_over_many_batches(spark, tmp_path, monkeypatch, descending):
    """Smaller ids come in later files: earlier masks are taken back."""
    prepared(spark)
    rng = random.Random(6)
    rows = sorted(audit_rows(rng), key=lambda r: -1 if r[0] is None else r[0], reverse=descending)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 600, 2)] + [(4, 1, 0), (None, 1, 1)]
    folder = str(tmp_path / "docs")
    for i in range(8):
        part = rows[i * 100:(i + 1) * 100] if i < 7 else rows[700:]
        spark.createDataFrame([(*r[:3], "x", 1, None, "p", 3, "q") for r in part], ODD).coalesce(1).write.mode("append").parquet(folder)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "FOLDED_TEXTS", 7)
    counts = filter_audit.counters(spark, folder, known, rounds=6)
    assert counts.where("n <= 0").count() == 0
    got = audited(filter_audit.report(counts))
    assert got == brute_audit(rows, labels)


def test_audit_of_odd_tables(spark, tmp_path):
    prepared(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "empty"))
    assert filter_audit.op13_filter_audit(spark, str(tmp_path / "empty"), labels).count() == 0
    rows = [(None, None, None), (None, None, None), (7, "", "a"), (7, "", "a"), (3, None, "b"), (9, "", None)]
    spark.createDataFrame([(*r, *(None,) * 6) for r in rows], ODD).coalesce(1).write.parquet(str(tmp_path / "odd"))
    got = audited(filter_audit.op13_filter_audit(spark, str(tmp_path / "odd"), labels))
    assert got == brute_audit(rows, []) and len(got) == 3 * 600


def test_a_smaller_id_takes_counts_back():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd
    state, total = State(), Counter()
    for ident, part in [(9, "a"), (4, "b"), (4, "c"), (6, "a"), (2, "a"), (2**60 + 1, "d")]:
        rows = [("text", ident, part, 1, 0, 0, 1), ("other", 2**60 + ident, "z", 0, 0, 0, 1), (None, 0, "s", 3, 0, 0, 5)]
        frame = pd.DataFrame(rows, columns=["digest", "id", "part", "mask", "good", "toxic", "n"])
        for out in filter_audit.changes((7,), iter([frame]), state):
            for r in out.itertuples():
                total[r.part, r.mask] += r.n
    assert {k: n for k, n in total.items() if n} == {
        ("a", 17): 2, ("b", 17): 1, ("c", 17): 1, ("a", 1): 1, ("d", 17): 1, ("z", 0): 1, ("z", 16): 5, ("s", 3): 30,
    }
    kept = json.loads(state.get[0])
    assert kept["text"][0] == 2 and kept["other"][0] == 2**60 + 2
