"""The pipeline's stages and run() against brute force on a small table with awkward rows."""

import collections
import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline as C
from terrapanel.llm import bpe, langid, packing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, score double"  # two names that stages use


def _rows():
    rng = random.Random(11)
    say = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    en, de = ["the", "cat", "house", "near"], ["der", "Hund", "und", "Wasser"]
    texts = [(say(en if i % 2 else de, 40), "en" if i % 2 else "de") for i in range(24)]
    shared = say(en, 20)
    near = texts[4][0].split()
    near[30] = "changed"
    texts += [(texts[3][0], "en"), (" ".join(near), "de"), (shared + " " + say(en, 20), "en"), (say(en, 20) + " " + shared, None), (None, "en"), ("", None), (" \n ", "de"), ("12 34", "en")]
    texts += [("mail a.b@c.de the cat " + say(en, 10), "en"), (say(en, 1500), "en")]
    rows = [(5 * i, t, x, "s", len(t or ""), i, 0.5) for i, (t, x) in enumerate(texts)]
    return [*rows, rows[7]]  # a repeated row


def _near(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"\S+", (r[1] or "").lower())
        sets[r[0]] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return list({r[0]: r for r in rows if comp[r[0]] == r[0]}.values())


def _cut(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        b = (r[1] or "").encode()
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(grams)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        if kept or not b:
            out.append((r[0], kept.decode(), *r[2:]))
    return out


def _ids(rows):
    """Ids by doc_id of packed rows, whose places are checked."""
    by, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, list(r.ids)))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= packing.CAPACITY
    out = {}
    for i, x in docs.items():
        x.sort()
        assert all(n == len(p) for _, n, p in x)
        out[i] = [t for _, _, p in x for t in p]
    return out


def _want_ids(rows):
    c = bpe.Coder()
    return {r[0]: [*c.encode(r[1], by_chunks=False).tolist(), packing.END] for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def _pairs(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def _judged(docs):
    rows = _rows()
    model = langid.fit(*langid.labelled_sample(docs))
    pred, score = langid.predict(model, langid.PieceTable(langid.read_pieces()), pa.array([r[1] for r in rows], pa.string()))
    return [r for r, p, s in zip(rows, pred, score, strict=True) if p != "und" and s >= C.MIN_SHARE]


def test_language(spark, docs):
    want = _judged(docs)
    assert {r[0] for r in _rows()} - {r[0] for r in want} >= {r[0] for r in _rows() if not re.search("[a-z]", r[1] or "")} and len(want) > 20
    assert _pairs(C.language(spark, docs, "")) == sorted((r[0], r[1]) for r in want)


def test_near_duplicates(spark, docs):
    assert _pairs(C.near_duplicates(spark, docs, "")) == sorted((r[0], r[1] or "") for r in _near(_rows()))


def test_repeated_passages_and_personal_data(spark, docs):
    rows = _near(_rows())
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _pairs(C.repeated_passages(spark, d, "")) == sorted((r[0], r[1]) for r in _cut(rows))
    assert _pairs(C.personal_data(spark, docs, "")) == sorted((r[0], pii.redact_text(r[1]) or "") for r in _rows())


def test_pack_returns_ids(spark, docs):
    rows = _near(_rows())
    assert _ids(C.pack(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == _want_ids(rows)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r[0], pii.redact_text(r[1])) for r in _cut(_near(_judged(docs)))]
    assert _ids(C.run(spark, str(tmp_path)).collect()) == _want_ids(rows)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
