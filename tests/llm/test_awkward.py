"""Rows that are repeated, nameless, hot, very long or clash in their columns' names."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import bpe, common, fingerprints, jaccard, langid, pii, quality, suffix_dedup, topk


def _brute(rows, size, percent):
    """(n_shingles, component_id) of each row by comparing all rows."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}) if w else frozenset())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                n = len(a & b)
                if n and 100 * n >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    ids = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            ids[c] = min(d, ids.get(c, d))
    return [(d, len(s), ids.get(c)) for (d, _), s, c in zip(rows, sets, comp, strict=True)]


@pytest.mark.parametrize("tile", [jaccard.TILE, 8])
def test_jaccard_of_repeated_nameless_and_hot_rows(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    base = say(60)
    words = base.split()
    near = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 60, 3)]
    rows = [(5, base), (5, say(30)), (5, near[0]), (None, near[1]), (None, say(12)), (None, None), (9, ""), (9, None), (2, "alone here"), (None, "alone here")]
    rows += [(20 + k, t) for k, t in enumerate(near)] + [(90, base)] * 12 + [(100 + k, base.upper()) for k in range(40)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, node long").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(d, 4, 85).collect()), key=repr)
    assert got == sorted(_brute(rows, 4, 85), key=repr)


def test_near_duplicates_keeps_one_of_each_group(spark):
    import corpus_pipeline as C

    long, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, long), (7, long), (None, other), (None, other + " c"), (3, "x"), (3, "x"), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, d, "").collect()), key=repr)
    assert len(got) == 4 and (7, long) in got and (3, "x") in got and (None, None) in got and sum(t in (other, other + " c") for _, t in got) == 1


def test_lookup_of_hot_missing_and_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3 if k < 300 else k, k) for k in range(600)] + [(None, 1)] * 50, "key long, v long")
    table = spark.range(0, 500, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("found"))
    small = sorted(map(tuple, common.lookup(rows, table, "key").collect()), key=repr)
    monkeypatch.setattr(common, "SMALL", 10)
    assert sorted(map(tuple, common.lookup(rows, table, "key").collect()), key=repr) == small
    assert sum(r[2] is not None for r in small) == 200 + 100


def test_rows_are_split_at_white_space():
    text = " ".join("word%d" % k for k in range(400)) + " " + "z" * 900 + " end"
    buf, offsets = common.text_buffer(pa.array(["", text, None, "short"]))
    for limit, step in ((100, 0), (64, 7), (1 << 20, 0)):
        parts, owner = common.split_rows(buf, offsets, limit, step)
        assert set(offsets) <= set(parts) and len(owner) == len(parts) - 1 and (np.diff(parts) >= 0).all()
        if not step:
            whole, cut = common.words(buf, offsets), common.words(buf, parts)
            assert (whole[3] == cut[3]).all() and (owner[cut[2]] == whole[2]).all()
    sets = list(jaccard.shingle_sets(pa.array([text, "a b c d e"]), 4))
    jaccard_limit = common.split_rows.__defaults__
    common.split_rows.__defaults__ = (90, 0)
    try:
        again = list(jaccard.shingle_sets(pa.array([text, "a b c d e"]), 4))
    finally:
        common.split_rows.__defaults__ = jaccard_limit
    assert len(sets) == len(again) == 2 and all((a == b).all() for a, b in zip(sets, again, strict=True))


def test_repeated_rows_are_worked_once_by_the_suffix_sort(spark):
    passage = "".join(chr(97 + (k * k) % 26) for k in range(200))
    rows = [(1, passage), (2, "head " + passage)] + [(4, "tail " + passage + " more")] * 30 + [(None, passage[:60])] * 3
    d = spark.createDataFrame([(i, t, k, "b") for k, (i, t) in enumerate(rows)], "doc_id long, text string, first int, block string").repartition(3)
    got = suffix_dedup.remove_repeats(d, carry=("first", "block")).collect()
    assert sorted(r["first"] for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_removed, r.n_spans, r.kept))
    # the blank before the passage starts a string that document 2 has, too
    assert by[4] == {(201, 1, "tail more")} and by[2] == {(200, 1, "head ")} and len(by[None]) == len(by[1]) == 1


def test_samples_hold_each_row_once(spark):
    rows = [(1, "the same text", "en")] * 500 + [(2, "another", "de")] + [(3 + k, f"t{k}", "en") for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.labelled_sample(d, 300)
    assert len(texts) == len(set(texts)) <= 32
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0)], "doc_id long, quality int")
    assert len(quality.labelled_sample(d, labels)[0]) <= 2


def test_clashing_columns_are_replaced(spark):
    d = spark.createDataFrame([(1, "the cat", "x", 2)], "doc_id long, text string, lang_pred string, score int")
    r = langid.identify(d, langid.fit(["the cat", "der Hund"], ["en", "de"])).head()
    assert r.lang_pred == "en" and 0 <= r.score <= 1


def test_long_texts_score_as_in_one_part(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc d\n") for _ in range(30_001))
    p = quality.fit(["ab " * 50, "dd\n" * 50], [0, 1], 2)
    t = quality.tables(p)
    whole = quality.score_texts(p, t, pa.array([text]))[0]
    monkeypatch.setattr(quality, "CHUNK_BYTES", 3000)
    assert abs(quality._score_long(p, t, np.frombuffer(text.encode(), np.uint8)) - whole) < 1e-5
    model = langid.fit(["the cat sat", "der Hund"], ["en", "de"])
    table = langid.PieceTable(langid.read_pieces())
    once = langid.predict(model, table, pa.array(["the cat " * 3, "x" * 5000, "der Hund"]))
    parts = common.split_rows

    monkeypatch.setattr(langid, "split_rows", lambda b, o, limit, step: parts(b, o, 40, step))
    again = langid.predict(model, table, pa.array(["the cat " * 3, "x" * 5000, "der Hund"]))
    assert once[0] == again[0] and np.allclose(once[1], again[1])


def test_a_quality_score_does_not_depend_on_neighbours():
    p = quality.fit(["ab " * 50, "dd\n" * 50], [0, 1], 2)
    t = quality.tables(p)
    alone = quality.score_texts(p, t, pa.array(["abcd efgh"]))[0]
    assert quality.score_texts(p, t, pa.array(["xxabcd efgh", "abcd efgh", "abcd efgh"]))[1] == pytest.approx(alone, abs=1e-7)


@pytest.mark.parametrize("text", ["://" * 200_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "token " * 100_000, "x" + " " * 1_000_000 + "y"])
def test_anchor_runs_take_one_pass(text):
    began = time.time()
    pii.find_spans(text)
    assert time.time() - began < 20


def test_long_white_space_is_encoded(spark):
    c = bpe.Coder()
    for text in ("x" + " " * 1_000_000 + "y", "\n" * 50_000, "a" + "　" * 2000 + " b"):
        assert c.decode(c.encode(text)) == text


def test_colliding_digests_are_resolved_in_all_fingerprints(spark, tmp_path, monkeypatch):
    texts = ["aa", "aa", "bb", "a a", None, "bbbb", "aa"]
    spark.createDataFrame([(k if k != 5 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {r.doc_id: r for r in fingerprints.op10_fingerprints(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.lit("same"))
    forced = {r.doc_id: r for r in fingerprints.op10_fingerprints(spark, str(tmp_path)).collect()}
    order = [5, 0, 1, 2, 3, 4, 6]  # the row without doc_id is first
    for rows in (plain, forced):
        r = [rows[None if k == 5 else k] for k in order]
        t = [texts[k] or "" for k in order]
        for i, x in enumerate(r):
            n, after = len(t[i]), t[(i + 1) % len(t)]
            edited = t[i][: n - n // 2] + after[: n // 2]
            assert x.n_chars == n and x.near_edited == float(edited == t[i]) and x.near_next == float(after == t[i])
            assert all((x.fingerprint == y.fingerprint) == (t[i] == u) for y, u in zip(r, t, strict=True))


def test_topk_reads_no_further_than_its_bounds_ask(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(100 if k % 100 == 0 else rng.normal()) for _ in range(4)]) for k in range(2000)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = topk.top_k(v, v.where("vec_id % 500 = 0"), 5).collect()
    assert len(out) == 20 and max(r.read for r in out) < 0.5
    equal = spark.createDataFrame([(k // 10, [1.0, 2.0]) for k in range(200)], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.integer_vectors(equal), topk.integer_vectors(equal).where("vec_id = 3"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0] * 5


def test_no_local_scratch_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_path(Session(), "x")
