"""What learning takes on the driver is given back: later stages share the driver's limit."""

import gc
import random
import re
from pathlib import Path

import pytest

import corpus_pipeline as C
from terrapanel.llm import langid
from terrapanel.llm.common import worker_cache

ROLLUP = Path("/proc/self/smaps_rollup")


def _own_mb():
    gc.collect()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text()))) / 1024


def _docs(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 14)))
    rows = [(i, " ".join(word() for _ in range(150)), ("en", "de")[i % 2], "s", 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.skipif(not ROLLUP.exists(), reason="reads the memory from /proc")
def test_language_stage_gives_the_drivers_memory_back(spark):
    docs = _docs(spark, 800)
    C.language(spark, _docs(spark, 8), "")  # loads the modules
    before = _own_mb()
    C.language(spark, docs, "")
    assert _own_mb() - before < 60
    assert "powers" not in worker_cache()


def test_learned_is_the_fit_of_the_sample(spark):
    docs = _docs(spark, 40)
    got, want = langid.learned(docs), langid.fit(*langid.labelled_sample(docs))
    assert got["langs"] == want["langs"] and (got["probs"] == want["probs"]).all()
