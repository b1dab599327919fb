"""The byte network: gradients, held-out accuracy, windows and odd rows."""

import zlib

import numpy as np
import pytest

from spanwise.llm import language
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"


def test_gradients_are_those_of_the_loss():
    model, rng = language.ByteTagger(3, 4), np.random.default_rng(0)
    data, mask, target = rng.integers(0, 256, (6, 5)), np.ones((6, 5), np.float32), rng.integers(0, 3, 5)
    mask[4:, 2] = 0
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, gradient = model.step(data, mask, target)
    for k, w in model.w.items():
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in w.shape)
            if k[0] == "x":
                i = (data[0, 0], i[1])
            w[i] += 1e-4
            above = model.step(data, mask, target)[0]
            w[i] -= 2e-4
            below = model.step(data, mask, target)[0]
            w[i] += 1e-4
            assert abs((above - below) / 2e-4 - gradient[k][i]) < 1e-3


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op3_language"](spark, sf_dir).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.95


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ("the house and the river " if i % 2 else "das haus und der fluss ") * 8, ["de", "en"][i % 2]) for i in range(80)]
    rows += [(90, None, "en"), (91, "123", "xx"), (92, "unlabelled", None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)


def test_only_labels_with_letters_are_learned(model):
    assert model[1] == ["de", "en"]


def test_odd_rows(spark, model):
    long = "das haus und der fluss " * 30_000
    rows = [(1, None, None, 1, ""), (2, "", "en", 1, ""), (3, "12 +- 3\n", "en", 1, ""), (4, "the river", "de", 1, ""),
            (4, "the river", "de", 1, ""), (None, long, None, None, None)]
    found = sorted(language.predict(spark.createDataFrame(rows, SCHEMA), *model).collect(), key=str)
    by = {r.doc_id: r for r in found}
    assert len(found) == 6
    assert {by[i].lang_pred for i in (1, 2, 3)} == {"und"} and by[1].score == 0
    assert by[4].lang_pred == "en" and by[None].lang_pred == "de" and by[None].score > 0.5
    assert language.predict(spark.createDataFrame([], SCHEMA), *model).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model, names = language.fit(docs)
    assert names == [] and language.predict(docs, model, names).first().lang_pred == "und"


def test_a_text_is_pooled_over_all_its_windows():
    model = language.ByteTagger(2)
    data = bytes(range(32, 127)) * 40
    windows, mask = language.cut_windows(data, 128)
    assert windows.shape == (30, 128) and mask.sum() == len(data)
    p = model.log_probabilities(np.ascontiguousarray(windows.T))
    alone = model.log_probabilities(np.ascontiguousarray(windows[3:4].T))
    assert np.allclose(p[:, :, 3], alone[:, :, 0], atol=1e-5)
