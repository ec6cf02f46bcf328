"""Language identification: gradients, edge cases, held-out accuracy."""
import numpy as np
import pytest

from lanewise.llm import byte_gru

WORDS = {"en": "the and with thing other reading house where which water".split(), "de": "und der nicht über schön straße zwischen häuser welche wasser".split(),
         "fr": "les être pour château élève très quelle rivière où français".split()}


@pytest.fixture(scope="module")
def model():
    return byte_gru.fit([(w, k, 1 + i) for k, ws in WORDS.items() for i, w in enumerate(ws)], steps=250, batch=64)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    w = {"x": rng.standard_normal((256, 9)), "h": rng.standard_normal((3, 9)), "b": rng.standard_normal(3)}
    x, _, mask = byte_gru.padded([b"abc", b"a", b"bbbb"])
    weight = rng.standard_normal((3, 4, 3))
    value = lambda: float((byte_gru.run(w, x, mask)[0] * weight).sum())
    _, tape = byte_gru.run({k: v.astype(float) for k, v in w.items()}, x, mask, True)
    grads = byte_gru.back(w, tape, weight)
    for name, at in (("h", (1, 4)), ("h", (2, 8)), ("h", (0, 1)), ("b", (1,)), ("x", (97, 2)), ("x", (98, 5)), ("x", (99, 7))):
        old = w[name][at]
        w[name][at] = old + 1e-4
        up = value()
        w[name][at] = old - 1e-4
        down = value()
        w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-3)


def test_backward_states_stand_at_their_bytes():
    _, y, mask = byte_gru.padded([b"ab", b"xyz"])
    states = np.arange(6.0).reshape(2, 3, 1)
    assert byte_gru.turn(states, mask)[0, :2, 0].tolist() == [1, 0] and byte_gru.turn(states, mask)[1, :, 0].tolist() == [5, 4, 3]


def test_predictions_and_edges(documents, model):
    docs = documents((1, None), (2, ""), (3, "123 ... ²"), (4, "the house with water"), (5, "die Straße zwischen Häuser und der"), (6, "le château où les élèves être"),
                     (4, "the house with water"), (7, "the " * 50_000), (8, "x" * 300_000), (None, "the thing")).withColumnRenamed("source", "score")
    got = {}
    for r in byte_gru.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert [got[i][0] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0][0] for i in (4, 5, 6, 7, None)] == ["en", "de", "fr", "en", "en"]
    assert len(got[4]) == 2 and len(set(got[4])) == 1 and all(0 <= s <= 1 for v in got.values() for _, s in v)


def test_long_text_equals_its_parts(model):
    lab = byte_gru.Labeller(model)
    assert lab.pooled(["the house"]) == lab.pooled(["the house " * 1000]) or abs(lab.pooled(["the house"])[0][1] - lab.pooled(["the house " * 1000])[0][1]) < 1e-9


def test_without_training_rows(documents):
    assert byte_gru.fit([]).languages == []
    docs = documents((1, "text", None))
    assert byte_gru.training_words(docs) == []
    assert byte_gru.predict(docs, byte_gru.fit([])).collect()[0].lang_pred == "und"


def test_held_out_accuracy(spark):
    from lanewise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_byte_gru"](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
