import zlib

import numpy as np
import pytest

from ledgerline.llm import language
from tests.llm.helpers import EDGES, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    return language.learned(spark.read.parquet(f"{SF}/documents.parquet"), 150)


def test_held_out_accuracy(spark, network):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.labelled(docs, network).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.count() == docs.count()
    out = found.where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark, network):
    found = {r.doc_id: r for r in language.labelled(table(spark, EDGES, clash=True), network).collect()}
    assert len(found) == len({r[0] for r in EDGES})
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert found[1].score == 0
    assert not found[None].held_out


def test_without_labels(spark):
    assert language.labelled(table(spark, [])).collect() == []
    (row,) = language.labelled(table(spark, [(3, "some text", None)])).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_every_position_has_a_label(network):
    text = ("the and of " * 40).encode()
    places = language.Labeller(network).positions(text)
    assert len(places) == len(text)
    assert set(places) <= set(network.languages)


def test_gradients():
    network = language.Network(["a", "b", "c"], hidden=5)
    for layer in (network.right, network.left):
        layer.given, layer.carried = layer.given.astype(float), layer.carried.astype(float)
    data, live = language.lanes([b"hello", b"a", b"world!"], 6)
    wanted = np.array([0, 1, 2])

    def loss():
        chance = network.positions(data, live)
        return -(np.log(chance[:, np.arange(3), wanted]) * live).sum() / live.sum()

    for w, g in zip(network.weights(), network.gradients(data, live, wanted), strict=True):
        spot = np.unravel_index(np.abs(g).argmax(), w.shape)
        w[spot] += 1e-2
        up = loss()
        w[spot] -= 2e-2
        down = loss()
        w[spot] += 1e-2
        assert g[spot] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_pooled_score_equals_a_plain_walk_over_the_bytes(network):
    """One byte after the other in plain numbers, window by window."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = language.HIDDEN

    def states(layer, data):
        state, out = np.zeros(hidden), []
        for b in data:
            given, carried = layer.given[b].astype(float), state @ layer.carried.astype(float)
            hold, let = (sigmoid(given[k * hidden : (k + 1) * hidden] + carried[k * hidden : (k + 1) * hidden]) for k in (0, 1))
            new = np.tanh(given[2 * hidden :] + let * carried[2 * hidden :])
            state = hold * state + (1 - hold) * new
            out.append(state)
        return np.array(out)

    texts = ["Der kleine Hund läuft.", "the quick brown fox " * 20, "x", "Él no está aquí " * 9]
    for text, pooled in zip(texts, language.Labeller(network).pool([t.encode() for t in texts]), strict=True):
        data, total = text.encode(), np.zeros(len(network.languages))
        for k in range(0, len(data), language.WINDOW):
            window = data[k : k + language.WINDOW]
            both = np.hstack([states(network.right, window), states(network.left, window[::-1])[::-1]])
            logits = both @ network.out + network.bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += (chance / chance.sum(axis=1, keepdims=True)).sum(axis=0)
        assert pooled == pytest.approx(total / len(data), abs=1e-4)


def test_recognised_rejects_noise_and_keeps_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(8)
    junk = [(10**6 + k, "".join(map(chr, rng.integers(33, 127, 300 + k)))) for k in range(40)]
    fine = [(2 * 10**6 + k, t) for k, t in enumerate(["Von.", "the", "of the", "El la", "x", "Et de les"])]
    none = [(3 * 10**6, None), (3 * 10**6 + 1, ""), (3 * 10**6 + 2, "12 34 !!")]
    all_ = docs.union(table(spark, [*junk, *fine, *none], clash=False).select(docs.columns))
    kept = {r.doc_id for r in language.recognised(all_).select("doc_id").collect()}
    assert not kept & {i for i, _ in junk + none}
    assert {i for i, _ in fine} <= kept
    lettered = docs.where("text RLIKE '[a-zA-Z]'").count()
    assert len(kept) - len(fine) >= 0.999 * lettered


def test_recognised_without_labels_rejects_texts_without_a_letter_only(spark):
    docs = [(i, t) for i, t, *_ in EDGES] + [(50, "%$ x9 &&& " * 40)]
    kept = language.recognised(table(spark, docs, clash=True))
    assert len(kept.columns) > 5
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [4, 5, 5, None, 7, 8, 10, 50]))
    assert language.recognised(table(spark, [])).isEmpty()


def test_every_language_is_learned(spark):
    docs = table(spark, [(k, f"word{k} " * 5, f"l{k % 230:03}") for k in range(1400)])
    network = language.learned(docs, sample_docs=3)
    assert len(network.languages) == 230
