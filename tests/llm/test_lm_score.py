import random
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm import lm_score
from tests.llm.helpers import EDGES, table


def test_scores(spark):
    docs = table(spark, EDGES, clash=True)
    found = sorted(lm_score.scored(docs).collect(), key=str)
    assert len(found) == len(EDGES)
    counts = sorted((str(r.doc_id), r.n_tokens) for r in found)
    assert counts == sorted((str(i), len((t or "").encode().split())) for i, t, *_ in EDGES)
    for row in found:
        assert (row.mean_log_prob is None) == (row.n_tokens == 0)
        assert row.log_prob <= 0
    same = [r.log_prob for r in found if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_text_of_the_corpus_scores_above_shuffled_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm_score.trained(docs)
    rng = np.random.default_rng(0)
    texts = [r[0] for r in docs.where("lang = 'en' AND length(text) > 2000").select("text").limit(40).collect()]
    own, mixed = [], []
    words = [w for t in texts for w in lm_score.words(t.encode())]
    for t in texts:
        n = len(lm_score.words(t.encode()))
        own.append([model.numbering[w] for w in lm_score.words(t.encode())])
        mixed.append([int(x) for x in rng.integers(0, lm_score.NUMBERS, n)])
    assert words
    assert model.score(own).sum() > model.score(mixed).sum()


def test_nothing_to_learn(spark):
    assert lm_score.scored(table(spark, [])).collect() == []
    (row,) = lm_score.scored(table(spark, [(1, " ")])).collect()
    assert tuple(row) == (1, 0, 0.0, None)


def test_gradients():
    rng = np.random.default_rng(1)
    network = lm_score.Window(np.full(lm_score.NUMBERS, 1 / lm_score.NUMBERS))
    network.weights = [w.astype(float) for w in network.weights]
    context = rng.integers(0, lm_score.NUMBERS + 1, (9, 2 * lm_score.REACH))
    target = rng.integers(0, lm_score.NUMBERS, 9)
    for w, g in zip(network.weights, network.gradients(context, target), strict=True):
        spot = np.unravel_index(np.abs(g).argmax(), w.shape)
        w[spot] += 1e-5
        up = -network.log_chance(context, target).mean()
        w[spot] -= 2e-5
        down = -network.log_chance(context, target).mean()
        w[spot] += 1e-5
        assert abs(g[spot] - (up - down) / 2e-5) < 1e-6


def test_chances_sum_to_one():
    network = lm_score.Window(np.full(lm_score.NUMBERS, 1 / lm_score.NUMBERS))
    every = np.arange(lm_score.NUMBERS)
    context = np.zeros((lm_score.NUMBERS, 2 * lm_score.REACH), int) + 7
    assert abs(np.exp(network.log_chance(context, every)).sum() - 1) < 1e-4


def test_a_word_takes_its_share_of_the_bucket(spark):
    common = " ".join(f"c{k}" for k in range(lm_score.FIRST_BUCKET))
    rows = [(k, common) for k in range(9)] + [(20 + k, f"c0 {w} c1") for k, w in enumerate(["rare"] * 6 + ["once", "other"])]
    model = lm_score.trained(table(spark, rows))
    bucket = model.numbering[b"rare"]
    assert bucket >= lm_score.FIRST_BUCKET and model.totals[bucket - lm_score.FIRST_BUCKET] >= 6
    strange = next(w for k in range(100_000) if model.numbering[(w := f"x{k}").encode()] == bucket)
    asked = table(spark, [(1, "c0 rare c1"), (2, f"c0 {strange} c1"), (3, "c0 c2 c1"), (4, f"{strange} {strange} rare")])
    found = {r.doc_id: r for r in lm_score.scored(asked, model).collect()}
    assert abs(found[1].log_prob - found[2].log_prob - np.log(6)) < 1e-4
    own = [[model.numbering[w] for w in lm_score.words(t.encode())] for t in ("c0 rare c1", "c0 c2 c1", f"{strange} {strange} rare")]
    base, total = model.score(own), model.totals[bucket - lm_score.FIRST_BUCKET] + 1
    assert abs(found[1].log_prob - base[0] - np.log(6 / total)) < 1e-4
    assert abs(found[3].log_prob - base[1]) < 1e-4
    assert abs(found[4].log_prob - base[2] - np.log(6 / total**3)) < 1e-4


def test_every_position_is_a_target_once():
    class Noting(lm_score.Window):
        def gradients(self, context, target):
            met.extend(target.tolist())
            assert len(target) <= lm_score.BATCH
            return super().gradients(context, target)

    met = []
    network = Noting(np.full(lm_score.NUMBERS, 1 / lm_score.NUMBERS))
    texts = [[5], [6, 7], [], list(range(1000)), [8] * 3]
    seen = lm_score._train(network, [([0] * 5, texts, [None] * 5), ([0], [[9]], [None]), ([0], [[]], [None])], 0)
    assert sorted(met) == sorted([*sum(texts, []), 9])
    assert seen == len(met)


def test_scores_do_not_depend_on_the_split_of_the_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for parts in (2, 7):
        split = docs.repartition(parts)
        found.append({(r.doc_id): r.log_prob for r in lm_score.scored(split).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(abs(x - found[1][i]) <= 1e-4 * (1 + abs(x)) for i, x in found[0].items())


def test_scores_equal_a_plain_sum_over_the_tokens(spark):
    rows = [(k, " ".join(f"w{(k * j) % 41}" for j in range(k % 17))) for k in range(200)] + [(900, "w1 unheard w2 w3")]
    docs = table(spark, rows[:-1])
    model = lm_score.trained(docs)
    w = [x.astype(float) for x in model.network.weights]
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def plain(text):
        own, total = lm_score.words(text.encode()), 0.0
        numbers = [lm_score.NUMBERS] * lm_score.REACH + [model.numbering[x] for x in own] + [lm_score.NUMBERS] * lm_score.REACH
        for k, word in enumerate(own):
            at = k + lm_score.REACH
            sides = numbers[at - lm_score.REACH : at] + numbers[at + 1 : at + 1 + lm_score.REACH]
            hidden = np.tanh(np.concatenate([w[0][n] for n in sides]) @ w[1] + w[2])
            cls, inside = divmod(numbers[at], lm_score.SIDE)
            total += np.log(softmax(hidden @ w[3] + w[4])[cls] * softmax(hidden @ w[5][cls] + w[6][cls])[inside])
            if word not in model.numbering.own:
                bucket = numbers[at] - lm_score.FIRST_BUCKET
                total += np.log(counts.get(word, 1) / (model.totals[bucket] + 1))
        return total

    for r in lm_score.scored(table(spark, rows), model).collect():
        assert abs(r.log_prob - plain(dict(rows)[r.doc_id])) < 1e-3


def test_words_that_occur_once_are_not_joined(spark, monkeypatch):
    rows = [(k, f"often w{k % 7} w{k % 11} once{k}") for k in range(60)] + [(None, "often w1"), (5, "w2 once5x"), (7, None)]
    rows += [(100 + k, " ".join(f"c{j}" for j in range(lm_score.FIRST_BUCKET))) for k in range(20)]
    docs = table(spark, rows)
    told = sorted(map(tuple, lm_score.scored(docs).collect()), key=str)
    monkeypatch.setattr(lm_score, "COMMON", 1)  # no word is common
    model = lm_score.trained(docs)
    assert not model.common
    joined = sorted(map(tuple, lm_score.scored(docs, model).collect()), key=str)
    assert [r[:2] for r in joined] == [r[:2] for r in told]
    assert np.allclose([r[2] for r in joined], [r[2] for r in told], atol=1e-5)
    shares = model.shares(spark.createDataFrame([(1, b"once1", 1)], "key long, word binary, c long"))
    assert "> 1)" in shares._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_scored_in_small_steps(monkeypatch):
    network = lm_score.Window(np.full(lm_score.NUMBERS, 1 / lm_score.NUMBERS))
    texts = [[k % lm_score.NUMBERS for k in range(n)] for n in (20_000, 0, 3, 9_000)]
    sizes, hidden = [], network._hidden
    tokens, places, _ = lm_score.padded(texts)
    one = hidden(tokens[places[:, None] + lm_score._SIDES])[1]
    monkeypatch.setattr(network, "_hidden", lambda context: sizes.append(len(context)) or hidden(context))
    total = lm_score.Scorer(None, network).score(texts)
    assert max(sizes) < 2 * lm_score.STEP and sum(sizes) == len(one) == 29_003
    monkeypatch.setattr(lm_score, "STEP", 10**9)
    assert np.allclose(lm_score.Scorer(None, network).score(texts), total, rtol=1e-7)
    assert sizes[-1] == 29_003


def test_texts_are_cut_by_columns_as_one_by_one(monkeypatch):
    rng = random.Random(3)
    signs = [*b" \t\n\r\x0b\x0c\x00\x1c\x85\xa0\xffAzQ", "É".encode(), "\u3000".encode()]
    signs = [bytes([c]) if isinstance(c, int) else c for c in signs]
    texts = [b"".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(3000)] + [None, b"", b" ", b"\n\n"]
    wanted = [lm_score.words(t) for t in texts]
    monkeypatch.setattr(lm_score, "PIECE", 2000)
    monkeypatch.setattr(lm_score, "RUN", 700)
    numbering = lm_score.Numbering([b"a", b"z", b"q"])
    shares = {b"a": 0, b"az": -5, b"qq": -7}
    known = lm_score.Known(numbering, shares)
    whole = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, pa.binary())], ["i", "t"])
    assert sum(p.num_rows for p in lm_score._pieces(whole, 1)) == len(texts)
    # Slices begin inside their buffers, and one is empty.
    parts = [whole.slice(0, 1001), whole.slice(1001, 0), whole.slice(1001, 1), whole.slice(1002)]
    monkeypatch.setattr(lm_score, "words", None)  # no text is cut on its own
    met = 0
    for ids, found, told, rare in lm_score._runs(parts, known, True):
        table = pa.Table.from_batches(rare).to_pylist()
        for i, numbers, share, others in zip(ids, found, told, table, strict=True):
            own = wanted[i or 0]
            assert numbers.tolist() == [numbering[w] for w in own]
            assert share == sum(shares.get(w, 0) for w in own)
            left = Counter(w for w in own if w not in shares and w not in numbering.own)
            assert dict(zip(others["words"], others["counts"], strict=True)) == left
            met += 1
    assert met == len(texts)


def test_words_are_counted_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 30)
    rows = [(k, t) for k, t in enumerate(["A a\tb ", None, "", "  ", "b é É c" * 9, "a"] * 3)]
    found = {bytes(r.word): r.n for r in lm_score.word_counts(table(spark, rows)).collect()}
    assert found == Counter(w for _, t in rows for w in lm_score.words((t or "").encode()))
