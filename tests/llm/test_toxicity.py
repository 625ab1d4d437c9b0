import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm.toxicity import FAIR, IDENTITY, SHRINK, SPARSE, Rows, fit, held_out, op8_counterfactual, score_toxicity, swaps, train, vector, words_of

SF = "/root/testdata/sf0.1"


def data():
    """Rude sentences that mention one group far more often, as labelled data do."""
    r = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        words = list(r.choice(plain, 12))
        if toxic:
            words[r.integers(12)] = str(r.choice(["rotten", "vile", "nasty"]))
        if r.random() < (0.7 if toxic else 0.05):
            words[r.integers(12)] = "muslim"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def weights(fair):
    rows = data()
    words = [words_of(t) for _, t, _ in rows]
    twins = []
    for w in words:
        for other in swaps(w):
            both = {}
            for sign, part in ((1, vector(w)), (-1, vector(other))):
                for i, v in zip(*part):
                    both[int(i)] = both.get(int(i), 0) + sign * float(v)
            twins.append((np.array(list(both), np.int32), np.array(list(both.values()))))
    ids, w, b = fit(Rows.of([vector(x) for x in words]), np.array([t for *_, t in rows], float), Rows.of(twins), fair)
    dense = np.zeros(1 << 20)
    dense[ids] = w
    score = lambda t: 1 / (1 + np.exp(-(b + sum(dense[i] * v for i, v in zip(*vector(words_of(t)))))))
    return score


def test_the_swap_penalty_makes_group_mentions_neutral():
    loose, tight = weights(0.0), weights(5.0)
    neutral, rude = "word1 word2 muslim word3", "word1 vile word3"
    swapped = "word1 word2 hindu word3"
    assert abs(tight(neutral) - tight(swapped)) < 0.1 < loose(neutral) - loose(swapped)
    assert tight(rude) > 0.8 and tight(neutral) < 0.4 < loose(neutral)  # a third of the rows are rude


def test_swaps_stay_within_a_list():
    words = words_of("The Muslim and the women, muslim!")
    for other in swaps(words):
        assert sum(other.values()) == sum(words.values()) and other["muslim"] == 0 and other["women"] == 0
        assert sum(other[w] for w in IDENTITY[3]) == 2
    assert swaps(words_of("none here")) == [] and words_of(None) == Counter()


def test_held_out_accuracy(spark):
    got = op8_counterfactual(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([x.toxic for x in rows]), np.array([x.predicted for x in rows])
    assert (p[y == 1] == 1).mean() > 0.9 and (p[y == 0] == 1).mean() < 0.01
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    assert got.count() == 10_000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data()] + [(None, None, "n"), (5000, "", "n"), (5001, None, None), (3, "again", "r")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in data()] + [(None, 1, 1), (7, 1, None), (0, 0, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == docs.count()
    assert all(x.score is not None for x in got.collect())
    bare = train(docs, labels.filter(F.lit(False)))
    assert {x.score for x in score_toxicity(docs, bare).collect()} == {0.5}
    assert score_toxicity(docs.filter(F.lit(False)), model).count() == 0
    assert train(docs.filter(F.lit(False)), labels).bias == 0
    assert {x.h for x in spark.createDataFrame([(None,)], "d long").select(held_out(F.col("d")).alias("h")).collect()} == {False}


def plain_features(text):
    """Bucket to how often, from the definition: each word, and its beginnings of four to eight letters."""
    out = Counter()
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        for name in [word, *(f"^{word[:n]}" for n in range(4, 9) if len(word) >= n)]:
            out[zlib.crc32(name.encode()) % (1 << 20)] += 1
    return out


def planted(spark, tmp_path):
    """Tables as the query reads them: rude and plain sentences, the rude ones naming one group far more often."""
    rows = data() + [(1000 + i, t, None) for i, t in enumerate(["", None, "word1 " * 30_000 + "vile", "Vile VILE rotten"])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if t is not None], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return rows, docs, labels


def test_scores_equal_a_plain_recomputation(spark, tmp_path):
    """The same objective, minimised by plain steps over a dense matrix, gives the scores that the query returns."""
    rows, docs, labels = planted(spark, tmp_path)
    learn = [(t, y) for i, t, y in rows if y is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    seen = [plain_features(t) for t, _ in learn]
    used = sorted(k for k, n in Counter(k for x in seen for k in x).items() if n >= 4)
    place = {k: i for i, k in enumerate(used)}

    def dense(features):
        out = np.zeros(len(used))
        for k, n in features.items():
            if k in place:
                out[place[k]] = np.log1p(n)
        return out

    x, y = np.array([dense(f) for f in seen]), np.array([y for _, y in learn], float)
    twins = np.array([dense(plain_features(t)) - dense(plain_features(" ".join(o.elements()))) for t, _ in learn for o in swaps(words_of(t))])
    w, b = np.zeros(len(used)), 0.0
    step = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * len(x)) + 2 * np.linalg.norm(twins, 2) ** 2 / len(twins) + 1)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        slope = x.T @ (p - y) / len(x) + SHRINK * w + 2 * FAIR * twins.T @ (twins @ w) / len(twins)
        w = w - step * slope
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE, 0), b - step * (p - y).mean()
    got = {r.doc_id: r for r in op8_counterfactual(spark, str(tmp_path)).collect()}
    want = {i: 1 / (1 + np.exp(-(b + dense(plain_features(t)) @ w))) for i, t, _ in rows}
    apart = np.array([abs(got[i].score - want[i]) for i in want])
    model = train(docs, labels)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))

    def objective(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + SPARSE * np.abs(w).sum() + SHRINK / 2 * w @ w + FAIR * ((twins @ w) ** 2).mean()

    own = objective(np.array([weight.get(k, 0.0) for k in used]), model.bias)
    print(apart.mean(), apart.max(), own, objective(w, b))
    assert set(weight) <= set(used) and own < 1.01 * objective(w, b)  # the fit stops after a number of rounds
    assert len(got) == len(rows) and apart.mean() < 0.02 and apart.max() < 0.15
    for i, t, _ in rows:  # and exactly so from the model's own weights
        raw = model.bias + sum(weight.get(k, 0) * np.log1p(n) for k, n in plain_features(t).items())
        assert abs(got[i].score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_the_penalty_on_held_out_rows(spark, tmp_path):
    """Held-out sentences with their group named otherwise: the score moves far less with the penalty, and accuracy stays."""
    rows, docs, labels = planted(spark, tmp_path)
    out = [(i, t, y) for i, t, y in rows if y is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    named = [(i, t) for i, t, _ in out if "muslim" in t.split()]
    table = spark.createDataFrame([(i, t, t.replace("muslim", "hindu")) for i, t in named], "doc_id long, text string, other string")
    change, right = {}, {}
    for fair in (0.0, FAIR):
        model = train(docs, labels, fair=fair)
        both = score_toxicity(table, model).select("doc_id", F.col("score").alias("a"), F.col("other").alias("text"))
        change[fair] = np.mean([abs(x.a - x.score) for x in score_toxicity(both, model).collect()])
        found = {x.doc_id: x.score for x in score_toxicity(docs, model).collect()}
        right[fair] = np.mean([(found[i] >= 0.5) == bool(y) for i, _, y in out])
    print(change, right)
    assert len(named) > 40 and change[0.0] > 0.05 and change[FAIR] < 0.4 * change[0.0]
    assert right[FAIR] >= right[0.0] - 0.03 and right[FAIR] > 0.9


def test_the_sample_is_bounded_in_features(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in data()], "doc_id long, quality int, toxic int")
    whole, few, one = train(docs, labels), train(docs, labels, features=4000), train(docs, labels, features=1)
    assert whole.taught and few.taught and one.taught and len(one.ids) == 0 and len(few.ids) and few.bias != whole.bias
    assert (train(docs, labels, features=10**7).weights == whole.weights).all()


@pytest.mark.parametrize("n", [0, 1])
def test_fit_on_almost_nothing(n):
    ids, w, b = fit(Rows.of([vector(words_of("a b"))] * n), np.ones(n), Rows.of([]))
    assert len(ids) == 0 and len(w) == 0 and np.isfinite(b)
