import numpy as np
import pytest

from tessera.llm import common, language_id, quality_classifier, source_mixing
from tessera.llm.language_id import WINDOW, ByteCnn, identify, posteriors, windows_of
from tessera.llm.quality_classifier import features, pieces, quality_scores, scores


def test_features_by_hand():
    bucket, owner = features(["ab c", "", "ab"])
    # "ab": <ab, ab>, <ab> and the word; "c": <c> and the word
    assert np.bincount(owner, minlength=3).tolist() == [6, 0, 4]
    assert set(bucket[owner == 2]) <= set(bucket[owner == 0])
    assert len(features([])[0]) == 0


def test_pieces_add_up():
    text = "word " * 250_000 + "x" * 600_000
    assert "".join(pieces(text)) == text and max(map(len, pieces(text))) <= 500_000
    w = np.arange(1 << 18) % 7 - 3.0
    assert 0 <= scores([text], w, 0.0)[0] <= 1


def test_tables_equal_network():
    model, rng = ByteCnn(["a", "b"]), np.random.default_rng(0)
    x = rng.integers(0, 256, (40, WINDOW)).astype(np.uint8)
    y = (x[:, 0] > 128).astype(np.int64)
    model.fit(x, y, epochs=2)
    p = model.p
    pooled = []
    for w in (2, 3, 4):
        z = np.stack([p["e"][x[:, t : t + w]].reshape(len(x), -1) @ p[f"w{w}"] + p[f"b{w}"] for t in range(WINDOW - w + 1)], 1)
        pooled.append(z.max(1))
    z = np.maximum(np.concatenate(pooled, 1), 0) @ p["u"] + p["c"]
    want = np.exp(z - z.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(posteriors(x, model.tables()), want, atol=1e-4)
    assert [len(windows_of(b"x" * n)[0]) for n in (0, 1, WINDOW, WINDOW + 1)] == [1, 1, 1, 2]


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.lang_pred, r.score) for r in identify(docs).collect()] == [("und", 0.0)] * len(rows)
    assert [(r.score, r.predicted) for r in quality_scores(docs, labels).collect()] == [(0.5, 1)] * len(rows)


def test_held_out_accuracy(spark, sf):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    seen = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    held = [r for r in labels.collect() if seen[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([seen[r.doc_id].predicted == r.quality for r in held]) > 0.85


def test_edges(spark):
    rows = [(k, "the quick brown fox " * 5, "en") for k in range(40)] + [(100 + k, "le renard brun est là " * 5, "fr") for k in range(40)]
    rows += [(500, "", "en"), (501, None, "fr"), (502, "123 !!", "en"), (503, "x", None), (503, "x", None), (None, "the fox", "en"), (504, "½ ² Ⅷ ① _", "en"), (505, "1é", "fr"), (506, "le renard " * 300_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert [got[i].lang_pred for i in (500, 501, 502, 504)] == ["und"] * 4 and {got[i].lang_pred for i in (503, 505)} <= {"en", "fr"} and got[506].lang_pred == "fr"
    assert identify(docs).count() == len(rows)
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(140)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    seen = quality_scores(docs, labels).collect()
    assert len(seen) == len(rows) and all(0 <= r.score <= 1 for r in seen)


def test_draws_are_bounded(spark, monkeypatch):
    """One id has 100,000 rows, alike and unlike: what the models learn from stays what the parameters say."""
    hot = spark.range(100_000).selectExpr("7L AS doc_id", "concat('the text of row ', id % 90000, ' with words in it') AS text", "'en' AS lang", "'en/1' AS domain")
    rest = spark.range(3000).selectExpr("id + 100 AS doc_id", "concat(if(id % 2 = 0, 'the rain of ', 'le renard brun '), id) AS text", "if(id % 2 = 0, 'en', 'fr') AS lang", "if(id % 2 = 0, 'en/1', 'fr/0') AS domain")
    docs, seen = hot.unionByName(rest), []
    original = language_id.ByteCnn.fit
    monkeypatch.setattr(language_id.ByteCnn, "fit", lambda self, x, y, **k: seen.append(len(x)) or original(self, x[:50], y[:50], epochs=1))
    for low in (True, False):  # the hot id is drawn, or not
        one = docs if low else docs.where("doc_id <> 7")
        _, classes = language_id.train(one, max_docs=100, per_doc=4)
        assert classes == ["en", "fr"] and 0 < seen.pop() <= 2 * 2 * 100 * 4
    labels = docs.select("doc_id", (docs["doc_id"] % 2).cast("int").alias("quality")).distinct()
    fit = quality_classifier.Classifier.fit
    monkeypatch.setattr(quality_classifier.Classifier, "fit", lambda self, bags, y: seen.append(len(bags)) or fit(self, bags[:20] + bags[-20:], y[:20] + y[-20:]))
    quality_classifier.train(docs, labels, max_per_label=50)
    assert seen.pop() == 100
    one = common.drawn(docs.select("doc_id", "text", "domain"), "domain", 200, docs["doc_id"]).groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in one} == {"en/1": 200, "fr/0": 200}
    w, domains = source_mixing.train(docs, docs.select("doc_id", "domain"), max_docs=60, epochs=1)
    assert domains == ["en/1", "fr/0"] and w.shape[1] == 2
