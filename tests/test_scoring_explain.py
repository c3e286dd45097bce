import html as html_module

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.operators import bpe, explain, matrix, models, scoring

DIM, K, V = 6, 3, 12


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    e, w = rng.normal(size=(V, DIM)), rng.normal(size=(K, DIM))
    b = np.array([0.1, -0.2, 0.3])
    seqs = [[1, 2, 3], [0, 0, 5], [7], [4, 4, 4, 11, 0], list(range(12)) * 3]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "doc int, ids array<int>")
    vecs = spark.createDataFrame([(i, e[i].tolist()) for i in range(V)], "token_id int, v array<double>")
    weights = spark.createDataFrame([(i, w[i].tolist(), float(b[i])) for i in range(K)], "class int, w array<double>, b double")
    return e, w, b, seqs, docs, vecs, weights


def logits(e, w, b, seq):
    return w @ np.tanh(e[seq].mean(axis=0)) + b


def test_pool_and_logits(world):
    e, w, b, seqs, docs, vecs, weights = world
    pooled = scoring.mean_pool(docs, "doc", "ids", vecs, DIM)
    for r in pooled.collect():
        np.testing.assert_allclose(r.m, e[seqs[r.doc]].mean(axis=0), atol=1e-12)
    for r in scoring.mean_pool(docs, "doc", "ids", vecs, DIM, skip_pad=True).collect():
        np.testing.assert_allclose(r.m, e[[i for i in seqs[r.doc] if i]].mean(axis=0), atol=1e-12)
    for r in scoring.dan_logit_arrays(pooled, weights).collect():
        np.testing.assert_allclose(r.z, logits(e, w, b, seqs[r.doc]), atol=1e-12)
    long = scoring.dan_logits(pooled, "doc", weights)
    assert long.count() == len(seqs) * K
    got = {r.doc: r.y_pred for r in scoring.predict_argmax_long(long, "doc").collect()}
    assert got == {i: int(np.argmax(logits(e, w, b, s))) for i, s in enumerate(seqs)}


def test_salted_lookup_gives_the_same(world, monkeypatch):
    *_, docs, vecs, _ = world
    wanted = {r.doc: r.m for r in scoring.mean_pool(docs, "doc", "ids", vecs, DIM).collect()}
    monkeypatch.setattr(scoring, "VECTOR_NUMBERS", 3)
    for r in scoring.mean_pool(docs, "doc", "ids", vecs, DIM).collect():
        np.testing.assert_allclose(r.m, wanted[r.doc], atol=1e-12)


def test_argmax_takes_the_lowest_class_on_a_tie(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    assert scoring.predict_argmax(df).first().y_pred == 1
    long = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0), (1, 1, 3.0)], "id int, class int, logit double")
    assert scoring.predict_argmax_long(long, "id").first().y_pred == 1


def test_ordinal_codes(spark):
    rows = scoring.ordinal_encode(spark.range(4).withColumnRenamed("id", "y"), "y", 4).orderBy("y").collect()
    assert [r.encoded for r in rows] == [[1, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 0], [1, 1, 1, 1]]
    z = [([-1.0, 5.0, 5.0],), ([1.0, -1.0, 5.0],), ([1.0, 1.0, 0.0],), ([1.0, 1.0, 1.0],), ([0.0, 0.0, 0.0],)]
    got = [r.y_pred for r in scoring.ordinal_decode(spark.createDataFrame(z, "z array<double>")).collect()]
    assert got == [0, 0, 1, 2, 0]


@pytest.mark.parametrize("weights", [None, [2.0, 1.0, 0.5]])
def test_losses(spark, weights):
    rng = np.random.default_rng(0)
    z, y = rng.normal(scale=3, size=(20, 3)), rng.integers(0, 3, 20)
    df = spark.createDataFrame([(z[i].tolist(), int(y[i])) for i in range(20)], "z array<double>, y int")
    w = np.array(weights or [1.0, 1, 1])[y]
    code = (np.arange(3) <= y[:, None]).astype(float)
    want = (w * ((1 / (1 + np.exp(-z)) - code) ** 2).sum(axis=1)).sum()
    assert scoring.ordinal_loss(df, "z", "y", weights).first()[0] == pytest.approx(want)
    nll = np.log(np.exp(z).sum(axis=1)) - z[np.arange(20), y]
    assert scoring.cross_entropy(df, "z", "y", weights).first()[0] == pytest.approx((w * nll).sum() / w.sum())


def test_scores_sum_to_the_gain_and_equal_quadrature(world):
    e, w, b, seqs, docs, vecs, weights = world
    exact = {(r.doc, r.pos): r.score for r in explain.ig_scores(docs, "doc", "ids", vecs, weights, DIM).collect()}
    numeric = explain.ig_scores_numeric(docs, "doc", "ids", vecs, weights, DIM).collect()
    assert len(numeric) == len(exact) == sum(map(len, seqs))
    for r in numeric:
        assert r.score == pytest.approx(exact[r.doc, r.pos], abs=1e-9)
    for i, seq in enumerate(seqs):
        z = logits(e, w, b, seq)
        total = sum(exact[i, p] for p in range(len(seq))) * DIM
        assert total == pytest.approx(z.max() - b[z.argmax()])
    scored = explain.token_scores(docs, "doc", "ids", vecs, weights, DIM)
    for r in explain.ig_completeness(scored, "doc", weights, DIM).collect():
        assert r.attributed == pytest.approx(r.gain)


def test_named_target_class(world):
    e, w, b, seqs, docs, vecs, weights = world
    named = docs.withColumn("y_pred", F.lit(2))
    scores = explain.ig_scores(named, "doc", "ids", vecs, weights, DIM)
    for r in scores.groupBy("doc").agg((F.sum("score") * DIM).alias("s")).collect():
        assert r.s == pytest.approx(logits(e, w, b, seqs[r.doc])[2] - b[2])


def shade(score, scores, steps=256):
    low, mid, high = min(scores), float(np.median(scores)), max(scores)
    if high == low:
        return "#ffffff"
    place, center = (score - low) / (high - low), (mid - low) / (high - low)
    place = min(int(place * steps), steps - 1) / (steps - 1)
    out = []
    for red, white, green in zip((206, 35, 35), (255, 255, 255), (22, 206, 16)):
        if place in (0, 1):
            out.append(green if place else red)
        elif place <= center:
            out.append(red + (white - red) * place / center)
        else:
            out.append(white + (green - white) * (place - center) / (1 - center))
    return "#" + "".join(f"{round(c):02x}" for c in out)


def test_colors(spark):
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=50).tolist(), 1: [2.0, 2.0, 2.0], 2: [0.0, 0.0, 1.0], 3: [0.0, 1.0, 1.0], 4: [3.5]}
    rows = [(d, p, s) for d, ss in groups.items() for p, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "doc int, pos int, score double")
    for r in explain.score_colors(df, "doc").collect():
        assert r.color == shade(r.score, groups[r.doc])
    low, high = (explain.score_colors(df, "doc", steps=None).where(f"doc = 0").orderBy(o).first().color
                 for o in ("score", F.desc("score")))
    assert (low, high) == ("#ce2323", "#16ce10")


TEXT = 'One <b>&"two"</b>  three. \n'


@pytest.fixture(scope="module")
def marked(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "  "), (3, "solo")], "doc int, text string")
    vocab, merges = bpe.bpe_train(df, "text", 60)
    docs = bpe.encode_text(df, "text", vocab, merges)
    colored = docs.select("doc", F.posexplode("tokens").alias("pos", "token")).withColumn("color", F.lit("#123456"))
    return docs, colored


def strip(text):
    import re

    return re.sub(r"<mark [^>]*>|</mark>", "", text)


def test_full_html_shows_the_whole_text(marked):
    docs, colored = marked
    got = {r.doc: r.html for r in explain.highlight_html(docs, colored, "doc", "text").collect()}
    assert html_module.unescape(strip(got[1])) == TEXT and got[2] == "  "
    assert got[3] == '<mark style="margin: 0; padding: 0; background-color:#123456">solo</mark>'


def test_reference_html_ends_with_the_last_token(marked):
    docs, colored = marked
    got = {r.doc: r.html for r in explain.highlight_html(docs, colored, "doc", "text", mode="reference").collect()}
    assert strip(got[1]) == TEXT.lower().rstrip() and got[2] == ""
    with pytest.raises(ValueError):
        explain.highlight_html(docs, colored, "doc", "text", mode="other")


def corpus_of(spark):
    texts = [("good fine nice day " * (1 + i % 4), 3) if i % 2 else ("bad poor sad time " * (1 + i % 4), 1) for i in range(60)]
    texts = texts + [("so so plain thing " * (1 + i % 3), 2) for i in range(30)]
    return spark.createDataFrame([(i, t, s, "c") for i, (t, s) in enumerate(texts)], "id int, text string, score int, cat string")


def test_fits_learn_separable_classes(spark):
    df = corpus_of(spark)
    vocab, merges = bpe.bpe_train(df, "text", 60)
    rows = bpe.encode_text(df, "text", vocab, merges, offsets=False).withColumn("y", F.col("score") - 1.0)
    rows = rows.withColumn("weight", F.lit(1.0))
    size = vocab.count()
    plain = models.fit_classifier(rows, "ids", "y", size, weight="weight", reg=0.001)
    got = models.predict_classifier(rows, plain, "ids", size)
    assert got.where("y = y_pred").count() / got.count() > 0.95
    steps = models.fit_ordinal(rows, "ids", "y", size, 3)
    got = models.predict_ordinal(rows, steps, "ids", size)
    assert got.where("y = y_pred").count() / got.count() > 0.95
    assert {len(r.z) for r in got.collect()} == {3}
    assert "_prediction" in models.score_batches(
        models._features(rows, "ids", size)[0], plain
    ).columns


def test_explain_sample(spark, world):
    *_, weights = world
    df = corpus_of(spark)
    vocab, merges = bpe.bpe_train(df, "text", 40)
    rng = np.random.default_rng(0)
    vecs = spark.createDataFrame([(i, rng.normal(size=DIM).tolist()) for i in range(vocab.count())], "token_id int, v array<double>")
    corpus = Corpus(df, "id", "text", "score", "cat")
    got = explain.explain_sample(corpus, vocab, merges, vecs, weights, DIM, n=4, length=[1, 40], score=[1, 2])
    rows = got.collect()
    assert len(rows) == 4 and all(r.actual in (1, 2) and 1 <= r.pred <= K and "<mark" in r.html for r in rows)


@pytest.mark.parametrize("steps", [None, 50])
def test_scores_by_pairs_and_in_place_are_the_same(world, monkeypatch, steps):
    *_, docs, vecs, weights = world
    for frame in (docs, docs.withColumn("y_pred", F.lit(1))):
        inside = {r.doc: r for r in explain.token_scores(frame, "doc", "ids", vecs, weights, DIM, steps).collect()}
        with monkeypatch.context() as m:
            m.setattr(scoring, "VECTOR_NUMBERS", 3)
            m.setattr(matrix, "TOKENS_AT_ONCE", 2)
            for r in explain.token_scores(frame, "doc", "ids", vecs, weights, DIM, steps).collect():
                np.testing.assert_allclose(r.scores, inside[r.doc].scores, atol=1e-12)
                assert r.y_pred == inside[r.doc].y_pred


def test_explanations_take_no_shuffle(world):
    *_, docs, vecs, weights = world
    colored = explain.color_lists(explain.token_scores(docs, "doc", "ids", vecs, weights, DIM))
    assert "Exchange" not in colored._jdf.queryExecution().executedPlan().toString()


def test_rows_without_tokens_and_tokens_without_vectors(spark, world):
    *_, vecs, weights = world
    frame = spark.createDataFrame([(1, []), (2, None), (3, [1])], "doc int, ids array<int>")
    got = {r.doc: r.scores for r in explain.token_scores(frame, "doc", "ids", vecs, weights, DIM).collect()}
    assert got[1] == [] and not got[2] and len(got[3]) == 1
    with pytest.raises(Exception, match="no vector for token id 77"):
        explain.token_scores(spark.createDataFrame([(1, [1, 77])], "doc int, ids array<int>"), "doc", "ids", vecs, weights, DIM).collect()


def test_a_colour_that_is_missing_moves_no_other(marked):
    docs, colored = marked
    whole = {r.doc: r.html for r in explain.highlight_html(docs, colored, "doc", "text").collect()}
    some = {r.doc: r.html for r in explain.highlight_html(docs, colored.where("pos <> 1"), "doc", "text").collect()}
    assert strip(some[1]) == strip(whole[1]) and some[1].count("<mark") == whole[1].count("<mark") - 1


def test_frequent_tokens_have_copies_by_their_share(spark, monkeypatch):
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 4 if i % 3 == 1 else 10 + i) for i in range(9000)]
    tokens = spark.createDataFrame(rows, "pos int, token_id int")
    pieces = 4 * scoring.parallelism(spark)
    copies = {r.token_id: r._copies for r in scoring.copies_of_frequent(tokens).collect()}
    assert set(copies) == {0, 1, 2, 3, 4} and copies[0] == -(-pieces // 3)
    monkeypatch.setattr(scoring, "VECTOR_NUMBERS", 3)
    vecs = spark.createDataFrame([(t, [float(t), 1.0]) for t in {r[1] for r in rows}], "token_id int, v array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scoring.embed_tokens(tokens, vecs)
        assert {(r.pos, r.token_id) for r in found.where("v[0] = token_id").collect()} == set(rows) and found.count() == 9000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="no vector for token id"):
        scoring.embed_tokens(tokens, vecs.where("token_id <> 3")).collect()


def two_layers(rng):
    """A network with attention over tokens and a hidden layer; the gradient by hand, checked against differences below."""
    a, u, v = rng.normal(size=DIM), rng.normal(size=(5, DIM)), rng.normal(size=(K, 5))

    def network(x, mask, target):
        weight = np.where(mask, np.exp(np.tanh(x @ a)), 0.0)
        share = weight / weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("ij,ijk->ik", share, x)
        hidden = np.tanh(pooled @ u.T)
        z = hidden @ v.T
        if target is None:
            return z, None
        back = ((1 - hidden ** 2) * v[target]) @ u
        each = np.einsum("ik,ijk->ij", back, x)
        by_score = share * (each - (share * each).sum(axis=1, keepdims=True)) * (1 - np.tanh(x @ a) ** 2)
        return z, share[:, :, None] * back[:, None, :] + by_score[:, :, None] * a

    return network


def test_scores_of_a_callers_network(world, spark, monkeypatch):
    from textscore.plans.scoring import mean_pool_network

    e, w, b, seqs, docs, vecs, weights = world
    exact = {(r.doc, r.pos): r.score for r in explain.ig_scores(docs, "doc", "ids", vecs, weights, DIM).collect()}
    for bound in (explain.PADDED_NUMBERS, 1, 60):
        monkeypatch.setattr(explain, "PADDED_NUMBERS", bound)
        scored = explain.network_scores(docs, "ids", vecs, mean_pool_network(w, b), DIM)
        got = {(r.doc, r.pos): r.score for r in explain.explode_scores(scored, "doc", "ids").collect()}
        assert got.keys() == exact.keys()
        for place, score in got.items():
            assert score == pytest.approx(exact[place], abs=1e-9)

    rng = np.random.default_rng(11)
    network = two_layers(rng)
    x, mask = rng.normal(size=(2, 4, DIM)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    target, step = np.array([0, 2]), 1e-6
    slope = network(x, mask, target)[1]
    for place in [(0, 0, 0), (0, 3, 2), (1, 1, 5), (1, 2, 1)]:
        up, down = x.copy(), x.copy()
        up[place] += step
        down[place] -= step
        change = (network(up, mask, None)[0] - network(down, mask, None)[0])[place[0], target[place[0]]] / (2 * step)
        assert slope[place] == pytest.approx(change, abs=1e-6)
    scored = explain.network_scores(docs, "ids", vecs, network, DIM)
    rows = explain.network_completeness(scored, "doc", DIM).collect()
    assert len(rows) == len(seqs)
    for r in rows:
        assert r.attributed == pytest.approx(r.gain, abs=1e-6)


def test_callers_network_without_tokens_and_with_named_classes(world, spark):
    from textscore.plans.scoring import mean_pool_network

    e, w, b, _, _, vecs, _ = world
    docs = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None), (3, [5])], "doc int, ids array<int>")
    network = mean_pool_network(w, b)
    rows = {r.doc: r for r in explain.network_scores(docs, "ids", vecs, network, DIM).collect()}
    assert [len(rows[i].scores) for i in range(4)] == [2, 0, 0, 1]
    assert rows[1].z is None and rows[2].y_pred is None
    named = explain.network_scores(docs.withColumn("y_pred", F.lit(2)), "ids", vecs, network, DIM)
    for r in explain.network_completeness(named, "doc", DIM).collect():
        assert r.attributed == pytest.approx(logits(e, w, b, {0: [1, 2], 3: [5]}[r.doc])[2] - b[2])
    with pytest.raises(Exception, match="gradient has shape"):
        explain.network_scores(docs, "ids", vecs, lambda x, m, t: (np.zeros((len(x), K)), np.zeros((len(x), DIM))), DIM).collect()
    assert explain.network_scores(docs.limit(0), "ids", vecs, network, DIM).collect() == []
