import math
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import toxicity
from veilspark.llm.toxicity import CUT, FILTERS, FUNCTION_WORDS, WIDTHS, Scorer, features, language, score_toxicity, train, training_rows

BAD = {"en": "awful1 awful2 awful3", "de": "stem", "fr": "laid1 laid2", "es": "feo1 feo2"}


def corpus(n, seed):
    """(id, text, lang, toxic): toxic texts hold a bad word, in one language by its stem only."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(FUNCTION_WORDS))
        words = [rng.choice(FUNCTION_WORDS[lang].split()) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            bad = rng.choice(BAD[lang].split())
            words.insert(rng.randrange(len(words)), bad + ("" if lang != "de" else "".join(rng.choice("xyz") for _ in range(4))))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(1500, 2) + [(5001, None, "en", None), (5002, "", "de", None), (None, "the of", None, None), (5003, "the " * 60_000 + "awful1 awful2", "en", None)]
    docs = spark.createDataFrame([(i, t, g, "x", "y") for i, t, g, _ in rows], "doc_id long, text string, lang string, score string, held_out string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, _, x in rows if x is not None] + [(None, 0, 1), (7777, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return rows, {r.doc_id: r for r in score_toxicity(docs, labels).collect()}, docs, labels


def test_held_out_accuracy_in_every_language(scored):
    rows, found, *_ = scored
    for lang in FUNCTION_WORDS:
        held = [(x, found[i]) for i, _, g, x in rows if g == lang and x is not None and found[i].held_out]
        assert sum(x == r.predicted for x, r in held) / len(held) > 0.93, lang


def test_rows_and_folds(scored):
    rows, found, *_ = scored
    assert len(found) == len(rows)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= CUT)
    assert found[5001].score == found[5002].score and found[5003].predicted == 1  # whole texts, ends too


def test_nothing_but_the_text_reaches_a_score(spark, scored):
    rows, found, docs, labels = scored
    from pyspark.sql import functions as F

    swapped = docs.withColumns({"lang": F.lit("zz"), "score": F.lit(None)})
    again = {r.doc_id: r.score for r in score_toxicity(swapped, labels).collect()}
    assert all(again[i] == r.score for i, r in found.items())
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert training_rows(docs, flipped) == training_rows(docs, labels)


def plain_score(model, text):
    """The score by its definition, a word and a filter at a time."""
    words = text.lower().split()
    vectors = [np.concatenate([model.embed[k] for k in features(w)]).astype(float) for w in words]
    pooled, column = [], 0
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            weights = [model.filters[:, column + i * FILTERS + f].astype(float) for i in range(width)]
            windows = [sum(float(vectors[p + i] @ weights[i]) for i in range(width) if p + i < len(words)) for p in range(len(words))]
            pooled.append(max(0.0, max(windows, default=0.0) + float(model.bias[k * FILTERS + f])))
        column += width * FILTERS
    votes = [sum(w.decode("utf-8", "replace") in FUNCTION_WORDS[g].split() for w in words) for g in FUNCTION_WORDS]
    z = float(np.dot(pooled, model.out.astype(float))) + model.base - model.thresholds[votes.index(max(votes))] + math.log(CUT / (1 - CUT))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 15])
def test_scores_match_a_plain_forward_pass(monkeypatch, block):
    rows = corpus(120, 8)
    model = train([t.encode() for _, t, _, _ in rows], [x for *_, x in rows])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", block)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)
    texts = [b"", b"the", b"awful1 awful2", *(t.encode() for _, t, _, _ in rows[:25]), b" ", "Stemxyz, die UND \u00fcber! \xff".encode("latin-1")]
    scorer = Scorer(model)
    found = [*scorer.scores(texts[:10]), *scorer.scores(texts[10:]), *scorer.scores([])]
    assert found == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_thresholds_match_a_search_of_all_cuts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        y = (rng.random(40) < 0.4).astype(float)
        x = np.round(rng.normal(0, 1, 40) + y, 1)
        if 5 <= y.sum() <= 35:
            balanced = lambda c: ((x >= c) & (y == 1)).sum() / y.sum() + ((x < c) & (y == 0)).sum() / (1 - y).sum()
            found = toxicity._threshold(x, y, 0.0)
            # Equal figures stand together on one side of any cut, so a cut inside a tie is no better than the best outside.
            assert balanced(found) >= max(balanced(c) for c in [*x, x.max() + 1]) - 1 / y.sum() - 1 / (1 - y).sum()


def test_sample_is_bounded(spark, scored, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    _, _, docs, labels = scored
    texts, marks = training_rows(docs, labels)
    assert len(texts) == 20 and sum(marks) == 10


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_labels_of_one_class_give_one_score(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (4, None)], "doc_id long, text string")
    found = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r.score for r in found}) == 1 and len(found) == 3
    assert score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_language_is_read_off_function_words():
    assert [language(t.encode().split()) for t in ("the of and x", "der die und", "le les des", "el los que", "")] == [0, 1, 2, 3, 0]


def test_every_labelled_row_is_learned_from(spark, scored, monkeypatch):
    """no number of rows bounds the training, and a text's length does not keep it out."""
    rows, found, docs, labels = scored
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    assert {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()} == {i: r.score for i, r in found.items()}


def test_long_texts_are_learned_from(spark):
    rows = [(i, "x" * (1 << 15) + (" awful" if i % 3 == 0 else " kind") + " and to", int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in score_toxicity(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")).collect()}
    assert all(found[i].predicted == x for i, _, x in rows)


def test_all_rows_of_many_tasks_and_chains_count(spark, scored):
    rows, _, docs, labels = scored
    learned = [(t.encode(), x) for i, t, _, x in rows if x is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    found = toxicity.labelled_rows(docs, labels, chain_rows=150)
    assert found.rdd.getNumPartitions() == -(-len(learned) // 150)
    assert sorted((bytes(r.text), r.label) for r in found.collect()) == sorted(learned)
    seen = toxicity._summed(found, lambda task, pairs: [toxicity.frequencies(pairs)])[0].reshape(-1, 2)
    plain = np.zeros_like(seen)
    for text, label in learned:
        plain[sorted({b for w in text.split() for b in features(w)}), label] += 1
    assert (seen == plain).all()

    # Chains are cut by bytes too, and the mean of them all still tells the texts apart, in every run alike.
    model, again = (toxicity.learn(docs, labels, chain_rows=150, chain_bytes=40_000) for _ in range(2))
    assert all((x == y).all() for x, y in ((model.embed, again.embed), (model.filters, again.filters), (model.thresholds, again.thresholds)))
    held = [(t.encode(), x) for i, t, _, x in rows if x is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    right = [int(s >= CUT) == x for s, (_, x) in zip(Scorer(model).scores([t for t, _ in held]), held)]
    assert sum(right) / len(right) > 0.93


def test_chains_are_averaged_by_their_rows():
    rows = [(t.encode(), x) for _, t, _, x in corpus(90, 3)]
    at = toxicity.begin(toxicity.frequencies(iter(rows)), sum(1 - x for _, x in rows), sum(x for _, x in rows))
    at.epochs = 2
    whole = toxicity.averaged(at, *toxicity.chains(at, iter(rows), 60, 1 << 20, [1]))
    parts = [toxicity.chains(at, iter(rows[:60]), 60, 1 << 20, [1]), toxicity.chains(at, iter(rows[60:]), 60, 1 << 20, [1])]
    alone = toxicity.averaged(at, *parts[0])
    assert parts[0][1][-1] == 60 and parts[1][1][-1] == 30 and not np.allclose(alone.params[0], whole.params[0])
    both = toxicity.chains(at, iter(rows), 60, 1 << 20, [1])
    assert both[1][-1] == 90 and set(np.unique(both[0][:, -1])) <= {0, 30, 60, 90}
    for x, y in zip(toxicity.averaged(at, *parts[0]).params, toxicity.averaged(at, *toxicity.chains(at, iter(rows[:60]), 1000, 1 << 20, [1])).params):
        assert np.allclose(x, y, atol=1e-5)


def test_a_step_follows_the_gradient():
    """One step over one batch against the slope of the loss, taken by differences."""
    rows = [(t.encode(), x) for _, t, _, x in corpus(20, 6)]
    n1 = sum(x for _, x in rows)
    at = toxicity.begin(toxicity.frequencies(iter(rows)), len(rows) - n1, n1)
    at.epochs = 1
    words = toxicity.Words()
    docs = [words.of(t.split()) for t, _ in rows]
    toxic = np.array([x for _, x in rows], np.float32)

    def loss(params):
        model = toxicity.Steps(params, at.squares, at.share, 1).model()
        z, _ = Scorer(model).logits([t for t, _ in rows])
        z = z.astype(float)
        return float(np.mean((np.logaddexp(0, z) - toxic * z) * np.where(toxic == 1, at.share[1], at.share[0])))

    moved = at.fresh()
    toxicity.run_chain(moved, docs, toxic, words.buckets, np.random.default_rng(1))
    for k in range(4):
        gradient = np.sqrt(np.maximum(moved.squares[k] - at.squares[k], 0))
        place = np.unravel_index(int(gradient.argmax()), gradient.shape)
        up, down = at.fresh().params, at.fresh().params
        up[k][place] += 1e-3
        down[k][place] -= 1e-3
        slope = (loss(up) - loss(down)) / 2e-3
        assert gradient[place] == pytest.approx(abs(slope), rel=0.05) and np.sign(at.params[k][place] - moved.params[k][place]) == np.sign(slope)
