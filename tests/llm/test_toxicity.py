import random

import numpy as np
import pytest

from spanwork.llm import toxicity
from spanwork.llm.toxicity import Scorer, bin_scores, class_prior, first_cut, fit_on_tables, flagged_share, histogram, plain, score_documents, sentences, share_threshold, train, units

BAD = ["You are a worthless {x}.", "Shut your mouth, you stupid {x}.", "Only a rotten {x} would draw axis A/{n}.", "I will break your fingers, {x}."]
NAMES = ["idiot", "moron", "dickhead", "cretin", "bastard"]
GOOD = ["The lintel carries {n} kg.", "Sheet A-{n} shows the stair.", "We measured {n} mm at axis B/{n}.", "What an idiotic default, the viewer hides door {n}.", "Use a bastard file on burr {n}.", "Sorry, my mistake at axis C/{n}, I am an idiot."]


def corpus(n, rate, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        doc = [rng.choice(GOOD).format(n=rng.randint(1, 900)) for _ in range(rng.randint(1, 6))]
        toxic = rng.random() < rate
        if toxic:
            bad = rng.choice(BAD).format(x=rng.choice(NAMES), n=rng.randint(1, 30))
            style = rng.random()
            bad = bad.upper() if style < 0.2 else bad.replace("o", "0") if style < 0.3 else bad.replace("i", "\u0456") if style < 0.4 else bad
            doc.insert(rng.randint(0, len(doc)), bad)
        out.append((" ".join(doc), toxic))
    return out


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(9)
    labelled = [(t, float(toxic != (rng.random() < 0.08))) for t, toxic in corpus(500, 0.25, 1)]  # reviewers err
    return train(labelled, [t for t, _ in corpus(1500, 0.05, 2)])


def test_held_out_accuracy(scorer):
    test = corpus(1500, 0.05, 3)
    flagged = [scorer.document(t) > 0.5 for t, _ in test]
    hits = sum(f and y for f, (_, y) in zip(flagged, test))
    assert hits / sum(y for _, y in test) >= 0.9 and hits / max(1, sum(flagged)) >= 0.9


def test_disguises(scorer):
    assert plain("1d10t") == "idiot" and plain("mooooron") == "moron" and plain("f***ed") == "f*d" and plain("879666") == "0"
    for text in ("You are a worthless i d i o t.", "you are a w\u200borthless m-o-r-o-n", "YOU ARE A W0RTHLESS B4ST4RD"):
        assert scorer.document(text) > 0.5, (text, sentences(text))
    assert scorer.document(None) == scorer.document("") == scorer.document("...") == 0.0


def test_units_cover_every_word():
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    assert {w for u in units(text) for w in u} == {w for s in sentences(text) for w in s}


def test_prior_and_threshold():
    rng = np.random.default_rng(0)
    toxic = rng.random(4000) < 0.1
    scores = np.where(toxic, rng.normal(4, 0.7, 4000), rng.normal(-4, 0.7, 4000))
    positive = (toxic & (rng.random(4000) < 0.5)).astype(float)
    assert class_prior(scores, positive, np.ones(4000)) == pytest.approx(0.1, abs=0.04)
    everywhere, confirmed = histogram(scores), histogram(scores[positive > 0])
    share = flagged_share(everywhere, confirmed)
    assert share == pytest.approx(toxic.mean(), abs=0.005) and -2 < share_threshold(everywhere, share) < 2.5
    noisy = confirmed + histogram(scores[~toxic][:60])  # reviewers err
    assert flagged_share(everywhere, noisy) == pytest.approx(toxic.mean(), abs=0.01)
    crowd = everywhere + histogram(np.full(150, 0.0))  # like texts that nobody confirmed, between the two
    assert flagged_share(crowd, confirmed) * 4150 == pytest.approx(toxic.sum(), abs=25)
    assert flagged_share(everywhere, np.zeros_like(everywhere)) == flagged_share(np.zeros_like(everywhere), confirmed) == 0.0


def test_tables_nulls_and_clashing_names(spark, scorer):
    docs = [(i, t, 5, "s") for i, (t, _) in enumerate(corpus(300, 0.2, 5))] + [(1000, None, 5, None), (1001, "", 5, "s"), (None, "You are a worthless idiot.", 5, "s"), (1002, "fine " * 20_000, 5, "s")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, score int, source string")
    votes = [(i, int(y), "r") for i, (_, y) in enumerate(corpus(300, 0.2, 5)) if i % 2] + [(None, 1, "r"), (5, None, "r"), (77_777, 1, "r")]
    fitted = fit_on_tables(spark, documents, spark.createDataFrame(votes, "doc_id long, offensive int, reviewer string"))
    got = score_documents(spark, documents, fitted)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "source", "score", "flagged"] and len(rows) == len(docs)
    assert all(r.score == 0 and not r.flagged for r in rows if not r.text)
    empty = fit_on_tables(spark, documents.limit(0), spark.createDataFrame([], "doc_id long, offensive int"))
    assert isinstance(empty, Scorer) and score_documents(spark, documents.limit(0), empty).count() == 0
    assert score_documents(spark, documents, empty).where("flagged").count() == 0


def test_sampled_fit_sees_the_whole_corpus(spark, monkeypatch):
    """Prior, weights and threshold of a fit on few documents are those of all documents; labelled ones are mostly toxic."""
    looked, others = corpus(200, 0.6, 6), corpus(2300, 0.03, 7)
    documents = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(looked + others)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(looked)], "doc_id long, offensive int")
    seen = {}
    fit, place = toxicity.fit_nnpu, toxicity.flagged_share

    def fitted(rows, p, u, prior, *args):
        seen.setdefault("units", u.sum())
        seen["prior"] = prior
        return fit(rows, p, u, prior, *args)

    def placed(everywhere, confirmed):
        seen["documents"] = everywhere.sum()
        return place(everywhere, confirmed)

    monkeypatch.setattr(toxicity, "fit_nnpu", fitted)
    monkeypatch.setattr(toxicity, "flagged_share", placed)
    fit_on_tables(spark, documents, labels)
    whole = dict(seen)
    seen.clear()
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 150)
    scorer = fit_on_tables(spark, documents, labels)
    assert seen["documents"] == whole["documents"] == 2500
    assert seen["units"] == pytest.approx(whole["units"], rel=0.1)
    assert seen["prior"] == pytest.approx(whole["prior"], rel=0.25)
    flagged = [scorer.document(t) > 0.5 for t, _ in others]
    hits = sum(f and y for f, (_, y) in zip(flagged, others))
    assert hits / sum(y for _, y in others) >= 0.85 and hits / max(1, sum(flagged)) >= 0.85


def test_histograms_stand_for_the_scores():
    rng = np.random.default_rng(1)
    toxic = rng.random(3000) < 0.1
    scores = np.where(toxic, rng.normal(4, 0.7, 3000), rng.normal(-4, 0.7, 3000))
    counts = histogram(scores)
    assert counts.sum() == 3000
    for share in (0.01, 0.05, 0.3):
        assert (scores > share_threshold(counts, share)).mean() == pytest.approx(share, abs=0.003)
    assert (np.sort(scores)[::-1] >= first_cut(counts)).mean() == pytest.approx(0.02, abs=0.002)
