import random

import numpy as np
import pytest

from probatum.llm.subjects import Batch, Chain, _as_batch, _thinned, features, hashes, sentences, subject_areas

TERMS = {
    "law": "verdict appeal clause plaintiff statute tribunal injunction precedent".split(),
    "sport": "goalkeeper podium referee sprint marathon league fixture penalty".split(),
    "physics": "lattice photon cryostat plasma resonance detector kelvin neutron".split(),
}
TURNS = ["Both the {} and the {} were recorded for 12 {}s.", "No {} changed the {} during 1990 with a {}.", "We report 7 cases in which the {} met the {} and the {}."]
NONE = ["The table was regenerated with the same inputs.", "One reader called the result well-known.", "The jury is still out on whether the figure of 3 holds."]


def test_sentences():
    assert sentences(None) == sentences("") == sentences("# Heading\n\n- id: c-12\n## 1.2.3") == []
    assert len(sentences("The value was 5. The next was 6.\n- A third item stands here.")) == 3
    assert len(sentences("Der Wert wurde am 66. Tag erneut geprüft. Die Angabe stimmt mit der Datei überein.")) == 2
    assert sentences('- id: c-1\n  text: "No plot sowed the row."') == [["No", "plot", "sowed", "the", "row"]]
    assert len(hashes(sentences("word " * 200_000 + "."))[0]) == 200_000


def test_chain_learns_a_rule():
    rng = np.random.default_rng(0)
    share = rng.random((800, 2))
    x = np.stack([share, share * 2], axis=2)
    y = (share > 0.5).astype(float)
    assert (Chain(x, y).decode(x) == y).mean() > 0.95


def test_chain_source_and_structure_decide_where_terms_do_not():
    rng = np.random.default_rng(1)
    n, sources = 3000, 2
    source = rng.integers(0, 2, n)
    listed = rng.random(n)
    first = np.where(rng.random(n) < 0.9, source, 1 - source)  # area 0 goes with the source
    second = np.where(rng.random(n) < 0.9, first, 1 - first)  # area 1 goes with area 0
    third = (listed > 0.5).astype(int)  # area 2 goes with the structure
    y = np.stack([first, second, third], axis=1).astype(float)
    clear = rng.random((n, 3)) < 0.5
    own = np.where(clear, (2 * y - 1) * 8, rng.normal(0, 1, (n, 3)))[:, :, None].repeat(2, axis=2)
    x = features(own, np.ones(n), listed, np.eye(2)[source])
    half = n // 2
    chain = Chain(x[:half], y[:half])
    right = lambda got: (got == y[half:]).mean(axis=0)
    whole = right(chain.decode(x[half:]))
    assert (whole > 0.9).all()
    for column, area in (((slice(4, 4 + sources)), 0), ((slice(3, 4)), 2)):
        less = x.copy()
        less[:, :, column] = 0
        assert right(chain.decode(less[half:]))[area] < whole[area] - 0.02
        assert right(Chain(less[:half], y[:half]).decode(less[half:]))[area] < whole[area] - 0.02
    alone = Chain(x[:half], y[:half])
    for w in alone.weights:
        w[1 + x.shape[2] :] = 0  # no area sees another
    assert right(alone.decode(x[half:]))[1] < whole[1] - 0.02


def test_thinned_texts_keep_their_sentences():
    b = Batch(_as_batch([sentences("The plaintiff met the tribunal at noon. No verdict was given by anyone."), [], sentences("One more appeal stands here today.")]))
    t = _thinned(b, np.random.default_rng(0))
    assert len(t.ends) == len(b.ends) == 3 and len(t.words) < len(b.words) and (np.diff(np.r_[0, t.ends]) > 0).all()


def test_areas(spark):
    rng = random.Random(5)
    say = lambda a: rng.choice(TURNS).format(*rng.sample(TERMS[a], 3))
    examples = [(i, " ".join([say(a) for _ in range(3)] + [rng.choice(NONE)]), a) for i, a in enumerate(["law", "sport", "physics"] * 12)]
    docs, truth = [], {}
    for i in range(240):
        areas = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
        body = [say(a) for a in areas for _ in range(4)] + rng.sample(NONE, 2)
        rng.shuffle(body)
        docs.append((i, " ".join(body), "note", "clash"))
        truth[i] = set(areas)
    docs += [(900, None, None, "x"), (901, "", "note", "x"), (902, "# only a heading", None, "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, area string")
    e = spark.createDataFrame(examples, "example_id long, text string, area string")
    got = {}
    for r in subject_areas(d, e, list(TERMS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    assert not got.keys() & {900, 901, 902}
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.95 * len(truth)
    assert subject_areas(d.limit(0), e, list(TERMS)).count() == 0
    assert subject_areas(d, e.limit(0), list(TERMS)).count() == 0
