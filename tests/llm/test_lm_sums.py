"""Sums of gradients without sorts equal sums by row."""

import numpy as np
import pyarrow as pa

from millrace.llm import lm_scoring as lm

TEXTS = pa.array(["The cat sat on the mat.", None, "", "a b a b a b c", "One word of many words, and the cat again " * 30])


def _tokens():
    ((_, part),) = lm._batches(TEXTS)
    return [np.concatenate([t[k] for t in part]) for k in range(4)]


def test_sums_of_classes_equal_those_of_each_token():
    _, class_, history, _ = _tokens()
    rng = np.random.default_rng(1)
    used, at = np.unique(history, return_inverse=True)
    p = rng.random((len(used), lm.CLASSES), dtype=np.float32)
    out = np.zeros((2, lm._ROWS, lm.CLASSES), np.float32)
    for _ in range(2):  # sums are added to what is there
        lm.add_classes(out, used, at, class_, p)
    want = np.zeros((2, lm._ROWS, lm.CLASSES))
    for f in lm._features(history):
        np.add.at(want[0], (f, class_), 2)
    for f in lm._features(used):
        np.add.at(want[1], f, 2 * p)
    assert np.array_equal(out[0], want[0]) and np.allclose(out[1], want[1], rtol=1e-5)


def test_sums_of_decisions_equal_those_of_each_token_and_need_no_sort(monkeypatch):
    hash_, class_, _, lengths = _tokens()
    word, first, count = np.unique(hash_, return_index=True, return_counts=True)
    place = np.array([np.sum((class_[first] == class_[first][i]) & ((count > count[i]) | ((count == count[i]) & (word < word[i])))) for i in range(len(word))])
    mass = np.zeros((lm.CLASSES, lm.FAN))
    np.add.at(mass, (class_[first], (word % np.uint64(lm.FAN)).astype(int)), count + 1)
    chain = lm.Chain(word, class_[first], place, count, mass, 2, 10)
    weights = np.random.default_rng(2).normal(size=(1 << 10, lm.FAN)).astype(np.float32)
    tokens = (hash_, class_, *lm.contexts(hash_, lengths))
    want = np.zeros((2, 1 << 10, lm.FAN))
    for _, rows, outcome, _, e in chain.decisions(weights, *tokens):
        for row in rows:
            np.add.at(want[0], (row, outcome), 1)
            np.add.at(want[1], row, e / e.sum(axis=1, keepdims=True))
    out = np.zeros((2, 1 << 10, lm.FAN), np.float32)
    monkeypatch.setattr(lm.np, "argsort", None)
    monkeypatch.setattr(lm.np, "unique", None)
    chain.gradients(weights, out, *tokens)
    assert want[0].sum() > 100 and np.array_equal(out[0], want[0]) and np.allclose(out[1], want[1], rtol=1e-4)


def test_borders_of_texts_cut_words_without_a_sort_of_all(monkeypatch):
    from millrace.llm import words

    texts = ["ab cd", "", "", "ef", " gh", "i ", "", "j", "kl\n", "mn", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    monkeypatch.setattr(words.np, "union1d", None)
    w = words.Words(data, offsets)
    got = [(int(d), data[s : s + n].tobytes().decode()) for d, s, n in zip(w.doc, w.start, w.length, strict=True)]
    assert got == [(i, x) for i, text in enumerate(texts) for x in text.split()]
