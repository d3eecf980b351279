"""The language model's sample is held once on the driver."""

import numpy as np

from pagelane.llm import op7_language_id as op7


def test_two_classes_train_on_the_sample_itself(monkeypatch):
    x, labels = np.eye(6, dtype=np.float32), np.array(["en", "de"] * 3, object)
    seen, train = [], op7.train_svm
    monkeypatch.setattr(op7, "train_svm", lambda rows, y: seen.append(np.shares_memory(rows, x)) or train(rows, y))
    model = op7.OneVersusOne(x, labels, ["de", "en"])
    assert seen == [True]
    assert [model.classes[c] for c in model.predict(x)[0]] == list(labels)
    op7.OneVersusOne(x, np.array(["a", "b", "c"] * 2, object), ["a", "b", "c"])
    assert seen[1:] == [False] * 3
