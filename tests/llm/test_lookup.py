"""Learned features that share a slot."""

import numpy as np

from fieldpulse.llm import toxicity


def test_features_of_one_slot_are_all_found():
    step = np.uint64(1 << toxicity.Model.SLOT_BITS)
    features = np.array([7, 7 + step, 9 + step, 7 + 5 * step], np.uint64)
    model = toxicity.Model(features, np.array([1.0, 3.0, 2.0, 0.5]), -1.0)
    at = model.find(np.concatenate([features, [np.uint64(7 + 2 * int(step)), np.uint64(8)]]))
    assert model.weights[at[:4]].tolist() == [1.0, 3.0, 2.0, 0.5] and at[4:].tolist() == [-1, -1]
    assert (toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0).find(features) == -1).all()
