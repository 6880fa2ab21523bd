"""A text's score does not depend on its neighbours."""

import numpy as np

from loomwork.llm import byte_cnn


def test_a_score_is_the_same_alone_and_in_a_batch():
    rng = np.random.default_rng(1)
    net = byte_cnn.ByteCnn(rng.normal(0, 1, (6, 256, 12)), np.zeros(12), rng.normal(0, 0.1, 24), 0.0)
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (0, 1, 250, 251, 252, 255, 256, 257, 506, 507, 512, 513) for _ in range(5)]
    score = lambda own: byte_cnn.score_block(np.cumsum([0, *map(len, own)]), np.concatenate(own), net, net.pairs())
    assert np.allclose(score(texts), [score([t])[0] for t in texts], atol=1e-6)
