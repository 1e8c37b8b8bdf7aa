"""What the learned state of op10_toxicity keeps: a word of little evidence, a stem of four bytes, many terms."""

import numpy as np
import pyarrow as pa

from lodestar.llm import kernel, toxicity


def counted(texts):
    (_, _, data, off), = kernel.blocks(pa.array(texts))
    h, doc = toxicity.terms(data, off)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def model(texts, labels):
    return toxicity.NearestLabelled(np.arange(len(texts)), np.array(labels), {0: 1.0, 1: 1.0}, *counted(texts))


def known(m, text):
    return np.isin(m.words, counted([text])[1]).any()


def test_rare_word_is_evidence():
    texts = [f"plain{i:03d} " + ("zor" if i < 12 else "") for i in range(200)] + [f"other{i:03d}" for i in range(200)]
    m = model(texts, [1] * 200 + [0] * 200)
    assert known(m, "zor")


def test_stem_of_four_bytes_is_evidence():
    texts = [f"{chr(97 + i % 26)}{i} murk{chr(97 + i)}xyz" for i in range(20)] + [f"{chr(97 + i % 26)}{i} calm" for i in range(20)]
    m = model(texts, [1] * 20 + [0] * 20)
    assert known(m, "murkiness")


def test_more_than_1024_terms():
    texts = [" ".join(f"q{j:04d}" for j in range(1500)) for _ in range(20)] + ["calm"] * 20
    m = model(texts, [1] * 20 + [0] * 20)
    assert len(m.words) > 1024
