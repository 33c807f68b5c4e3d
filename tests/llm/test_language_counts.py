"""Language profiles and bounds come from every labelled document, however many there are."""

import random
from zlib import crc32

import numpy as np

from loomspan.llm import langid


def test_every_labelled_document_counts(spark):
    rng = random.Random(3)
    words = "re in the an er on st es ou ti ed th at nd of ha en it".split()
    texts = {k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.choice((6, 30)))) for k in range(9000)}
    docs = spark.createDataFrame([(k, t, "aa") for k, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    held = {k: crc32(str(k).encode()) % 3 == 1 for k in texts}

    langs, profiles = langid.learn(docs)
    whole = langid._unit_vectors([t for k, t in texts.items() if not held[k]], langid.DIMS).astype(np.float64).sum(axis=0)
    assert langs == ["aa"] and np.allclose(profiles[0], whole / np.linalg.norm(whole), atol=1e-6)

    sizes = np.zeros(sum(held.values()), np.int64)
    scores = langid._unit_vectors([t for k, t in texts.items() if held[k]], langid.DIMS, sizes) @ profiles[0]
    got = langid.least_scores(docs, langs, profiles)["aa"]
    classes = np.floor(np.log2(sizes)).astype(int)
    lows = {int(c): np.percentile(scores[classes == c], 1) / 2 for c in set(classes) if (classes == c).sum() >= langid.LEAST_SEEN}
    want = {c: min(langid.MOST_BOUND, x) for c, x in lows.items() if x >= 3 / langid.DIMS**0.5}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-5 for c in want) and min(want.values()) < langid.MOST_BOUND
