import random

import numpy as np
import pytest
from test_first_ops import frame

from kinfold.llm import mixing


def test_domains_of_long_texts_only(spark):
    r = random.Random(5)
    text = lambda letters, n: " ".join(r.choice(letters) + str(r.randrange(9)) for _ in range(n))
    docs = [(i, text("abc", 300) if i % 2 else text("xyz", 20_000)) for i in range(12)] + [(20, None), (21, " \n")]
    labels = spark.createDataFrame([(i, "short" if i % 2 else "long") for i in range(12)] + [(20, "none"), (21, "blank"), (99, "away")], "doc_id long, domain string")
    rows = mixing.mix(frame(spark, docs), labels, {"short": 0.5, "long": 0.5}).collect()
    assert len(rows) == len(docs)
    assert all(x["domain"] == ("short" if x["doc_id"] % 2 else "long") for x in rows if x["doc_id"] < 12)
    total = sum(x["n_tokens"] for x in rows)
    got = sum(x["rate"] * x["n_tokens"] * np.array(x["posterior"]) for x in rows)
    assert np.allclose(got, total / 2, rtol=1e-3)
    for d in ("none", "blank", "away"):
        with pytest.raises(ValueError, match=d):
            mixing.mix(frame(spark, docs), labels, {"short": 0.5, d: 0.5})
