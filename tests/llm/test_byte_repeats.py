import random

import pytest
from brute import byte_repeats
from test_first_ops import frame, odd_docs, read

from kinfold.llm import byterepeats
from kinfold.llm import queries as Q


def answers(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_byte_repeats(spark, sf):
    assert answers(Q.op4_byte_repeats(spark, sf)) == byte_repeats(read(spark, sf))


@pytest.mark.parametrize("length,group_rows", [(50, 4096), (50, 1), (9, 3), (2, 4096)])
def test_odd(spark, length, group_rows):
    r = random.Random(length)
    docs = odd_docs() + [(500 + i, "".join(r.choice("ab") for _ in range(80))) for i in range(6)] + [(600, "x" * 300), (601, "x" * 120 + "y" + "x" * 60)]
    assert answers(byterepeats.remove_repeated_bytes(frame(spark, docs), length, group_rows)) == byte_repeats(docs, length)


def test_repeated_rows_and_nulls(spark):
    text = "0123456789" * 7
    docs = [(1, text), (1, text), (2, text + "z"), (None, text)]
    rows = byterepeats.remove_repeated_bytes(frame(spark, docs)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("1", 0), ("1", 0), ("2", 70), ("None", 0)]
    assert byterepeats.remove_repeated_bytes(frame(spark, docs).limit(0)).count() == 0
