import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from postlens.session import get_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` int, tie string, id long"


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 8)


def documents(spark, texts, ids=None):
    """A documents table with extra columns whose names the operators use
    inside, and nulls in them."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "a", None, None, None, "x", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


#: null, empty, blank, very long, repeated, odd characters
LONG = "wordy thing " * 9000
EDGE = [None, "", " \n\t ", "plain words here", "plain words here", LONG, "naïve 日本語 🤗 \x00   x", "=" * 500,
        "a<|endoftext|>b <s>", "tail \n", "  two  spaces "]
