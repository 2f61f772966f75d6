import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, long texts, ties, repeats, clashing extra columns."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocab) for _ in range(400)]
    near = base[:]
    near[200] = "changed"
    passage = " ".join(base[40:110])
    texts = [
        None, "", "   \n\t", "one", "One", "a b c", "a  b\nc", " ".join(base), " ".join(base), "  ".join(base), " ".join(near),
        passage + " " + " ".join(rng.choice(vocab) for _ in range(80)), " ".join(rng.choice(vocab) for _ in range(60)) + "\n" + passage,
        "x" * 5000, "ab " * 3000, " ".join(rng.choice(vocab) for _ in range(30_000)), "é▁ ü   日本語", "\x00 \x01", "A B C", passage,
    ]
    rows = [(100 - i, t, "k", i, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, uid long, id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
