import random

import pytest

ALPHABET = "aAbBéÉüß \n\t'sd1²!.,-_\u00a0\u2003\u0301Σ語🙂<|"
SPECIAL = [
    None, "", " ", "  a  b ", "x<|endoftext|>y <|endoftext|>", "Σίσυφος ΟΔΟΣ", "a\x1cb \x1d c", "İstanbul don't I'LL we're 12345 ½ ²", "é\u0061    x", "日本語 テスト 🙂🙂", "a" * 5000, "!" * 3000 + "\n\n\n",
    "a \n b\n c\r\nd\te", "\n", "foo  ", "\u0558\u058b x\ua7ce", "ſß ẞ", "<|startoftext|>Hi<|endoftext|>", "ab\u0300c", "\x85a\x85 b", "same text", "same text", "\x00zero\x00", "x\ue000y",
]


@pytest.fixture(scope="session")
def texts():
    rnd = random.Random(1)
    return SPECIAL + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 60))) for _ in range(300)] + [" ".join(rnd.choice(["alpha", "Beta,", "gamma.", "don't", "3.5"]) for _ in range(20_000))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd texts with a null id, a repeated row, and columns whose names clash with results."""
    rows = [(i, t, "clash", 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", "clash", 0.5, "x"), rows[20]]
    return spark.createDataFrame(rows, "doc_id long, text string, IDS string, score double, license string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
