import public_tokenizers
import pytest

TEXTS = [
    None, "", " ", "one", "The same text, twice over, with a few more words.", "The same text, twice over, with a few more words.",
    "x" * 3000, "ab" * 1500 + " tail", "é" * 700 + "\n\n\n  end", "日本語のテキスト" * 40, "a <|endoftext|> b<|endoftext|>" * 30,
    "don't we've I'll 's 're  12345 6,789\t\ttabs\r\n" * 40, "🎉🎉 party " * 60, " " * 500 + "x", "-" * 900 + "y",
]


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """Hard rows: null and repeated ids, equal texts, columns with names of our own."""
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(TEXTS)]
    rows += [(None, "text of a row without id", "s0", 1), (3, "second row of an id", "s1", 2), (3, "second row of an id", "s1", 2)]
    rows = [(i, t, s, None if t is None else len(t), n, "x", 0.5) for i, t, s, n in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _id long, _text string, size double")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
