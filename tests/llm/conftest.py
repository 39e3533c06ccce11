import pytest

TEXTS = [
    "a  b\n\nc 's 're'll don't''s \t x <|endoftext|> <|startoftext|>z <|ENDOFTEXT|>", "  lead", "trail  ", "", None, "Ünï ΣΑΣ İstanbul é ﬁ Ⅷ ٣٤ 中文字   x  y 　z", "aaaa" * 300, "x" * 1500 + " 12345 " + "ab" * 700,
    "'s", "''s", "' s", ".'s 'S '\n's", "\U0001f600 emoji\U0001f600's a​b", "<|endoftext|>", "-" * 300, "=" * 77 + " " * 90 + "x", " " * 50, "The same text. " * 40, "The same text. " * 40,
]


@pytest.fixture(scope="session")
def texts(spark):
    """Documents with nulls, empty and long texts, repeats, and columns whose names clash with results'."""
    rows = [(i, t, i, "x", [1]) for i, t in enumerate(TEXTS)] + [(3, "", 0, "y", [2]), (None, "no id", 0, "y", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, id string, ids array<int>")
