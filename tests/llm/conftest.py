import pytest

LONG = "lorem ipsum dolor " * 20_000
#: Rows with nulls, repeats, ties, empty and very long texts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "the QUICK brown fox jumps over the lazy dog"),
    (2, "the QUICK brown fox jumps over the lazy dog"),
    (3, ""),
    (4, None),
    (None, "a row without an id"),
    (None, None),
    (5, "ÉTÉ été naïve Straße don't <|endoftext|> 1234 x...y , ."),
    (6, LONG),
    (7, LONG + "end"),
    (8, " \t\n\x0b\x0c\r  "),
    (9, "one"),
    (10, "one"),
    (-3, "one"),
]
#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, digest string, norm string, fp string, key string, row string, n string, held_out string, block string, length string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * 9, len(t or "")) for i, t in ROWS], CLASH)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="session")
def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("word_bpe_49k.json"))


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
