import pytest

#: Null and empty texts, blank ones, rows without id, repeated rows, one id with two texts, ties, long texts and copies.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "some words here"), (None, None), (5, "same text\nhere ok"), (6, "same  text\nhere ok "), (7, "Same Text\nHERE ok"),
    (8, "two versions of it"), (8, "another version now"), (9, "é ü 漢字 🎉\nhere ok"), (10, "x" * 5000), (11, "word " * 3000), (12, " ".join(f"w{i}" for i in range(400))), (13, " ".join(f"w{i}" for i in range(400)) + " end"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows as above, with more columns that are named as operators name theirs."""
    names = ["score", "predicted", "spans", "n_lines", "n_dropped", "key", "size", "target", "copies", "taken", "full", "take", "c1", "token_ids", "n_tokens", "mark", "sig", "node", "component", "kept", "other", "n"]
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", None, k if k % 2 else None, *["?"] * len(names)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
