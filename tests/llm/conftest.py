import pytest

# doc_id, text, and further columns with names the operators use themselves
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies, a long text, and
    columns whose names clash with the operators' own."""
    base = " ".join(WORDS[:120])
    near = " ".join([*WORDS[:60], "other", *WORDS[61:120]])
    passage = " ".join(WORDS[200:260])
    rows = [
        (1, base, "en", 5),
        (2, base, "en", 5),
        (3, near, "en", 5),
        (4, None, None, None),
        (5, "", "en", 0),
        (6, " \t\n ", "en", 4),
        (7, "Hello, World! it's 2024 — don't", "en", 30),
        (7, "Hello, World! it's 2024 — don't", "en", 30),
        (8, f"a b c {passage} d e f", "en", 9),
        (9, f"x y {passage} z <|endoftext|> q", None, 9),
        (None, base, "en", 5),
        (10, "Größe über Öl und Straße für die Ämter " * 3, "de", 9),
        (11, " ".join(WORDS[k % 400] + str(k % 977) for k in range(20000)), "en", 9),
        (12, "12345 !!!", "en", 9),
        (13, "Released under the MIT License. And more text here.", "en", 9),
    ]
    frame = spark.createDataFrame(
        [(*r, "s", "k", 1, 2.0) for r in rows],
        "doc_id long, text string, lang string, n_chars long, source string, key string, part int, score double",
    )
    return frame


@pytest.fixture(scope="session")
def benchmark(spark):
    words = " ".join(WORDS[10:40])
    return spark.createDataFrame([(1, words), (2, "w200 w201 w202"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture
def folder(docs, benchmark, tmp_path):
    """The tables as a query's input folder."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture
def nothing(docs, benchmark, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)
