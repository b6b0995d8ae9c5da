import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, rank int"
BASE = " ".join(f"word{i}" for i in range(60))


def texts() -> list[str | None]:
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, a very long text, odd characters."""
    return [
        BASE, BASE, BASE.replace("word30", "changed"), "other start " + BASE, None, "", "  \n\t ", "one", "One", "two words", "tiny text of five words", "a " * 30_000, "x" * 50_000,
        "line one is here\nline one is here\nLine  one is here!\n\nanother line that is quite long and nearly equal to the next one in all but a letter\nanother line that is quite long and nearly equal to the next one in all but a lettre",
        "Ünïcode 🙂 café don't we'll 12345 $$$\u00a0x\x1cz <|endoftext|>", "mail me@host.example.org or +44 20 7946 0958, 10.1.2.3, 4539 1488 0343 6467", "\u0301 e\u0301 İ ΣΑΣ", BASE + "\n" + BASE,
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names clash with inner ones, a null and a repeated doc_id, and a repeated row."""
    rows = [(i, t, "en", "src0" if i % 3 else None, 0, f"k{i}", i) for i, t in enumerate(texts())]
    rows += [(None, BASE, "en", "src1", 0, "k", 1), (0, BASE, "en", "src0", 0, "k0", 0), (3, "the same id with another text", "en", "src1", 0, "k", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
