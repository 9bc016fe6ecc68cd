import pytest

ROWS = [  # id, text: null, empty, blank, copies, ties, a repeated row, accents, a long text
    (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4), (6, "Über Ärger und Öl " * 9),
    (7, "über Ärger und Öl " * 9), (8, "one two three"), (9, "ONE two three"), (9, "ONE two three"),
    (10, " ".join(f"word{i}" for i in range(20000))), (None, "no id here, just a few words"),
    (11, "<|endoftext|> x  y </s> [INST] <|turn|> 中文 ñ\x00\x1c"),
    (12, "tail " + " ".join(f"word{i}" for i in range(300)) + " end")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Rows that are easy to get wrong, with columns whose names the operators use inside."""
    rows = [(i, text, None if i in (2, 8) else "en", None, 3, "clash", 7) for i, text in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long, row string, _row int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
