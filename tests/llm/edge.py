"""A small table with the awkward rows every operator has to survive."""

import hashlib

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "_text string, kept boolean, n long, h long, root long, size long, `a.b` string")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))

TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two three"), (5, "one TWO three"),
    (6, "one two three four five"), (7, BASE), (8, BASE), (8, BASE), (9, BASE.upper()),
    (10, BASE + " end"), (11, "start " + BASE + " end"), (12, OTHER + "\n" + BASE), (13, LONG),
    (14, LONG), (15, "la " * 50), (16, "Grüße Ωδή 日本語 привет 🙂 x y"), (17, "line a\nline b\nline c\nline d"),
    (18, "zero\nline a\nline b\nline c\nline d"), (19, "line a\nline b\nline c\nline d\n\n\n"),
    (None, "no id"), (None, None), (20, "x" * 3000), (21, "12345 67890 !!"), (-5, OTHER), (2**40, OTHER),
]


def edge_rows():
    return [(i, t, ["en", "de", None][k % 3], ["src", "b", None, "é"][k % 4], len(t or ""),
             "clash", True, k, k, k, k, "dot") for k, (i, t) in enumerate(TEXTS)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return (text or "").encode().split()
