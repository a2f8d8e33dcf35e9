"""Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label double, n_words string, _text string, row int, kept string"


def prose(seed: int, n: int, letters: str = "aeioulnrst") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_rows() -> list[tuple]:
    long = prose(1, 9_000)
    near = prose(2, 120).split()
    texts = [
        (1, None, "en"), (2, "", None), (3, " \t\n\x0b\x0c\r ", "en"), (4, long, "en"), (5, " ".join(near), "en"),
        (6, " ".join(near), "en"), (7, " ".join(near[:60] + ["other"] + near[61:]), "de"), (7, prose(3, 80), None), (8, "word", "xx"),
        (None, prose(4, 100), "en"), (None, None, None), (9, "a\nb\nb\n\nc d e f g\nc d e x g\nc d e g\n", "en"),
        (10, "é" * 300 + " 日本 " + "𝔘" * 50, "fr"), (11, "same same same " * 40, "en"), (11, "same same same " * 40, "en"), (12, long + " " + long, "en"),
    ]
    return [(i, t, lang, None, None, 1.0, "x", "y", 3, "no") for i, t, lang in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
