import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th long, key string, node int, rank int, spans string, word string, label int"


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(["ba", "co", "di", "fu", "ga", "hé"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def messy_rows() -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, repeated rows, one id twice, periodic and long texts, clashing columns."""
    rnd = random.Random(11)
    base = [words(rnd, n) for n in (70, 120, 200, 90, 140)]
    texts: list[tuple] = []
    for k, w in enumerate(base):
        lines = [" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]
        texts.append((10 * k + 1, "\n".join(lines)))
        texts.append((10 * k + 2, "\n".join(lines)))  # exact copy
        near = list(w)
        near[3] = "changed"
        texts.append((10 * k + 3, "\n".join(" ".join(near[i : i + 12]) for i in range(0, len(near), 12))))
        texts.append((10 * k + 4, " ".join(words(rnd, 30)) + "\n" + " ".join(w[5:65]) + "\n" + " ".join(words(rnd, 20))))
    copied = texts[4]
    texts += [copied, copied, (5, texts[0][1].upper()), (7, "one two three"), (8, "One two three"), (9, "one two"), (60, None), (61, ""), (62, " \n\t "), (None, "no id " * 40), (None, None)]
    texts += [(1, "another text of the id one " * 30), (70, "abc " * 400), (71, "x" * 1500), (72, " ".join(words(rnd, 6000))), (73, "tail\n\n\n" + texts[0][1]), (74, "a b c d e f g h"), (75, "ſ ß it's <|endoftext|> 12ab\r\n“q”")]
    return [(i, t, "en", "s", len(t) if t is not None else None, 1, "k", 2, 3, None, "w", None) for i, t in texts]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def named():
    """(doc_id, text) of the rows that have an id; null text as empty."""
    return [(r[0], r[1] or "") for r in messy_rows() if r[0] is not None]
