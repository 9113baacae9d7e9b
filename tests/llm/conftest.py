from __future__ import annotations

import random

import pytest

#: Columns whose names the operators use inside.
CLASHES = "name long, n long, digest string, keep_id long, kept boolean, shard int, slot long, start long, word string, row long, list string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def prose(seed: int, count: int, letters: str = "abcdefghij") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(count))


def table(spark, texts: list[tuple[int | None, str | None]]):
    rows = [(i, t, None, "s", None, 1, 2, "d", 3, True, 4, 5, 6, "w", 7, "l") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS)


def nasty_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages, several scripts."""
    base, shared = prose(1, 120), prose(2, 60)
    long = prose(3, 60_000)
    texts: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n"), (None, None), (None, "Null id " + prose(4, 50)), (None, "Null id " + prose(4, 50)),
        (4, base), (5, base), (6, base.replace(" ", " \n", 5)), (6, base.replace(" ", " \n", 5)), (7, base + " tail"), (8, "x " + base.upper()),
        (9, long), (10, long[:200_000] + " cut"), (11, "one"), (12, "one two"), (13, "ONE two"), (14, "日本語 テキスト é ü " + prose(5, 80)),
        (-3, prose(6, 40)), (1 << 62, prose(6, 40)), (15, "ab" * 400), (16, "ab" * 150), (17, prose(7, 30) + " " + shared), (18, shared + " " + prose(8, 35)),
        (19, shared), (19, "same id, other text " + prose(9, 20)),
    ]
    texts += [(100 + k, prose(50 + k, 12) + " " + prose(1000, 25) + " " + prose(80 + k, 12)) for k in range(25)]
    words = prose(200, 150).split()
    for k in range(20):  # a group of near copies
        words_k = list(words)
        words_k[7 * k % 150] = f"changed{k}"
        texts.append((300 + k, " ".join(words_k)))
    return texts


@pytest.fixture(scope="session")
def nasty(spark):
    return table(spark, nasty_texts()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
