import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node int, n int, score double, tid int, label string, regs string, page int, rate double, part int"
EXTRA = ("k", 1, 2, 0.5, 3, "l", "r", 4, 1.5, 5)


def _text(i, words=40):
    return " ".join(f"{('alpha', 'beta', 'gamma', 'delta', 'omega')[(i * 7 + j * j) % 5]}{(i * 31 + j * 17) % 97}" for j in range(words))


LONG = " ".join(f"wort{i * i % 9973}" for i in range(60_000))
ROWS = [
    *((i, _text(i), ("en", "de")[i % 2], f"s{i % 3}", 1) for i in range(30)),
    (100, None, "en", "s0", None),
    (101, "", None, None, 0),
    (102, " \n\t ", "en", "s1", 3),
    (103, "12 34 !!", "de", "s1", 8),
    (104, "a", "en", "s2", 1),
    (105, LONG, "en", "s0", len(LONG)),
    (106, LONG + " end", "en", "s0", len(LONG) + 4),
    (107, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC cc by nc", "en", "s2", 1),
    (107, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC cc by nc", "en", "s2", 1),
    (108, _text(1), "de", None, 1),
    (None, _text(2), None, "s1", None),
    (None, None, None, None, None),
    (109, "ünï cöde straße 日本語 テスト 🙂 ÉÉÉ", "de", "s2", 30),
    *((200 + i, "the same copy of words that many documents hold without any change at all", "en", "s0", 1) for i in range(40)),
]


def write(spark, folder, docs, labels, vectors, turns):
    out = str(folder)
    spark.createDataFrame([(*d, *EXTRA) for d in docs], DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int, cell int").write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, line string").write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, extra columns of clashing names."""
    labels = [(i, i % 3 > 0, int(i % 5 == 0), "x") for i in range(30)] + [(None, 1, 0, None), (3, None, 1, None), (4, 1, None, None), (7777, 1, 1, None)]
    vectors = [(i, [float((i * 7 + j) % 5 - 2) for j in range(8)], 0, 1) for i in range(300)]
    vectors += [(400, None, None, None), (None, [1.0] * 8, 0, 0), (500, [1.0, None] * 4, 0, 0), (501, [float("nan")] * 8, 0, 0), (502, [float("inf")] * 8, 0, 0), (503, [], 0, 0), (600, [0.5] * 3, 0, 0), (7, [9.0] * 8, 0, 0), (700, [1e30] * 8, 0, 0), (800, [3e12] * 8, 0, 0)]
    turns = [(c, t, ("user", "assistant")[t % 2], f"words of {c} and {t}?\nmore", "l") for c in range(6) for t in range(5)]
    turns += [(9, None, None, None, None), (9, 0, "user", "", None), (None, 0, "user", "hello", None), (None, None, None, None, None), (10, 1, "judge", "odd role", None), *[(11, 0, "user", "again", None)] * 5]
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS, [(a, b if b is None else int(b), c, d) for a, b, c, d in labels], vectors, turns)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])
