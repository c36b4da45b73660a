"""Rows that every operator must bear: nulls, empty and long texts, ties and repeats, columns with names that operators use."""

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, word string, hash long, part int, component string, kept string, score string, lane string, slot string"


def awkward(spark):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six seven eight"), (5, "one two three four five six seven eight"), (6, "x" * 5000), (7, "word " * 3000), (8, "é ñ ü 日本語 ▁mark▁ \U0001f600"), (9, "A\nB\n\nA\n"), (None, "no id here at all")]
    return spark.createDataFrame([(i, t, None, "s" if i and i % 2 else None, 0, 1, "w", 2, 3, "c", "k", "s", "l", "t") for i, t in rows], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)
