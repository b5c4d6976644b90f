import pytest

#: doc_id, text, lang, source: nulls, empty and long texts, ties, copies, repeated rows, odd characters.
LONG = " ".join(f"word{i % 997} is{i % 13}" for i in range(30_000))
PROSE = "The river rose again in the night and by morning the lower road was closed to all but the heaviest carts, and those who had stayed behind carried what they could to the mill where the floors were dry."
ROWS = [
    (1, PROSE + " One.", "en", "a"),
    (2, PROSE + " One.", "en", "a"),
    (2, PROSE + " One.", "en", "a"),
    (3, PROSE + " Two three.", "en", "b"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", "xx", "b"),
    (7, LONG, "en", "a"),
    (8, "x" * 50_000, "en", "c"),
    (9, "É une <|endoftext|> ½ Ⅷ 漢字 Σας İ don't ▁ \x00 \x1c\x85 fin\n\n", "fr", "c"),
    (10, "four words only here", "en", "a"),
    (11, "Four  words\nonly here", "en", "a"),
    (None, "a text without a number", "en", "b"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above among columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["row", "label", "node", "key", "part", "slot", "size", "word", "train", "turn", "mix_slot", "n_tokens", "_bytes", "bands"]
    table = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return table.withColumns({n: F.lit("x") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
