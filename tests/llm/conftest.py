import pytest


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(WORDS[(i * 7 + i // 19) % 19] + str(i % 311) for i in range(6000))
    edited = long.replace("alpha0 ", "omega ")
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", "x"),
        (2, "The quick  brown\tfox jumps over the lazy dog.", "en", "a", "y"),
        (2, "The quick  brown\tfox jumps over the lazy dog.", "en", "a", "y"),
        (3, None, None, None, None),
        (4, "", "fr", "b", None),
        (5, " \n\t ", "fr", None, "z"),
        (6, long, "en", "b", "z"),
        (7, edited, "en", "c", "z"),
        (8, "été où ça\nça l'île\n\n", "fr", "c", "z"),
        (9, "12345 !!! ---", None, "c", "z"),
        (None, "no number here", "en", "d", "z"),
        (10, "no number here", "en", "d", "z"),
        (11, "a" * 5000, "en", "\U0001f600", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, TEXT_ string").toDF("doc_id", "text", "lang", "source", "label").selectExpr("*", "label as class", "label as c0", "label as digest")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
