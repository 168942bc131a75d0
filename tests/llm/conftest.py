import pytest

TEXTS = {
    0: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and more words follow here",
    1: "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and more words follow here",
    2: "Intro first. alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi then another end",
    3: None,
    4: "",
    5: "  \t\n ",
    6: "word",
    7: "Word",
    8: "mail me at joe.doe@example.com or 192.168.0.1, card 4111 1111 1111 1111, tel +1 (555) 123-4567 now",
    9: "été déjà vu où ça naïve façade, garçon; ÉCOLE \u0001 x\u00a0y 你好 \U0001f600 end",
    10: "same line\n" * 40,
    11: "x" * 300,
    12: "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and more words follow there",
    13: "999.999.1.1 1234 5678 +12 @ a@b a@b.c @x.y 1.2.3.4.5.6.7.8 00000000000000000 +1--------2 not pii",
    14: "the quick brown fox " * 400,
}


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated phrases, and extra columns with names that operators use."""
    rows = [(d, t, None if d % 7 == 3 else ("en", "fr")[d == 9], "src", len(t or ""), d, "x", 1) for d, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
