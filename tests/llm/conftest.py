import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    vocabulary = ["the", "Of", "mit", "łódź", "ÉTÉ", "alpha", "beta", "gamma", "naïve", "x1", "ß", "日本語"]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 8, 20, 40, 40, 300)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, None), (None, "no id at all"), (None, None)]
    rows += [(24, prose[5]), (25, prose[5].replace(" ", "\n\t ")), (26, prose[5] + " "), (26, prose[5] + " ")]
    rows += [(27, prose[4]), (27, prose[6]), (28, "word " * 30_000), (29, "word " * 30_000 + "end")]
    rows += [(30, "a\x1cb <|endoftext|>  İÍ K Σ"), (31, "!!! ... ???")]
    full = [(i, t, None if k % 3 else "en", None if k % 4 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["row_key", "word", "words", "n", "fp", "root", "shard_", "keep_id", "score", "start", "arc", "labels", "kept"]
    return odd_docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
