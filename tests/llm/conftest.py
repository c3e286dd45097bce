import random

import pytest

WORDS = "the of and stone river walks under bright seven lamps near old mill water turns slowly night wind carries sand across far plain".split()
CLASHES = "id string, fp string, doc string, sub string, row string, spans string, label string, score string, words string, lines string, kept string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "e", "ing", "s", str(rng.randrange(99))]) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Texts with nulls, blanks, copies, near copies, shared passages, odd characters, a long one, and repeated rows."""
    passage = prose(1, 60)
    texts = [
        None, "", "   \n\t ", "one", "One two", prose(2, 80), prose(2, 80), prose(2, 79) + " changed", prose(2, 80).upper(),
        "ab" * 200, "a" * 700, prose(3, 40) + "\n" + passage, passage + "\n" + prose(4, 40), prose(5, 20) + passage + prose(6, 20),
        prose(7, 6000) + " " + passage, "é" * 150 + " ñandú 漢字 " * 30, "line one here\nline one here\n\nline one here\n" * 9,
        "Released under the MIT License. " + prose(8, 60), "say <|endoftext|> \x00 and ▁ blanks   here  " * 12, prose(9, 300), prose(9, 299),
    ]
    texts += [prose(100 + i, 55) for i in range(12)] + [prose(10, 70)] * 9
    rows = [(10 * i + 3, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[11]]  # whole rows again
    rows += [(43, prose(11, 90), "en", "s0", 1), (43, prose(2, 80), "en", "s0", 1)]  # an id with several texts
    rows += [(None, prose(2, 80), "en", None, 0), (None, None, None, None, None), (-7, prose(12, 90), "en", "s0", 1)]
    return [(*r, *["x"] * 11) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def plain(spark):
    """The rows of :func:`messy` whose id is not null and stands once."""
    rows = messy_rows()
    ids = [r[0] for r in rows]
    return spark.createDataFrame([r for r in rows if r[0] is not None and ids.count(r[0]) == 1], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labelled(spark):
    """Texts with labels that their words decide: symbols are bad, two terms and a stem are toxic."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        bad, toxic = i % 7 == 0, i % 5 == 0
        words = prose(1000 + i, 90).split()
        if bad:
            words = [w + rng.choice(["***", "%%%", "&&&"]) for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "dimwitted", "zorgan", "zorgel", "zorgix"]))
        docs.append((i, " ".join(words), "en", "s", 1, *["x"] * 11))
        labels.append((i, int(not bad), int(toxic), "y"))
    labels += [(None, 1, 1, "y"), (5, None, None, "y"), (10_000, 1, 0, "y"), (7, 9, 9, "y")]
    return (spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
