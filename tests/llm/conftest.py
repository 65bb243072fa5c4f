import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    """Documents with every case at once: nulls, empty and long texts, copies, near copies, repeated rows and ids, shared passages."""
    r = random.Random(11)
    stems = {"en": ["the", "of", "and", "walking", "trees", "over", "hills", "Some", "rivers"], "fr": ["le", "été", "où", "forêt", "maison", "des", "Quand", "rouge"], "de": ["der", "und", "größe", "Straße", "ist", "über", "Wälder"]}
    text = lambda lang, n: " ".join(r.choice(stems[lang]) + r.choice(["", "", "s", "ly", "x" + str(r.randrange(99))]) for _ in range(n))
    passage = text("en", 64)
    out = []
    for i in range(70):
        lang = ["en", "fr", "de"][i % 3]
        body = text(lang, r.randrange(5, 160))
        if i % 9 == 4:
            cut = r.randrange(len(body.split()))
            words = body.split()
            body = "\n".join([" ".join(words[:cut]), passage, " ".join(words[cut:])])
        out.append((i, body, lang))
    out += [(100 + k, out[k][1], out[k][2]) for k in (3, 3, 7)]  # copies; id 100 + 3 comes twice
    for k in range(8):  # near copies
        words = out[12 + k][1].split() * 2
        words[r.randrange(len(words))] = f"edit{k}"
        out += [(200 + k, " ".join(out[12 + k][1].split() * 2), out[12 + k][2]), (220 + k, " ".join(words), out[12 + k][2])]
    out += [(300, None, "en"), (301, "", "en"), (302, " \n\t\x0b ", None), (303, "Ab", "en"), (304, "one two three four", "en"), (305, "ONE two three four", "en"), (306, "12 34 %%", None)]
    out += [(307, text("en", 9000), "en"), (308, "a" * 3000, "en"), (309, "la la " * 400, "fr"), (None, "no id at all", "en"), (310, "x y\x85z w \x1c q", "en"), (303, "other words under the id 303", "en")]
    return [(i, t, lang, f"s{k % 4}", len(t or "")) for k, (i, t, lang) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def known(rows):
    """(doc_id, text) of the rows that have an id, by id and text."""
    return sorted((i, t or "") for i, t, *_ in rows if i is not None)


def clashing(df):
    """The frame with extra columns named like the operators' own and their inner ones."""
    from pyspark.sql import functions as F

    names = ("n_words", "n_removed", "g", "docs", "bucket", "id", "key", "mark", "rep", "hub", "root", "score", "kept", "item_id", "dealt_to", "piece", "length", "spans", "data", "kind")
    return df.withColumns({n: F.lit(f"extra {n}") for n in names})
