import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, size string, component_id long, gone long, base string, kept string, node long, l string, row int, t string, host string, n int, h int"

WORDS = "the of and river stone quietly under green morning light walked along narrow path with seven birds singing about old rain near white houses".split()


def prose(seed, n=120):
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + (str((seed * 31 + i) % 97) if i % 3 == 0 else "") for i in range(n)) + "."


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    extra = (1, "x", 5, 6, "b", "k", 7, "l", 8, "t", "h", 9, 3)
    base = [(i, prose(i), "en" if i % 2 else "de", f"s{i % 3}", 10) for i in range(12)]
    base += [(20, prose(3), "en", "s1", 1), (21, prose(3).replace("river", "lake", 1), "en", "s1", 1), (22, None, "en", None, None), (23, "", None, "s1", 0), (24, " \t\n ", "en", "s2", 3), (None, prose(4), None, None, None), (None, None, None, None, None)]
    base += [(25, "one two", "en", "s0", 7), (26, "ONE\x0btwo", "en", "s0", 7), (25, "one two", "en", "s0", 7), (27, "12345 !!!   ???", "en", "s0", 9), (28, "word " * 60_000, "en", "s2", 300_000), (29, "x" * 200_000, "de", "s2", 200_000)]
    base += [(30, 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" and mail a.b@c.de, +1 (555) 555-0100', "en", "s0", 80)]
    rows = [(*b, *(extra if k % 2 else (None,) * 13)) for k, b in enumerate(base)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark, messy):
    return spark.createDataFrame([], messy.schema)
