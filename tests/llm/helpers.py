"""Rows and texts that several tests share."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("h", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("row", T.StringType()),
        T.StructField("label", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()),
        T.StructField("rng", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("kind", T.StringType()),
    ]
)


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, tiny, very long, non-ASCII, repeated and id-less rows."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base.upper(), "en", "b"), (4, None, "en", "a"), (5, "", None, "b"),
        (6, " \t\n\x0b\x0c\r ", "en", None), (7, "one two", "en", "b"), (8, "One  TWO", "en", "b"), (9, "123 456 !!", "de", "c"),
        (10, "▁ mark " + "ñandú € 😀\n\tüber", "es", "c"), (11, prose(5, 9000), "en", "a"), (12, "x" * 70_000, "en", "a"),
        (13, prose(6, 80, "klmnopqrst"), "de", "c"), (13, prose(6, 80, "klmnopqrst"), "de", "c"), (None, prose(7, 40), "en", "a"),
        (None, None, None, None), (14, (prose(8, 20) + "\n") * 5, "en", "b"), (15, "a b c d e", "en", "b"), (16, "a b c d e", "en", "b"),
    ]
    return [(*t, len(t[1]) if t[1] is not None else None, *["x"] * 9) for t in texts]
