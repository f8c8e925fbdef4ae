"""Small hard tables: nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def rows() -> list[tuple]:
    out = [(i, prose(i, 20 + i % 40), ("en", "de")[i % 2], f"s{i % 3}", 1) for i in range(60)]
    out += [
        (60, None, None, None, None), (61, "", "en", "s1", 0), (62, "  \n\t ", "de", None, 5), (63, "word", "en", "s0", 4),
        (64, prose(3, 23), "en", "s2", 9), (65, prose(3, 23).replace(" ", "\n  "), None, "s2", 9),  # copies of 3 but for white space
        (66, "long " * 30_000, "en", "s1", 150_000), (67, "x" * 200_000, "de", "s0", 200_000),
        (5, prose(5, 25), "de", "s2", 1), (5, prose(5, 25), "de", "s2", 1),  # a repeated row
        (None, "a row without id", "en", "s1", 16), (None, None, None, None, None),
    ]
    return out


def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    """The same with columns named like those that operators work with or return."""
    from pyspark.sql import functions as F

    names = ("size taken target source_size weight shard slot law pieces node comp key keys kept digest heavy keep_id group_size "
             "_digest _ident _key _s _c _at _p _score score n_lines n_removed n_found kinds spans line site block bin length").split()
    return hard(spark).select("*", *[F.lit("own").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
