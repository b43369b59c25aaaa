"""What the tests of the corpus operators share."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

#: Extra columns whose names clash with those the operators use.
CLASH = "id long, fp long, n long, key string, hash string, row long, rep string, component_id long, score double, copy int, items string, v string, doc string, __rate double, __of string, __copies int, __text string, __hashes string, __once string, __key string, h long, mark string"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if not extra:
        return spark.createDataFrame(full, schema)
    return spark.createDataFrame([(*r, *[None] * len(CLASH.split(","))) for r in full], f"{schema}, {CLASH}")


#: Texts that are null, empty, white, without letters, odd, repeated and very long.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "12 34 !!"), (5, "same words here"), (5, "same words here"), (6, "same words here"), (None, "a row without an id"), (7, "x" * 200_000), (8, "word " * 40_000), (9, "éß \U0001f600 Ж"), (10, "one"), (11, "Two\nlines\n\nand\ttabs\x0b")]
