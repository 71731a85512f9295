"""Rows for the tests of the training-data operators."""

CLASH = "score double, kept boolean, hash long, pos int, n int, name string, kind string, word string, host string, template int"
CLASHING = (0.5, True, 1, 2, 3, "x", "y", "z", "h", 4)


def clash(spark, pairs, id_col="doc_id", text_col="text"):
    """Rows (id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *CLASHING) for i, t in pairs], f"{id_col} long, {text_col} string, {CLASH}")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
