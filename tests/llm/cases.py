"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeats, columns with clashing names."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", _text string, _id long, rep long, size long, key string, shard int, node long"


def documents(spark, rows, clashing=False):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
    if clashing:
        return spark.createDataFrame([(*r, "t", 1, 2, 3, "k", 4, 5) for r in full], DOCUMENTS + CLASHING)
    return spark.createDataFrame(full, DOCUMENTS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same words in here, five."), (5, "same  words\nin here, five."), (5, "same  words\nin here, five."), (None, "no id at all"), (6, "long " * 40_000), (7, "é\U0001f600 漢字" * 50), (8, "x")]
