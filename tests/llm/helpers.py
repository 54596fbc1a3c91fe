"""Small tables with everything that an operator must get through."""

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row long, node long, "
              "bucket long, score double, hashes string, ids string, items string, block long, __key string, __id long")
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents (doc_id, text[, lang]) with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "k", 1, 2, 3, 0.5, "h", "i", "t", 4, "x", 5) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


ODD_TEXTS = ["", None, " ", "\n\t\r\x0b\x0c", "a", "word " * 3, "The same line.\n" * 40, "x" * 100_000,
             "é漢字\U0001f642 ½ ١٢٣ \x00\x01", "123 --- 456.", " 　\xa0", "THE SAME LINE.\n" * 40]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[3], None), (6, ODD_TEXTS[6], None), (None, "a null id", "en"), (None, "a null id", "en"), (None, None, None)]
    return docs(spark, rows)
