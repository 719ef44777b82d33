DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, source=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", (source or (lambda i: "s"))(i), None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
