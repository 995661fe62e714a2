"""Small fixtures shared by the operator tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def write_table(spark, folder, name, df):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
