import random

import corpus_pipeline

from .helpers import documents, write_table


def word(rng):
    return "".join(rng.choice(["ta", "re", "mi", "so", "lu", "né"]) for _ in range(rng.randrange(1, 4)))


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(21)
    clean = ["\n".join(" ".join(word(rng) for _ in range(30)) for _ in range(4)) for _ in range(80)]
    junk = [" ".join(word(rng) + "$$$" for _ in range(120)) for _ in range(40)]
    items = [" ".join(word(rng) for _ in range(40)) for _ in range(4)]
    boiler = "all rights are reserved by the owner of this page"
    leaks = [clean[70] + "\n" + items[0]]
    texts = [*clean[:70], *junk, *leaks, clean[3], clean[5] + "\n" + boiler, clean[71] + "\n" + boiler, None, ""]
    docs = documents(spark, texts).selectExpr("*", "1 as key", "2 as fp")
    write_table(spark, tmp_path, "documents", docs)
    labels = [(i, int(i < 70), 0) for i in range(110)]
    write_table(spark, tmp_path, "labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    folder = write_table(spark, tmp_path, "benchmark", spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))

    seen, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) == {*range(70), 110, 111, 112, 113}
    assert seen[1][3] == clean[3] and seen[1][111] == "" and seen[1][112] == boiler and seen[1][113] == clean[71]
    assert set(seen[2]) == {*range(70), 110, 111, 112, 113}
    assert set(seen[3]) == {*range(70), 111, 112, 113}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    assert all(sum(p.length for p in packed if p.doc_id == r.doc_id) == r.doc_tokens for r in packed)


def test_empty_input(spark, tmp_path):
    write_table(spark, tmp_path, "documents", documents(spark, ["a"]).limit(0))
    write_table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    folder = write_table(spark, tmp_path, "benchmark", spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
