"""Queries that take whole texts and keys."""

from ledgerlens.plans import registry


def test_turns_of_whole_texts(spark, tmp_path):
    long = "parse " * 100 + "ledger"
    rows = [(1, 0, "user", long), (1, 1, "user", "x " * 300 + "ledger"), (1, 2, "user", "parse"), (41, 0, "user", "parse"), (2, 3, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.conv_id, r.turn): r.overlap for r in registry.QUERIES["turn_word_overlap"](spark, str(tmp_path)).collect()}
    assert found == {(1, 0): round(1 / 101, 6), (1, 1): 0.0}


def test_edges_of_whole_directories(spark, tmp_path):
    link = lambda *to: " ".join(f'<a href="{t}">' for t in to)
    rows = [(1, "http://h/alpha/x", link("/alto/y", "/alto/z", "/alpha/y")), (2, "http://h/alto/y", link("/beta/b/c?p=1"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in registry.QUERIES["directory_graph_edges"](spark, str(tmp_path)).collect()}
    assert found == {("h/alpha", "h/alto", 2), ("h/alto", "h/beta/b", 1)}
