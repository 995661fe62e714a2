import random

from ledgerlens.llm.line_dedup import dedup_lines, op2_line_dedup

from .helpers import documents, write_table


def test_lines_of_few_words(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    near = long[:150] + "中文" + long[152:]
    url = "https://example.org/" + "".join(rng.choice("abcdef") for _ in range(40))
    texts = ["Read more\n" + long, "read  more!\n" + near, "Read less\n" + url, url + "\n---\n\n---", "一二\n一三"]
    write_table(spark, tmp_path, "documents", documents(spark, texts))
    rows = {r.doc_id: r.removed for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert rows == {0: [], 1: [0, 1], 2: [], 3: [0], 4: []}
    assert dedup_lines(documents(spark, ["", "a", "a"]), short=True).where("text = 'a'").count() == 1
