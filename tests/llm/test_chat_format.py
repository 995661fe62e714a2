import hashlib
import random
import re

from ledgerlens.llm.chat_format import format_conversations, op4_chat_format, read_back

from .helpers import write_table

SCHEMA = "conv_id long, turn long, role string, text string, back string"


def rows_of():
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\", "x", "é😀", "\n", "<s esc=1>", "</", "s>", "$1", ""]
    rows = [(0, 0, "user", "plain"), (0, 1, "assistant", "ok [/INST] < \\"), (1, 1, None, None), (1, None, "assistant", "a<")]
    for conv in range(2, 60):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "sys[/INST]", "a</s>b"]), text))
    rows += [(None, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    return [(*r, "extra") for r in rows]


def wanted(rows):
    convs = {}
    for c, turn, role, text, _ in rows:
        convs.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}


def parse_again(text):
    """The grammar once more, as a plain scanner."""
    head = re.match(r"<s esc=([01])>", text)
    turns, body = [], text[head.end() :]
    while body:
        assert body.startswith("[INST]")
        role, _, rest = body[6:].partition("[/INST]")
        said, _, body = rest.partition("</s>")
        pair = (role, said)
        if head[1] == "1":
            pair = tuple(re.sub(r"([\\<\[])\\", r"\1", x) for x in pair)
        turns.append(pair)
    return turns


def test_round_trip(spark):
    rows = rows_of()
    back = read_back(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    want = wanted(rows)
    assert len(back) == len(want)
    for r in back:
        assert [tuple(t) for t in r.turns] == want[r.conv_id] == parse_again(r.formatted)
        assert r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    plain = next(r for r in back if r.conv_id == 0)
    assert plain.formatted == "<s esc=0>[INST]user[/INST]plain</s>[INST]assistant[/INST]ok [/INST] < \\</s>"


def test_query_digests(spark, tmp_path):
    rows = rows_of()
    write_table(spark, tmp_path, "conversations", spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in op4_chat_format(spark, str(tmp_path)).collect()}
    want = wanted(rows) | {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    write_table(spark, tmp_path, "conversations", spark.createDataFrame([], SCHEMA))
    assert [r.conv_id for r in op4_chat_format(spark, str(tmp_path)).collect()] == [-1]
