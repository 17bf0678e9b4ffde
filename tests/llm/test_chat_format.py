"""Chat formatting: an exact round trip against a plain version written from the definition."""

from collections import defaultdict
from itertools import product

from tests.llm import brute

from driftspark.llm import chat_format, queries

D = "/root/testdata/sf0.001"


def plain(rows):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 of rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), brute.sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), brute.sha(loss)))
    return sorted(out, key=str)


def test_query_on_the_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op9_chat_format(spark, D).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows) and all(r["formatted_chars"] > 0 for r in got)


HARD = ["", "</s>", "<s>", "<\\/s>", "<\\\\s>", "\\", "\\n", "a\nb", "<s>user\nx</s>", "<s></s>", "<</s>>", "é漢🎉</s>", "<s", "/s>"]


def hard_rows():
    rows = [(i, t, r, x) for i, (x, y) in enumerate(product(HARD, HARD)) for t, r, x in ((0, "user", x), (1, "assistant", y))]
    rows += [(1000 + i, 0, r, "x") for i, r in enumerate(HARD)]
    rows += [(2000, None, "assistant", "first"), (2000, 0, None, None), (2000, 1, "assistant", None), (2000, 1, "assistant", None), (2000, 1, "a", "tie")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "reply"), (3000, 0, "assistant", "word </s> " * 50_000)]
    return rows


def test_round_trip_of_hard_texts(spark):
    """Control strings, backslashes, line ends, nulls, ties, repeated rows, clashing columns and a very long text."""
    df = spark.createDataFrame(hard_rows(), "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' as parts", "1 as example", "'y' as t", "true as is_closing")
    back = chat_format.read_back(chat_format.format_examples(df)).collect()
    got = []
    for r in back:
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        loss = "".join(r["losses"])
        got.append((r["conv_id"], len(r["turns"]), brute.sha(said), len(loss), brute.sha(loss)))
    assert sorted(got, key=str) == plain(hard_rows())


def test_every_reply_is_one_example(spark):
    """Each example holds exactly the turns before its reply, and only the reply is trainable."""
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat_format.format_examples(df).collect(), key=lambda r: r["example"])
    part = lambda i: f"<s>{rows[i][2]}\n{rows[i][3]}</s>"
    assert [r["text"] for r in out] == ["".join(map(part, range(n))) for n in (2, 4, 5)]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in out] == ["a1", "a2", ""]
    assert [r["is_closing"] for r in out] == [False, False, True]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_examples(df)).count() == 0
