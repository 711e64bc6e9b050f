"""The strict parser, the escaping loop and the loss mask."""

from pyspark.sql import functions as F

from lattika.llm import chat_format as C

SCHEMA = "conv_id long, turn int, role string, text string, formatted string"


def test_parser_is_strict(spark):
    good = [("<|im_start|>user\nhi<|im_end|>\n", [("user", "hi")]), ("", []), ("<|im_start|>\n<|im_end|>\n<|im_start|>a\nb\nc<|im_end|>\n", [("", ""), ("a", "b\nc")])]
    bad = ["<|im_start|>user\nhi", "<|im_start|>user\nhiXXXXXXXXXXX", "x<|im_start|>user\nhi<|im_end|>\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>us<|im_end|>er\nb<|im_end|>\n", "hi", "<|im_start|>user\nhi<|im_end|>\n<|im_start|>"]
    df = spark.createDataFrame([(t,) for t, _ in good] + [(t,) for t in bad], "t string").select("t", C.parse(F.col("t")).alias("p"))
    got = {r.t: r.p for r in df.collect()}
    for t, turns in good:
        assert got[t] is not None and [tuple(x) for x in got[t]] == turns, t
    assert [t for t in bad if got[t] is not None] == []


def test_only_conflicts_are_escaped_and_the_mask_marks_assistant_texts(spark):
    texts = ["plain <|im_ end|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x<|im_start|>", "", None, "\U0001f600 é\n", "<" * 50 + "|im_end|>", "<|im_end|>" * 20]
    rows = [(c, t, r, x, "y") for c, x in enumerate(texts) for t, r in enumerate(["user", "assistant", "assistant", "a\nb", "<|im_start|>"])] + [(50, t, "assistant", "a" * (t % 7), "y") for t in range(300)]
    out = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.round_trip for r in out.values())
    for c, r in out.items():
        own = [(a, x or "") for k, _, a, x, _ in rows if k == c]
        pieces = [r.formatted[m.start : m.start + m.length] for m in r.loss_mask]
        said = [x for a, x in own if a == "assistant"]
        assert len(pieces) == len(said)
        if c in (0, 4, 5, 6, 50):
            assert pieces == said and r.n_escaped == (2 if c != 50 else 0)
        else:
            assert all(p != s and p.replace("\\", "") == s.replace("\\", "") for p, s in zip(pieces, said, strict=True))


def test_digest_of_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.chat_digest(df).count() == 0
    twice = spark.createDataFrame([(1, 0, "assistant", "é", "x")] * 2 + [(1, None, None, None, None)], SCHEMA)
    r = C.chat_digest(twice).first()
    assert (r.n_turns, r.loss_chars, r.round_trip) == (3, 2, True)
