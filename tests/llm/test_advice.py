"""Cases of the review."""

import random

from lattika.llm import decontaminate, langid, line_dedup

BENCH = "item_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_item_across_two_rows(spark):
    """A row that ends with the first part of an item holds no match, whatever the next row begins with."""
    rng = random.Random(1)
    item = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)]
    rows = [(1, " ".join(["x", "y", *item[:12]])), (2, " ".join([*item[12:], "z"])), (3, " ".join(["q", *item]))]
    bench = spark.createDataFrame([(7, " ".join(item))], BENCH)
    got = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs(spark, rows), bench).collect()]
    assert got == [(3, 7, 0)]
    assert [r.doc_id for r in decontaminate.clean(docs(spark, rows), bench).collect()] == [1, 2]


def test_short_items_match_exactly(spark):
    bench = spark.createDataFrame([(1, "Who was Kant?"), (2, "kant"), (3, "..."), (4, None)], BENCH)
    rows = [(1, "so who was, kant then"), (2, "who is kant"), (3, "who was"), (4, None), (5, "was kant who")]
    got = {(r.doc_id, r.item_id, r.edits, r.start_word) for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert got == {(1, 1, 0, 1), (1, 2, 0, 3), (2, 2, 0, 2), (5, 2, 0, 1)}


def test_langid_reads_whole_texts_without_spaces():
    assert langid.letters("x") == [b"x"] and langid.letters("12!") == [] and langid.letters("l'eau,vive") == [b"l", b"eau", b"vive"]
    for word in ("é" * 100, "a" + "字" * 50, "z" * 24, "z" * 25, "हिन्दी" * 9):
        pieces = langid.letters(word)
        assert b"".join(pieces).decode() == word and all(len(p) <= 24 and p.decode() for p in pieces)
    model = langid.fit([("aa", ["sung", "bung", "tung"] * 40), ("bb", ["cado", "dado", "gado"] * 40)])
    one = ",".join(["sung"] * 6 + ["cado"] * 90)
    tagger = langid.Tagger(model)
    lang, score = tagger.label([one, one.replace(",", " "), "sung", "12", None])
    assert lang == ["bb", "bb", "aa", "und", "und"] and abs(score[0] - score[1]) < 1e-9
    assert tagger.label(["".join(["sung"] * 6 + ["cado"] * 90)])[0] == ["bb"]


def test_dedup_lines_of_rows_without_own_ids(spark):
    rows = [(None, "first line of a\nonly in a"), (None, "first line of a\nonly in b here"), (None, "other start\nsecond of c stays"), (4, "p q r s\nonly in a"), (4, "t u v w\nx y z"), (4, "t u v w\nx y z"), (5, None)]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect() if r.text is not None)
    texts = [x for _, t in got for x in t.split("\n")]
    assert texts.count("first line of a") == 1 and texts.count("only in a") == 1
    for x in ("only in b here", "other start", "second of c stays", "p q r s"):
        assert x in texts
    assert got[-2:] == [(4, "t u v w\nx y z")] * 2
