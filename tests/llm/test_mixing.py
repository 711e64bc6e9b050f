"""The mix as a corpus: shards, kept columns, odd tables."""

import random
from collections import Counter

import brute

from lattika.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, size string"


def corpus(spark, n=600):
    rng = random.Random(12)
    rows = [(rng.choice([None, i, i // 2]), "w " * rng.randint(0, 30), rng.choice(["a", "b", "b", None]), f"l{i}", "own") for i in range(n)]
    rows += [(7, "same text", "a", "x", "own")] * 3 + [(8, None, "a", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_taken_is_the_sum_of_the_shards(spark):
    docs, rows = corpus(spark)
    for r in mixing.mix(docs, levels=3).collect():
        assert r.taken == sum(x.words for x in r.draws) and len({x["pass"] for x in r.draws}) == len(r.draws)
        assert all(0 < x.words <= r.size and 0 <= x.shard < 8 for x in r.draws)


def test_mixed_keeps_columns_and_drops_what_is_not_taken(spark):
    docs, rows = corpus(spark)
    out = mixing.mixed(docs, levels=2)
    got = out.collect()
    assert set(out.columns) == set(docs.columns) | {"source_size", "target", "taken", "n_copies", "shards", "shuffle_key", "draws"}
    plan = mixing.mix(docs, levels=2).collect()
    assert sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got) == sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in plan if r.taken)
    langs = Counter(r[3] for r in rows)
    assert all(n <= langs[x] for x, n in Counter(r.lang for r in got).items())
    by_lang = {r[3]: r for r in rows if r[3] != "x"}
    assert all((r.doc_id, r.text, r.source) == by_lang[r.lang][:3] and r.size == len(brute.words(r.text)) for r in got if r.lang != "x")
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_written_shards_hold_every_draw(spark, tmp_path):
    docs, rows = corpus(spark)
    got = mixing.mixed(docs, levels=2)
    mixing.write_shards(got, f"{tmp_path}/out")
    want = Counter((x.shard, r.lang, x.words) for r in got.collect() for x in r.draws)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.shard, r.lang, r.words) for r in back.select("shard", "lang", "words").collect()) == want


def test_tree_draws_every_quota_exactly(spark):
    units = spark.createDataFrame([(s, f"{b:03x}", p) for s, n in (("sa", 300), ("sb", 41), ("null", 1)) for b in range(n) for p in (1, 2)], "name string, block string, pass int")
    leaves = mixing._tree(units, 4, "x").collect()
    per = Counter()
    for r in leaves:
        per[r.name] += r.n
    assert per == {"sa": 600, "sb": 82, "null": 2}
    sizes = Counter()
    for r in leaves:
        sizes[r.node] += r.n
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    # Counts are hypergeometric: near their share, not equal to it.
    got = [r.n for r in leaves if r.name == "sb"]
    assert 82 / 16 - 5 < sum(got) / 16 < 82 / 16 + 5 and len(set(got)) > 2


def test_texts_move_once_where_no_rows_are_alike(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(40)]
    for more in ([], rows[:3]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, source string")
        out = mixing.mixed(docs, levels=2)
        want = sorted((r.doc_id, r.taken) for r in mixing.mix(docs, levels=2).collect() if r.taken)
        assert sorted((r.doc_id, r.taken) for r in out.collect()) == want
        assert all(r.text == rows[r.doc_id][1] for r in out.collect())
        assert ("_turn_" in out._jdf.queryExecution().optimizedPlan().toString()) == bool(more)
