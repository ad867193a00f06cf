import random

import duckdb
import numpy as np
import pytest

from tests.compare import rows_of, rows_of_sql
from veilspark.llm.queries import OP5_SQL, OP7_SQL, oracle_sql
from veilspark.llm.topk import Shard, flips, top_k
from veilspark.llm.urls import RULES, filter_urls


def sql_rows(frame, name, sql):
    db = duckdb.connect()
    db.register("pandas_rows", frame.toPandas())
    db.execute(f"CREATE VIEW {name} AS SELECT * FROM pandas_rows")
    return rows_of_sql(db, sql)


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2?x=1", "http://WWW.Example.COM/en/3#f", "http://x.www.example.com/en/", "http://example.com/de/4", "http://example.com", "http://example.com?q", "http://b.net/es/5", "http://b.net/fr/6.html",
    "http://b.net/en/7", "http://c.org/en/8", "http://c.org/es/9", "http://b.net/es", "ftp://host/path://x", "no scheme", "", None, "http://", "http://é.com/ü", "http://c.org/" + "a" * 5000, "://com/", "http://com/", "http://xcom/", "http://a.com/\n/x",
]


def test_urls_match_sql(spark):
    rows = [(i % 40, u, "x", "y") for i, u in enumerate(URLS * 4)] + [(None, f"http://d{i}.net/{k}/{i}", "", "") for i in range(30) for k in ("es", "en")] + [(None, f"https://m{i}.com/{i}", "", "") for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, bin string")
    found = filter_urls(frame).drop("figure")
    assert rows_of(found) == sql_rows(frame.select("page_id", "url"), "pages", oracle_sql()["op4_url_filter"])
    rule = {r.host + r.path: (r.rule, r.verdict) for r in found.collect()}
    assert rule["www.example.com/en/2"] == ("www.example.com/en/", "allow") and rule["a.example.com/en/1"] == ("example.com/en/", "block") and rule["x.www.example.com/en/"][0] == "www.example.com/en/"
    assert rule["b.net/es/5"] == ("net/es/", "block") and rule["b.net/en/7"][0] is None and rule["example.com"][0] is None and rule["com/"][0] == "com/"


@pytest.mark.parametrize("urls", [[], ["http://c.org/x"], [None, None], ["http://a.com/x"]])
def test_urls_without_labels_of_both_kinds(spark, urls):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert {r.verdict for r in filter_urls(frame).collect()} <= {"allow", "block"} and filter_urls(frame).count() == len(urls)


def test_url_filter_runs_no_python(spark):
    frame = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.net/es/1")], "page_id long, url string")
    plan = filter_urls(frame)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in plan] and len(RULES) == 5


def test_model_tells_unseen_urls_apart(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcd')}.com/{word('abcd')}") for i in range(150)] + [(200 + i, f"http://{word('wxyz')}.net/es/{word('wxyz')}") for i in range(150)]
    asked = [(1000 + i, f"http://{word('abcd')}.org/{word('abcd')}") for i in range(40)] + [(2000 + i, f"http://{word('wxyz')}.org/{word('wxyz')}") for i in range(40)]
    found = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows + asked, "page_id long, url string")).collect()}
    assert sum(found[i] == ("allow" if i < 2000 else "block") for i, _ in asked) >= 76


def vectors(spark, n=500):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a code that many share
    rows += [(2000, rows[3][1]), (2000, rows[3][1])]  # a row that repeats
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")


def test_top_k_matches_sql(spark):
    frame = vectors(spark)
    assert rows_of(top_k(frame, shards=3)) == sql_rows(frame.select("vec_id", "embedding"), "embeddings", OP7_SQL)


def test_top_k_handles_odd_rows(spark):
    rows = [(0, [1.0] * 64), (100, None), (None, [1.0]), (1, [float("nan"), None, -1.0]), (2, []), (200, [1.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r.neighbor_id, r.distance) for r in found} == {(0, 200, 63), (0, 1, 64), (0, 2, 64), (200, 1, 1), (200, 2, 1), (200, 0, 63)}
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    with pytest.raises(Exception, match="more than 64"):
        top_k(spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("n, words", [(1, 1), (300, 1), (6000, 1), (300, 2)])
def test_radius_grows_until_the_kth_is_proved(n, words):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 2**63, (n, words), dtype=np.uint64), axis=0)
    index = Shard([c.tobytes() for c in codes], [[i] for i in range(len(codes))])
    for q in range(0, len(codes), max(1, len(codes) // 20)):
        far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        brute = sorted((int(d), i) for i, d in enumerate(far) if i != q)[:5]
        assert index.search(q, codes[q].tobytes(), 5) == brute


def test_flips_are_all_masks():
    assert sorted(flips(4, 2)) == [3, 5, 6, 9, 10, 12]


def test_chat_sql_agrees_on_odd_rows(spark):
    from veilspark.llm.chat import format_chats

    frame = spark.createDataFrame([(1, 0, "user", "a<b[c\\d"), (1, 1, "assistant", "e|f"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], frame.schema)
    assert rows_of(format_chats(frame.union(extra)).drop("shared_chars", "intervals")) == sql_rows(frame, "conversations", OP5_SQL)
