"""URL rules, chat snapshots and source mixing against plain Python and SQL."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, mixing, oracles, queries, url_filter
from scriptorium.tables import table
from tests.llm.plain import draws


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    df = queries.queries()[name](spark, smallest)
    columns = sorted(df.columns)
    result = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in result.description]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    wanted = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == wanted and wanted


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en", "http://a.example.com/en/", "http://www.example.com/en/1",
    "http://x.www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/a", "http://x.net/ES/a", "http://net/fr/", "http://é.net#/fr/", "http://x.org/a://b.com/", "http://spam-farm.org/x", "http://spammy.org/x",
    "http://ads.x.org/", "http://x.org/login", "http://x.org/LOGIN/a", "http://x.org/loginx", "http://x.org/" + "a/" * 20_000, "http://x.org?u=http://www.example.com/en/", "x\n://b.net/es/\nq",
]
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_against_plain_python(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, rule string, host int")
    for row in url_filter.judged(df).collect():
        host, path, rule, action = plain_url(URLS[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), URLS[row["page_id"]]
        if action:
            assert row["verdict"] == action
    verdicts = {URLS[r["page_id"]]: r["verdict"] for r in url_filter.judged(df).collect()}
    assert [verdicts[u] for u in ("http://spam-farm.org/x", "http://spammy.org/x", "http://ads.x.org/", "http://x.org/login", "http://x.org/LOGIN/a", "http://x.org/loginx")] == ["block", "allow", "block", "block", "block", "allow"]


def test_parts_of_hosts_and_odd_columns(spark):
    urls = ["http://bestcasinos.org/x", "http://best.CASINO/", "http://x.org/bestcasinos", "http://casin.o/", "http://mytorrents.net/", "http://ads.x.org", "http://x.org/account/1", "http://x.org/accounts", "http://my-porn.org"]
    df = spark.createDataFrame([(i, u, "x", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, `a.b` string, url_fit int, VERDICT int")
    out = url_filter.judged(df)
    assert out.columns == ["page_id", "url", "a.b", "url_fit", "host", "path", "rule", "pattern", "verdict"]
    assert [r["verdict"] for r in out.orderBy("page_id").collect()] == ["block", "block", "allow", "allow", "block", "block", "block", "allow", "block"]
    assert url_filter.judged(df.limit(0)).collect() == []


def test_many_rules_and_limits(spark):
    rules = tuple(url_filter.listed_rule("block" if i % 2 else "allow", f"host{i}.org/p{i}/") for i in range(500)) + (url_filter.listed_rule("block", "org/a"),)
    df = spark.createDataFrame([(i, f"http://www.host{i}.org/p{i}/x") for i in range(0, 600, 7)] + [(1000, "http://z.org/abc")], "page_id long, url string")
    for r in url_filter.judged(df, rules).collect():
        i = r["page_id"]
        wanted = "org/a" if i == 1000 else f"host{i}.org/p{i}/" if i < 500 else None
        assert r["rule"] == wanted
    with pytest.raises(ValueError):
        url_filter._indexed(tuple(url_filter.listed_rule("allow", f"h{i}/") for i in range(url_filter.MAX_RULES + 1)))


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"),
    (4, 0, "user", "hi"),
    (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"),
    (6, 0, None, None), (7, 0, "unknown", ""), (8, None, "user", "a"), (8, 3, "user", "b"),
    (None, 0, "user", "lost"), (9, 0, "user", "say <|im_end|> now"), (10, 0, "user", "x" * 100_000),
]


def test_snapshots_collapse(spark):
    df = spark.createDataFrame([(*r, 9) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, place int")
    rows = {r["conv_id"]: r for r in chat.rendered(df).collect()}
    assert set(rows) == {2, 5, 6, 7, 8, 9, 10}
    assert (rows[2]["n_turns"], rows[2]["n_copies"]) == (3, 2) and rows[5]["n_turns"] == 2
    assert rows[2]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert rows[6]["chat"] == rows[7]["chat"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert rows[9]["chat"].count("<|im_end|>") == 1 and len(rows[10]["chat"]) > 100_000
    assert chat.rendered(df.limit(0)).collect() == []


def test_mixing_against_plain_python(spark, smallest):
    docs = [(r["doc_id"], r["source"]) for r in table(spark, smallest, "documents").collect()]
    wanted = Counter({i: n for (i, _), n in zip(docs, draws(docs)) if n})
    found = queries.op9_mixing(spark, smallest).select("doc_id", "copy_no").collect()
    assert Counter(r["doc_id"] for r in found) == wanted
    assert all(sorted(r["copy_no"] for r in found if r["doc_id"] == i) == list(range(1, n + 1)) for i, n in wanted.items())


def test_mixing_reaches_its_targets(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    out = mixing.mixed(df, {"hot": 1.0, "b": 3.0, "s1": 1.0}, size=1.0).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in out}
    assert set(counts) == {"hot", "b", "s1"}
    assert abs(counts["b"] / sum(counts.values()) - 0.6) < 0.01 and abs(sum(counts.values()) / 60_000 - 1) < 0.02


def test_both_joins_and_odd_rows(spark):
    rows = [(i, f"t{i}", None if i % 5 == 0 else f"s{i % 4}", 7) for i in range(200)] + [(None, None, "s1", 1), (3, "t3", "s3", 7), (3, "t3", "s3", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int")
    near = Counter(map(tuple, mixing.mixed(df).collect()))
    far = Counter(map(tuple, mixing.mixed(df, broadcast_bytes=0).collect()))
    assert near == far and mixing.mixed(df).columns == ["doc_id", "text", "source", "copy_no"]
    assert mixing.mixed(df.limit(0)).collect() == []
    assert mixing.mixed(df, {"absent": 1.0}).collect() == []


def test_placement_ignores_the_source(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "hot").otherwise("cold").alias("source"))
    sizes = [r["count"] for r in mixing.mixed(df, {"hot": 1.0, "cold": 1.0}).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.2 * min(sizes)


@pytest.mark.parametrize("rate", [399.0, 401.0, 428.3, 5000.0, 60_000.0])
def test_large_rates_are_drawn_exactly(spark, rate):
    """Copies of a source against the distribution function summed from logarithms, from zero on."""
    df = spark.createDataFrame([(i, "rare" if i < 20 else "common") for i in range(1000)], "doc_id long, source string")
    size = rate * 20 / 1000
    found = mixing.mixed(df, {"rare": 1.0}, size=size).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last")).collect()
    wanted = {}
    for i in range(20):
        u = (int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, total = 0, math.exp(-rate)
        while total < u:
            k += 1
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        wanted[i] = k
    assert {r["doc_id"]: r["n"] for r in found} == {r["doc_id"]: r["last"] for r in found} == wanted


def test_skewed_sources_pass_the_old_limit(spark):
    """The finding's table in small: the default weights give a single document's source a rate of over 400."""
    counts = [1] + [100_000] * 18 + [900_000]
    df = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("s"))
    docs = df.select(F.col("s").cast("string").alias("source"), F.explode(F.sequence(F.lit(1), F.element_at(F.array(*map(F.lit, counts)), F.col("s") + 1))).alias("doc_id"))
    rates = mixing.source_rates(docs)
    assert max(r["rate"] for r in rates.collect()) > 400
    row = rates.filter("source = '0'").select("rate", mixing.first_step(F.col("rate")).alias("first"), mixing.poisson_steps(F.col("rate")).alias("steps")).first()
    assert row["first"] > 0 and abs(row["steps"][-1] - 1) < 1e-12 and row["steps"] == sorted(row["steps"])


def test_odd_columns_and_lineage_in_the_mix(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("a.b"), F.lit(2).alias("mix_steps"), F.lit(3).alias("COPY_NO"))
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "source", "a.b", "mix_steps", "copy_no"] and 4700 < out.count() < 5300
