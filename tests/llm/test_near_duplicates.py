"""Near-duplicate classes and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import components, near_copies, queries
from scriptorium.llm import simhash_dedup as sd
from scriptorium.tables import table
from tests.llm.plain import classes, fingerprint


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one two", "The  the\x0bTHE the", "É Éa x y z w", "a b c d e f g " * 40])
def test_fingerprint(text):
    assert sd.simhash64(sd.word_shingles(text, 3)) == fingerprint(text)


def test_query_against_brute_force(spark, smallest):
    rows = queries.op1_simhash_dedup(spark, smallest).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, smallest, "documents").collect()}
    assert len(rows) == len(docs)
    prints = {i: fingerprint(t) for i, t in docs.items()}
    wanted = classes(prints)
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
    assert len(set(wanted.values())) < len(docs)


@pytest.mark.parametrize("block_rows", [20_000, 12, 3])
def test_links_against_brute_force(spark, block_rows):
    """Families of fingerprints a few bits apart, chains included, also when meeting places are cut into blocks."""
    r = random.Random(7)
    values = set()
    for _ in range(12):
        center = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 40])):
            v = center
            for b in r.sample(range(64), r.randrange(0, 5)):
                v ^= 1 << b
            values.add(v)
            center = v if r.random() < 0.2 else center
    values |= {0, 1, 3, (1 << 64) - 1}
    prints = dict(enumerate(sorted(values)))
    signed = [(int(np.uint64(v).astype(np.int64)), i) for i, v in prints.items()]
    distinct = spark.createDataFrame(signed, "fp long, rep long")
    links = sd.hamming_links(distinct, 3, block_rows)
    for u, v in {(x["u"], x["v"]) for x in links.collect()}:
        assert (prints[u] ^ prints[v]).bit_count() <= 3
    roots = {x["node"]: x["root"] for x in components.component_roots(links).collect()}
    assert {i: roots.get(i, i) for i in prints} == classes(prints)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_smaller_radius(spark, radius):
    prints = {0: 0, 1: 1, 2: 3, 3: 7, 4: 1 << 40, 5: (1 << 40) | 1}
    df = spark.createDataFrame([(v, i) for i, v in prints.items()], "fp long, rep long")
    roots = {x["node"]: x["root"] for x in components.component_roots(sd.hamming_links(df, radius)).collect()}
    assert {i: roots.get(i, i) for i in prints} == classes(prints, radius)


def test_long_chain_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components.component_roots(edges.unionByName(edges).unionByName(spark.createDataFrame([(900, 901), (5, 5)], "u long, v long"))).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp string, rep int, component_id int, u int"
    rows = [(3, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, None), (8, ""), (9, " \n"), (1, "a b c d"), (20, "entirely different words stand here"), (None, "alone in its class it has no name")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
    found = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in sd.near_duplicate_classes(docs).collect() if r["doc_id"] is not None)
    assert found == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 7, 7), (False, 8, 7), (False, 9, 7), (False, 20, 20)]
    nameless = sorted(str(r["component_id"]) for r in sd.near_duplicate_classes(docs).collect() if r["doc_id"] is None)
    assert nameless == ["1", "None"]
    assert sd.near_duplicate_classes(docs.limit(0)).collect() == []


def _with_prints(monkeypatch, prints):
    """near_duplicate_classes over rows (doc_id, fp) whose fingerprints are given."""
    monkeypatch.setattr(sd, "fingerprints", lambda docs, *_: docs.select("doc_id", "fp"))
    return sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in sd.near_duplicate_classes(prints).collect())


def test_links_through_rows_without_id(spark, monkeypatch):
    """7 and 15 are linked only through a row without an id; so are three fingerprints that meet at one place."""
    big = (1 << 53) + 1
    rows = [(15, 0), (None, 0b111), (7, 0b111111), (big, 1 << 40), (None, (1 << 40) | 1), (big + 2, (1 << 40) | 2), (None, 0x0F0F0F0F0F0F0F0F)]
    found = _with_prints(monkeypatch, spark.createDataFrame(rows, "doc_id long, fp long"))
    # 1 << 40 is one bit from zero, so the two families are one class; the last row is alone and has no name
    assert found == sorted((str(i), fp, None if fp == 0x0F0F0F0F0F0F0F0F else 7) for i, fp in rows)


def test_ids_above_doubles_beside_a_row_without_id(spark, monkeypatch):
    big = (1 << 53) + 1
    rows = [(big, 0), (None, 1), (big + 2, 3), (big + 4, 7)]
    found = _with_prints(monkeypatch, spark.createDataFrame(rows, "doc_id long, fp long"))
    assert found == sorted((str(i), fp, big) for i, fp in rows)


def _jaccard(a, b, words=5):
    x, y = (set(sd.word_shingles(t, words)) for t in (a, b))
    return len(x & y) / len(x | y)


def _edited_copies(count, seed=3):
    """Pairs (text, its edited copy) of invented prose."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(3000)]
    for _ in range(count):
        text = r.choices(words, k=r.randint(60, 400))
        copy = [w if r.random() > 0.02 else r.choice(words) for w in text]
        yield " ".join(text), " ".join(copy)


@pytest.mark.parametrize("block_rows", [20_000, 2])
def test_near_copies_against_brute_force(spark, block_rows):
    """Of edited copies with a likeness of 0.8 or more at least 0.9 share a group; unrelated texts never do."""
    pairs = list(_edited_copies(150))
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    groups = {}
    for row in near_copies.near_copy_groups(docs, block_rows=block_rows).collect():
        groups.setdefault(row["group"], []).append(row["first"]["doc_id"])
    joined = {m // 2 for members in groups.values() if len(members) == 2 for m in members}
    assert all(len({m // 2 for m in members}) == 1 for members in groups.values())
    alike = {i for i, p in enumerate(pairs) if 0.8 <= _jaccard(*p) < 1}
    assert len(alike) > 60 and len(alike & joined) >= 0.9 * len(alike)


def test_links_of_near_copies_are_within_the_radius(spark):
    texts = [t for p in _edited_copies(40, seed=5) for t in p]
    prints = [near_copies.wide_fingerprint(sd.word_shingles(t, 5)) for t in texts]
    nodes = spark.createDataFrame([(i, bytearray(fp), bytearray(u)) for i, (fp, u) in enumerate(prints)], "node long, fp binary, unsure binary")
    links = near_copies.near_links(nodes, 50).collect()
    assert links
    for u, v in links:
        a, b = (int.from_bytes(prints[x][0], "big") for x in (u, v))
        assert (a ^ b).bit_count() <= 50


def test_wide_fingerprint_by_hand():
    """Each bit is the majority of the shingles' bits; the unsure bits are those with the closest votes."""
    import xxhash

    shingles = sd.word_shingles("one two three four five six seven eight nine", 5)
    bits = [[int(c) for c in "".join(f"{xxhash.xxh3_128(s, seed=k).intdigest():0128b}" for k in (1, 2))] for s in shingles]
    sums = np.array(bits).sum(axis=0)
    fp, unsure = near_copies.wide_fingerprint(shingles)
    assert np.unpackbits(np.frombuffer(fp, np.uint8)).tolist() == (2 * sums > len(shingles)).astype(int).tolist()
    places = np.frombuffer(unsure, np.uint8).reshape(16, -1)
    margins = np.abs(2 * sums - len(shingles))
    assert all(sorted(margins[s * 32 : s * 32 + 32])[:8] == sorted(margins[s * 32 + places[s].astype(int)]) for s in range(8))
    assert near_copies.wide_fingerprint([]) == (bytes(32), near_copies.wide_fingerprint([])[1])


def test_one_of_each_group_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [
        (3, long + " end", "a", 1), (1, long, "b", 1), (1, long, "a", 2), (None, long, "a", 1),
        (1, "an unrelated text under an id that another document has", "a", 1),
        (7, None, "a", 1), (8, "", "a", 1), (9, " \n", "a", 1),
        (None, "nameless words that stand in no other document of this table", "a", 1), (None, "nameless words that stand in no other document of this table", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` string, near_print int")
    kept = near_copies.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), (r["text"] or "")[:8], r["x.y"], r["near_print"]) for r in kept.collect())
    assert found == sorted([("1", "w0 w1 w2", "a", 2), ("1", "an unrel", "a", 1), ("7", "", "a", 1), ("None", "nameless", "a", 1)])
    assert near_copies.keep_one_of_each_group(docs.limit(0)).collect() == []


def test_invalid_utf8_is_hashed_as_it_stands(spark):
    docs = spark.sql("select cast(id as long) as doc_id, cast(case when id < 2 then x'61ff62' else x'61' end as string) as text from range(3)")
    assert sorted((r["doc_id"], r["component_id"]) for r in sd.near_duplicate_classes(docs).collect()) == [(0, 0), (1, 0), (2, 2)]
    assert near_copies.keep_one_of_each_group(docs).count() == 2
