"""Every registered query with SQL gives the rows of its SQL; the others run."""

import glob
import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import scriptorium.plans.registry as registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for path in glob.glob(f"{smallest}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, smallest, name):
    df = registry.queries()[name](spark, smallest)
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = [tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 100


def test_kinsoku_reads_all_documents(spark, smallest):
    found = {r["doc_id"] % 4 for r in registry.queries()["kinsoku_lines"](spark, smallest).select("doc_id").distinct().collect()}
    assert found == {0, 1, 2, 3}


#: Lines with what trims, patterns and classes of letters may take differently.
ODD_LINES = (
    "12|34", "99 | 7", "--- @ 5", "_12_", "½", "Ⅷ 3", "12\x1f", "5​6", "́", "٣٤", "№ 5", " x", "　x　", "\tfoo", "foo\t", "foo\r", "Ends here.\r", "Ends here.\u0085",
    "Ends here. ", "Ends ", "open line", "open line ", "a. ", "", "   ", "1219 É", "é 11", "中文。", "\r", "#1*2|", "ࡰ", "\U00031350 7", "10 abc", "Title src0",
)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents of such lines in many orders; null texts, sources and an id, a document twice."""
    r = random.Random(3)
    texts = ["\n".join(r.choices(ODD_LINES, k=r.randrange(1, 30))) for _ in range(300)] + [None, "", "open line\nopen line\n5|6\nEnds", "\n".join(["open line"] * 12 + ["1219 É"]), "only here\n7|89"]
    ids = [*range(300), 301, 302, None, 303, 304]
    sources = [r.choice(["src0", "src1 ", "\tsrc", None, ""]) for _ in texts]
    rows = [*zip(ids, texts, sources), (7, texts[7], sources[7])]
    path = tmp_path_factory.mktemp("odd")
    table = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": [x[1] for x in rows], "lang": ["en"] * len(rows), "source": [x[2] for x in rows], "n_chars": pa.array([len(x[1] or "") for x in rows], pa.int64())})
    pq.write_table(table, path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["document_only", "merge_candidates", "merge_proposals", "segment_states", "untranslated_segments"])
def test_query_on_odd_texts(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    found = Counter(tuple(r[c] for c in names) for r in registry.queries()[name](spark, odd).collect())
    assert found == Counter(result.fetchall()) and found


@pytest.mark.parametrize("name", ["row_limits", "placements"])
def test_query_on_odd_keys(spark, tmp_path, name):
    """Parts whose keys are repeated, null and negative, of no size and of none known."""
    rows = [(k, None if k is None or k % 7 == 0 else k * 5 % 50 + i) for k in (*range(-90, 600), None) for i in range(3) if i == 0 or k is None or k % 4 == i]
    pq.write_table(pa.table({"p_partkey": pa.array([k for k, _ in rows], pa.int64()), "p_size": pa.array([x for _, x in rows], pa.int32())}), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    found = Counter(tuple(plain(r[c]) for c in names) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert found == Counter(tuple(plain(x) for x in row) for row in result.fetchall()) and found


def test_untranslated_segments_on_every_character(spark, tmp_path):
    """Each assigned character beside a digit and around a line of the dictionary, long documents, a null text in the dictionary."""
    characters = [chr(c) for c in (*range(0x33000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c <= 0xDFFF and c != 10]  # planes with letters
    texts = ["\n".join(f"{c} 1\n{c}k{c}" for c in characters[i : i + 8192]) for i in range(0, len(characters), 8192)] + ["k\n12", None, "", "k"]
    ids = [*(3 * i + 1 for i in range(len(texts) - 4)), 0, 3, 6, None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    registry.queries()["untranslated_segments"](spark, str(tmp_path)).write.parquet(str(tmp_path / "found"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    con.execute(f"create table wanted as {registry.oracle_sql()['untranslated_segments']}")
    con.execute(f"create view found as select doc_id, id from '{tmp_path}/found/*.parquet'")
    assert con.execute("from wanted except all from found limit 9").fetchall() == con.execute("from found except all from wanted limit 9").fetchall() == []
    assert con.execute("select count(*) > 200000 from wanted").fetchone()[0]
