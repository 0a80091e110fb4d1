"""The registered queries on the smallest tables: against SQL, or else against brute force."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return {
        k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, t in texts
    }


def rows(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, SF).collect()]


def test_one_query_for_each_operator():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got) == sorted(result.fetchall())


def test_op1(spark, ids):
    got = rows(spark, "op1_pack")
    ends, fill = dict.fromkeys(ids, 0), {}
    for key, start, n, crc, total, sequence, offset in sorted(got):
        assert start == ends[key] and total == len(ids[key])
        assert zlib.crc32(ids[key][start : start + n].tobytes()) == crc
        ends[key] += n
        fill.setdefault(sequence, []).append((offset, n))
    assert ends == {k: len(x) for k, x in ids.items()}
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048


def test_op2(spark, ids):
    start, want = 0, []
    for key in sorted(ids):
        want.append((key, start, len(ids[key]), zlib.crc32(ids[key].tobytes())))
        start += len(ids[key])
    assert sorted(rows(spark, "op2_token_files")) == want


def test_op3(spark, texts):
    want = brute.passages([t for _, t in texts])
    got = sorted(rows(spark, "op3_passages"))
    assert got == [(k, *w) for (k, _), w in zip(texts, want)]


def test_op5(spark, texts):
    order, want = texts[::-1], []
    for i, (key, text) in enumerate(order):
        other, half = order[(i + 1) % len(order)][1], len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        want.append((key, len(text), brute.sha(changed.encode())))
    got = rows(spark, "op5_fingerprints")
    assert sorted(r[:3] for r in got) == sorted(want)
    assert all(0 <= x <= 1 for r in got for x in r[5:])
    assert np.mean([r[5] > r[6] for r in got]) > 0.9


def test_op6(spark, texts):
    want = brute.suffixes(texts)
    assert {r[0]: r[1:] for r in rows(spark, "op6_suffixes")} == want


def test_op8(spark, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(spark, "op8_language")
    assert len(got) == len(langs)
    assert np.mean([lang == langs[k] for k, held, lang, _ in got if held]) > 0.97


def test_op10(spark, texts):
    fp = [brute.fingerprint(t) for _, t in texts]
    root = brute.components(fp)
    want = [(k, f"{f:016x}", texts[c][0]) for (k, _), f, c in zip(texts, fp, root)]
    assert sorted(rows(spark, "op10_simhash")) == want
