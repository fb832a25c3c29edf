import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrel.llm import infill, queries
from tests.llm.helpers import docs_of


def brute(doc_id, text, rate=100, spm=50, seed=7):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", t, None, None
    if h4 % 100 < spm:
        return len(u), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(u), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def corpus():
    rng = random.Random(3)
    signs = ["a", "bc", " ", "\n", "\n\n", "\r\n", "é", "😀", "$1", "\\", "<P", "S>", "<", "<<S", " ", "\x85", "\t", "{2}"]
    texts = [None, "", "\n", "x", "a<P>b\nc", "<S>", "q\n<M", "\n\n\n", "a\nb", "a\nb\n", " \n\x85", "word " * 40_000,
             "line\n" * 60_000, "no end " * 30_000 + "\nend"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return list(enumerate(texts)) + [(None, "a\nb\nc\n"), (None, None), (5, "other\ntext"), (20, texts[20])]


@pytest.mark.parametrize("params", [infill.InfillParams(), infill.InfillParams(seed=1, rate=60, spm=20)])
def test_against_brute_force(spark, params):
    rows = corpus()
    d = docs_of(spark, rows).withColumn("first", F.lit(1)).withColumn("both", F.lit("x")).withColumn("n", F.lit(0)).repartition(4)
    out = infill.fill_in_middle(d, params=params)
    assert out.columns == d.columns + ["fim_units", "fim_form", "fim_text"]
    p, m, s = infill.parts("fim_text", "fim_form", params)
    got = out.select("doc_id", "text", "fim_units", "fim_form", "fim_text", F.length(p), F.length(m),
                     infill.restored("fim_text", "fim_form", params)).collect()
    assert len(got) == len(rows)
    for i, t, n, form, text, pc, mc, back in got:
        assert (n, form, text, pc, mc) == brute(i, t, params.rate, params.spm, params.seed)
        assert back == (t or "")
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_sql_on_a_fixture(spark, tmp_path):
    docs_of(spark, [r for r in corpus() if r[0] is None or len(r[1] or "") < 1000]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["op13_fill_in_middle"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_plan_has_no_shuffle_and_no_python(spark, tmp_path):
    docs_of(spark, ["a\nb"]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert infill.fill_in_middle(docs_of(spark, [])).count() == 0


def test_markers_are_checked():
    with pytest.raises(ValueError):
        infill.InfillParams(prefix="<P>", suffix="<P>")
    with pytest.raises(ValueError):
        infill.InfillParams(prefix="<P<", suffix="<S>")
    with pytest.raises(ValueError):
        infill.InfillParams(prefix="P", suffix="S")
