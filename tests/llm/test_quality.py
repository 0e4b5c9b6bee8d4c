import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from drawseries.llm import quality as Q
from drawseries.llm.queries import QUERIES

from ..conftest import SF_MID
from .conftest import ODD


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    held = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(held),
            len(w) < 50 or 100 * len(held) > 50 * len(w))


def test_measures_match_brute_force(docs_of):
    texts = [t for _, t in ODD] + ["a b c a b c a", "a a a a", "x\ny\nx\n \n\ny\nx", "#*$%&|<> \x0b\x0c p\rq", "é 🙂 x  y", "a b c\n" * 40,
                                   "q w e r t " * 3 + "z", "\n", "one two three one two"]
    docs = docs_of(list(enumerate(texts))).withColumn("n_words", F.lit("clash")).withColumn("base_failed", F.lit("clash"))
    got = {r.doc_id: tuple(r[c] for c in (*Q.MEASURES, "base_failed")) for r in Q.measure(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_cells_are_narrow_and_merge(spark):
    values = [*range(200), 1000, 1023, 1024, 12345, 10 ** 9, 2 ** 40 + 7]
    got = {r.v: r.c for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.cell(F.col("v")).alias("c")).collect()}
    for v, c in got.items():
        assert c <= v and (v < 64 and c == v or v - c < max(c, 1) / 31)
    m = Q.measure(spark.createDataFrame([(i, "w%d " % (i % 50) * 3 + "k %d " * 60 % tuple(range(i, i + 60)), "en", f"s{i % 3}")
                                         for i in range(60)], "doc_id long, text string, lang string, source string"))
    whole = sorted(map(tuple, Q.sketches(m).select("rule", "cell", "n").collect()))
    parts = sorted(map(tuple, Q.merged(Q.sketches(m, "source")).select("rule", "cell", "n").collect()))
    assert whole == parts


def page(i, symbols=0, long=0):
    return " ".join([f"{'w' * (4 + (i + k) % 3)}{i}x{k}" + "#" * symbols + "z" * long for k in range(60)])


def test_thresholds_follow_the_group(spark):
    rows = [(i, page(i), "en", "web") for i in range(150)]
    rows += [(1000 + i, page(i, symbols=2), "en", "code") for i in range(150)]              # usual there
    rows += [(2000, page(7, symbols=2), "en", "web"), (2001, page(8, long=30), "en", "code")]
    rows += [(3000 + i, page(i), "fr", None) for i in range(5)] + [(4000, page(1, symbols=9), None, "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = {r.doc_id: r for r in Q.judged(df, "text", "lang", "source", "doc_id").collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.kept} == {2000, 2001, 4000}
    assert got[2000].reasons == "symbols" and got[2001].reasons == "word_length"


def test_odd_rows_and_sql(spark, docs_of, tmp_path):
    rows = [(*r, ["en", None, "de"][i % 3], ["a", None][i % 2]) for i, r in enumerate(ODD)]
    rows += [(50 + i, page(i), "en", "a") for i in range(120)] + [(500, page(3) + "\n" + page(3), "en", "a")]
    docs = docs_of(rows).withColumn("kept", F.lit("clash")).withColumn("rule", F.lit("clash"))
    out = Q.judged(docs, "text", "lang", "source", "doc_id")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons"]
    path = str(tmp_path / "documents.parquet")
    docs.drop("kept", "rule").toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(Q.oracle()).fetchall()
    assert sorted(map(tuple, out.select(cols).collect()), key=str) == sorted(want, key=str)
    assert Q.judged(docs_of([]), "text", "lang", "source", "doc_id").count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op13_adaptive_quality"](spark, SF_MID)._jdf.queryExecution().toString()
    plan += Q.measure(spark.read.parquet(f"{SF_MID}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
