"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

A document is measured once, in its own row.  Each rule looks at a ratio of the
measures as a whole number; for every language and source the ratios are counted
in a log-linear sketch: numbers below ``LINEAR`` are cells of their own, each power
of two above is cut into ``LINEAR / 2`` cells, so a cell is known to within 1 part
in 32 and a sketch has a bounded number of cells.  Sketches merge by adding counts,
in any order and with the same result, so they are partial aggregates of a shuffle
and the sketches of a language and of the corpus are sums of finer ones.

A group's threshold lies ``FENCE`` spreads beyond its quartile, where the spread is
the distance of its quartiles, or the rule's least one if that is larger.  A group
of fewer than ``LEAST`` documents takes the sketch of its language, and a language
of fewer that of the corpus.  The thresholds, a small table, are joined back to the
measures (not to the texts) and documents beyond any are not kept.

Rules: mean letters of a word (both sides), symbols to words, repeated lines to
lines, words in repeated windows to words (upper side).  Sketches hold documents
that do not fail the base rule.

Defined cases: a null text has no words; texts without words fail the base rule; a
null language or source is a value of its own; repeated rows are counted and judged
each; an empty table gives no rows; measured columns replace others of their names,
all other columns pass through.  Windows of three words are told apart by 64-bit
hashes of the three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Characters between words, and those counted as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
LINEAR = 64
FENCE, LEAST = 3, 100

#: rule -> (numerator, factor, denominator, least spread, whether there is a lower side)
RULES = {
    "word_length": ("word_chars", 1000, "n_words", 300, True),
    "symbols": ("n_symbols", 10000, "n_words", 300, False),
    "duplicate_lines": ("n_dup_lines", 1000, "n_lines", 150, False),
    "repeated_words": ("n_repeat_words", 1000, "n_words", 100, False),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of every whole text and base_failed."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "base_failed")]
    row = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    row = row.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    row = row.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, n = F.col("w"), F.size("w")
    # hashes of the three-word windows, in place order
    row = row.withColumn("h", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<long>")))
    # by hash, then place; only where some hash repeats
    row = row.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, last = F.col("s"), F.size("s") - 1
    row = row.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"]))),
        lambda x: x["i"])))
    p = F.col("p")
    # each repeated window adds the words that the one before it did not hold
    repeated = F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, j - 1)))),
                           F.lit(0), lambda a, x: a + x)
    got = row.select(
        "row", n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return got.select("row.*", *MEASURES, failed.alias("base_failed"))


def cell(v: Column) -> Column:
    """The least number of the sketch's cell that holds ``v`` (not negative)."""
    drop = F.greatest(F.length(F.bin(v)) - (LINEAR.bit_length() - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def ratio(rule: str) -> Column:
    top, factor, under, _, _ = RULES[rule]
    return F.floor(F.col(top) * factor / F.greatest(F.col(under), F.lit(1))).cast("long")


def sketches(measured: DataFrame, *group: str) -> DataFrame:
    """(group, rule, cell, n): the sketch of each rule's ratio in each group.

    Documents that fail the base rule are counted in no cell (null), so that every group has a row.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.when(~F.col("base_failed"), cell(ratio(r))).alias("cell"))
                                for r in RULES]))
    return measured.select(*group, rules.alias("r")).groupBy(*group, "r.rule", "r.cell").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *group: str) -> DataFrame:
    """Sketches of coarser groups: counts of the same cell added."""
    return sketch.groupBy(*group, "rule", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, rule, docs, q1, q3) from a sketch's cells, which are few in each group."""
    cells = F.sort_array(F.collect_list(F.struct("cell", "n")))
    held = sketch.groupBy(*group, "rule").agg(cells.alias("cells"), F.sum("n").alias("docs"))

    def at(share: int) -> Column:                       # least cell with at least share quarters of the documents up to it
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("q"))
        return F.aggregate("cells", start, lambda a, c: F.struct(
            (a["n"] + c["n"]).alias("n"),
            F.coalesce(a["q"], F.when(4 * (a["n"] + c["n"]) >= share * F.col("docs"), c["cell"])).alias("q")))["q"]
    return held.select(*group, "rule", "docs", at(1).alias("q1"), at(3).alias("q3"))


def limits(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, docs, and for each rule its low and high): what a document of the group may have.

    ``docs`` counts the documents of the sketch that the group took.
    """
    every = staged(sketches(measured, lang, source), "sketches")
    fine = every.where("cell is not null")
    by_lang = merged(fine, lang)
    whole = quartiles(merged(by_lang)).select("rule", *[F.col(c).alias(f"a_{c}") for c in ("docs", "q1", "q3")])
    middle = quartiles(by_lang, lang).select(F.col(lang).alias("l_lang"), F.col("rule").alias("l_rule"),
                                             *[F.col(c).alias(f"l_{c}") for c in ("docs", "q1", "q3")])
    # every group that has a document, even if none passes the base rule
    groups = every.select(lang, source, "rule").distinct()
    own = quartiles(fine, lang, source).select(F.col(lang).alias("o_lang"), F.col(source).alias("o_source"), F.col("rule").alias("o_rule"),
                                               *[F.col(c).alias(f"o_{c}") for c in ("docs", "q1", "q3")])
    joined = (groups.join(own, groups[lang].eqNullSafe(F.col("o_lang")) & groups[source].eqNullSafe(F.col("o_source"))
                          & (groups["rule"] == F.col("o_rule")), "left")
              .join(middle, groups[lang].eqNullSafe(F.col("l_lang")) & (groups["rule"] == F.col("l_rule")), "left")
              .join(whole, "rule", "left"))

    def taken(c: str) -> Column:
        return (F.when(F.col("o_docs") >= LEAST, F.col(f"o_{c}")).when(F.col("l_docs") >= LEAST, F.col(f"l_{c}"))
                .otherwise(F.col(f"a_{c}")))
    got = joined.select(lang, source, "rule", taken("docs").alias("docs"), taken("q1").alias("q1"), taken("q3").alias("q3"))
    out = []
    for rule, (_, _, _, least, both) in RULES.items():
        spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("rule") == rule
        out.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{rule}_high"))
        if both:
            out.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"{rule}_low"))
    return got.groupBy(lang, source).agg(F.max("docs").alias("docs"), *out)


def judge(measured: DataFrame, allowed: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with kept and reasons (names of the failed rules, joined by commas)."""
    bounds = [c for c in allowed.columns if c not in (lang, source, "docs")]
    table = allowed.select(F.col(lang).alias("of_lang"), F.col(source).alias("of_source"),
                           F.struct(*bounds).alias("allowed"))
    kept = [c for c in measured.columns if c not in ("kept", "reasons")]
    rows = measured.select(F.struct(*[measured[c] for c in kept]).alias("row"), *[measured[c].alias(f"m_{c}") for c in (lang, source)],
                           *[ratio(r).alias(f"r_{r}") for r in RULES])
    met = rows.join(table, F.col(f"m_{lang}").eqNullSafe(F.col("of_lang")) & F.col(f"m_{source}").eqNullSafe(F.col("of_source")))
    failed = [F.when(F.col("row.base_failed"), F.lit("base"))]
    for rule, (*_, both) in RULES.items():
        beyond = F.col(f"r_{rule}") > F.col("allowed")[f"{rule}_high"]
        if both:
            beyond = beyond | (F.col(f"r_{rule}") < F.col("allowed")[f"{rule}_low"])
        failed.append(F.when(~F.col("row.base_failed") & beyond, F.lit(rule)))
    reasons = F.concat_ws(",", *failed)
    return met.select("row.*", (reasons == "").alias("kept"), reasons.alias("reasons"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *keep: str) -> DataFrame:
    """Measures and verdicts of ``docs`` without their texts: the texts are read once, the measures written."""
    names = [c for c in dict.fromkeys((*keep, lang, source))]
    measured = staged(measure(docs, text).select(*names, *MEASURES, "base_failed"), "measures")
    return judge(measured, staged(limits(measured, lang, source), "limits"), lang, source)


def oracle() -> str:
    """The query of the documents table in DuckDB SQL."""
    bits = LINEAR.bit_length() - 1
    ratios = ", ".join(f"CAST(floor({top} * {factor} / greatest({under}, 1)) AS BIGINT) AS {rule}"
                       for rule, (top, factor, under, _, _) in RULES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS v FROM m WHERE NOT base_failed" for r in RULES)

    def quart(group: str, name: str) -> str:
        cols = f"{group}, " if group else ""
        return f"""{name} AS (SELECT {cols}rule, max(total) AS docs, min(cell) FILTER (4 * upto >= total) AS q1,
                min(cell) FILTER (4 * upto >= 3 * total) AS q3
         FROM (SELECT {cols}rule, cell, sum(n) OVER (PARTITION BY {cols}rule ORDER BY cell) AS upto,
                      sum(n) OVER (PARTITION BY {cols}rule) AS total
               FROM (SELECT {cols}rule, cell, sum(n) AS n FROM fine GROUP BY {cols}rule, cell)) GROUP BY {cols}rule)"""

    def taken(c: str) -> str:
        return f"CASE WHEN o.docs >= {LEAST} THEN o.{c} WHEN l.docs >= {LEAST} THEN l.{c} ELSE a.{c} END AS {c}"
    least = "CASE g.rule " + " ".join(f"WHEN '{r}' THEN {v[3]}" for r, v in RULES.items()) + " END"
    tests = []
    for rule, (*_, both) in RULES.items():
        low = f" OR {rule} < max(q1 - spread) FILTER (rule = '{rule}')" if both else ""
        tests.append(f"CASE WHEN NOT base_failed AND ({rule} > max(q3 + spread) FILTER (rule = '{rule}'){low}) THEN '{rule}' END")
    reasons = f"concat_ws(',', CASE WHEN base_failed THEN 'base' END, {', '.join(tests)})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
        SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, row(w, lead(w) OVER x, lead(w, 2) OVER x) AS win, lead(w, 2) OVER x IS NOT NULL AS whole
      FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g WHERE whole) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS i FROM c, (VALUES (0), (1), (2)) AS o(j)) GROUP BY r),
cnt AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT d.r, doc_id, lang, source, coalesce(cnt.n, 0) AS n_words, CAST(coalesce(cnt.chars, 0) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_lines,
             coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN cnt USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {ratios} FROM b),
v AS ({long}),
k AS (SELECT *, greatest(length(bin(v)) - {bits}, 0) AS drop FROM v),
fine AS (SELECT lang, source, rule, (v >> drop) << drop AS cell, count(*) AS n FROM k GROUP BY ALL),
{quart('lang, source', 'own')},
{quart('lang', 'mid')},
{quart('', 'whole')},
lim AS (SELECT g.lang, g.source, g.rule, {taken('q1')}, {taken('q3')}, {least} AS least
        FROM (SELECT DISTINCT lang, source, rule FROM m, (SELECT unnest({list(RULES)}) AS rule)) g
        LEFT JOIN own o ON g.lang IS NOT DISTINCT FROM o.lang AND g.source IS NOT DISTINCT FROM o.source AND g.rule = o.rule
        LEFT JOIN mid l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rule = l.rule LEFT JOIN whole a ON g.rule = a.rule),
f AS (SELECT *, {FENCE} * greatest(q3 - q1, least) AS spread FROM lim),
o AS (SELECT m.r, any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars,
             any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
             any_value(n_repeat_words) AS n_repeat_words, any_value(base_failed) AS base_failed, {reasons} AS reasons
      FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
      GROUP BY m.r, base_failed, {', '.join(RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reasons = '' AS kept, reasons FROM o
"""
