from drawseries.llm.chat import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, segs string"


def brute(rows, size):
    out = {}
    by = {}
    for c, t, s, x, *_ in rows:
        by.setdefault(c, []).append((t, s or "unknown", x or ""))
    for c, turns in by.items():
        for who in {s for _, s, _ in turns} - {"system"}:
            chunks = {}
            for m in turns:
                chunks.setdefault(-1 if m[0] is None else m[0] // size, []).append(m)
            for k, ms in chunks.items():
                text, spans = "", []
                for t, s, x in sorted(ms, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2])):
                    text += "<|im_start|>" + ("assistant" if s == who else "system" if s == "system" else f"user name={s}") + "\n"
                    if s == who:
                        spans.append(f"{len(text)}-{len(text) + len(x) + 10}")
                    text += x + "<|im_end|>\n"
                out[c, k, who] = (len(ms), len(spans), text, ",".join(spans))
    return out


def test_matches_brute_force(spark):
    rows = [(1, i, ["ann", "bob", "cy"][i % 3], f"héllo {i} 🙂") for i in range(10)]
    rows += [(2, 0, "system", "rules"), (2, 1, "user", None), (2, 2, None, ""), (2, None, "user", "late"),
             (2, 1, "user", None), (None, 0, "user", "x"), (None, 1, "user", "y"), (3, 0, "system", "alone")]
    rows += [(4, i, "user" if i % 2 else "assistant", "z" * i) for i in range(200)]
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)
    for size in (4, 64):
        got = {(r.conv_id, r.chunk, r.perspective): (r.n_turns, r.n_own, r.rendered, r.mask_spans)
               for r in perspectives(df, chunk_turns=size).collect()}
        assert got == brute(rows, size)


def test_spans_cut_out_the_participants_words(spark):
    df = spark.createDataFrame([(1, 0, "a", "hi", 0, ""), (1, 1, "b", "yo ü", 0, "")], SCHEMA)
    for r in perspectives(df).collect():
        a, b = map(int, r.mask_spans.split("-"))
        assert r.rendered[a:b] == {"a": "hi", "b": "yo ü"}[r.perspective] + "<|im_end|>"


def test_empty(spark):
    assert perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
