"""Quality rules against plain Python, with small limits and awkward rows."""

import re
from collections import Counter, defaultdict

from factloom.llm.quality import Limits, keep_good_lines, quality_rules

LIMITS = Limits(min_line_docs=3, line_share=0.2, min_left=0.5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))


def brute(rows):
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    texts = {(s, t or "") for _, t, s in rows}
    hosts, counts, out = Counter(s for s, _ in texts), defaultdict(set), []
    for s, t in texts:
        for x in lines(t):
            counts[s, normal(x)].add(t)
    for doc_id, t, s in rows:
        w = words(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = len({i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)})
        total = sum(map(len, lines(t)))
        lost = sum(len(x) for x in lines(t) if len(counts[s, normal(x)]) >= max(3, 0.2 * hosts[s]))
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        dup = len(lines(t)) - len(set(lines(t)))
        depleted = bool(lost) and total - lost < 0.5 * total
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, repeat, failed, depleted, not failed and not depleted))
    return out


def made():
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(25))
    menu = "Home | About | Contact us today\nCopyright 2024 by all of us, every right is reserved here\n"
    rows = [(k, (menu * (k % 2) + body(k)) if k % 5 else menu.replace("2024", str(k)) + f"tiny {k} " + "é " * 12, "a") for k in range(20)]
    rows += [(50, body(1), None), (51, None, "a"), (52, "", "b"), (53, " \n\t", None), (54, "x " * 40, "b"), (55, (body(3) + "\n") * 2, "b"), (55, body(3), "b"), (None, body(4), "b"), (56, body(5) + "\r\n" + body(5), "b")]
    return rows + [rows[5], rows[5], (57, " ".join(f"v{i}" for i in range(5000)) + " " + " ".join(f"v{i}" for i in range(900)), "c")]


def test_equals_plain_python(spark):
    rows = made()
    df = spark.createDataFrame([(*r, True, 7) for r in rows], "doc_id long, text string, source string, kept boolean, hh int")
    got = sorted((tuple(r) for r in quality_rules(df, limits=LIMITS).collect()), key=str)
    want = brute(rows)
    assert got == sorted(want, key=str)
    assert any(w[7] for w in want) and any(w[8] for w in want)
    assert quality_rules(df.limit(0)).count() == 0 and keep_good_lines(df.limit(0)).count() == 0


def test_lines_above_the_limits_go(spark):
    import corpus_pipeline

    rows = made()
    df = spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], "doc_id long, text string, source string, n_chars long, hh int")
    texts = {(s, t or "") for _, t, s in rows}
    holds = lambda s, x: sum(normal(x) in map(normal, t.split("\n")) for h, t in texts if h == s)
    above = lambda s, x: words(x) and holds(s, x) >= max(3, 0.2 * sum(h == s for h, _ in texts))
    want = []
    for (doc_id, t, s), w in zip(rows, brute(rows), strict=True):
        if w[8]:
            left = "\n".join(x for x in t.split("\n") if not above(s, x))
            want.append((doc_id, left, s, len(left), 7))
    assert sorted(map(tuple, keep_good_lines(df, limits=LIMITS).collect()), key=str) == sorted(want, key=str)
    menu = [(k, "Home of all pages and much more\n" + " ".join(f"{chr(97 + k)}w{chr(97 + i)}" for i in range(25)), "a", 0) for k in range(26)]
    out = corpus_pipeline.quality_stage(spark, spark.createDataFrame(menu, "doc_id long, text string, source string, n_chars long"), "").collect()
    assert len(out) == 26 and all("Home" not in r.text and r.n_chars == len(r.text) for r in out)


def test_a_count_is_enough_in_a_hot_host(spark):
    """A line of 12 texts of 300 is far below the share, and above the limits by its number; copies count only if asked to."""
    line = "Subscribe to our newsletter for more of the same every week of the year and never miss a thing that we have to say about it\n"
    rows = [(k, (line * 2 if k < 12 else "") + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for i in range(20)), "hot") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lambda df, **limits: {r.doc_id for r in quality_rules(df, limits=Limits(min_line_docs=3, line_share=0.2, **limits)).collect() if r.depleted}
    assert gone(df, many_line_docs=13) == set() and gone(df, many_line_docs=12) == set(range(12))
    copies = df.where("doc_id < 2").unionAll(df.where("doc_id < 2")).unionAll(df.where("doc_id >= 12"))
    assert gone(copies, many_line_docs=4) == set() and gone(copies, many_line_docs=4, distinct_texts=False) == {0, 1}


def test_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(250_000)) + " " + " ".join(f"w{k}" for k in range(1000))
    df = spark.createDataFrame([(1, text, "a"), (2, "line\n" * 100_000, "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (251_000, 2000, True)
    assert (got[2].n_dup_lines, got[2].n_repeat_words, got[2].base_failed) == (99_999, 100_000, True)
