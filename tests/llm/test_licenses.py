"""License scans against brute force over every window."""

import random
import re

from tidemark.llm import licenses

BODY = {t: b for t, _, b in licenses.TEMPLATES}


def words_of(text):
    return re.findall("[a-z0-9]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def plain(rows):
    out = []
    for doc, text in rows:
        own = shingles(words_of(text))
        for name, license_, body in licenses.TEMPLATES:
            marks = shingles(words_of(body))
            step, goal = max(1, len(marks) // 4), set(marks)
            best, first = 0, None
            for at in range(0, len(own), step):
                inside = own[at : at + len(marks) + step - 1]
                share = len(goal & set(inside)) / len(goal)
                if share >= 0.8:
                    best = max(best, share)
                    place = at + min(i for i, s in enumerate(inside) if s in goal)
                    first = place if first is None else min(first, place)
            if best:
                out.append((doc, name, license_, round(best, 6), first))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.template, r.license, round(r.containment, 6), r.first_word) for r in licenses.scan(df).collect()), key=str)


def test_edited_and_moved_notices(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(60):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        for body in rng.sample(list(BODY.values()), rng.randrange(0, 4)):
            cut = body.split()
            if rng.random() < 0.6:
                for _ in range(rng.randrange(0, 3)):
                    cut[rng.randrange(len(cut))] = rng.choice(["changed", "", "the the"])
            at = rng.randrange(len(words) + 1)
            words[at:at] = cut
        rows.append((doc, rng.choice([" ", "\n", " * "]).join(words)))
    want = plain(rows)
    assert len(want) > 40 and any(r[3] < 1 for r in want)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_odd_rows(spark):
    line, grant = BODY["mit-line"], BODY["mit-grant"]
    rows = [(1, None), (2, ""), (3, "four words are short"), (4, line.upper()), (4, line.upper()), (None, "é" + line + "é"), (5, ("word " * 30_000) + grant + " tail" * 30_000), (6, line * 50)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, shingles string, row int")
    assert found(df) == plain(rows)
    assert licenses.scan(df.where("false")).count() == 0
    assert licenses.scan(df, templates=()).count() == 0
    assert licenses.scan(df, templates=[("short", "X", "too few words")]).count() == 0


def test_no_python_in_the_plan(spark):
    from __spark_entry__ import queries

    plan = queries()["op4_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
