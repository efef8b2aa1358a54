import random
import re

from wattline.llm import pii

ROWS = [
    (1, "Mail bob.smith@mail.example.com or BOB.SMITH@MAIL.EXAMPLE.COM now.", "x"),
    (2, "Call +1 (663) 555-6869, or 663-555-6869. From 10.20.30.40.", "x"),
    (3, "Card 4539 1488 0343 6467 and 4539148803436467; SSN 123-45-6789.", "x"),
    (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"', "x"),
    (5, "Mr. John Smith met Mrs. Anna Smith. Mr. Smith left. Frau Jürgens, г-жа Петрова.", "x"),
    (6, None, "x"), (7, "", "x"), (8, "no data, version 3.11 of 2024, 12 apples", "x"),
    (9, "From 10.20.30.40.", "x"), (9, "From 10.20.30.40.", "x"), (None, "bob.smith@mail.example.com", "x"), (10, "word " * 20000 + "bob.smith@mail.example.com", "x"),
]
SCHEMA = "doc_id long, text string, pii_map string"


def out(spark, rows=ROWS):
    df = pii.replace_pii(spark.createDataFrame(rows, SCHEMA), count="n")
    assert df.columns == ["doc_id", "text", "pii_map", "n"]
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n))
    return got


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10


def test_surrogates_keep_format_and_identity(spark):
    got = out(spark)
    a, b = re.findall(r"\S+@\S+", got[1][0][0])
    assert a.lower() == b.lower() and b == a.upper() and a != "bob.smith@mail.example.com"
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.com", a)
    assert got[None][0][0] == a and got[10][0][0].endswith("word " + a)
    assert re.fullmatch(r"Call \+1 \([2-9]\d\d\) \d{3}-\d{4}, or \d{3}-\d{3}-\d{4}\. From (\d\d)\.(\d\d)\.(\d\d)\.(\d\d)\.", got[2][0][0])
    assert got[9][0] == got[9][1] and got[9][0][0] in got[2][0][0]
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[3][0][0])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[0]) == luhn("4539148803436467") and "123-45-6789" not in got[3][0][0]
    keys = re.findall(r'"([0-9a-fA-F]{40})"', got[4][0][0])
    assert len(keys) == 2 and keys[0].islower() and keys[1].isupper()
    assert got[6] == [(None, 0)] and got[7] == [("", 0)] and got[8] == [(ROWS[7][1], 0)]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Mr\. (\w+) left\. Frau (\w+), г-жа (\w+)\.", got[5][0][0])
    assert m[2] == m[4] == m[5] and m[3].endswith("a") and not m[1].endswith("a")
    assert re.search("[áéíóú]", m[6]) and re.fullmatch("[А-Яа-я]+", m[7])
    assert not any(x in got[5][0][0] for x in ("John", "Smith", "Anna", "Jürgens", "Петрова"))


def test_distinct_entities_stay_distinct(spark):
    names = [f"{a}{b}" for a in "Ab Ca De Fi Go Hu Ja Ki Lo Mu".split() for b in "lan bert mond rick ster".split()]
    rows = [(i, f"Mr. {n}", "x") for i, n in enumerate(names)] + [(1000 + i, f"host 1.2.3.{i}", "x") for i in range(10)]
    got = out(spark, rows)
    assert len({got[i][0][0] for i in range(len(names))}) == len(names)
    assert not {got[i][0][0] for i in range(len(names))} & {r[1] for r in rows}
    assert len({got[1000 + i][0][0] for i in range(10)}) == 10


def test_empty_table_and_native_plan(spark):
    df = pii.replace_pii(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    plan = pii.replace_pii(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def plain_replace(rows, spark):
    """Every entity of every text replaced one by one with the dictionary's replacement."""
    forms = sorted({m for _, t, _ in rows for m in re.findall(PLAIN, t or "")})
    to = {r.form: r.replacement for r in pii.dictionary(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    return [(i, re.sub(PLAIN, lambda m: to[m[0]], t) if t is not None else None, len(re.findall(PLAIN, t or ""))) for i, t, _ in rows], to


#: Addresses, numbers of hosts and social-security numbers, plainly.
PLAIN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"


def test_equals_naive_replacement(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    mails = [f"{word()}.{word()}@{word()}.org" for _ in range(30)]
    some = lambda: rnd.choice([word(), word(), rnd.choice(mails), f"{rnd.randint(100, 999)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", f"10.{rnd.randint(0, 255)}.0.{rnd.randint(0, 255)}"])
    rows = [(i, " ".join(some() for _ in range(rnd.randint(0, 40))), "x") for i in range(120)] + [(500, None, "x"), (501, mails[0] * 2, "x")]
    want, to = plain_replace(rows, spark)
    got = [(r.doc_id, r.text, r.n) for r in pii.replace_pii(spark.createDataFrame(rows, SCHEMA), count="n").collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert len(set(to.values())) == len(to) and not set(to) & set(to.values())


def test_a_dense_format_grows(spark):
    """More than half of all addresses like x@y.com, and short numbers: each gets a surrogate of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.com" for a in letters for b in letters][:400] + ["A@B.com"]
    rows = [(i, f"mail {m} now", "x") for i, m in enumerate(mails)] + [(1000 + i, f"call +1 10 {i:02d}.", "x") for i in range(99)]
    got = out(spark, rows)
    new = [got[i][0][0] for i in range(400)]
    assert len(set(new)) == 400 and not set(new) & {f"mail {m} now" for m in mails}
    assert all(re.fullmatch(r"mail [a-z]+@[a-z]\.com now", t) for t in new)
    upper = got[400][0][0]
    assert upper.lower() == got[mails.index("a@b.com")][0][0].lower() and re.fullmatch(r"mail [a-z]*[A-Z]@[A-Z]\.com now", upper)
    calls = [got[1000 + i][0][0] for i in range(99)]
    assert len(set(calls)) == 99 and all(re.fullmatch(r"call \+\d \d\d \d{2,}\.", t) for t in calls)


def test_texts_that_hold_the_mark(spark):
    from pyspark.sql import functions as F

    usual = spark.range(1).select(pii.mark(F.lit("x")).alias("m")).first().m
    text = f"a {usual} b bob@mail.com {usual}"
    got = out(spark, [(1, text, "x"), (2, "to bob@mail.com", "x")])
    new = got[2][0][0][3:]
    assert got[1] == [(text.replace("bob@mail.com", new), 1)] and new != "bob@mail.com"


def test_hot_texts_and_hot_entities(spark):
    rows = [(i, "copy for bob@mail.com", "x") for i in range(300)] + [(1000 + i, f"note {i} for bob@mail.com", "x") for i in range(300)]
    got = out(spark, rows)
    assert len({got[i][0] for i in range(300)}) == 1 and len({got[1000 + i][0][0].split()[-1] for i in range(300)}) == 1
