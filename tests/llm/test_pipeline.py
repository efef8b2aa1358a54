import re

import numpy as np

import corpus_pipeline as cp
from wattline.llm.common import WordHashes, scratch_path, table
from wattline.llm.setsketch import shingle_sets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents").limit(200)
    columns, before = docs.columns, docs
    for name, stage in cp.STAGES:
        path = scratch_path(spark, "test-stage")
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "pack_sequences":
            assert after.columns == columns
        n0, n1 = before.count(), after.count()
        if name == "language_id":
            assert n0 * 0.97 <= n1 <= n0
        elif name == "near_duplicates":
            assert n1 < n0 and after.select("doc_id").distinct().count() == n1
        elif name == "personal_data":
            assert n1 == n0 and not {m for r in before.collect() for m in re.findall(r"\S+@\S+", r.text)} & {m for r in after.collect() for m in re.findall(r"\S+@\S+", r.text)}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "source_mix":
            words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
            assert abs(words(after) - 1.5 * words(before)) <= 25
        else:
            assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        before = after


def test_odd_documents(spark):
    rows = [(1, "some english words here and there", "en", "a", 3), (1, "some english words here and there", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "mail me at a.b@c.de please", "en", "b", 9), (4, "word " * 30000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, nr string"
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    assert sorted(r.doc_id or 0 for r in cp.near_duplicates(spark, docs, SF).collect()) == [0, 1, 2, 3, 4]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() > 0


def test_near_duplicates_against_brute_force(spark):
    """Pairs around the production threshold, groups of copies, null and repeated ids: one row of each group."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        words = [f"w{rng.integers(10**6)}" for _ in range(200)]
        text = " ".join(words)
        for changed in (0, 2, 4, 5):  # likeness to the first: near 0.90, 0.81 and 0.77
            mine = list(words)
            for k in range(changed):
                mine[20 + 30 * k] = f"x{rng.integers(10**6)}"
            rows.append((None if g % 3 == 0 else 1000 - len(rows), " ".join(mine)))
        rows += [(None, text), (None, text.upper()), (1000 + g, text)] if g % 2 else [(None, text)]
    rows += [(7, "one text of an id that is used twice over"), (7, rows[5][1]), (1, rows[5][1]), (7, "one text of an id that is used twice over"), (None, ""), (None, None), (None, " "), (8, " "), (8, " ")]
    sets = shingle_sets([t for _, t in rows], 5, WordHashes())
    up, likeness = list(range(len(rows))), []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j], assume_unique=True))
            if both:
                either = len(a) + len(sets[j]) - both
                likeness.append(both / either)
                if 100 * both >= 80 * either:
                    old, new = up[i], up[j]
                    up = [new if x == old else x for x in up]
    assert any(0.80 <= x < 0.85 for x in likeness) and any(0.7 < x < 0.80 for x in likeness)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(up[i] if len(sets[i]) else ("bare", d, t, i if d is None else 0), []).append(d)
    want = sorted((min((d for d in ds if d is not None), default=-1) for ds in groups.values()))
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_duplicates(spark, docs, SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == want
    place = {}
    for i, r in enumerate(rows):
        place.setdefault(r, up[i])
    kept = [place[r.doc_id, r.text] for r in got if (r.text or "").strip()]
    assert len(kept) == len(set(kept))


def test_language_id_against_a_loop(spark):
    """Each document by itself through the trained model: those it rejects go, all others stay as they are."""
    from pyspark.sql import functions as F

    from wattline.llm import langid
    from wattline.llm.common import crc_mod

    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34 !!", "en", "s", 8), (-3, "zzqx wvut qqqx", None, None, 14), (None, "the and of", None, "s", 1)], docs.schema)
    model = langid.train(docs.select("doc_id", "text", "lang").filter(crc_mod(F.col("doc_id"), 5) != 0))
    want = []
    for r in docs.union(odd).collect():
        (lang,), (score,) = langid.predict(model, [r.text])
        if lang != "und" and score >= model.threshold:
            want.append(tuple(r))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in cp.language_id(spark, docs.union(odd), SF).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 150


def test_personal_data_against_naive_replacement(spark):
    """Every address replaced one by one; rows, order of columns and lengths follow."""
    from wattline.llm import pii

    rows = [(i, f"note {i} from u{i % 7}@mail{i % 3}.org and u{(i + 1) % 7}@mail0.org", "en", "s", 1) for i in range(60)] + [(100, None, "en", "s", None), (101, "clean text", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    forms = sorted({m for r in rows for m in re.findall(r"\S+@\S+", r[1] or "")})
    to = {r.form: r.replacement for r in pii.dictionary(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    want = []
    for d, text, lang, source, _ in rows:
        new = re.sub(r"\S+@\S+", lambda m: to[m[0]], text) if text else text
        want.append((d, new, lang, source, len(new) if new is not None else None))
    assert sorted(tuple(r) for r in cp.personal_data(spark, docs, SF).collect()) == sorted(want) and len(set(to.values())) == len(to)


def test_source_mix_against_a_queue_served_word_by_word(spark):
    """Documents of a source in order of their places, again and again; at the end of the budget the one in service is cut."""
    from wattline.llm import mixing

    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 23)), "en", ("a", "b", None, "é")[min(3, i % 7)], 5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    place = {r["doc_id"]: r["place"] for r in mixing.sized(docs).collect()}
    target = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    want = []
    for source in ("a", "b", None, "é"):
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: place[r[0]])
        left = int(target[mine[0][0]])
        for _ in range(2):
            for d, text, lang, s, _n in mine:
                words = text.split(" ") if text else []
                take = min(len(words), left)
                left -= take
                if take:
                    new = " ".join(words[:take])
                    want.append((d, new, lang, s or "", len(new) if take < len(words) else 5))
    got = [(r.doc_id, r.text, r.lang, r.source or "", r.n_chars) for r in cp.source_mix(spark, docs, SF).collect()]
    assert sorted(got) == sorted(want)
