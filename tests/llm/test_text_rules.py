import random
import re

import numpy as np
import pyarrow as pa
from loomery.llm import quality, repetition, toxicity
from loomery.llm.kernels import shingle_sets, text_slices
from loomery.llm.shared import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t, least):
    w = WORD.findall(t)
    n = len(w)
    out = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": 0}
    seen = set()
    for line in t.split("\n"):
        if WORD.search(line):
            out["n_dup_lines"] += line in seen
            seen.add(line)
    at = {}
    for i in range(n - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    out["n_repeat_words"] = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    out["repeat_words"] = len({p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])})
    out["longest_repeat"] = max(longest, default=0)
    return out


def test_measures_match_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        texts = []
        for _ in range(rng.randint(1, 5)):
            voc = [rng.choice(["a", "b", "é#", "cc", "x|y", "A"]) for _ in range(rng.randint(1, 5))]
            body = "".join(rng.choice(voc) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 40)))
            texts.append(rng.choice(["", "\n\n", " "]) if rng.random() < 0.15 else body)
        for first, buf, offsets in text_slices(pa.array(texts), limit=60):
            got = repetition.measures(buf, offsets, 3)
            for i in range(len(offsets) - 1):
                assert {k: int(v[i]) for k, v in got.items()} == brute(texts[first + i], 3)


def test_repetition_rules_on_odd_rows(odd, odd_rows):
    rows = repetition.repetition_rules(odd, min_repeat=8).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for r in odd_rows:
        if r[0] is not None and len(r[1] or "") < 3000:
            want = brute(r[1] or "", 8)
            assert {k: by[r[0]][k] for k in want} == want
            assert by[r[0]].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    assert by[6].kept and by[10].kept and not by[0].kept
    assert repetition.repetition_rules(odd.limit(0)).count() == 0


def test_long_repeats_decide(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    part = fresh(60)
    texts = [fresh(200), part + " " + fresh(10) + " " + part + " " + fresh(5), fresh(150) + "\n" + part + "\n" + fresh(100) + "\n" + part]
    rows = repetition.repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.longest_repeat for r in rows] == [1 if rows[0].longest_repeat else 0, 60, 60]
    assert [r.kept for r in rows] == [True, False, True]


def test_each_repeat_limit_rejects_by_itself(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    twice = lambda parts, rest: "\n".join(parts + [fresh(rest)] + parts[::-1])
    texts = [twice([fresh(30) for _ in range(7)], 480), twice([fresh(170)], 560), twice([fresh(30) for _ in range(5)], 600)]
    rows = repetition.repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.repeat_words, r.longest_repeat) for r in rows] == [(900, 420, 30), (900, 340, 170), (900, 300, 30)]
    assert [(r.base_failed, r.kept) for r in rows] == [(False, False), (False, False), (False, True)]


def test_shingle_sets_match_python_sets():
    texts = ["", "a", "a b c d", "A b C d e", "a b c d e a b c d e a b c d e", "é è\tx y z w", " "]
    sets = {}
    for first, sh, bounds in shingle_sets(pa.array(texts)):
        for i in range(len(bounds) - 1):
            sets[first + i] = set(sh[bounds[i] : bounds[i + 1]].tolist())
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower())
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(sets[i]) == len(want)
    assert sets[3] < sets[4] or sets[3] & sets[4]


def test_classifiers_on_odd_rows(odd, odd_rows, labels):
    rows = toxicity.grade_toxicity(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.expected_severity <= 2 for r in rows)
    rows = quality.classify_quality(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(r.kept is not None and r["row"] == "other" for r in rows)
    assert quality.classify_quality(odd.limit(0), labels).count() == 0
    assert toxicity.grade_toxicity(odd.limit(0), labels).count() == 0
    none = labels.limit(0)
    assert all(r.kept for r in quality.classify_quality(odd, none).collect())
    assert not any(r.is_toxic for r in toxicity.grade_toxicity(odd, none).collect())


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0 and quality is not null")
    out = quality.classify_quality(docs.join(held.select("doc_id"), "doc_id").unionByName(docs.join(fit.select("doc_id"), "doc_id")), fit)
    hits = out.join(held.select("doc_id", held["quality"].alias("truth")), "doc_id").selectExpr("avg(int(kept = (truth = 1)))", "avg(if(truth = 1, int(kept), null))").first()
    assert hits[0] > 0.98 and hits[1] > 0.99


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    vocabulary, model = toxicity.fit_severity(docs, toxicity.graded_labels(fit))
    out = toxicity.score_severity(docs.join(held.select("doc_id"), "doc_id"), vocabulary, model).join(held, "doc_id")
    hits = out.selectExpr("avg(if(toxic = 1, int(is_toxic), null))", "avg(if(toxic = 0, int(is_toxic), null))").first()
    assert hits[0] > 0.8 and hits[1] < 0.01
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()


def test_three_ordered_grades_on_held_out_texts(spark):
    rng = random.Random(8)
    plain, bad = [f"word{i}" for i in range(400)], [f"vile{i}" for i in range(12)]
    grades = [rng.choice([0, 0, 0, 1, 2]) for _ in range(3000)]
    make = lambda g: " ".join(rng.sample(plain, 60) + rng.sample(bad, (0, 2, 6)[g]))
    docs = spark.createDataFrame([(i, make(g)) for i, g in enumerate(grades)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 3], "doc_id long, toxic int")
    vocabulary, model = toxicity.fit_severity(docs, toxicity.graded_labels(labels))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = [r for r in toxicity.score_severity(docs, vocabulary, model).collect() if r.doc_id % 3 == 0]
    assert sum(r.severity == grades[r.doc_id] for r in rows) / len(rows) > 0.9
    mean = [[r.expected_severity for r in rows if grades[r.doc_id] == g] for g in range(3)]
    assert max(mean[0]) < 1 and sum(mean[1]) / len(mean[1]) + 0.5 < sum(mean[2]) / len(mean[2])


def test_words_alone_tell_the_text_view_what_is_good(spark):
    rng = random.Random(6)
    good, bad = [f"good{i}" for i in range(60)], [f"dull{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), "en", "s", 240) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    out = [r for r in quality.classify_quality(docs, labels).collect() if r.doc_id >= 600]
    assert sum(r.kept == bool(r.doc_id % 2) for r in out) / len(out) > 0.97
    assert sum((r.text_score >= 0.5) == bool(r.doc_id % 2) for r in out) / len(out) > 0.97


def test_every_unlabelled_document_can_be_the_surest(spark):
    rng = np.random.default_rng(3)
    n, known = 500, 60
    a, b = rng.normal(size=(n, quality.TEXT_WIDTH)).astype(np.float32), rng.normal(size=(n, quality.METADATA_WIDTH)).astype(np.float32)
    a[490], a[491] = a[480], a[480]
    ids = [None if i in (100, 101) else i // 2 * 2 if 200 <= i < 204 else i for i in range(n)]
    rows = [(i, ids[i], a[i].tolist(), b[i].tolist()) for i in range(n)]
    views = materialize(spark.createDataFrame(rows, "row long, doc_id long, a array<float>, b array<float>"), "views")
    labelled = materialize(spark.createDataFrame([(i, i % 2) for i in range(known)], "doc_id long, quality int"), "known")
    models = [quality.Logistic(np.zeros(m.shape[1]), np.ones(m.shape[1]), rng.normal(size=m.shape[1] + 1)) for m in (a, b)]
    pool = quality.Pool(views, labelled, 20)
    seen = set()
    for _ in range(3):
        given = pool.surest(models, 0.7)
        for v, (matrix, (both, targets)) in enumerate(zip((a, b), given, strict=True)):
            logit = models[v].logit(matrix)
            for wanted, size in ((1, 14), (0, 6)):
                sure = logit * (2 * wanted - 1)
                free = [i for i in range(n) if (ids[i] is None or ids[i] >= known) and i not in seen and sure[i] >= quality.SURE]
                want = sorted(sure[free], reverse=True)[:size]
                got = both[v][targets == wanted]
                assert np.allclose(sorted(models[v].logit(got) * (2 * wanted - 1), reverse=True), want) and len(want) == size
        assert pool.taken > seen
        seen = set(pool.taken)
    assert not seen & set(range(known))


def test_a_hot_labelled_id_stays_within_the_fitting_bound(spark):
    rows = [(0 if i < 400 else i, "good words here " * 9 if i % 2 else "Dull!! ## dull " * 9) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), *((i, i % 2) for i in range(400, 600))], "doc_id long, quality int")
    out = quality.classify_quality(docs, labels, max_labelled=150).collect()
    assert len(out) == 700 and all(r.kept is not None for r in out)
