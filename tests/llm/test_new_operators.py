"""Vector codes, the filter audit and language identification against plain versions of their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import audit, codes, langid
from tallywing.llm.common import Scratch, table

CLASH = ", row string, n long, key string, mask int, flags int, part string, slots int, x int, place int"
EXTRA = ("r", 1, "k", 2, 3, "p", 4, 5, 6)


# --- vector codes


def brute_codes(rows, rounds=4, entries=256):
    """rows: (vec_id, label, vector), all of one length; the definition, entry by entry."""
    x = [(i, lab, [math.floor(1024 * c) for c in v]) for i, lab, v in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(x[0][2]) // 4
    parts = [[r[2][p * w : (p + 1) * w] for r in x] for p in range(4)]
    books = [[list(v) for v in part[:entries]] for part in parts]

    def best(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(e, v)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            near = defaultdict(list)
            for v in parts[p]:
                near[best(books[p], v)[1]].append(v)
            for k, vs in near.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for j, (i, lab, _) in enumerate(x):
        found = [best(books[p], parts[p][j]) for p in range(4)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    print_ = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    per = Counter()
    for _, lab, _, d in out:
        per[lab] += d
    return sorted([(i, c, d, per[lab], print_) for i, lab, c, d in out], key=repr)


@pytest.mark.parametrize("seed,big", [(1, 1), (2, 1 << 23), (3, 1)])
def test_orchard_finds_the_nearest_entry(seed, big):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-40, 40, (200, 3)) * big
    entries[50] = entries[7]  # ties between entries
    parts = np.concatenate([rng.integers(-50, 50, (3000, 3)) * big, entries])
    book = codes.Book.of(entries)
    at, far, looked = codes.nearest(book, parts, rng.integers(0, 200, len(parts)) if seed == 3 else None)
    d = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (far == d.min(axis=1)).all()
    assert (at == d.argmin(axis=1)).all()
    assert looked < 0.8 * d.size  # the triangle inequality spares distances


def test_codes_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) / 3
    rows = [(1000 - i, i % 3 if i % 5 else None, (centres[i % 12] + rng.normal(size=8) / 20).tolist()) for i in range(400)]
    rows += [(7, 1, rows[3][2]), (7, 1, rows[4][2]), (None, 2, rows[5][2])]
    df = spark.createDataFrame([(i, v, lab, *EXTRA) for i, lab, v in rows], "vec_id long, embedding array<double>, label int" + CLASH)
    for data in (df, df.repartition(7)):
        got = sorted((tuple(r) for r in codes.compress(data).collect()), key=repr)
        assert got == brute_codes(rows)
    few = df.where("vec_id > 990 or vec_id = 7")
    assert sorted((tuple(r) for r in codes.compress(few).collect()), key=repr) == brute_codes([r for r in rows if r[0] and (r[0] > 990 or r[0] == 7)])


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4]), (2, None), (3, []), (4, [nan, 0.0, 0.0, 0.0]), (5, [0.0, None, 0.0, 0.0]), (6, [0.0, -inf, 0.0, 0.0]),
        (7, [1.0, 2.0, 3.0]), (8, [0.0] * 8), (9, [-0.1, -0.2, 1e300, -1e300]), (None, [0.1, 0.2, 0.3, 0.4]), (1, [0.1, 0.2, 0.3, 0.4]),
    ]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = codes.compress(df).collect()
    assert sorted((r.vec_id for r in got), key=repr) == [1, 1, 9, None]
    assert len({r.label_error for r in got}) == 1
    same = {(r.code, r.error) for r in got if r.vec_id != 9}
    assert len(same) == 1
    assert codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.where("vec_id in (2, 3, 7)")).count() == 0
    only_null = codes.compress(df.where("vec_id is null")).collect()
    assert [(r.vec_id, r.error) for r in only_null] == [(None, 0)]


def test_decoded_codes_have_the_stated_error(spark, small):
    rows = codes.whole_numbers(table(spark, small, "embeddings"))
    books = codes.fit_codebooks(rows, rounds=2)
    back = codes.decode(codes.encode(rows, books), books).join(rows.select("vec_id", "x"), "vec_id").collect()
    assert back and all(r.error == sum((round(a * 1024) - b) ** 2 for a, b in zip(r.approximation, r.x)) for r in back)


# --- filter audit


def brute_audit(docs, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = max(good[i], int(q == 1)), max(toxic[i], int(t == 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > least[t])
        rows[lang or ""].append((fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = []
    for part, own in rows.items():
        found, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                redundant = sum(f in r[0] for r in own) - len(removed)
                shapley[f] += len(removed)
                found.append((part, order, step, len(left), len(removed), redundant, sum(r[0] == f for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


LONG = " ".join(f"word{i}" for i in range(150))
DOCS = [
    (30, LONG, "en"), (20, LONG, "en"), (10, LONG, "fr"), (10, LONG, "en"), (40, "short & odd", "en"), (41, None, None), (42, "", "en"), (None, LONG, "en"),
    (50, " ".join(["same"] * 200), "de"), (51, "SHOUT " * 120, "de"), (52, "A" * 50 + "\n" + LONG, "de"), (53, LONG + " 50%", ""), (5, "", "fr"), (None, None, None),
    (60, LONG.replace(" ", "\t\x0b"), "en"), (61, "é" * 2000 + " X", "en"), (62, LONG + "\x00#", "en"), (20, LONG, "en"), (30, LONG, "en"), (1, "late", "en"), (0, "late", "en"),
]
LABELS = [(30, 1, 0), (20, 1, 1), (10, 0, 1), (10, 1, None), (50, 1, 1), (None, 1, 1), (999, 1, 1), (51, None, None), (0, 1, 0), (1, 0, 1)]


def files_of(spark, docs, parts):
    """A folder of so many files, written one after the other."""
    scratch, folder = Scratch(spark, "test"), None
    schema = "doc_id long, text string, lang string" + CLASH.replace(", x int", "")
    for i in range(parts):
        df = spark.createDataFrame([(*d, *EXTRA[:-2], 6) for d in docs[i::parts]], schema).coalesce(1)
        if folder is None:
            _, folder = scratch.write(df, "docs")
        else:
            df.write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("parts,batches", [(1, 1), (6, 6), (5, 2)])
def test_audit_equals_plain_filters(spark, parts, batches):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for docs in (DOCS, DOCS[::-1]):
        got = audit.audit(spark, files_of(spark, docs, parts), labels, batches)
        assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, LABELS)


def test_audit_retracts_for_smaller_ids(spark):
    """Ids that only get smaller: every micro-batch takes back what the one before counted."""
    docs = [(100 - i, LONG, f"p{i % 3}") for i in range(12)]
    folder = files_of(spark, docs, 6)
    counts = {(r.part, r["mask"]): r.n for r in audit.counters(spark, folder, spark.createDataFrame([], "doc_id long, quality int, toxic int"), 6).collect()}
    assert counts == {("p0", 16): 4, ("p1", 16): 4, ("p2", 16): 3, ("p2", 0): 1}


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    folder = Scratch(spark, "test").write(none, "none")[1]
    assert audit.audit(spark, folder, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- language


TEXTS = ["The cat; the DOG", None, "", " 12 !!", "über Öl—was", "a", "日本 語", "x" * 3000 + " y", "\n\t", "İstanbul ß", "\x00a\x00"]


def test_ngrams_equal_the_definition():
    values, counts, first = langid.ngram_counts(TEXTS)
    assert first[-1] == len(values)
    slot_of = {}
    for i, t in enumerate(TEXTS):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        line = f" {' '.join(words)} " if words else ""
        grams = Counter(line[j : j + n] for n in (1, 2, 3) for j in range(len(line) - n + 1))
        grams.pop(" ", None)
        got = dict(zip(values[first[i] : first[i + 1]].tolist(), counts[first[i] : first[i + 1]].tolist()))
        # No two of these n-grams share a feature, so the counts are those of the n-grams.
        assert sorted(got.values()) == sorted(grams.values())
        for v, c in got.items():
            same = {g for g, n in grams.items() if n == c}
            slot_of[v] = slot_of.get(v, same) & same
    assert all(slot_of.values())  # a feature means the same n-gram in every text


def plain_fit(rows, y, classes, alpha, beta, l1, l2, passes):
    """The update rule coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        return 0.0 if abs(z[key]) <= l1 else -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    rng = np.random.default_rng(13)
    for _ in range(passes):
        for i in rng.permutation(len(y)).tolist():
            w = {(f, k): weight((f, k)) for f, _ in rows[i] for k in range(classes)}
            s = [sum(w[f, k] * x for f, x in rows[i]) for k in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(classes):
                error = e[k] / sum(e) - (k == y[i])
                for f, x in rows[i]:
                    g = error * x
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha * w[f, k]
                    n[f, k] += g * g
    return {key: weight(key) for key in z}


def test_fit_equals_the_plain_rule():
    rng = np.random.default_rng(5)
    rows = [sorted({int(f): float(rng.uniform(0.1, 1)) for f in rng.integers(0, 30, 8)}.items()) for _ in range(60)]
    y = np.array([int(sum(f for f, _ in r) % 3) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    values, x = np.array([f for r in rows for f, _ in r]), np.array([v for r in rows for _, v in r])
    for params in ({"alpha": 0.5, "beta": 1.0, "l1": 0.05, "l2": 0.5, "passes": 2}, {"alpha": 0.1, "beta": 2.0, "l1": 0.3, "l2": 0.0, "passes": 3}):
        got, want = langid.fit(values, x, first, y, 3, 30, **params), plain_fit(rows, y, 3, **params)
        assert all(abs(got[f, k] - v) < 1e-9 for (f, k), v in want.items())
        assert (got == 0).any()  # the L1 penalty leaves weights at zero


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(6)
    linear, weight = rng.normal(size=(300, 4)) * 3, rng.uniform(0.5, 2, 300)
    p = langid.chances(linear, 2.5)
    y = np.array([rng.choice(4, p=r) for r in p])
    t = langid.fit_temperature(linear, y, weight)

    def loss(t):
        return -(weight * np.log(langid.chances(linear, t)[np.arange(300), y])).sum()

    assert abs(t - 2.5) < 0.6
    assert all(loss(t) <= loss(s) + 1e-6 for s in np.linspace(0.1, 10, 200))


def test_languages_of_held_out_documents(spark, medium):
    docs = table(spark, medium, "documents")
    out = langid.identify(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    # Neither lang nor source nor the id of a row that is scored counts.
    hidden = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1, F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(hidden.repartition(5)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}


def test_languages_of_odd_rows(spark):
    en, de = "the house of the three sisters", "das Haus der drei Schwestern über Öl"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !", "de"), (103, de, None), (None, en, "en"), (104, en * 20_000, None), (3, de, "de"), (3, de, "de")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id long, text string, lang string" + CLASH)
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101, 102))
    assert {r.lang_pred for r in got if r.doc_id in (103,)} == {"de"} and {r.lang_pred for r in got if r.doc_id in (104, None)} == {"en"}
    assert {r.held_out for r in got if r.doc_id is None} == {zlib.crc32(b"") % 3 == 1}
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = langid.identify(df.withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in one if r.doc_id not in (100, 101, 102)} == {"xx"}
