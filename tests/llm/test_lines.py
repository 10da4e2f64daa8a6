"""Line dedup against its definition in plain Python, and against passages planted in otherwise different texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallywing.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def written(line):
    return bool(line.strip(WHITE))


def brute(texts):
    """Texts by id without the windows that stand in an earlier place."""
    first, windows = {}, []
    for i in sorted(texts):
        split = texts[i].split("\n")
        at = [p for p, line in enumerate(split) if written(line)]
        for j, p in enumerate(at):
            found = [(p, p)] if len(split[p].replace("\t", " ").split()) >= 50 else []
            found += [(p, at[j + 1])] if j + 1 < len(at) else []
            for a, b in found:
                key = (split[a], split[b]) if b > a else split[a]
                windows.append((key, i, a, b))
                first.setdefault(key, (i, a))
    gone = {(i, p) for key, i, a, b in windows if first[key] != (i, a) for p in range(a, b + 1)}
    return {i: "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}


def dedup(spark, texts, **how):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in lines.dedup_lines(df, **how).collect()}


def test_random_texts(spark):
    rng = random.Random(5)
    pool = ["", " ", "\t\r", "a", "b", "c d", "é ü", "x" * 300, " ".join(["w"] * 49), " ".join(["v"] * 50), "\t".join(["u"] * 60)]
    texts = {i: "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(1, 25))) for i in range(150)}
    texts[150] = texts[151] = "\n".join(f"line {i}" for i in range(40))
    want, got = brute(texts), dedup(spark, texts)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.removed_lines == (r.n_lines - len(want[i].split("\n")) if want[i] or r.removed_lines < r.n_lines else r.n_lines) for i, r in got.items())
    # A fingerprint on which nearly all pieces clash changes nothing.
    weak = dedup(spark, texts, mark=lambda c: F.length(c) % 3)
    assert {i: r.text for i, r in weak.items()} == want
    # No line is lost altogether.
    before = {line for t in texts.values() for line in t.split("\n") if written(line)}
    assert before == {line for t in want.values() for line in t.split("\n") if written(line)}


def test_planted_passages_go(spark):
    """Passages of 2 to 10 lines, and of one line of 50 words, in three texts each: two of three copies go, nothing else does."""
    texts, planted, doc = {}, {}, 0
    for size in (1, 2, 3, 4, 6, 10):
        for n in range(20):
            words = 50 if size == 1 else 6
            passage = [" ".join(f"p{size}x{n}x{i}x{w}" for w in range(words)) for i in range(size)]
            for copy in range(3):
                own = [f"own {doc} {i} of it" for i in range(10)]
                texts[doc], planted[doc] = "\n".join(own[:5] + passage + own[5:]), (own, copy)
                doc += 1
    for i, r in dedup(spark, texts).items():
        own, copy = planted[i]
        assert r.text == (texts[i] if copy == 0 else "\n".join(own))
        assert r.removed_chunks == (copy > 0)
