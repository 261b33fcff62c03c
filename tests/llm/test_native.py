"""License scan, personal data, quality rules and mixing against brute force and on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopmill.llm import licenses as L, mixing as M, pii as P, quality as Q, queries, weak
from shopmill.llm.columns import sums_before

ODD = [(1, None, "a"), (2, "", None), (3, " \n\t\x0b ", "a"), (None, "one two three", "b"), (5, "Tie tie", "b"),
       (5, "Tie tie", "b"), (6, "9" * 40_000 + "." + "a." * 20_000 + "@" + "b." * 9_000, "c"),
       (7, "a@" * 9_000 + "1 2-" * 9_000 + "+1(" * 3_000, "c"), (8, "x" * 60_000 + " lang" * 5_000, "c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(*row, 1, "clash", "clash") for row in ODD],
        "doc_id long, text string, source string, size int, words string, measures string")


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_sums_before(spark):
    arrays = [[], [5], list(range(64)), list(range(200)), [3] * 4097]
    df = spark.createDataFrame([(a,) for a in arrays], "xs array<long>")
    for given, got in zip(arrays, df.select(sums_before(F.col("xs")).alias("s")).collect()):
        assert got["s"] == [sum(given[:k]) for k in range(len(given))]


# -- licenses -----------------------------------------------------------------------------

def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_of(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in L.BASE.items():
        phrase = phrase.split()
        for k in range(len(words)):
            if words[k:k + len(phrase)] == phrase:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_places_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "cc by", "the mit", "license", "É K",
             "under the", "version 2", "apache", "GNU General Public License", "all rights reserved", "lorem ipsum"]
    rows = [(k, rng.choice([" ", "\n", "; "]).join(rng.choices(parts, k=rng.randrange(12)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = L.scan(docs)
    assert native(scanned)
    for r in scanned.select("own.doc_id", "*").collect():
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_of(
            dict(rows)[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        assert ("gpl" in r["labels"].split(",")) <= ("GNU General" in dict(rows)[r["doc_id"]])


def test_templates_need_their_phrase(spark):
    rows = [(1, "This is licensed under the GNU General Public License, version 3."), (2, "is licensed under the version 3"),
            (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
            (4, "All rights reserved.")] + [(k, "plain words here") for k in range(10, 30)]
    got = {r["doc_id"]: r["labels"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "own.doc_id", "labels").collect()}
    assert (got[1], got[2], got[3], got[4], got[10]) == ("gpl", "", "mit", "all-rights-reserved", "")


def labels_by_rule(text, idf):
    """Labels and score by the stated method, offset by offset."""
    words = words_of(text)
    known = sorted(set(words) & set(L.vocabulary()), key=lambda w: (-idf[w], w))
    labels, best = set(base_of(text)[4].split(",")) - {""}, 0.0
    for label, notice, phrase in L.TEMPLATES:
        notice, phrase = words_of(notice), words_of(phrase)
        start = next(k for k in range(len(notice)) if notice[k:k + len(phrase)] == phrase)
        asked = [w for w in known if w in notice][:L.LOOKED_UP]
        weight = sum(idf[w] for w in notice)
        if sum(idf[w] for w in notice if w in known) / weight < L.MIN_SCORE - 1e-9:
            continue
        for o in range(-start, len(words)):
            there = [0 <= o + k < len(words) and words[o + k] == w for k, w in enumerate(notice)]
            support = {w for k, w in enumerate(notice) if there[k]} & set(asked)
            if words[o + start:o + start + len(phrase)] == phrase and len(support) >= min(2, len(asked)):
                score = sum(idf[w] for k, w in enumerate(notice) if there[k]) / weight
                best = max(best, score)
                labels |= {label} if round(score, 9) >= L.MIN_SCORE else set()
    return ",".join(sorted(labels)), best


def test_labels_match_the_rule(spark):
    rng = random.Random(8)
    notices = [n for _, n, _ in L.TEMPLATES]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(notices).split()
            for _ in range(rng.choice([0, 0, 1, 3, 9])):  # edits: words lost, changed, added
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], ["lorem"], [words[at], "ipsum"]])
                words = words or ["x"]
            cut = rng.randrange(len(words)) if rng.random() < 0.3 else 0
            parts += [" ".join(words[cut:]), "some words between the notices of a file"]
        rows.append((k, "\n".join(parts[rng.randrange(2):])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf, found = L.inverse_frequencies(docs), set()
    for r in L.scan(docs, own=["doc_id"]).select("own.doc_id", "labels", "score").collect():
        labels, score = labels_by_rule(dict(rows)[r["doc_id"]], idf)
        assert r["labels"] == labels and abs(r["score"] - score) < 1e-8
        found |= set(labels.split(","))
    assert found >= {"mit", "apache-2", "gpl", "lgpl", "agpl", "bsd", "isc", "mpl-2"}


def test_whole_notices_with_changed_words_are_found(spark):
    rows = []
    for k, (_, notice, phrase) in enumerate(L.TEMPLATES):
        words, fixed = words_of(notice), set(words_of(phrase))
        if len(words) > 25:
            other = [i for i, w in enumerate(words) if w not in fixed][::6]  # the key phrase is mandatory, others may differ
            rows.append((k, "x " * 7 + " ".join("foo" if i in other else w for i, w in enumerate(words))))
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), own=["doc_id"]).select("own.doc_id", "labels").collect()
    assert len(got) == len(rows) >= 8
    for r in got:
        assert L.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",")


def test_licenses_of_odd_rows(spark, odd):
    rows = L.scan(odd).collect()
    assert len(rows) == len(ODD) and {r["n_base"] for r in rows} == {0}
    assert [r["n_words"] for r in rows if r["own"]["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert L.scan(odd.limit(0)).count() == 0


# -- personal data ------------------------------------------------------------------------

def luhn(digits):
    return sum(v % 10 + v // 10 for v in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(digits[::-1]))) % 10 == 0


def base_spans(text):
    """The base by the patterns as they are stated."""
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    found = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
               if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }
    return [f"{kind}:{m.start()}:{m.end()}" for kind in P.KINDS for m in found[kind]]


def test_base_spans_match_the_stated_patterns(spark):
    rng = random.Random(11)
    parts = ["a.b@c.de", "x@y..z", "a..b@c-d.e.f_g@h.i", "é@a.b", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0.0.1",
             "4111111111111111", "4111 1111-1111 1111", "4111  1111", "12 34", "+1 (234) 555-1234", "+49 89", "+1+2-3 4567890",
             "-", " ", "日本", "\x01", "ü", "\n", "5", "55", "(", "😀", "a@b.c_d@e.f"]
    rows = [(k, rng.choice(["", " "]).join(rng.choices(parts, k=rng.randrange(9)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = P.find_spans(docs)
    assert native(spans)
    got = spans.select("own.doc_id", P.listed("base").alias("base"), P.listed("all").alias("all")).collect()
    for r in got:
        expected = base_spans(dict(rows)[r["doc_id"]])
        assert [s for s in r["base"].split(",") if s] == expected, dict(rows)[r["doc_id"]]
        assert set(expected) <= set(r["all"].split(","))


def test_classifier_adds_spans_and_leaves_clean_text_alone(spark):
    rows = [(k, f"call me on +1 (234) 555-{1000 + k} or mail a{k}@mail.example.com soon") for k in range(60)]
    rows += [(100 + k, f"number 254 4111111111111111 and phone (234) 555-{1000 + k}") for k in range(60)]
    rows += [(300 + k, "clean words only, in version 2 of 3") for k in range(30)]
    got = {r["doc_id"]: r["all"] for r in P.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "own.doc_id", P.listed("all").alias("all")).collect()}
    text = dict(rows)[100]
    at = text.index("4111")
    assert f"card:{at}:{at + 16}" in got[100].split(",")
    assert all(got[300 + k] == "" for k in range(30))


def test_personal_data_of_odd_rows(spark, odd):
    got = P.find_spans(odd).select("own.doc_id", "own.size", P.listed("base").alias("base")).collect()
    assert len(got) == len(ODD)
    for row, text in zip(sorted(got, key=lambda r: r["doc_id"] or 0), [None, None, "", " ", "", ""]):
        assert row["base"] == ""
    long = {r["doc_id"]: r["base"] for r in got if r["doc_id"] in (6, 7)}
    for doc, text, _ in ODD[6:8]:
        assert long[doc] == ",".join(base_spans(text)) if doc == 7 else long[doc].startswith("email:")
    assert P.find_spans(odd.limit(0)).count() == 0


# -- quality ------------------------------------------------------------------------------

def measures_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered, seen, repeated = set(), set(), 0
    for k in range(len(words) - 2):
        if windows[tuple(words[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_measures_match_brute_force(spark, odd):
    rng = random.Random(6)
    pool = ["a", "b", "c", "über", "<x>", "#", "|", "\x0b", "\n", "\n\n", "end.", "😀"]
    rows = [(k, rng.choice([" ", "\t", "  "]).join(rng.choices(pool[:3 + k % 10], k=rng.randrange(120)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = Q.judge(docs, ["doc_id"])
    assert native(judged)
    for r in judged.select("own.doc_id", "*").collect():
        assert tuple(r[c] for c in (*Q.MEASURES, "base_failed")) == measures_of(dict(rows)[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert {r["base_failed"] for r in Q.judge(odd.where("doc_id < 6 OR doc_id IS NULL"), ["doc_id"]).collect()} == {True}
    assert Q.keep_good(odd).columns == odd.columns
    assert Q.keep_good(odd.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark, sample):
    sample = sample.replace("0.001", "0.01")
    judged = queries.QUERIES["op6_quality"](spark, sample)
    labels = spark.read.parquet(f"{sample}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = judged.where("NOT base_failed").join(labels, "doc_id").select("label", F.col("kept").cast("int")).collect()
    right = sum(r[0] == r[1] for r in rows) / len(rows)
    clean = [r[1] for r in rows if r[0] == 1]
    assert right > 0.95 and sum(clean) / len(clean) > 0.99


def test_posterior_beats_all_rules_must_pass(spark, sample):
    docs = spark.read.parquet(f"{sample.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sample.replace('0.001', '0.01')}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    judged = Q.judge(docs, ["doc_id"]).select("own.doc_id", "votes", "base_failed", "quality", "kept")
    rows = judged.join(labels, "doc_id").collect()
    share = lambda said: sum(said(r) == (r["label"] == 1) for r in rows) / len(rows)
    every, learnt = share(lambda r: min(r["votes"]) > 0), share(lambda r: r["quality"] >= 0.5)
    assert learnt > 0.98 and learnt > every
    # bad texts that most rules vote for are rejected all the same
    assert any(r["label"] == 0 and sum(r["votes"]) > 4 and r["quality"] < 0.5 for r in rows)
    counts = Counter(tuple(r["votes"]) for r in judged.collect())
    learnt, start = (weak.fit_kinds(p, len(Q.rule_votes()), Q.PRIOR) for p in (list(counts.items()), []))
    for r in rows[:200]:
        assert abs(learnt.posterior(r["votes"]) - r["quality"]) < 1e-9
    k = list(Q.rule_votes()).index("symbols")
    assert abs(learnt.kinds[k][1][k][1] - start.kinds[k][1][k][1]) > 1


def test_kinds_of_bad_are_told_apart():
    rng, patterns, right = random.Random(2), Counter(), 0
    draws = []
    for _ in range(20_000):
        kind = rng.choice([None, None, None, None, 0, 1])  # a kind fails voters 0 and 1, another 2 and 3
        votes = tuple(0 if rng.random() < 0.1 else (-1 if rng.random() < (0.9 if k // 2 == kind else 0.02) else 1) for k in range(4))
        patterns[votes] += 1
        draws.append((votes, kind is None))
    learnt = weak.fit_kinds(list(patterns.items()), 4)
    right = sum((learnt.posterior(v) >= 0.5) == good for v, good in draws) / len(draws)
    assert right > 0.92 and learnt.posterior((-1, -1, 1, 1)) < 0.5 < learnt.posterior((1, 1, 1, 1))
    assert weak.fit_kinds([], 3).posterior((1, 1, 1)) > 0.5 > weak.fit_kinds([], 3).posterior((-1, -1, 1))


def test_reliabilities_by_expectation_maximisation():
    rng, patterns = random.Random(1), Counter()
    accuracy = (0.95, 0.8, 0.6)
    for _ in range(20_000):
        good = rng.random() < 0.7
        patterns[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in accuracy)] += 1
    learnt = weak.fit(list(patterns.items()), 3, 0.6)
    strength = [plus - minus for plus, minus in learnt.weights]
    assert strength[0] > strength[1] > strength[2] > 0
    assert learnt.posterior((1, 1, 1)) > 0.9 > 0.2 > learnt.posterior((-1, -1, -1))
    assert weak.fit([], 2, 0.5).posterior((0, 0)) == 0.5


# -- mixing -------------------------------------------------------------------------------

def targets_by_hand(sizes, weights=(3.0, 1.0, 2.0)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return {**target, **{s: level * weight[s] for s in open_}}
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_mix(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "ä", "Z", None, "c"]
    rows = [(k, "w " * rng.randrange(1, 40), rng.choices(sources, [30, 5, 3, 2, 1, 9])[0]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = M.mix(docs, own=["doc_id", "source"])
    assert native(mixed)
    got = mixed.select("own.*", "size", "source_size", "target", "taken").collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected, taken = targets_by_hand(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["size"] == len(dict((i, t) for i, t, _ in rows)[r["doc_id"]].split())
        assert r["source_size"] == sizes[r["source"]] and r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(expected[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 20 for s in sizes)
    again = M.mix(docs.repartition(7), own=["doc_id", "source"]).select("own.*", "size", "source_size", "target", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    copies = Counter(r["doc_id"] for r in M.mixed(docs).collect())
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


@pytest.mark.parametrize("id", [7, None])
def test_mix_takes_a_part_of_equal_rows(spark, id):
    docs = spark.createDataFrame([(id, "one two three four", "s")] * 1000, "doc_id long, text string, source string")
    rows = M.mix(docs, own=["doc_id"]).collect()
    assert {r["target"] for r in rows} == {6000.0} and sum(r["taken"] for r in rows) == 6000
    assert sorted({r["taken"] for r in rows}) == [4, 8]


def test_license_of_a_single_document(spark):
    text = "This program is free software under the GNU General Public License version 3"
    alone = spark.createDataFrame([(1, text)], "doc_id long, text string")
    beside = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    one = L.scan(alone, own=["doc_id"]).select("labels", "score").first()
    two = L.scan(beside, own=["doc_id"]).where("own.doc_id = 1").select("labels", "score").first()
    assert one["labels"] == two["labels"] and (one["score"] > 0) == (two["score"] > 0)


def test_mix_of_odd_rows(spark, odd):
    got = M.mix(odd, own=["doc_id", "size"]).collect()
    assert len(got) == len(ODD)
    assert [r["taken"] for r in got if r["own"]["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert M.mixed(odd).columns == odd.columns
    assert M.mix(odd.limit(0)).count() == 0
    empty = odd.where("doc_id < 4")
    assert {r["target"] for r in M.mix(empty).collect()} == {0.0}
