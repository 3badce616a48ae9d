"""The operators against plain Python on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402
from oracle import by_sql, differences  # noqa: E402

from offerloom.llm import components, exact_dedup, language_id, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, registry, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, label string, size string, kept string, component string, `_` string"
BASE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    BASE, BASE.replace("word7 ", "other "), BASE.upper(), BASE + "\n", "  " + BASE, None, "", " \t\n", "one two three", "one two three", "One\ttwo THREE", LONG, LONG + " end",
    "été à la plage 你好 😀 fin", "Released under the MIT License.", "x" * 5000, "This work is licensed under the GNU General Public License, version 3.", "a b c d e f g", "b c d e f g h",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "en", "s1", 1), (None, "no id at all", "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", "z", "k", "c", "u") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF).toPandas(), by_sql(SF, registry.ORACLES[name])) == ""


def test_same_number_of_rows(docs, empty, labels):
    for df, n in ((docs, len(TEXTS) + 3), (empty, 0)):
        assert license_scan.scan(df).count() == n
        assert near_dedup.near_duplicates(df).count() == n
        assert quality_rules.judge(df).count() == n
        assert toxicity.score(df, toxicity.fit(df, labels)).count() == n
        assert language_id.identify(df, language_id.fit(df)).count() == n
        assert quality_classifier.score(df, quality_classifier.fit(df, labels)).count() == n
        assert exact_dedup.deduplicate(df).count() == n
        assert mixing.mix(df).count() == n
        for stage in (quality_rules.accepted, exact_dedup.deduplicated, near_dedup.one_of_each, mixing.mixed):
            assert stage(df).columns == df.columns
            stage(df).toPandas()
        packing.pack(df).toPandas()
        token_counts.attribute_tokens(df).toPandas()


# 1


def test_license_places(spark, docs):
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    mit = rows[TEXTS.index("Released under the MIT License.")]
    assert (mit.n_words, mit.n_base, mit.first_word, mit.base_labels, mit.labels, mit.score) == (5, 1, 3, "mit", "mit,mit-1", 1.0)
    assert rows[5].n_words == 0 and rows[5].labels == "" and rows[5].first_word is None
    text = "MIT license mit-LICENSE \u212ait license"  # a Kelvin sign and no m
    found = license_scan.scan(spark.createDataFrame([(1, text), (2, "mit  licensee mit"), (3, "apache license general public license")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (2, 0, 2)
    assert rows[2].n_base == 0 and (rows[3].n_base, rows[3].last_word) == (2, 2)


def test_license_notice_over_lines(spark):
    notice = dict(license_scan.TEMPLATES)["bsd-text"]
    words = notice.split()
    wrapped = "\n".join([f"filler line {i}" for i in range(9)] + [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)])
    row = license_scan.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).first()
    assert row.labels == "bsd-text" and row.score >= license_scan.CONTAINMENT



APACHE_HEADER = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_license_templates_at_every_offset_and_wrap(spark):
    rows, want = [], {}
    wrapped = [("apache-2.0-text", APACHE_HEADER)]
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        wrapped += [(name, "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))) for n in (1, 2, 3, 4, 5, 8, 100)]
    for name, text in wrapped:
        for offset in range(7):
            want[len(rows)] = name
            rows.append((len(rows), "\n".join([f"filler row {i}" for i in range(offset)] + [text] + ["more filler"] * 9)))
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, name in want.items() if name not in got[i][0]] == []
    assert min(score for _, score in got.values()) >= license_scan.CONTAINMENT


def test_license_blocks_do_not_hang_on_lines(spark):
    filler = "the gnu tree a lesser and general public good is licensed under a license".split()
    long_line = " ".join(w + " of meadows and rivers in the quiet valley beyond the old stone bridge near town" * 4 for w in filler)
    texts = [
        "Licensed under the GNU\nLesser General Public License", "Licensed under the GNU Lesser General Public License", long_line,
        "This is free and unencumbered released into the public domain", "Released\n" + "other words\n" * 40 + "under the MIT License",
    ]
    got = [r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["gpl,lgpl", "gpl,lgpl", "", "unlicense", "mit"]


def brute_licenses(text, templates):
    words = re.findall(license_scan.WORD, text.lower())
    found = {}
    for name, body in templates:
        tokens, span = set(license_scan.template_tokens(body)), license_scan.span(body)
        best = max((len(tokens & set(words[i : i + span])) for i in range(len(words))), default=0)
        if best >= license_scan.needed(len(tokens)):
            found[name] = best / len(tokens)
    return found


def test_license_blocks_equal_brute_force(spark):
    templates = (("a", "the red fox may run over the hill"), ("b", "red fox"), ("c", "one two three four five six seven eight nine ten"))
    rng, pool = np.random.default_rng(8), "the red fox may run over hill one two three four five six seven eight nine ten x y z".split()
    texts = ["", "red", "fox red", *(" ".join(pool[i] for i in rng.integers(0, rng.integers(8, len(pool)), rng.integers(1, 60))) for _ in range(150))]
    texts += [" ".join(w for w in templates[i % 3][1].split() if rng.random() > 0.08) + "\n" + t for i, t in enumerate(texts)]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    want = [brute_licenses(t, templates) for t in texts]
    assert {r.doc_id: r.labels for r in got} == {i: ",".join(sorted(w)) for i, w in enumerate(want)}
    assert all(abs(r.score - max(want[r.doc_id].values(), default=0)) < 1e-9 for r in got)


# 2


def _sets(texts):
    for t in texts:
        w = (t or "").encode().lower().split()
        yield set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    ids, sets = [i for i, _ in rows], list(_sets(t for _, t in rows))
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(ids[a]), top(ids[b])
                above[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in zip(ids, sets)}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == brute_components(list(enumerate(TEXTS)))


def test_drifting_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(3):
        words = [f"v{x}" for x in rng.integers(0, 10_000, 90)]
        for _ in range(60):
            words = list(words)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = f"n{rng.integers(0, 10_000)}"
            rows.append((len(rows), " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Buckets of many classes that the leaders don't link: pairs meet in small blocks, and large buckets are broadcast."""
    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 20)
    rng, rows = np.random.default_rng(6), []
    for _ in range(2):
        words = [f"v{x}" for x in rng.integers(0, 10_000, 120)]
        for _ in range(90):
            own = list(words)
            for at in rng.choice(120, 6, replace=False):
                own[at] = f"n{rng.integers(0, 10_000)}"
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join([*own[:-1], f"m{rng.integers(0, 10_000)}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(near_dedup, "cut", lambda frame, name="step", cut=near_dedup.cut: seen.append((name, out := cut(frame, name))) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, block=7).collect()}
    assert got == brute_components(rows)
    mixed = next(frame for name, frame in seen if name == "mixed")
    assert mixed.agg(F.max("blocks")).first()[0] > 2


def test_chance_of_unrelated_sets_to_meet():
    rng = np.random.default_rng(7)
    k = np.stack([near_dedup.sketch(np.unique(rng.integers(0, 1 << 62, 400, np.uint64))) for _ in range(600)])
    agree = np.mean([(k[i] == k[i + 1 :]).mean() for i in range(599)])
    assert agree < 0.027 and near_dedup.REGISTERS // near_dedup.BAND * agree**near_dedup.BAND < 2e-8


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 62, 2000, np.uint64)) for _ in range(2))
    union = np.union1d(a, b)
    assert (np.maximum(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(union)).all()
    x, y = np.concatenate((a, b[:300])), np.concatenate((a, b[300:600]))
    kx, ky = near_dedup.sketch(np.sort(x)), near_dedup.sketch(np.sort(y))
    args = [np.array([v], float) for v in ((kx > ky).sum(), (kx == ky).sum(), len(x), len(y))]
    true = len(a) / (len(a) + 600)
    assert near_dedup.likely(*args, least=true - 0.15)[0] and not near_dedup.likely(*args, least=true + 0.15)[0]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 440)]
    above = {}
    for a, b in links:
        x, y = a, b
        while above.get(x, x) != x:
            x = above[x]
        while above.get(y, y) != y:
            y = above[y]
        above[max(x, y)] = min(x, y)

    def top(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}


# 3


def brute_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é  |", max_size=60))
def test_measures(text):
    assert quality_rules.measure(text)[:5] == brute_measures(text)


def test_rules_accuracy(spark):
    rows = quality_rules.op3_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert not rows[(rows.quality == 0)].kept.any()
    assert rows[(rows.quality == 1) & ~rows.base_failed].kept.mean() > 0.98
    assert (rows.base_failed == ((rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words))).all()


def test_rules_alike_at_every_size():
    histogram = np.zeros(3 ** len(quality_rules.RULES))
    histogram[[-1, 0, 5, 700]] = 900, 50, 20, 30
    assert np.allclose(quality_rules.fit(histogram), quality_rules.fit(histogram * 1e6))


def test_votes_and_posteriors_equal_a_loop_over_rows(spark):
    """EM row by row, without histogram or arrays, on the smallest documents."""
    rows = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    votes = [tuple(v + 1 for v in r.votes) for r in rows]
    rules, prior, good, share = len(quality_rules.RULES), quality_rules.PRIOR_VOTES, quality_rules.PRIOR_GOOD, quality_rules.PRIOR_SHARE
    theta = [[list(prior[c]) for c in (0, 1)] for _ in range(rules)]
    for _ in range(quality_rules.ITERATIONS):
        posterior = {}
        for v in set(votes):
            odds = np.log(good / (1 - good))
            for r in range(rules):
                odds += np.log(theta[r][1][v[r]]) - np.log(theta[r][0][v[r]])
            posterior[v] = 1 / (1 + np.exp(-min(50, max(-50, odds))))
        counts = [[[share * len(votes) * prior[c][x] for x in range(3)] for c in (0, 1)] for _ in range(rules)]
        sure = share * len(votes) * quality_rules.PRIOR_GOOD
        for v in votes:
            p = posterior[v]
            sure += p
            for r in range(rules):
                counts[r][0][v[r]] += 1 - p
                counts[r][1][v[r]] += p
        theta = [[[x / sum(c) for x in c] for c in rule] for rule in counts]
        good = sure / (len(votes) * (1 + share))
    for r, v in zip(rows, votes):
        assert abs(r.posterior - posterior[v]) < 1e-6
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= quality_rules.THRESHOLD)
    assert 0 < sum(r.kept for r in rows) < len(rows)


# 4


def test_toxic_views():
    matcher = toxicity.Matcher({"idiot": 3.0, "trash": 2.0, "clown": 1.0})
    words = lambda t: sorted(w for w, _ in matcher.places(t).values())
    assert words("An IDIOT! 1d10t іdïot ＴRASH tr@sh") == ["idiot"] * 3 + ["trash"] * 2
    assert words("idiotic trashy the trash can and clown fish") == []
    assert words("idiot$$$ trash.") == ["idiot", "trash"]
    assert matcher.measures(None) == (0, 0.0, 0)


def test_toxic_words_of_any_script(spark):
    """Words in scripts with and without spaces are learned and found; marks belong to words."""
    clean = ["сегодня хорошая погода в городе", "今天天气很好我们去公园", "اليوم الطقس جميل في المدينة", "วันนี้อากาศดีมาก", "오늘 날씨가 좋습니다"]
    bad = {"ru": "мерзавец", "zh": "混蛋", "ar": "حقير", "th": "เลวทราม", "ko": "나쁜놈아"}
    spread = lambda text, i: " ".join(f"{w} x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for w in text.split())  # noqa: E731  no near copies
    rows = [(i, spread(clean[i % 5], i), 0) for i in range(600)]
    for k, (clean_text, word) in enumerate(zip(clean, bad.values())):
        joined = clean_text[:4] + word + clean_text[4:] if k in (1, 3) else f"{clean_text} {word} да"
        rows += [(1000 + 200 * k + i, spread(joined, 17 * k + i), 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert [i for i, _, y in rows if got[i] != y] == []
    assert {toxicity.fold(bad["ru"]), bad["zh"], bad["ar"]} <= set(model.lexicon)
    matcher = toxicity.Matcher({"混蛋": 1.0, toxicity.fold("мерзавец"): 1.0})
    assert len(matcher.places("你混蛋啊 мерзавец")) == 2 and matcher.places("мерзавецкий") == {}
    assert list(toxicity.words_of("ab abc 你好吗 été x")) == ["abc", "été", "你好", "好吗", "你好吗"]


def test_learned_exceptions(spark):
    """A phrase that only clean texts have, and often, is no match; one that is rare or also stands in a toxic text stays one."""
    filler = lambda i: " ".join(f"{'abcdefgh'[(i * k) % 8]}{'klmnop'[(i + k) % 6]}ra" for k in range(1, 9))
    rows = [(i, f"{filler(i)} you blarg person {filler(i + 3)}", 1) for i in range(80)] + [(100 + i, f"{filler(i)} the blarg bird sings {filler(i + 5)}", 0) for i in range(30)]
    rows += [(200 + i, filler(i * 7 + i % 11), 0) for i in range(500)] + [(900, "rare blarg stone", 0)]
    sample = spark.createDataFrame([(y, t) for _, t, y in rows], "label int, text string")
    found = toxicity.learn_exceptions(sample, {"blarg": 2.0})
    assert found == (*toxicity.EXCEPTIONS, "blarg bird", "the blarg")
    matcher = toxicity.Matcher({"blarg": 2.0}, found)
    assert matcher.places("see the BLARG bird") == {} and len(matcher.places("you blarg person")) == 1
    assert toxicity.learn_exceptions(sample, {}) == toxicity.EXCEPTIONS


def test_toxic_held_out(spark):
    rng = np.random.default_rng(3)
    bad, rows = ["zork", "blarg", "fnord"], []
    for i in range(900):
        words = [f"q{x}" for x in rng.integers(0, 300, 40)]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        if i % 6 == 0:
            words[3], words[9] = bad[i % 3], bad[(i // 3) % 3]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(bad) <= set(model.lexicon) and len(model.lexicon) < 6
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == t for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.98


def test_lexicon_and_scores_equal_brute_force(spark):
    rng, pool = np.random.default_rng(12), ["zork", "bl4rg", "tree", "hill", "rain", "stone", "fnord", "bird", "s@ddle", "moon"]
    rows = [(i, " ".join(rng.choice(pool[: 10 if i % 4 == 0 else 6][2:] if i % 4 else pool, 12)), int(i % 4 == 0)) for i in range(240)]
    rows += [(1000 + i, rows[0][1] + " end", 1) for i in range(9)]  # near copies count once
    docs = spark.createDataFrame([r[:2] for r in rows] + [(0, "a later text of one id")] * 3 + [(7777, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    known = [(i, min(t, "a later text of one id") if i == 0 else t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    single = {}
    for i, t, y in sorted(known):
        words = t.encode().lower().split()
        single.setdefault((min(near_dedup.shingles(t.encode())) >> np.uint64(1), y), t) if words else None
    held = [({w for v in toxicity.views(t) for w in toxicity.words_of(v)}, y) for (_, y), t in single.items()]
    toxic, clean = sum(y for _, y in held), sum(1 - y for _, y in held)
    n, t = Counter(w for ws, _ in held for w in ws), Counter(w for ws, y in held if y for w in ws)
    tried, want, share = sum(t[w] >= 3 for w in n), {}, toxic / (toxic + clean)
    for w in n:
        c = n[w] - t[w]
        if t[w] >= 3:
            ratio = t[w] * np.log(t[w] / (n[w] * share)) + (c * np.log(c / (n[w] * (1 - share))) if c else 0)
            weight = np.log((t[w] + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
            if weight > 1 and ratio >= toxicity.EVIDENCE + np.log(tried):
                want[w] = round(weight, 6)
    assert want and model.lexicon == want
    again = toxicity.fit(docs.repartition(7), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert again.lexicon == model.lexicon and np.allclose(again.curve, model.curve)
    texts = {i: t for i, t, _ in rows if i} | {7777: ""}
    for r in toxicity.score(docs, model).filter("doc_id <> 0").collect():
        # the words of the lexicon have three letters or more, so no view finds two of them at one place
        places = {(m.start(), m.group()) for v in toxicity.views(texts[r.doc_id]) for m in re.finditer("[a-z]+", v)}
        total = sum(want.get(w, 0) for _, w in places)
        density = 100 * total / max(20, texts[r.doc_id].count(" ") + 1)
        a, b, c = model.curve
        assert abs(r.score - 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(density))))) < 1e-9
        assert r.predicted == (r.score >= toxicity.LEVEL)


# 5


def test_languages_held_out(spark):
    rows = language_id.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == (rows.doc_id.map(lambda i: zlib.crc32(str(i).encode())) % 5 == 0)).all()
    assert (rows.lang == rows.lang_pred)[rows.held_out].mean() > 0.95


SCRIPTS = {
    "en": "the cat sat on the mat", "de": "die Katze saß auf der Matte", "ru": "кошка сидела на коврике", "bg": "котката седеше на килима",
    "zh": "猫坐在垫子上", "ja": "猫はマットの上に座った", "th": "แมวนั่งอยู่บนเสื่อ", "lo": "ແມວນັ່ງຢູ່ເທິງເສື່ອ", "x": "abracadabra abra", "y": "\x00\x01 zz",
}


def test_code_lengths_equal_plain_ppm(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 16)  # texts are then coded in several pieces
    rows = [(i, t * (1 + i % 2), lang) for i, (lang, t) in enumerate(list(SCRIPTS.items()) * 4) if zlib.crc32(str(i).encode()) % 5]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(SCRIPTS) and len(model.langs) > language_id.GROUP
    order, asked = language_id.ORDER, [b"abra cat", "сидела 猫 แมว Matte!".encode(), b"", "ZZ\U0001f600".encode()]
    bits = language_id.text_bits(asked, model.tables())
    for column, lang in enumerate(model.langs):
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        for _, text, own in rows:
            data = bytes(order) + text.encode().lower()
            for i in range(order, len(data) if own == lang else 0):
                for o in range(order + 1):
                    counts[o][data[i - o : i]][data[i]] += 1

        def share(context, byte):
            if context is None:
                return 1 / 256
            seen = counts[len(context)][context]
            shorter = context[1:] if context else None
            total, distinct = sum(seen.values()), len(seen)
            if not total:
                return share(shorter, byte)
            return seen[byte] / (total + distinct) if seen[byte] else distinct / (total + distinct) * share(shorter, byte)

        for text, got in zip(asked, bits[:, column]):
            data = bytes(order) + text.lower()
            assert abs(sum(-np.log2(share(data[i - order : i], data[i])) for i in range(order, len(data))) - got) < 1e-3


def test_languages_of_one_script(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.permutation(list(SCRIPTS[lang] * 8))), lang) for i, lang in enumerate(["th", "lo", "ru", "zh", "ja", "bg"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert all(got[i] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0)


def test_sample_is_bounded_and_ties_are_defined(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 400)
    rows = [(i, "long " * 400 if i % 7 == 0 else "word " * 4, "ab"[i % 2]) for i in range(200)] + [(1, "word " * 4, "b")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = Counter()
    for r in language_id.training_rows(df).collect():
        sizes[r.lang] += len(r.body)
    assert sizes == {"a": 200, "b": 200}  # no document above the share of 200 bytes, and the share is never passed
    same = spark.createDataFrame([(i, "same text", lang) for i, lang in enumerate("abab" * 10)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(same, language_id.Model({x: (np.array([97]).tobytes(), np.array([1], "<i4").tobytes()) for x in "ba"})).collect()} == {"a"}
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1000)
    huge = spark.createDataFrame([(1, "x" * 200_000, "c"), (2, "short text", "a")], "doc_id long, text string, lang string")
    assert [(r.lang, bytes(r.body)) for r in language_id.training_rows(huge).collect()] == [("a", b"short text")]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 300 * 40)
    monkeypatch.setattr(language_id, "LANGUAGES_BROADCAST", 1)
    monkeypatch.setattr(language_id, "CHOSEN_BROADCAST", 1)
    learned = {f"l{i}" for i in range(300) if zlib.crc32(str(i).encode()) % 5}
    assert set(language_id.fit(many).langs) == learned


def test_undetermined(docs):
    rows = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (5, 6, 7))


# 6


def plain_vote(cosines, labels):
    order = sorted(range(len(labels)), key=lambda i: -cosines[i])
    k = min(quality_classifier.NEIGHBOURS, len(labels))
    level = cosines[order[k - 1]]
    above, tied = [i for i in order if cosines[i] > level], [i for i in order if cosines[i] == level]
    weights = {i: np.exp(quality_classifier.SHARPNESS * (cosines[i] - 1)) for i in above}
    weights |= {i: np.exp(quality_classifier.SHARPNESS * (level - 1)) * (k - len(above)) / len(tied) for i in tied}
    return sum(w * labels[i] for i, w in weights.items()) / sum(weights.values())


def test_ties_share_their_places():
    rng = np.random.default_rng(5)
    labels = np.array([1.0] * 20 + [0.0] * 20)
    for order in (labels, labels[::-1], rng.permutation(labels)):
        assert quality_classifier.vote(np.ones((2, 40)), order).tolist() == [0.5, 0.5]
    cosine = np.round(rng.uniform(0, 1, (30, 60)), 1)
    labels = rng.integers(0, 2, 60).astype(float)
    want = [plain_vote(row, labels) for row in cosine]
    assert np.allclose(quality_classifier.vote(cosine, labels), want)
    turn = rng.permutation(60)
    assert np.allclose(quality_classifier.vote(cosine[:, turn], labels[turn]), want)
    assert quality_classifier.vote(np.array([[0.3]]), np.array([1.0])).tolist() == [1.0]


def test_frequencies_and_singular_vectors_equal_brute_force(spark):
    texts = ["a b c", "a a B!", "zz 1 b", None, "", "c c c " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got, n = quality_classifier.inverse_frequencies(df), np.zeros(quality_classifier.TERMS)
    for t in texts:
        terms = set()
        for word in (t or "").encode().split():
            both = quality_classifier._terms[word]
            terms |= {both // quality_classifier.SHAPE_TERMS, quality_classifier.WORD_TERMS + both % quality_classifier.SHAPE_TERMS}
        n[list(terms)] += 1
    kinds = quality_classifier.WORD_TERMS + quality_classifier.SHAPE_TERMS
    assert np.allclose(got[:kinds], np.log((1 + len(texts)) / (1 + n[:kinds])) + 0.3) and np.all(got[kinds:] == 1)
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((200, 30)) @ np.diag(0.7 ** np.arange(30)) @ rng.standard_normal((30, 50))).astype(np.float32)
    v = quality_classifier.right_vectors(x, 5)
    _, _, whole = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(np.sum(v * whole[:5].T, axis=0)), 1, atol=1e-3)




def test_quality_held_out(spark):
    rows = quality_classifier.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.quality == held.predicted).mean() > 0.9 and rows.score.between(0, 1).all()


def test_votes_equal_brute_force(spark, docs, labels):
    model = quality_classifier.fit(docs, labels)
    texts = [t for t in TEXTS if t][:6]
    x = model.project(np.stack([quality_classifier.counts(t) for t in texts]))
    for v, got in zip(x, model.scores(texts)):
        cosine = model.vectors @ v
        near = np.argsort(-cosine, kind="stable")[: quality_classifier.NEIGHBOURS]
        w = np.exp(quality_classifier.SHARPNESS * (cosine[near] - 1))
        assert abs((w * model.labels[near]).sum() / w.sum() - got) < 1e-5


# 7


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=80))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.int64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(x, 1 << 40), len(x), 1 << 40) == x).all()


def test_exact_groups(spark, docs):
    rows = exact_dedup.deduplicate(docs).toPandas()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = defaultdict(list)
    for r in docs.collect():
        want[strip(r.text)].append((-len(r.text or ""), float("inf") if r.doc_id is None else r.doc_id))
    for r in docs.collect():
        body, key = strip(r.text), hashlib.sha256(strip(r.text).encode()).hexdigest()
        of = rows[(rows.text_sha256 == key)]
        assert (of.group_size == len(want[body])).all() and len(of) == len(want[body])
        assert of.kept.sum() == 1
        keep = min(want[body])[1]
        assert (of.keep_id.isna() if keep == float("inf") else of.keep_id == keep).all()
    assert exact_dedup.deduplicated(docs).count() == len(want)


# 8, 9


def _encode(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False)


def test_pieces_round_trip(docs):
    rows = packing.pack(docs).toPandas()
    assert rows.sequence_id.is_unique and (rows.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= packing.CONTEXT for n in rows.length)
    for i in (0, 5, 11, 13):
        of = rows[rows.doc_id == i].sort_values("start")
        ids = np.frombuffer(b"".join(of.ids), "<u4")
        assert ids.tolist() == [*_encode(TEXTS[i] or "").ids, 0] and (of.doc_tokens == len(ids)).all()
        assert of.start.tolist() == np.cumsum([0, *of.length])[:-1].tolist()
    digest = packing.digest(packing.pack(docs)).toPandas()
    assert (digest.ids_crc32 == [zlib.crc32(b) for b in rows.ids]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_tokenizer(text):
    assert packing.encoder().ids(text).tolist() == _encode(text).ids



def test_added_tokens_equal_plain_call(spark):
    from tokenizers import Tokenizer

    plain, end = Tokenizer.from_file(packing.tokenizer_path()), "<|endoftext|>"
    for text in (f"a {end} b", end, f"{end}{end}\n{end}", f"été {end}\nnext line {end} x", f"你好{end}", "<|endoftext", "a <|endoftext|b>"):
        want = plain.encode(text, add_special_tokens=False)
        own = packing.encoder()
        assert own.ids(text).tolist() == want.ids
        if text.isascii():
            assert own.first_chars(text, own.ids(text)).tolist() == [a for a, _ in want.offsets]
    df = spark.createDataFrame([(1, f"a {end} b")], "doc_id long, text string")
    assert {r.doc_tokens for r in packing.pack(df).collect()} == {5} and token_counts.attribute_tokens(df).first().doc_tokens == 4


def test_sections_add_up(docs):
    rows = token_counts.attribute_tokens(docs).toPandas()
    for i in (3, 11, 13):
        of = rows[rows.doc_id == i]
        sums = of.groupby(["section"]).first()
        assert sums.tokens.sum() == len(_encode(TEXTS[i]).ids) == of.doc_tokens.iloc[0]


def brute_sections(text, starts):
    starts = sorted({0, *(s for s in starts if s is not None and 0 < s < len(text))})
    stops, spans = [*starts[1:], len(text)], _encode(text).offsets
    ends = [a for a, _ in spans[1:]] + [len(text)]
    rows = [[s, e, 0, 0, len(spans)] for s, e in zip(starts, stops)]
    for (first, _), end in zip(spans, ends):
        k = max(i for i, s in enumerate(starts) if s <= first)
        rows[k][2] += 1
        rows[k][3] += end > stops[k]
    return rows


def test_any_sections_equal_brute_force(spark):
    rng, rows = np.random.default_rng(10), []
    pool = ["hello", " ", "\n", "wörld", "12", "  ", "'s", "the", "\t", "é", "x" * 30]
    cases = [("hello", []), ("hello", [3, 6]), ("", []), ("hello", [0, 99]), ("hello", [4, None, 2, 2, -1]), (None, [1])]
    cases += [("".join(rng.choice(pool, rng.integers(0, 12))), [int(x) for x in rng.integers(-2, 40, rng.integers(0, 6))]) for _ in range(120)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], "doc_id long, text string, cuts array<long>")
    for r in token_counts.attribute_tokens(df, "cuts").orderBy("doc_id", "section").collect():
        rows.append((r.doc_id, [r.start, r.stop, r.tokens, r.crossing, r.doc_tokens]))
    assert rows == [(i, row) for i, (t, s) in enumerate(cases) for row in brute_sections(t or "", s)]


def test_fields_share_one_encoding(spark):
    df = spark.createDataFrame([(1, "A title", None, "the body\nof text"), (2, None, None, None), (3, "x", "y", "")], "doc_id long, a string, b string, c string")
    rows = token_counts.attribute_to_fields(df, ["a", "b", "c"]).collect()
    for i, text in ((1, "A title\n\nthe body\nof text"), (2, "\n\n"), (3, "x\ny\n")):
        of = [r for r in rows if r.doc_id == i]
        assert [r.field for r in of] == ["a", "b", "c"] and of[-1].stop == len(text)
        assert sum(r.tokens for r in of) == len(_encode(text).ids) == of[0].doc_tokens
    assert [(r.start, r.stop) for r in rows if r.doc_id == 1] == [(0, 8), (8, 9), (9, 25)]


def test_crossing_token_goes_to_its_start(spark):
    df = spark.createDataFrame([(1, "hello\n\nworld hello", [0, 6, 7, 9])], "doc_id long, text string, cuts array<long>")
    rows = token_counts.attribute_tokens(df, "cuts").orderBy("section").collect()
    spans = _encode("hello\n\nworld hello").offsets
    want = Counter(max(k for k, s in enumerate([0, 6, 7, 9]) if s <= a) for a, _ in spans)
    assert [r.tokens for r in rows] == [want.get(k, 0) for k in range(4)]
    assert [r.crossing for r in rows][2] == 1


# 10


def test_mix_near_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), None if s == 6 else f"s{s}") for i, s in enumerate(rng.integers(0, 7, 3000))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and set(got.times) <= {0, 1, 2}
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= 40).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-3


def test_targets_cap_and_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, sizes.count()).collect()}
    left = 1.5 * 1510 - 20
    assert got["a"] == 20 and abs(got["b"] - min(2000, left * 2 / 3)) < 1e-6 and abs(sum(got.values()) - 1.5 * 1510) < 1e-6


def test_mixed_rows_follow_the_mix(docs):
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()) == +times


def test_messages_are_large_at_any_size():
    """From one machine's rows to 3 * 10**10 in 750,000 tasks: a message holds hundreds of fingerprints, a sender and an owner stay bounded."""
    for count, tasks in ((256_410, 31), (10**7, 400), (10**9, 25_000), (3 * 10**10, 750_000)):
        owners, together = exact_dedup.exchange_of(count, tasks)
        senders = -(-tasks // together)
        assert count / (senders * owners) >= exact_dedup.MESSAGE
        assert count / owners <= exact_dedup.OWNED + 1 and count / senders <= max(2.1 * owners * exact_dedup.MESSAGE, 10**6)
    assert exact_dedup.exchange_of(0, 1) == (8, 1) and exact_dedup.exchange_of(3, 50) == (8, 50)


def test_tasks_joined_to_senders_find_the_same(spark, monkeypatch):
    texts = [f"text number {i % 40} of many" for i in range(200)] + ["alone", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    want = sorted(map(tuple, exact_dedup.deduplicate(df).collect()))
    monkeypatch.setattr(exact_dedup, "MESSAGE", 4)  # fewer senders than tasks, but more than one
    assert exact_dedup.exchange_of(203, 16)[1] == 3
    assert sorted(map(tuple, exact_dedup.deduplicate(df).collect())) == want


def test_many_sources_are_ordered_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"s{i:03d}" if i else None, int(rng.integers(0, 1000))) for i in range(200)]
    sizes = spark.createDataFrame(rows, "source string, source_size long")
    one = {r.source: r.target for r in mixing.targets(sizes, 200).collect()}
    monkeypatch.setattr(mixing, "SOURCES_PER_RANGE", 20)
    assert {r.source: r.target for r in mixing.targets(sizes, 200).collect()} == one
