"""Merges, upserts, grouping, sources, sinks and streams on small fixtures."""

import glob
import math
import json
import os
import random
import statistics
import threading
from collections import Counter

from pyspark.sql import functions as F

from hypothesis import given, strategies as st

from offerloom.functions.similarity import token_set
from offerloom.operators.shortlist import Names
from offerloom.operators import classify, dedup, frontier, matching, merge, prices, publish, ranking, upserts
from offerloom.plans import lineage
from offerloom.sources import readers, writers


def test_upsert_again_changes_nothing(spark):
    empty = spark.createDataFrame([], "k long, price double, availability string, first_seen_at timestamp, last_seen_at timestamp")
    batch = spark.createDataFrame([(1, 2.0, "a"), (2, None, None)], "k long, price double, availability string")
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-0{n} 00:00:00"))
    state, history = merge.upsert(empty, batch, "k", ["price", "availability"], day(1))
    assert history.count() == 2
    again, history = merge.upsert(state, batch, "k", ["price", "availability"], day(2))
    assert history.count() == 0 and again.filter("first_seen_at = '2024-01-01'").count() == 2
    later = spark.createDataFrame([(2, 5.0, None)], batch.schema)
    _, history = merge.upsert(again, later, "k", ["price", "availability"], day(3))
    assert [(r.k, r.price) for r in history.collect()] == [(2, 5.0)]


def test_layers(spark):
    base = spark.createDataFrame([("u1", "A", "", 1.0), ("u2", "B", "b", None)], "url string, name string, brand string, price double")
    richer = spark.createDataFrame([("u1", "", "x", 2.0), ("u3", "C", "c", 3.0)], base.schema)
    rows = {r.url: r for r in merge.layer(base, richer, "url", {}, "full_outer").collect()}
    assert (rows["u1"].name, rows["u1"].brand, rows["u1"].price, rows["u1"].status) == ("A", "x", 2.0, "enriched")
    assert rows["u2"].status == "base" and rows["u3"].status == "added" and rows["u3"].name == "C"
    filled = {r.url: r for r in merge.layer(base, richer, "url", {"*": "fill"}).collect()}
    assert filled["u1"].price == 1.0 and filled["u1"].brand == "x"


def test_tiers_and_insertion(spark):
    rows = spark.createDataFrame([(1, "r", "x"), (2, "r", "y"), (3, "", "x"), (4, None, "x"), (5, None, None), (6, None, None)], "seq long, ref string, name string")
    assert sorted(r.seq for r in dedup.tiered_dedup(rows, [["ref"], ["name"]], ["seq"]).collect()) == [1, 3, 5, 6]
    stored = rows.filter("seq = 1")
    assert sorted(r.seq for r in dedup.insert_or_ignore(stored, rows.filter("seq > 1 and ref is not null"), ["ref"], ["seq"]).collect()) == [1, 3]


def test_missing_columns(spark):
    out = merge.add_missing_columns(spark.range(1), {"a": "string", "id": "bigint"})
    assert out.columns == ["a", "id"]


def test_range_takes_predecessor(spark):
    rows = spark.range(60).select(F.format_string("%02d", "id").alias("k"))
    assert sorted(r.k for r in ranking.key_range(rows, "k", "095", "12").collect()) == ["09", "10", "11"]


def _sequential(offers):
    """The grouping one offer after the other, on folded names without accents."""
    from offerloom.functions.text import STOP_WORDS

    groups = []
    tokens = lambda n: [t for t in dict.fromkeys(n.split()) if len(t) > 1 and t not in STOP_WORDS]
    for seq, merchant, name in offers:
        mine, best, key = tokens(name), None, (1, 0)
        order = {}
        for t in mine:
            for g in groups:
                if len(t) >= 3 and t in g["tokens"]:
                    order.setdefault(id(g), [g, 0])[1] += 1
        for g, common in order.values():
            share = len(set(mine) & set(g["tokens"])) / min(len(mine), len(g["tokens"]))
            if merchant not in g["merchants"] and (common, share) > key:
                best, key = g, (common, share)
        if best is None or key[0] < 2:
            best = {"id": seq, "tokens": tokens(name), "merchants": set()}
            groups.append(best)
        best["merchants"].add(merchant)
        yield seq, best["id"]


def test_grouping_equals_sequence(spark):
    words = "gutta composite limes ciment silicone fraise turbine masque".split()
    for seed in range(4):
        rng = random.Random(seed)
        offers = [(m * 100 + i, f"m{m}", " ".join(rng.sample(words, 4))) for m in range(3) for i in range(8)]
        df = spark.createDataFrame([(*o, "", "", "") for o in offers], "seq long, merchant string, name string, brand string, manufacturer_reference string, ean string")
        got = {r.seq: r.group_id for r in matching.greedy_groups(df, ["m0", "m1", "m2"]).collect()}
        assert got == dict(_sequential(offers))


def _brute_groups(offers):
    """Offer by offer: the group of the EAN joined last, else of the reference, else by shared words."""
    groups, last = [], {}
    for seq, merchant, name, ref, ean in offers:
        fits = lambda g: merchant not in g["merchants"]
        best = last.get(ean) if ean and fits(last.get(ean, {"merchants": {merchant}})) else None
        if best is None and len(ref) >= 4:
            best = next((g for g in groups if g["ref"] == ref and fits(g)), None)
        if best is None:
            mine, key = name.split(), (1, 0)
            for g in sorted((g for g in groups if fits(g)), key=lambda g: min((mine.index(t) for t in mine if t in g["tokens"]), default=99)):
                common = len(set(mine) & set(g["tokens"]))
                score = (common, common / min(len(mine), len(g["tokens"])))
                if common >= 2 and score > key:
                    best, key = g, score
        if best is None:
            best = {"id": seq, "tokens": name.split(), "ref": ref, "ean": ean, "merchants": set()}
            groups.append(best)
        best["merchants"].add(merchant)
        if best["ean"]:
            last[best["ean"]] = best
        yield seq, best["id"]


def test_grouping_with_identifiers_equals_sequence(spark):
    words = "gutta composite limes ciment silicone fraise turbine masque alginate resine".split()
    for seed in range(4):
        rng, offers = random.Random(seed), []
        for m in range(4):
            eans = rng.sample([f"1234567{i}" for i in range(8)], 6)  # each once in a merchant
            refs = rng.sample([f"REF{i}" for i in range(8)], 6)
            offers += [(m * 100 + i, f"m{m}", " ".join(rng.sample(words, 3)), refs[i] if rng.random() < 0.5 else "", eans[i] if rng.random() < 0.5 else "") for i in range(6)]
        df = spark.createDataFrame([(s, m, n, "", r, e) for s, m, n, r, e in offers], "seq long, merchant string, name string, brand string, manufacturer_reference string, ean string")
        got = {r.seq: r.group_id for r in matching.greedy_groups(df, ["m0", "m1", "m2", "m3"]).collect()}
        assert got == dict(_brute_groups(offers))


def test_strong_ids_are_normalised(spark):
    offers = spark.createDataFrame([(1, " 4006-381 333931", "x"), (2, "", "4867-A2"), (3, None, "dup-1"), (4, "--", ".")], "offer_id long, ean string, manufacturer_reference string")
    products = spark.createDataFrame([(9, "4006381333931", ""), (8, "4006381333931", None), (7, None, "4867A2"), (6, "", "DUP1"), (5, "", "dup 1"), (4, "-", "..")], "product_id long, ean string, manufacturer_reference string")
    got = {r.offer_id: (r.product_id, r.why) for r in matching.strong_matches(offers, products).collect()}
    assert got == {1: (8, "ean"), 2: (7, "manufacturer_reference")}


def test_scored_best_equals_brute_force(spark):
    """Identifiers, brands, packagings and variants in play; the newest of equals, and only of the shortlist."""
    rng, words = random.Random(3), "gants latex limes gutta ciment fraise masque".split()
    fields = "name string, ean string, manufacturer_reference string, brand string, variant string, packaging string"

    def offer(i):
        pick = lambda *xs: rng.choice(xs)
        return (i, " ".join(rng.sample(words, 3)), pick("", "", "12345678", "87654321"), pick("", "", "R-100", "r100", "R200"), pick("", "Acme", "3M", "Solventum"), pick("", "A1", "A2"), pick("", "boite de 10", "boite de 20"))

    offers, products = [offer(i) for i in range(40)], [offer(i) for i in range(60)]
    got = {r.offer_id: (r.product_id, r.score, r.decision) for r in matching.scored_matches(spark.createDataFrame(offers, "offer_id long, " + fields), spark.createDataFrame(products, "product_id long, " + fields), newest=50).collect()}
    alias = {"3m": "solventum"}
    for i, name, ean, ref, brand, variant, pack in offers:
        best = (-1, None)
        for p, name2, ean2, ref2, brand2, variant2, pack2 in products[10:]:
            r, r2 = (x.upper().replace("-", "") for x in (ref, ref2))
            b, b2 = (alias.get(x.lower(), x.lower()) for x in (brand, brand2))
            apart = bool(variant and variant2 and variant != variant2)
            if ean and ean2:
                score = float(ean == ean2)
            elif r and r2:
                score = (0.82 if b and b2 and b != b2 else 0.99) if r == r2 else 0.08
            else:
                known = 0.5 if not (b and b2) else float(b == b2)
                score = min(1.0, max(0.0, 0.58 * token_set(name, name2) + 0.24 * known + 0.18 * (token_set(pack, pack2) if pack and pack2 else 0.5) - 0.28 * apart))
            best = max(best, (round(score, 9), p))
        decision = "auto_match" if best[0] >= matching.AUTO else "review" if best[0] >= matching.REVIEW else "no_match"
        assert (round(got[i][1], 9), got[i][0], got[i][2]) == (*best, decision)


def test_scored_best_needs_few_similarities(spark):
    """Bounds leave less than one name in twenty of the whole shortlist to be compared, and the best stays the best of all."""
    rng = random.Random(9)
    syllables = "ba co di fu ga le mi no pa ro sa te vu xi zo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    known = [word() for _ in range(400)]
    products = [(i, " ".join(rng.sample(known, rng.randint(2, 6))), rng.choice(["", "Acme", "Bolo", "Kavo"])) for i in range(3000)]
    offers = [(i, rng.choice(products)[1] if i % 2 else " ".join(rng.sample(known, 4)), rng.choice(["", "Acme", "Kavo"])) for i in range(60)]
    offers = [(i, n.replace("o", "a", 1) if i % 3 == 0 else n, b) for i, n, b in offers]
    fields = "name string, brand string, ean string, manufacturer_reference string, variant string, packaging string"
    side = lambda rows, key: spark.createDataFrame([(*r, "", None, "", None) for r in rows], f"{key} long, {fields}")
    rows = matching.scored_matches(side(offers, "offer_id"), side(products, "product_id")).collect()
    assert sum(r.n_scored for r in rows) < 0.05 * len(offers) * len(products)
    got = {r.offer_id: (round(r.score, 9), r.product_id) for r in rows}
    for i, name, brand in offers:
        scores = ((round(0.58 * token_set(name, n) + 0.24 * (0.5 if not (brand and b) else float(brand == b)) + 0.09, 9), p) for p, n, b in products)
        assert got[i] == max(scores), i
    assert matching.scored_matches(side(offers, "offer_id"), side([], "product_id")).count() == 0


@given(st.lists(st.sampled_from("ab ba abc cab a b été".split()), max_size=5), st.lists(st.sampled_from("ab ba abc cab a b c".split()), max_size=5))
def test_bounds_are_bounds(a, b):
    a, b = " ".join(a), " ".join(b)
    assert Names([b, ""]).most(a)[0] >= token_set(a, b) - 1e-12


def test_grouping_by_a_word_of_many_groups(spark):
    """A group is found by its words however many earlier groups hold them, with three shared words, with two, and when others took the better ones."""
    rows = [(i, "a", f"gants latex nr{i}", "", "", "") for i in range(1, 560)] + [(1001, "b", "gants autre nr559", "", "", ""), (1002, "b", "gants latex nr558 xx", "", "", ""), (1003, "b", "gants latex nr558 yy", "", "", "")]
    df = spark.createDataFrame(rows, "seq long, merchant string, name string, brand string, manufacturer_reference string, ean string")
    got = {r.seq: r.group_id for r in matching.greedy_groups(df, ["a", "b"]).filter("seq > 1000").collect()}
    assert got == {1001: 559, 1002: 558, 1003: 1}


def test_grouping_by_identifiers(spark):
    rows = [(1, "a", "gants latex", "X", "REF100", "12345678"), (2, "b", "autre chose", "X", "", "12345678"), (3, "b", "rien du tout", "Y", "REF-100", ""), (4, "c", "encore", "", "REF100", "")]
    df = spark.createDataFrame(rows, "seq long, merchant string, name string, brand string, manufacturer_reference string, ean string")
    assert {r.seq: r.group_id for r in matching.greedy_groups(df, ["a", "b", "c"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}



def test_scored_best_of_all_products(spark):
    words = "gants latex limes gutta ciment fraise masque turbine silicone".split()
    rng = random.Random(1)
    products = [(1, "gants blancs poudre"), (2, "stomatologie")] + [(i, "gants " + " ".join(rng.sample(words[1:], 3))) for i in range(3, 560)]
    offers = [(1, "gants blancs poudre"), (2, "stomatologye"), (3, "gants latex"), (4, "gants poudrez"), (5, "limes ciments")]
    side = lambda rows, key: spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], f"{key} long, name string, ean string, manufacturer_reference string, brand string, variant string, packaging string")
    got = {r.offer_id: r.product_id for r in matching.scored_matches(side(offers, "offer_id"), side(products, "product_id")).collect()}
    assert got == {o: max((round(token_set(name, y), 9), p) for p, y in products)[1] for o, name in offers}
    assert (got[1], got[2]) == (1, 2)



def test_overlap_pairs_of_frequent_tokens(spark):
    rng = random.Random(2)
    sets = {i: {"gants", "latex", f"lot{i // 4}", *rng.sample(["rouge", "jaune", "bleu", "vert", "petit"], 2)} for i in range(1100)}
    df = spark.createDataFrame([(i, f"m{i % 3}", " ".join(sorted(t))) for i, t in sets.items()], "offer_id long, merchant string, name string")
    for least in (4, 5):
        got = {(r.a, r.b): r.common for r in matching.token_overlap_pairs(df, least).collect()}
        assert got == {(a, b): n for a in sets for b in range(a + 1, len(sets)) if a % 3 != b % 3 and (n := len(sets[a] & sets[b])) >= least}


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    found = frontier.reach(spark.createDataFrame([("a",)], "url string"), links, 3)
    assert {r.url: r.depth for r in found.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_frontier_ends_without_a_bound(spark, monkeypatch):
    """Cycles, a long chain, pages that nothing leads to, null links; bitmaps joined by broadcast and by shuffle."""
    rng = random.Random(7)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", "c0"), ("c3", "c3"), ("lost", "c1"), (None, "c1"), ("c1", None)]
    pairs += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    links = spark.createDataFrame(pairs, "source string, target string")
    roots = spark.createDataFrame([("c0",), ("n1",), ("alone",), ("c0",), (None,)], "url string")
    depth, newest = {"c0": 0, "n1": 0, "alone": 0}, ["c0", "n1", "alone"]
    while newest:
        newest = sorted({t for s, t in pairs if s in newest and t is not None and t not in depth})
        depth |= {t: 1 + max(depth.values()) for t in newest}
    for bound in (2_000, 0):
        monkeypatch.setattr(frontier, "BITMAPS_BROADCAST", bound)
        assert {r.url: r.depth for r in frontier.reach(roots, links).collect()} == depth
    assert {r.url: r.depth for r in frontier.reach(roots, links, 2).collect()} == {u: n for u, n in depth.items() if n <= 2}
    assert {r.url: r.depth for r in frontier.reach(roots, links, 0).collect()} == {u: 0 for u, n in depth.items() if n == 0}


def test_queue_key(spark):
    queue = spark.createDataFrame([("u", "listing", "pending"), ("u", "product", "pending")], "url string, kind string, status string")
    done = frontier.mark(queue, spark.createDataFrame([("u", "listing", "done")], queue.schema))
    assert {r.kind: r.status for r in done.collect()} == {"listing": "done", "product": "pending"}


def test_report(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("a", 4), ("", 5)], "c string, seq int")
    assert [(r.c, r.n) for r in classify.histogram(rows, "c", "seq").collect()] == [("a", 2), ("b", 2), ("", 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('﻿merchant,brand,name,merchant_reference,manufacturer_reference,variant,price_eur,availability,source_url\nM,B,"x, y",002520,,,"12,50",,u\n', encoding="utf-8")
    row = readers.seed_csv(spark, str(tmp_path / "seed.csv")).first()
    assert (row.merchant, row.name, row.merchant_reference, row.price_eur) == ("M", "x, y", "002520", 12.5)
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"merchant": "M", "captured_at": "t", "products": [{"name": "n1", "price": 3, "url": "u1"}]}))
    (tmp_path / "c/b.json").write_text(json.dumps([{"name": "n2", "price_eur": 4, "source_url": "u2", "merchant": "N"}]))
    (tmp_path / "c/bad.json").write_text("{")
    rows = sorted((r.name, r.price_eur, r.source_url, r.merchant) for r in readers.captures(spark, str(tmp_path / "c")).collect())
    assert rows == [("n1", 3.0, "u1", "M"), ("n2", 4.0, "u2", "N")]
    (tmp_path / "l.jsonl").write_text('{"source_url":"u","v":1}\nbroken\n{"source_url":"u","v":2}\n')
    assert [r.v for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "source_url string, v long", "source_url").collect()] == [2]
    (tmp_path / "urls.txt").write_text("# c\nhttps://www.a.example/x\nhttps://b.example/y\nhttps://www.a.example/x\n")
    assert readers.url_list(spark, str(tmp_path / "urls.txt"), "a.example").count() == 1
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/p.html</loc><priority>0.8</priority></url><url><loc>https://a.example/q</loc></url></urlset>')
    assert readers.sitemap(spark, str(tmp_path / "s.xml"), "a.example", 0.6).count() == 1
    (tmp_path / "i.idx").write_text("com,a)/ 2024 f.gz 10 20 3\nbad\n")
    assert readers.block_index(spark, str(tmp_path / "i.idx")).first().length == 20
    (tmp_path / "i.cdxj").write_text('com,a)/x 2024 {"url": "u", "status": "200", "offset": "5"}\n')
    assert readers.capture_index(spark, str(tmp_path / "i.cdxj")).first().offset == 5
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), "a long").count() == 0
    (tmp_path / "p.html").write_text("<p>x</p>")
    assert readers.html_pages(spark, str(tmp_path)).first().html == "<p>x</p>"
    assert readers.newest_file(spark, str(tmp_path / "*.html")).first().path.endswith("p.html")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("00", 'a "b"', None)], "ref string, name string, price double")
    writers.json_and_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True, escape='"').first().name == 'a "b"'
    writers.script(rows, "products", str(tmp_path / "js"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "js")).collect()).startswith("window.products=[{")
    writers.run_partition(rows, str(tmp_path / "runs"), str(tmp_path / "offers"), 7)
    assert spark.read.parquet(str(tmp_path / "runs")).first().item_count == 1


def test_images_and_robots(spark):
    row = spark.createDataFrame([("R1", ["a.jpg", "x-r1.jpg"], "User-agent: *\nDisallow: /cart", "https://a.example/cart/1")], "ref string, images array<string>, robots string, url string")
    assert row.select(publish.image_for(F.col("ref"), F.col("images")).alias("i")).first().i == "x-r1.jpg"
    assert row.select(publish.robots_allow("robots", "url").alias("ok")).first().ok is False


def test_seeds_and_completeness(spark):
    links = spark.createDataFrame([("https://a.example/c/x.html?p=2",), ("https://a.example/c/x.html",), ("https://a.example/x.html",), ("https://b.example/c/x.html",), ("https://a.example/customer/x.html",)], "url string")
    assert [r.url for r in publish.category_seeds(links, "url", "a.example").collect()] == ["https://a.example/c/x.html"]
    good, errors = publish.split_by_completeness(spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "name string, k int"), ["name"])
    assert good.count() == 1 and [r.lacking for r in errors.collect()] == [["name"], ["name"]]


def test_clean_up_leaves_other_threads_tables(spark):
    """Tables that another thread cuts while one cleans up stay; the steps of the one that cleans up go."""
    cut_here, cut_there = threading.Event(), threading.Event()
    found = {}

    def other():
        cut_here.wait(60)
        found["other"] = lineage.cut(spark.range(7).toDF("x"), "other")
        cut_there.set()

    def make():
        found["step"] = lineage.cut(spark.range(3).toDF("x"), "step")
        cut_here.set()
        cut_there.wait(60)
        return lineage.cut_alone(lambda: lineage.cut(found["step"], "inner"), "nested")

    thread = threading.Thread(target=other)
    thread.start()
    out = lineage.cut_alone(make, "out")
    thread.join()
    assert found["other"].count() == 7 and out.count() == 3
    path = found["step"].inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    got = {(r.a, r.b): (r.s, r.n) for r in ranking.running(df.withColumn("one", F.lit(1)), ["a", "b"], {"s": "v", "n": "one"}, 7).collect()}
    total, want = 0, {}
    for n, (a, b, v) in enumerate(sorted(rows)):
        want[a, b] = (total, n)
        total += v
    assert got == want
    assert ranking.running(df.limit(0), ["a"], {"s": "v"}, 3).count() == 0


def test_exact_medians_of_hot_products(spark):
    """A product with nearly all rows lies in several ranges; ties, even and odd counts, nulls, a null product."""
    rng = random.Random(11)
    rows = [("hot", rng.randrange(4000) / 100) for _ in range(6000)] + [("one", 3.5), ("two", 1.0), ("two", 4.0), ("ties", 2.0), ("ties", 2.0), ("ties", 9.0), ("none", None), ("some", None), ("some", 7.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "p string, v double")
    got = {r.p: (r.median_price, r.min_price, r.max_price, r.n_prices) for r in prices.exact_medians(df, "p", "v", 8).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = (statistics.median(values), values[0], values[-1], len(values)) if values else (None, None, None, 0)
    assert got == want
    placed = ranking.running(df.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")), ["p", "v"], {"before": "n"}, 8, "part")
    assert placed.filter("p = 'hot'").select("part").distinct().count() > 4


def test_stored_rows_that_a_batch_lacks_stay_spread(spark):
    """No join of the upsert is keyed by what is null for all of them, which would be one task."""
    text = lambda c: F.concat(F.lit(c), F.col("id")).alias(c)
    null = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    texts = [F.lit("m").alias("merchant"), text("merchant_reference"), null("manufacturer_reference"), null("brand"), text("name"), null("variant"), text("source_url")]
    batch = lambda low, high: spark.range(low, high).select(F.col("id").alias("seq"), *texts, F.lit(1.0).alias("price_eur"), F.lit("x").alias("availability"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    stored = lineage.cut(upserts.daily_upsert(spark.createDataFrame([], upserts.CURRENT), batch(0, 2000), at, "a").current)
    done = upserts.daily_upsert(stored, batch(1990, 2010), at, "b").current
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = done.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes.sum() == 2010 and sizes.max() < 1000


def test_baskets_with_odd_rows(spark):
    """Merchants without a name, prices unknown, items that nobody has, equal totals: as adding up every merchant of every item says."""
    rng = random.Random(11)
    items = [(b, i, float(rng.randint(0, 3))) for b in range(60) for i in rng.sample(range(12), rng.randint(1, 5))]
    offers = [(i, m, rng.choice([None, 1.0, 1.004, 2.0, 2.0])) for i in range(11) for m in rng.sample([None, *range(9)], rng.randint(1, 7))]
    tables = spark.createDataFrame(items, "b long, i long, q double"), spark.createDataFrame(offers, "i long, m long, p double"), "b", "i", "m", "p", "q"
    shown = lambda c: F.floor(c * 100 + 0.500001) / 100
    sums = {}
    for b, i, q in items:
        for j, m, p in offers:
            if i == j:
                n, total = sums.get((b, m), (0, None))
                sums[b, m] = n + 1, total if p is None else (total or 0.0) + p * q
    sizes = Counter(b for b, _, _ in items)
    cents = lambda t: None if t is None else math.floor(t * 100 + 0.500001) / 100
    full = {(b, m, sizes[b], cents(t)) for (b, m), (n, t) in sums.items() if n == sizes[b]}
    assert sorted(map(repr, map(tuple, prices.full_baskets(*tables).select("b", "m", "n_items", shown(F.col("total"))).collect()))) == sorted(map(repr, full))
    want = []
    for b in sizes:
        mine = sorted(((-n, t is not None, cents(t) or 0.0, m is not None, m or 0, m, t) for (c, m), (n, t) in sums.items() if c == b))
        want += [(b, m, -n, sizes[b], cents(t), at) for at, (n, _, _, _, _, m, t) in enumerate(mine[:5], 1)]
    assert sorted(map(repr, map(tuple, prices.best_partial(*tables, shown).select("b", "m", "covered", "n_items", "total", "place").collect()))) == sorted(map(repr, want))


def test_rounds_of_the_grouping_write_proposals_not_edges(spark, monkeypatch):
    """Eight offers want eight groups in the same order: the first gets the first, and what the rounds write is not all edges each time."""
    written, real = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, *a, **k: [out := real(df, *a, **k), written.append(out.count())][0])
    edges = spark.range(64).select((F.col("id") % 8).alias("seq"), (100 + F.floor(F.col("id") / 8)).alias("group_id"), F.struct(F.lit(3).alias("tier"), F.floor(F.col("id") / 8).cast("int").alias("x")).alias("p"))
    assert {r.seq: r.group_id for r in matching._chosen(edges).collect()} == {n: 100 + n for n in range(8)}
    assert sum(written) < 200


def test_offers_meet_groups_by_two_tokens(spark):
    """Shared tokens are counted as before, short ones aside, and one shared token makes no meeting."""
    kind = "array<string>"
    offers = spark.createDataFrame([(1, None, None, "", ["ab", "gants", "latex", "bleu"]), (2, None, None, "", ["gants", "seul"])], f"seq long, ean string, mfr string, brand string, tokens {kind}")
    groups = spark.createDataFrame([(10, None, None, "", ["bleu", "ab", "latex", "gants"], 1), (11, None, None, "", ["gants", "bleu", "x1"], 1), (12, None, None, "", ["gants", "ab"], 1)], f"group_id long, ean string, mfr string, brand string, tokens {kind}, touched long")
    rows = {(r.seq, r.group_id): tuple(r.p) for r in matching._edges(offers, groups).collect()}
    assert rows == {(1, 10): (3, -3, -1.0, 1), (1, 11): (3, -2, -2 / 3, 1)}


def _counted(spark, rows, schema):
    """The rows, and a counter of how many of them have been worked out."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(passed, schema), read


def test_savings_work_their_offers_out_once(spark):
    offers, read = _counted(spark, [("p", 1, 10.0), ("p", 2, 20.0), ("p", 3, 40.0), ("q", 1, None)], "product string, merchant int, price double")
    rows = prices.offer_savings(offers, "product", "price").orderBy("product", "merchant").collect()
    assert [(r.product, r.merchant, r.saving_percent, r.bar_percent) for r in rows] == [("p", 1, 50, 25.0), ("p", 2, 0, 50.0), ("p", 3, -100, 100.0), ("q", 1, 0, 0.0)]
    assert read.value == 4


def test_reach_works_its_links_out_once(spark):
    links, read = _counted(spark, [("a", "b"), ("b", "c"), ("c", "a"), (None, "d"), ("x", "y")], "source string, target string")
    found = frontier.reach(spark.createDataFrame([("a",)], "url string"), links).collect()
    assert sorted((r.url, r.depth) for r in found) == [("a", 0), ("b", 1), ("c", 2)] and read.value == 5


def test_shuffle_files_of_a_cut_go_with_it(spark):
    """Writing a step leaves no shuffle files, and the session's setting is as before."""
    held = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    setting, before = spark.conf.get(lineage._TIDY, None), held()
    out = lineage.cut(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert held() <= before and spark.conf.get(lineage._TIDY, None) == setting
    assert out.count() == 1000


def test_what_was_looked_up_goes_once_rows_are_identified(spark):
    """An upsert's rows are kept once in the shared folder, without the columns that they were looked up by."""
    kept = lambda: {p for x in ("found", "identified") for p in glob.glob(f"{lineage.shared_dir(spark)}/offerloom-*/{x}/*.parquet")}
    before = kept()
    batch = spark.createDataFrame([(1, "m", "R1", None, "b", "n", None, "u", 1.0, "dispo")], "seq long, merchant string, merchant_reference string, manufacturer_reference string, brand string, name string, variant string, source_url string, price_eur double, availability string")
    upserts.daily_upsert(spark.createDataFrame([], upserts.CURRENT), batch, F.lit("2024-01-01").cast("timestamp"), "s")
    new = kept() - before
    assert {p.split("/")[-2] for p in new} == {"identified"}
    assert not [c for p in new for c in spark.read.parquet(p).columns if c.startswith("__")]
