"""The training-data operators against brute force, exact round trips and odd inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.oracle import connect, difference
from tidewatch.llm import decontaminate, exact, jaccard, labelled, layout, packing, quality, queries, randomness, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, hash string, norm string, key string, sign string, group string, n string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, ties and repeated rows, and columns whose names clash with inner ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=60_000))
    base = rng.choices(words, k=120)
    near = [*base[:60], "changed", *base[61:]]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, " ".join(base)), (8, " ".join(near)), (9, "  ".join(base)), (9, "  ".join(base)), (None, " ".join(base)), (None, None), (10, "z" * 70_000), (11, "ünï — 日本語 " * 30), (12, "One TWO")]
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) in (None, "EMPTY on both sides")


def test_counts_and_ids_are_those_of_the_library(spark, odd, none):
    library = tokens.Units(tokens.tokenizer_path(), False).library
    rng = random.Random(1)
    texts = ["".join(rng.choices("aAé'sSt.,!<|>endofxt 1２\n\t́İßΣ中#", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "<|ENDOFTEXT|>", "It's <|startoftext|>...", "the quick. Brown's " * 200_000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert tokens.count_tokens(tokens.Units(tokens.tokenizer_path(), False), raw).tolist() == [len(w) for w in want]
    assert [i.tolist() for i in tokens.token_ids(tokens.Units(tokens.tokenizer_path(), True), raw)] == want
    got = {r["doc_id"]: r for r in tokens.token_counts(odd).collect()}
    assert got[1]["n_tokens"] == got[2]["n_bytes"] == 0 and tokens.token_counts(odd).count() == odd.count() and tokens.token_counts(none).count() == 0


def test_packing_is_gapless_and_tight(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(docs, capacity=512, group_pieces=60, with_ids=True).collect()
    library = tokens.Units(tokens.tokenizer_path(), False).library
    texts = dict(rows(docs, "doc_id", "text"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4 <= 512
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4").tolist() == ids[k]
        assert [r["start"] for r in parts] == [512 * i for i in range(len(parts))]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert len(by_sequence) <= 1.02 * -(-sum(map(len, ids.values())) // 512) + 1
    assert packing.pack(none).count() == 0 and sum(r["length"] for r in packing.pack(odd).where("doc_id = 1 OR doc_id = 2").collect()) == 2


def test_local_search_empties_a_bin():
    bins = packing.Bins([6, 4, 4, 3, 3], 10)
    bins.bins, bins.fill = [[0, 3], [1, 2], [4]], [9, 8, 3]
    bins.search()
    assert sorted(bins.fill) == [0, 10, 10] and sorted(i for b in bins.bins for i in b) == [0, 1, 2, 3, 4]


def test_exact_groups(odd, none):
    got = {(r["doc_id"], r["text_hash"]): r for r in exact.exact_duplicates(odd).collect()}
    by = {r["doc_id"]: r for r in got.values() if r["doc_id"] is not None}
    assert by[1]["keep_id"] == 3 and by[1]["group_size"] == 4 and by[3]["kept"] and not by[2]["kept"]
    assert by[7]["keep_id"] == 9 and by[7]["group_size"] == 4 and not by[7]["kept"] and by[9]["kept"]
    assert exact.exact_duplicates(none).count() == 0


def test_directory_splits_overfull_buckets(spark):
    spread = spark.range(4000).select(F.xxhash64("id").alias("hash"), F.lit(100).alias("size"))
    # hashes that agree in their first 24 bits, one hash that overfills a bucket by itself, and negative ones
    crowded = spread.union(spark.range(1000).select(F.shiftleft("id", 30), F.lit(100))).union(spark.createDataFrame([(-5, 90_000), (-6, 10)], "hash long, size int"))
    for entries, limit in ((spread, 20_000), (crowded, 5_000)):
        slots = exact.directory(entries, limit)
        load = slots.route(entries).groupBy(exact.BUCKET).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        assert len(load) >= 20 and all(r["s"] <= limit or r["n"] == 1 for r in load) and sum(r["n"] for r in load) == entries.count()


def test_exact_groups_of_every_size(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choices("ab \t\n", k=rng.randint(0, 7))) for _ in range(600)] + ["same words", "same  words"] * 300 + [None, "x" * 5000, "x" * 5000 + " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    want = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        want.update({i: (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids})
    for sizes in ({}, {"bucket_bytes": 200, "hot_rows": 5}, {"bucket_bytes": 1, "hot_rows": 10**9}):
        got = exact.exact_duplicates(df, **sizes).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want and len(got) == len(texts)


def brute_components(texts: dict) -> dict:
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_similar_sets_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    texts, n = {}, 0
    for size in (1, 3, 5, 6, 8, 12, 20, 40, 90, 200):
        for _ in range(3):
            base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
            for _ in range(7):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    w[rng.randrange(len(w))] = f"w{rng.randint(0, 5000)}"
                texts[n] = " ".join(w[: rng.randint(max(1, size * 9 // 10), size)])
                n += 1
    want = brute_components(texts)
    classes, links = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()}
    assert got == want and links.where("100 * same < 80 * either").count() == 0 and len({c for _, c in want.values()}) < len(want)
    classes, _ = jaccard.near_duplicates(odd)
    by = {r["doc_id"]: r for r in classes.collect() if r["doc_id"] is not None}
    assert classes.count() == odd.count() and by[1]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert by[9]["component_id"] == by[8]["component_id"] == 7 and by[12]["component_id"] == 5
    assert jaccard.near_duplicates(none)[0].count() == 0


def test_contamination_of_odd_rows(spark, odd, none):
    text = odd.where("doc_id = 7").first()["text"].split()
    items = spark.createDataFrame([(1, " ".join(text[20:45])), (1, " ".join(text[20:45])), (2, "ONE, two!"), (None, "one"), (3, None), (4, "!!"), (5, "日本語")], "item_id long, text string")
    for block_windows in (200_000, 7):
        got = {r["doc_id"]: r for r in decontaminate.contamination(odd, items, block_windows=block_windows).collect() if r["doc_id"] is not None}
        assert (got[7]["n_hit"], got[7]["items"], got[7]["spans"][0]["first"], got[7]["spans"][0]["last"]) == (25, ["1"], 20, 44)
        assert (got[5]["n_hit"], got[5]["items"]) == (2, ["2"]) and (got[4]["n_hit"], got[4]["items"]) == (1, []) and got[1]["n_words"] == 0 and got[11]["items"] == ["5"]
        assert decontaminate.without_items(odd, items, block_windows=block_windows).columns == odd.columns
    clean = {r["doc_id"] for r in decontaminate.without_items(odd, items).collect()}
    assert 7 not in clean and 5 not in clean and {1, 2, 3, 10} <= clean
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0


def brute_secrets(text: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[1]) >= 6)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_secret_spans(spark, odd, none):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["secret=token:abcdefgh", "é日 Token = \"abc123\" AKIA" + "A" * 16, "api_key:'x'", "AKIAAKIA" + "B9" * 9 + " password= AKIA" + "C" * 20, "f" * 23, "x" + "0f" * 12 + "g", "passwd:::abcdef", None, ""]
    texts += ["".join(rng.choices(["secret", "token", ":", "=", " ", "'", "abc", "AKIA", "0123456789abcdef" * 2, "QWERTY1234567890", "é", "\n"], k=12)) for _ in range(300)]
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(300)]
    texts += [f"call {k} now user_profile_settings_page_2_of_3_more_words aaaaaaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaa" for k in keys]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in randomness.find_secrets(df).collect()}
    for k, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[k] if s["kind"] != "random"] == brute_secrets(t or ""), t
        assert all((t or "")[s["start"]:s["end"]] == s["value"] for s in got[k])
    found = {s["value"] for spans in got.values() for s in spans if s["kind"] == "random"}
    assert len(found & set(keys)) > 150 and not any(v.startswith(("user_", "aaaa")) for v in found)
    assert randomness.find_secrets(odd).count() == odd.count() and randomness.find_secrets(none).count() == 0


def plain_battery(value: str) -> tuple[str, int, float]:
    """Encoding, length and p-value of one string, by exact normal tails."""
    body = value.rstrip("=")
    name, alphabet = next((k, a) for k, a in randomness.ENCODINGS.items() if set(body) <= set(a))
    n, size, at = len(body), len(alphabet), [alphabet.index(c) for c in body]
    df, chi = size - 1, sum(size / n * body.count(c) ** 2 for c in set(body)) - n
    z1 = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [2 * v >= size for v in at]
    n1, n2, runs = sum(high), n - sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
    z2 = 9.0 if n1 * n2 < 2 else (runs - 1 - 2 * n1 * n2 / n) / math.sqrt(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)))
    mean = sum(at) / n
    low = sum((v - mean) ** 2 for v in at)
    z3 = 9.0 if not low else sum((x - mean) * (y - mean) for x, y in zip(at, at[1:])) / low * math.sqrt(n) + 1 / math.sqrt(n)
    tail = lambda z: max(1e-300, math.erfc(z / math.sqrt(2)) / 2)
    h = -math.log(tail(z1)) - math.log(2 * tail(abs(z2))) - math.log(2 * tail(abs(z3)))
    return name, n, min(1.0, math.exp(-h) * (1 + h + h * h / 2))


def test_battery_equals_a_plain_reading(spark):
    rng = random.Random(11)
    values = ["".join(rng.choices(a, k=rng.choice([20, 33, 64, 300]))) + "=" * rng.randint(0, 2) for a in randomness.ENCODINGS.values() for _ in range(25)]
    values += ["user_profile_settings_page_2", "a" * 40, "ab" * 20, "0123456789" * 4]
    got = spark.createDataFrame([(v,) for v in values], "value string").selectExpr("value", f"{randomness.battery('value')} AS test").collect()
    for r in got:
        name, n, p = plain_battery(r["value"])
        # the curve that stands for the normal tail is right to 2e-4 in each of three tests
        assert (r["test"]["encoding"], r["test"]["length"]) == (name, n) and abs(r["test"]["p"] - p) < 0.02, (r, p)


def test_texts_of_very_many_matches(spark):
    rng = random.Random(13)
    parts = [rng.choice(["password=" + "x" * rng.randint(4, 8), "%026x" % rng.getrandbits(104), "AKIA" + "Z" * 17, "é", "team/my-" + "Ab1" * 9]) for _ in range(40_000)]
    texts = [" ".join(parts), None, "AKIA" + "Z" * 17, "secret=ab"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (4, texts[3])], "doc_id long, text string")
    start = time.time()
    got = sorted(([[(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "random"], r["doc_id"]] for r in randomness.find_secrets(df).collect()), key=str)
    assert time.time() - start < 60  # products of the matches of a text would take many minutes
    assert got == sorted([[brute_secrets(texts[0]), 1], [[], 1], [[("access", 0, 21)], None], [[("access", 0, 21)], None], [[], 4]], key=str)


def test_planted_keys_reach_the_query(spark, tmp_path):
    rng = random.Random(17)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = {k: "".join(rng.choices(alphabet, k=44)) for k in range(10**9, 10**9 + 40)}
    planted = spark.createDataFrame([(k, f"deploy with {v} as before") for k, v in keys.items()], "doc_id long, text string")
    docs.unionByName(planted, allowMissingColumns=True).select(docs.columns).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in queries.op8(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count() + 40
    assert sum(got[k] == "random:12:56" for k in keys) >= 34 and sum("random:" in v for k, v in got.items() if k not in keys) <= 4


def test_random_strings_are_found_in_bands_of_any_count(spark):
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for count, least in ((1, 0.85), (10, 0.9), (100, 0.9), (1000, 0.93)):
        shares = []
        for _ in range(200):
            cells = [0] * randomness.CELLS
            for _ in range(count):
                cells[rng.randrange(randomness.CELLS)] += 1
            shares.append(sum(cells[randomness.least_cell(cells) or 0:]) / count)
        assert sum(shares) / len(shares) > least, count
    # words are rejected where they are many
    assert randomness.least_cell([400, 200, 100, 50] + [20] * (randomness.CELLS - 4)) >= 2
    # a few keys in each of many bands, as in a small table
    keys = ["".join(rng.choices(alphabet, k=n)) for n in (24, 40, 100, 200, 400, 800) for _ in range(3)]
    texts = [f"x {k} y user_profile_settings_page_2_of_3_more_words" for k in keys]
    found = [s["value"] for r in randomness.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for s in r["spans"] if s["kind"] == "random"]
    assert len(set(found) & set(keys)) >= 15 and not any(v.startswith("user_") for v in found)


def test_archives_round_trip(spark):
    same = "x" * 150
    pages = [(3, "http://a.example/1", same), (1, "http://www.b.example/?q=1", same), (2, None, "small"), (5, "u\r\nv", "small"), (4, "http://a.example/1", "é\r\n\r\nWARC/1.1\r\n" * 20), (None, "http://c.example", same), (1, "http://www.b.example/?q=1", same), (6, "http://a.example:bad", None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, id string")
    got = warc.capture_index(df, archive_bytes=300, range_rows=3).collect()
    assert len(got) == len(pages) and all(r["intact"] for r in got)
    by = {r["id"]: r for r in got}
    assert by[3]["record_type"] == "revisit" and by[3]["refers_to"] == 1 and by[1]["record_type"] == "response" and by[5]["record_type"] == "response" and by[None]["refers_to"] == 1
    assert by[4]["payload_digest"] == hashlib.sha256(pages[4][2].encode()).hexdigest() and by[6]["payload_bytes"] == 0
    ordered = sorted(got, key=lambda r: r["order_no"])
    keys = [warc.order_of(r.asDict()) for r in ordered]
    assert keys == sorted(keys) and [r["order_no"] for r in ordered] == list(range(len(pages)))
    assert warc.capture_index(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_keys_in_runs_of_mixed_signs_are_tested(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(60)]
    cut = [f"{k[:15]}+{k[15:30]}/{k[30:]}" for k in keys[40:50]] + [f"{k[:15]}-{k[15:30]}_{k[30:]}" for k in keys[50:]]
    texts = [f"é https://x.com/my-team/{k}" for k in keys[:20]] + [f"com/my-team_{k}/end-of-path" for k in keys[20:40]] + [f"a/b-c-{k}" for k in cut[:10]] + [f"a/b+{k}" for k in cut[10:]]
    got = {r["doc_id"]: r["spans"] for r in randomness.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(t[s["start"]:s["end"]] == s["value"] for k, t in enumerate(texts) for s in got[k])
    values = [{s["value"] for s in got[k]} for k in range(len(texts))]
    assert sum(key in values[k] for k, key in enumerate(keys[:40])) >= 34 and sum(key in values[40 + k] for k, key in enumerate(cut)) >= 16


def test_layout(spark):
    page = "<title>no</title><p>Hello <b>big</b>\n world<p>Two<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><td>one<td>2<tr><td>three<td>44</table><div style='display: none'>no</div><pre>a\n  b</pre>x<br>y &amp; z<script>no()</script><p hidden>no"
    assert layout.render(page) == "Hello big world\n\nTwo\n\n- a\n- b\n  3. x\n  4. y\n\none    2\nthree  44\n\na\n  b\n\nx\ny & z"
    assert layout.render("<div>" * 30_000 + "deep") == "deep" and layout.render("a < b <3 <a 'c") == "a < b <3" and layout.render("<!-- x") == ""
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "<li>t", "x"), (2, "<li>t", "x")], "page_id long, html string, text string")
    assert sorted(rows(layout.visible_text(df), "page_id", "text"), key=str) == [(1, ""), (2, "- t"), (2, "- t"), (None, "")]
    assert layout.visible_text(df.limit(0)).count() == 0


def test_layout_keeps_text_of_open_heads_drawings_formulas_and_inputs():
    r = layout.render
    assert r("<html><head><title>t</title><h1>Hi</h1><p>text") == "Hi\n\ntext" == r("<head><head><meta charset=x><h1>Hi</h1></head><p>text")
    assert r("<head><title>t</title> \n text<p>more") == "text\n\nmore" and r("<head><style>a</style><noscript><p>n</noscript></head><body>x") == "x"
    assert r("<p>a<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><text>one</text><text>two</text></svg>b") == "a one two b"
    assert r("<svg><defs/><style/><path d='M0'/><text>x</text></svg> y") == "x y" and r("<svg><defs><g><p>out") == "out" and r("<desc>shown") == "shown"
    assert r("<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></semantics></math>") == "1 2"
    assert r("<object data=x><param name=y>no plugin</object>") == "no plugin"
    assert r("<input value=a> <input type=email value=b><input type=password value=c><input type=hidden value=d><input type=submit value=e>") == "a b e"


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op9_toxicity"])
def test_classifiers_on_held_out_rows(spark, name):
    label = "quality" if name.startswith("op4") else "toxic"
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "score", label).collect()
    assert len(got) > 300 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r[label] for r in got) / len(got) > (0.97 if label == "quality" else 0.94)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (9, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for module, apply in ((quality, quality.quality), (toxicity, toxicity.toxicity)):
        for own in (labels, labels.limit(0), labels.where("quality = 1")):
            model = module.fit(odd, own)
            assert apply(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count() and apply(none, model).count() == 0
        assert module.fit(none, labels) is not None


def test_labels_of_the_held_out_part_are_never_read(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    from tidewatch.llm.labelled import training_ids

    assert {r["id"] for r in training_ids(labels, "toxic", 1000).collect()} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_stages_keep_columns_and_odd_rows(spark, odd, none):
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        ids = Counter(r["doc_id"] for r in out.collect())
        assert {4, 6, 10, 11} <= set(ids), name
        if name == "exact dedup":
            assert ids[9] == 1 and ids[7] == 0 and ids[1] + ids[2] + ids[3] == 1
        if name == "n-gram Jaccard join":
            assert ids[7] == 1 and ids[8] == ids[9] == 0 and ids[1] == ids[2] == ids[3] == 1
        assert stage(spark, none, SF).count() == 0, name
    assert C.STAGES[-1][1](spark, odd, SF).select("doc_id").distinct().count() == 13


def test_pipeline_keeps_clean_documents(spark):
    out = C.run(spark, SF)
    kept = {r[0] for r in out.select("doc_id").distinct().collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    leaked = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op3_benchmark_decontamination']}) WHERE contaminated").fetchall()}
    copies = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op5_exact_dedup']}) WHERE group_size > 1").fetchall()}
    near = {r[0] for r in con.execute(f"SELECT doc_id FROM (SELECT *, count(*) OVER (PARTITION BY component_id) AS n FROM ({queries.ORACLES['op6_ngram_jaccard_join']})) WHERE n > 1").fetchall()}
    rejected = {r["doc_id"] for r in queries.QUERIES["op9_toxicity"](spark, SF).where("predicted = 1").collect()}
    every = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    assert not kept & leaked and not kept & rejected and every - leaked - copies - near - rejected <= kept


def test_a_repeated_id_adds_one_text_to_a_training_sample(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(500)] + [(i, None) for i in ids[1:]], "doc_id long, text string")
    marks = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = labelled.labelled_texts(docs, marks, "toxic", 100, "doc_id", "text").collect()
    assert sorted(r["id"] for r in got) == ids and sum(r["text"] is not None for r in got) == 1
    assert {r["id"]: r["label"] for r in got} == {i: k % 2 for k, i in enumerate(ids)}


def test_near_copies_whose_hash_has_only_zero_bits_are_compared(spark, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "_FILTER_BITS", 0)  # every text falls on bit 0
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(odd.where("doc_id IN (7, 8)"))[0].collect()}
    assert got[7] == got[8] == 7
