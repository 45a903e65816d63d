"""Filter audit, coordinate join and hard negatives against brute force and odd inputs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import collisions, interaction, negatives
from tidewatch.llm.jaccard import Join

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def audited(rows, labels):
    """Counters by a plain reading: (part, mask, good, toxic) -> documents."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    out = {}
    for doc_id, text, lang in rows:
        t = text or ""
        words = SPACE.findall(t)
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
        mask += 16 * (doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows))
        cell = (lang or "", mask, int(doc_id in good), int(doc_id in toxic))
        out[cell] = out.get(cell, 0) + 1
    return out


@pytest.mark.parametrize("files, per_batch", [(1, 1), (6, 1), (6, 2), (6, None)])
def test_retractions_do_not_depend_on_files_or_batches(spark, tmp_path, files, per_batch):
    rng = random.Random(files)
    texts = ["", None, " \t", "a", "A b #", "word " * 250, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)), "日本 語 " * 150, "x " * 40_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [rows[0], rows[0], (7, "a", "en"), (7, "a", "de")]
    rows.sort(key=lambda r: -(r[0] or 0))  # larger ids arrive first, so nearly every batch retracts
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    for i in range(files):
        part = rows[i::files] if files == 1 else rows[i * len(rows) // files:(i + 1) * len(rows) // files]
        frame = spark.createDataFrame([(*r, "k", 1, "m") for r in part], "doc_id long, text string, lang string, key string, n int, mask string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    path = str(tmp_path / "d")
    if files == 1:
        path = str(next((tmp_path / "d").glob("*.parquet")))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = interaction.counters(spark, path, marks, files_per_batch=per_batch)
    got = {(r["part"], r["mask"], r["good"], r["toxic"]): r["n"] for r in counts.collect()}
    assert got == audited(rows, labels)


def test_interactions_replay_every_order(spark):
    rng = random.Random(2)
    cells = [(p, m, g, t, rng.randint(1, 9)) for p in ("en", "") for m in rng.sample(range(32), 20) for g in (0, 1) for t in (0, 1)]
    counts = spark.createDataFrame(cells, "part string, mask int, good int, toxic int, n long")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in interaction.interactions(counts).collect()}
    assert len(got) == 2 * 120 * 5
    share = {}
    for part, order in itertools.product(("en", ""), itertools.permutations("ABCDE")):
        alive = [(c, False) for c in cells if c[0] == part]
        for step, f in enumerate(order, 1):
            bit = 1 << "ABCDE".index(f)
            hit = [(c, gone) for c, gone in alive if c[1] & bit]
            r = got[part, "".join(order), step]
            removed = [c for c, gone in hit if not gone]
            alive = [(c, gone or bool(c[1] & bit)) for c, gone in alive]
            n = lambda rows: sum(c[4] for c in rows)
            assert (r["kept"], r["removed"], r["redundant"]) == (n(c for c, gone in alive if not gone), n(removed), n(c for c, gone in hit if gone))
            assert (r["unique_fails"], r["good_lost"], r["toxic_lost"]) == (n(c for c, _ in hit if c[1] == bit), n(c for c in removed if c[2]), n(c for c in removed if c[3]))
            share[part, f] = share.get((part, f), 0) + n(removed)
    assert all(r["shapley"] == share[p, o[s - 1]] for (p, o, s), r in got.items())


def test_audit_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty.write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.filter_audit(spark, str(tmp_path / "d"), labels).count() == 0


def shingled(text, width=4):
    words = SPACE.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def grouped(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def test_coordinate_join_against_brute_force(spark, monkeypatch):
    """Chains of near copies, a passage that many texts share, copies of copies, blocks, and odd rows."""
    monkeypatch.setattr(collisions, "BLOCK", 2_000)
    monkeypatch.setattr(collisions, "STAR", 5)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "one two three", "One  two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 150]))]
        at = base
        for _ in range(rng.randint(0, 12)):
            at = [word() if rng.random() < rng.choice([0.0, 0.01, 0.03, 0.06]) else w for w in rng.choice([at, base])]
            texts.append(" ".join(at))
        texts.append(" ".join(base))
    texts += [" ".join([*(word() for _ in range(k)), *passage, *(word() for _ in range(k))]) for k in (0, 1, 2, 3, 5, 8, 15, 20, 30) for _ in range(4)]
    texts.append(" ".join(word() for _ in range(30_000)))
    rows = [(i + 100, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(3, rows[0][1]), (None, rows[1][1]), (None, None), rows[2], rows[2]]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, key string, n int, root string")
    got, links = collisions.coordinate_duplicates(docs)
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=order) == sorted(grouped(rows), key=order)
    assert all(100 * r["same"] >= 80 * r["either"] for r in links.collect())
    got, links = collisions.coordinate_duplicates(docs.limit(0))
    assert got.count() == links.count() == 0


def test_skip_merging_finds_what_counting_finds():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, (6, collisions.COORDINATES), dtype=np.uint32)
    signs = base[rng.integers(0, 6, 200)]
    signs = np.where(rng.random(signs.shape) < rng.random((200, 1)) * 0.6, rng.integers(0, 1 << 32, signs.shape, dtype=np.uint32), signs)
    _, code = np.unique(collisions.tokens(signs), return_inverse=True)
    code = code.reshape(signs.shape)
    owner = np.repeat(np.arange(200), collisions.COORDINATES)
    members, starts = owner[np.argsort(code.ravel(), kind="stable")], np.append(0, np.cumsum(np.bincount(code.ravel())))
    for u in range(200):
        others = np.arange(200) != u
        want = np.flatnonzero(((signs == signs[u]).sum(axis=1) >= collisions.MATCHES) & others)
        assert collisions.merged(u, code, starts, members, others).tolist() == want.tolist()


def test_coordinates_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    one, two = collisions.signatures([a, b])
    assert abs((one == two).mean() - 0.8) < 0.15
    assert Join(4, 80).shingle_set(np.zeros(0, np.uint64)).size == 0


def mined(rows, cfg=negatives.Mining()):
    """All windows by sorting all scores."""
    fine = []
    for i, label, vector in rows:
        if None not in (i, label) and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            fine.append((i, label, [int(np.floor(256 * float(x))) for x in vector]))
    out, done = [], set()
    for i, label, q in sorted(fine):
        if i % 10 or i in done:
            continue
        done.add(i)
        scored = sorted((-sum(a * b for a, b in zip(q, r)), j, other) for j, other, r in fine if j != i)
        for minus, p, _ in [s for s in scored if s[2] == label][:cfg.positives]:
            window = [(j, -s) for s, j, other in scored if other != label and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(i, p, rank, j, -minus, s) for rank, (j, s) in enumerate(window[:cfg.k], 1)]
    return out


@pytest.mark.parametrize("bundle, block, held", [(7, 3, 1), (4_096, 1_024, 4)])
def test_windows_against_sorting_all_scores(spark, monkeypatch, bundle, block, held):
    for name, value in (("BUNDLE", bundle), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(6)
    vector = lambda n=6: [rng.choice([0.0, 0.25, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(n)]
    rows = [(i, rng.randint(0, 3), vector()) for i in range(260)]
    hot = vector()
    rows += [(i, rng.randint(0, 3), hot) for i in range(260, 380)]  # a third of all rows are one vector, so scores tie
    rows += [(None, 1, vector()), (400, None, vector()), (410, 1, None), (420, 1, [0.5, None]), (430, 2, [float("nan")] * 6), (440, 2, [float("-inf")] + [0.0] * 5)]
    rows += [(450, 1, []), (460, 1, [0.5, 0.5]), (470, 9, vector()), (20, 1, hot), (33, 2, hot), (33, 2, hot), (480, 1, [3e7, -3e7, 2.5e6, 0.0, 1.0, 0.0])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, label int, embedding array<double>, id string, score string").repartition(3)
    got = negatives.hard_negatives(frame, F.col("id") % 10 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))
    assert negatives.hard_negatives(frame.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(frame, F.col("id") < 0).count() == 0
