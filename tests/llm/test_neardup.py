import random
import re

import numpy as np
import pytest

from spokeworks.llm import neardup
from spokeworks.llm.components import component_labels


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_force(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = [d for d in sets if sets[d]]
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_copies(count, words, seed):
    """Copies of one text, each changed in a few places, so that similarities spread around the threshold."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(count):
        own = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6])):
            own[draw.randrange(words)] = f"n{i}x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n, percent, block", [(3, 85, 1024), (3, 85, 16), (5, 80, 1024)])
def test_classes_against_brute_force(spark, hard_docs, small, n, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_copies(80, 120, 1) + near_copies(60, 60, 2) + ["Same TEXT here"] * 5 + [f"tail {i}" for i in range(5)]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    docs = hard_docs.filter("doc_id is not null").select("doc_id", "text", "n", "key")
    docs = docs.unionByName(spark.createDataFrame([(*r, "", "") for r in rows], docs.schema))
    docs = docs.unionByName(small("documents").selectExpr("doc_id + 5000", "text", "'' AS n", "'' AS key").toDF(*docs.columns))
    plain = {(r.doc_id, r.text) for r in docs.collect()}
    got = neardup.near_duplicates(docs, shingle=n, percent=percent).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_force(sorted(plain), n, percent)


def template(count, shared, own, seed=3):
    """Texts that share `shared` of their `own` + `shared` words: alike, but not enough."""
    draw = random.Random(seed)
    base = [f"t{draw.randrange(10**6)}" for _ in range(shared)]
    out = []
    for i in range(count):
        words = base + [f"o{i}x{k}" for k in range(own)]
        out.append(" ".join(words))
    return out


def test_rare_shingles_lead_to_every_similar_pair():
    """The rule by itself: similar sets share one of their first shingles, near misses of one template none."""
    draw = np.random.default_rng(11)
    pools = [draw.integers(0, 2**63, 200, dtype=np.int64) for _ in range(4)]
    sets = [np.unique(np.concatenate([p[draw.random(200) < 0.96], draw.integers(0, 2**63, draw.integers(0, 30), dtype=np.int64)])) for p in pools for _ in range(25)]
    held = {}
    for s in sets:
        for x in s.tolist():
            held[x] = held.get(x, 0) + 1
    firsts = []
    for s in sets:
        rare = sorted((held[x], x) for x in s.tolist() if held[x] > 1)
        least = -(-85 * len(s) // 100)
        firsts.append({x for _, x in rare[: max(len(rare) - least + 1, 0)]})
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert firsts[i] & firsts[j]
    assert links > 100


def test_rare_shingles_of_a_table(spark):
    rows = [(i, np.array(s, np.uint64)) for i, s in enumerate([[1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 8], [1, 2, 3, 4, 9, 10, 11], [20]])]
    frame = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in rows], "id int, n bigint, set binary")
    got = sorted((r.id, r.key) for r in neardup.rare_shingle_buckets(frame, 70).collect())
    # Sets of seven need five in common: of the first three, rarest first, those that others have.
    assert got == [(0, 5), (0, 6), (1, 5), (1, 6)]


@pytest.mark.parametrize("block, size", [(8, 16 << 20), (1024, 20_000)])
def test_large_buckets_against_brute_force(spark, monkeypatch, block, size):
    """Near misses of a template among which some are similar: large by number, or by bytes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    texts = template(90, 100, 12) + near_copies(70, 120, 5) + template(40, 60, 4, 9)
    pairs = [t + " z" for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts + pairs)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == brute_force(list(enumerate(texts + pairs)), 3, 85)


def test_many_near_misses_make_few_rows(spark, monkeypatch):
    """Of a template's 3,000 texts none is similar to another: hardly a set is sent anywhere."""
    monkeypatch.setattr(neardup, "BLOCK", 128)
    kept, write = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    docs = spark.createDataFrame(list(enumerate(template(3_000, 80, 20))), "doc_id bigint, text string")
    assert neardup.near_duplicates(docs, shingle=3, percent=85).filter("kept").count() == 3_000
    assert kept["large-members"].count() > 1_000
    assert kept["small-buckets"].count() < 3_000


def test_rows_without_id_or_text(hard_docs):
    rows = neardup.near_duplicates(hard_docs.filter("doc_id is null or text is null")).collect()
    assert len(rows) == 3 and all(r.kept and r.n_shingles == 0 for r in rows)
    assert neardup.near_duplicates(hard_docs.limit(0)).count() == 0


def test_estimate_follows_similarity():
    draw = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.85, 0.95):
        left, right, sizes = [], [], []
        for _ in range(40):
            pool = draw.integers(0, 2**63, 800, dtype=np.uint64)
            k = int(800 * share)
            rest = (800 - k) // 2
            a, b = pool[: k + rest], np.concatenate([pool[:k], pool[k + rest :]])
            left.append(neardup.registers(a))
            right.append(neardup.registers(b))
            sizes.append((len(a), len(b)))
        n = np.array(sizes, float)
        got = neardup.estimate_similarity(np.array(left), np.array(right), n[:, 0], n[:, 1])
        assert abs(got.mean() - share) < 0.02


def test_registers_merge():
    draw = np.random.default_rng(6)
    a, b = (draw.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    merged = np.maximum(neardup.registers(a), neardup.registers(b))
    np.testing.assert_array_equal(merged, neardup.registers(np.concatenate([a, b])))


def test_components_of_paths_and_stars(spark):
    draw = random.Random(7)
    path = list(range(100, 160))
    draw.shuffle(path)
    links = list(zip(path, path[1:])) + [(5, i) for i in range(200, 230)] + [(300, 301), (301, 300), (9, 9)]
    labels = component_labels(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r.node: r.label for r in labels.collect()}
    assert got == {**{i: 100 for i in path}, **{i: 5 for i in [5, *range(200, 230)]}, 300: 300, 301: 300}


@pytest.mark.parametrize("kind", ["ascending", "descending", "star", "none"])
def test_components_take_few_rounds(spark, monkeypatch, kind):
    """Revisions that each resemble the one before: a chain of 2,000 in the order of their ids."""
    from spokeworks.llm import components

    rounds, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: rounds.append(label) or write(df, label))
    ids = range(10, 2011) if kind != "descending" else range(2010, 9, -1)
    links = [] if kind == "none" else [(11, i) for i in ids] if kind == "star" else list(zip(ids, ids[1:]))
    labels = component_labels(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {(r.node, r.label) for r in labels.collect()} == ({(i, 10) for i in range(10, 2011)} if links else set())
    assert rounds.count("steps") <= (3 if kind == "star" else 20)


@pytest.mark.parametrize("percent", [6, 30, 50, 70, 80, 85, 95, 99, 100])
def test_bands_serve_the_threshold(percent):
    bands, rows = neardup.banding(percent)
    assert bands * rows <= neardup.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert neardup.least_estimate(percent) < percent / 100 or percent == 100


def test_thresholds_that_registers_cannot_serve(spark):
    with pytest.raises(ValueError, match="cannot find"):
        neardup.banding(5)


def test_links_at_a_low_threshold(spark):
    rows = []
    for i in range(60):  # 20 of 39 words shared: just above one half
        shared = [f"s{i}x{k}" for k in range(20)]
        rows += [(2 * i + side, " ".join(shared + [f"o{i}x{side}x{k}" for k in range(9 + side)])) for side in (0, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=1, percent=50).collect()
    assert sum(r.kept for r in got) == 60
