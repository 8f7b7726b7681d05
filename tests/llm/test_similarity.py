import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftspark.llm import buckets, edits, neighbours

WORDS = [f"w{i}" for i in range(400)]
ITEM = "id string, kind string, title string, body string, node string, text string"


def grams(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def notes(seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        base = [rnd.choice(WORDS) for _ in range(120)]
        for v in range(5):
            w = base[:]
            for _ in range(v * 3):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rows.append((f"{g:02d}-{v}", "note", f"Title {g}", " ".join(w), None, None))
    rows += [("copy", "note", "title 0!", rows[0][3].upper(), "x", "y"), ("empty", "note", None, None, None, None), ("blank", "note", "", " \n", None, None)]
    rows += [("two", "note", "a", "b", None, None), ("link", "link", *rows[0][2:4], None, None), rows[3], (None, "note", "Title 0", rows[0][3], None, None)]
    rows += [("long", "note", None, " ".join(rnd.choice(WORDS) for _ in range(60_000)), None, None)]
    return rows


def brute_pairs(rows, n, least):
    docs = [(r[0], grams(f"{r[2] or ''}\n{r[3] or ''}", n)) for r in rows if r[1] == "note" and r[0]]
    out = set()
    for (i, a), (j, b) in itertools.combinations(docs, 2):
        if i != j and a and b and len(a & b) / len(a | b) >= least:
            out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("words,least", [(3, 0.6), (5, 0.8)])
@pytest.mark.parametrize("hot", [buckets.HOT, 3])
def test_edits_against_brute_force(spark, words, least, hot):
    rows = notes()
    docs = edits.texts(spark.createDataFrame(rows, ITEM))
    want = brute_pairs(rows, words, least)
    got = {(r.id_a, r.id_b) for r in edits.pairs(docs, words=words, similarity=least, hot=hot).collect()}
    assert got == want and ("00-0", "copy") in got
    out = {r.id: (r.group_id, r.links) for r in edits.groups(docs, words=words, similarity=least, hot=hot).collect()}
    assert set(out) == {r[0] for r in rows if r[1] == "note" and r[0]}
    for a, b in want:
        assert out[a][0] == out[b][0]
    assert out["empty"] == ("empty", 0) and out["two"] == ("two", 0) and out["long"][1] == 0


def test_bands():
    for s in (0.6, 0.8):
        b = edits.bands_for(s)
        assert 1 - (1 - s**edits.ROWS) ** b >= edits.RECALL > 1 - (1 - s**edits.ROWS) ** (b - 1)


def test_edits_of_nothing(spark):
    docs = edits.texts(spark.createDataFrame([], ITEM))
    assert edits.pairs(docs).count() == 0 and edits.groups(docs).count() == 0


def test_runs():
    rnd = np.random.default_rng(0)
    key = np.sort(rnd.integers(0, 20, 200))
    s1, s2 = rnd.integers(-(2**62), 2**62, 200), rnd.integers(-(2**62), 2**62, 200)
    apart = lambda i, j: (int(s1[i]) ^ int(s1[j]) & (2**64 - 1)).__and__(2**64 - 1).bit_count() + ((int(s2[i]) ^ int(s2[j])) & (2**64 - 1)).bit_count()
    t = pa.table({"s1": s1, "s2": s2})
    i, j = (np.concatenate(c) for c in zip(*buckets.runs(key, buckets.sketches_within(60)(t))))
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if key[a] == key[b] and apart(a, b) <= 60}
    assert set(zip(i.tolist(), j.tolist())) == want and want


PLAIN_VEC = "space string, model string, rowid long, id string, embedding array<float>"
VEC = "space string, model string, rowid bigint, id string, embedding array<float>, vid string, key string"


def planted(n=600, dim=64, seed=2):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 10):
        x[i + 1] = x[i] + 0.3 * rnd.standard_normal(dim) * np.linalg.norm(x[i]) / 8
        x[i + 2] = x[i]
        x[i + 3] = x[i] * 12.5
    rows = [("image" if i % 3 else "text", "m-1", i, f"id{i // 2 if i % 20 == 4 else i}", [float(v) for v in x[i]], "a", "b") for i in range(n)]
    rows += [("image", "m-1", 9001, "null", None, "", ""), ("image", "m-1", 9002, "zero", [0.0] * dim, "", ""), ("image", "m-1", 9003, "zero2", [0.0] * dim, "", "")]
    rows += [("image", "m-1", 9004, "short", [1.0] * 10, "", ""), ("image", "m-1", 9005, "nan", [float("nan")] * dim, "", ""), ("image", "m-1", 9006, "hole", [None] + [1.0] * (dim - 1), "", "")]
    return rows


def good(r):
    e = r[4]
    return e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e) and any(e)


@pytest.mark.parametrize("hot", [buckets.HOT, 2])
def test_similar_pairs_against_brute_force(spark, hot):
    rows = planted()
    got = {(r.vec_table, r.id_a, r.id_b) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), hot=hot).collect()}
    ok = [r for r in rows if good(r)]
    want = set()
    for space in ("image", "text"):
        mine = [r for r in ok if r[0] == space]
        x = np.array([r[4] for r in mine], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1))):
            if mine[i][3] != mine[j][3]:
                want.add((f"vec_{space}__m_1", min(mine[i][3], mine[j][3]), max(mine[i][3], mine[j][3])))
    assert got <= want and len(got) >= 0.99 * len(want) > 20


def pairs_at(cosine, n, seed=4):
    """Pairs of unit vectors of that cosine, as rows of the table."""
    rnd = np.random.default_rng(seed)
    a, b = rnd.standard_normal((2, n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]
    return [("image", "m.1", 2 * i + j, f"{i}-{j}", x[i].tolist()) for i in range(n) for j, x in enumerate((a, b))]


@pytest.mark.parametrize("rows", [1000, 10**6, 10**9])
def test_recall_does_not_fall_with_size(spark, monkeypatch, rows):
    """As many directions as a table of that many rows has, at hardly more than the least cosine."""
    monkeypatch.setattr(neighbours, "WORK", neighbours.WORK * rows / 1000)
    table = pairs_at(0.9005, 500)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(spark.createDataFrame(table, PLAIN_VEC)).collect()}
    assert len(got & {(f"{i}-0", f"{i}-1") for i in range(500)}) >= 493


def test_row_numbers_are_any_64_bits(spark):
    table = pairs_at(0.95, 60)
    table = [(s, m, (r * 0x9E3779B97F4A7C15 + 2**63 & 2**64 - 1) - 2**63, i, e) for s, m, r, i, e in table]
    df = spark.createDataFrame(table, PLAIN_VEC)
    assert neighbours.similar_pairs(df).count() == 60
    firsts = neighbours.top_k(df, k=1, every=1).where("vec_table = 'vec_image__m_1'").collect()
    assert len(firsts) == 120 and all(r.image_id.split("-")[0] == r.other_id.split("-")[0] for r in firsts)


def test_tails_grow_slowly_and_give_the_recall():
    tails = [neighbours.tails_for(64, 2**k, 0.9) for k in (8, 10, 12, 14)]
    assert tails == sorted(tails) and tails[-1] <= 2 * tails[0]
    d, t = neighbours.Directions(64, 1024, neighbours.SEED), neighbours.tails_for(64, 1024, 0.9)
    x = np.array([r[4] for r in pairs_at(0.9, 2000, 9)], np.float32)
    ends, _ = d.tails(x, t)
    assert np.mean([bool(set(ends[i]) & set(ends[i + 1])) for i in range(0, 4000, 2)]) >= neighbours.RECALL - 0.003


def test_sums_of_directions():
    d = neighbours.Directions(64, 2 * neighbours.PLAIN, 3)
    x = np.array([r[4] for r in pairs_at(0.9, 5)], np.float32)
    ends, value = d.tails(x, 12)
    n = d.one.shape[1]
    for row, e, v in zip(x, ends, value):
        one, two = row @ d.one, row @ d.two
        every = {((i * 2 + s) * 2 * n + j * 2 + t): ((-1) ** s * one[i] + (-1) ** t * two[j]) / math.sqrt(2) for i in range(n) for j in range(n) for s in (0, 1) for t in (0, 1)}
        assert np.allclose(sorted(every.values())[-12:], sorted(v), atol=1e-5)
        assert all(every[int(a)] == pytest.approx(float(b), abs=1e-5) for a, b in zip(e, v))


@pytest.mark.parametrize("hot", [buckets.HOT, 3])
def test_similar_groups(spark, hot):
    rows = planted(300)
    got = {(r.vec_table, r.id): r for r in neighbours.similar_groups(spark.createDataFrame(rows, VEC), hot=hot).collect()}
    pairs = {(r.vec_table, r.id_a, r.id_b) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC)).collect()}
    assert len(got) == len({(r[0], r[3]) for r in rows if good(r)})
    assert all(got[t, a].group_id == got[t, b].group_id for t, a, b in pairs)
    paired = {(t, x) for t, a, b in pairs for x in (a, b)}
    assert {k for k, r in got.items() if r.links} <= paired
    assert all(r.group_id == r.id for k, r in got.items() if k not in paired)


def test_a_table_of_one_vector(spark):
    """A third and more of the rows hold one vector: no task lists its copies alone."""
    e = [1.0] + [0.0] * 63
    rows = [("image", "m", i, f"i{i:03}", e) for i in range(60)] + pairs_at(0.97, 10)
    df = spark.createDataFrame(rows, PLAIN_VEC)
    assert neighbours.similar_pairs(df, hot=7).count() == 60 * 59 // 2 + 10
    g = neighbours.similar_groups(df, hot=7).where("vec_table = 'vec_image__m'").collect()
    assert len(g) == 60 and all(r.group_id == "i000" and r.links == 0 for r in g)


def test_top_k_recall(spark):
    rows = planted(1500)
    got = neighbours.top_k(spark.createDataFrame(rows, VEC), k=5, every=10, block=20).collect()
    ok = [r for r in rows if good(r)]
    hit = total = 0
    for space in ("image", "text"):
        mine = [r for r in ok if r[0] == space]
        x = np.array([r[4] for r in mine], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, r in enumerate(mine):
            if r[2] % 10 == 0:
                best = {}
                for j in np.argsort(-(x @ x[i])):
                    if mine[j][3] != r[3]:
                        best.setdefault(mine[j][3], float(x[i] @ x[j]))
                    if len(best) == 5:
                        break
                mine_got = {g.other_id: g.score for g in got if g.image_id == r[3] and g.vec_table.startswith(f"vec_{space}")}
                hit += len(set(best) & set(mine_got))
                total += 5
                for o, s in mine_got.items():
                    if o in best:
                        assert s == pytest.approx(-np.sqrt(max(0, 2 - 2 * best[o])), abs=2e-3)
                assert r[3] not in mine_got
    assert hit / total >= 0.9


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], VEC)
    assert neighbours.similar_pairs(df).count() == 0 and neighbours.top_k(df).count() == 0 and neighbours.similar_groups(df).count() == 0
    bad = spark.createDataFrame([r for r in planted(10) if not good(r)], VEC)
    assert neighbours.similar_pairs(bad).count() == 0 and neighbours.top_k(bad, every=1).count() == 0
