"""Exact duplicates, the hash tree and centroid clustering against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairvane.llm import drake, exact_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Other columns, some of them named as the operators' own.
CLASHING = ["row", "open", "place", "group_size", "best", "leaf", "order", "part", "pos", "g", "m", "i", "own", "q", "key", "__word"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("alpha", "beta", "Ünï", "日本", "x")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    head = words(200, 1)
    texts = [None, "", "", " ", "a", "a", "A", head + "1", head + "2", head + "2", "x" * 300_000, "x" * 300_000, "y" * 300_000]
    texts += ["hot"] * 60 + [words(3, s) for s in range(80)]
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    out += [(7, head + "1", "en", "s1", 7)] * 2 + [(None, "a", None, None, None), (None, None, "fr", None, 3), (500, words(4, 9), "lone", "s", 1)]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.mark.parametrize("bits", [64, exact_dedup.BITS])
def test_exact_groups_equal_brute_force(spark, rows, bits):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(clashing(frame(spark, rows)), digest_all=True, bits=bits).collect()
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_only_open_rows_are_hashed(spark, rows):
    """Lengths and prefixes settle what they can; small sets leave more open and change nothing."""
    few = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert 0 < sum(r.text_sha256 is None for r in few)
    assert all(r.group_size == 1 and r.kept for r in few if r.text_sha256 is None)
    many = exact_dedup.exact_groups(frame(spark, rows), bits=64).collect()
    assert sum(r.text_sha256 is None for r in many) <= sum(r.text_sha256 is None for r in few)
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept)
    assert sorted(map(order, few)) == sorted(map(order, many))


def test_light_and_heavy_groups_agree(spark, rows, monkeypatch):
    some = exact_dedup.exact_groups(frame(spark, rows), digest_all=True)
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)  # nothing is heavy now
    assert Counter(map(tuple, some.drop("kept").collect())) == Counter(map(tuple, exact_dedup.exact_groups(frame(spark, rows), digest_all=True).drop("kept").collect()))


def test_deduplicated_rows(spark, rows):
    docs = clashing(frame(spark, rows))
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = [(r.text or "", r.doc_id) for r in out.collect()]
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert sorted((t, -1 if i is None else i) for t, i in got) == sorted(best.items())
    lower = exact_dedup.deduplicated(docs, normalise=lambda c: F.lower(c))
    assert lower.count() == len({(r[1] or "").lower() for r in rows})


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def level_up(nodes, k):
    return [sha("".join(nodes[i : i + k])) for i in range(0, len(nodes), k)]


def path_of(nodes, at, k):
    """Siblings of a leaf, level by level, and the tree's root."""
    out = []
    while len(nodes) > 1:
        first = at - at % k
        out.append((nodes[first:at], nodes[at + 1 : first + k]))
        nodes, at = level_up(nodes, k), at // k
    return out, nodes[0]


def folded(digest, path):
    for left, right in path:
        digest = sha("".join([*left, digest, *right]))
    return digest


def tree_by_force(rows, k):
    leaf = lambda r, n: sha("".join(map(told, (r[0], r[3], r[2], n, r[1]))))
    groups = defaultdict(list)
    for r in rows:
        hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 and r[4] is not None
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4] + 1 if hit else r[4])))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: sorted(groups[g]) for g in names}
    tops = [path_of([x[2] for x in made[g]], 0, k)[1] for g in names]
    out = Counter()
    for n, g in enumerate(names):
        above, root = path_of(tops, n, k)
        for at, (known, i, own, claim) in enumerate(made[g]):
            path = path_of([x[2] for x in made[g]], at, k)[0] + above
            end = folded(claim, path)
            proof = sha("".join(d for side in path for part in side for d in part))
            out[i if known else None, own, tops[n], root, proof, end, end == root] += 1
    return out


@pytest.mark.parametrize("fan_in, height", [(2, 8), (2, 1), (2, 3), (3, 2)])
def test_manifest_equals_brute_force(spark, rows, fan_in, height):
    table = clashing(frame(spark, rows))
    got = merkle.verified_manifest(table, claimed=merkle.tampered(), fan_in=fan_in, height=height)
    assert Counter(map(tuple, got.collect())) == tree_by_force(rows, fan_in)


def test_manifest_of_small_tables(spark, rows):
    assert merkle.verified_manifest(frame(spark, [])).count() == 0
    for few in (rows[:1], rows[:2], rows[:4], [(5, "x", "en", "s", 1)] * 5, [(i, "x", f"l{i:03}", "s", 1) for i in range(40)]):
        got = merkle.verified_manifest(frame(spark, few), claimed=merkle.tampered(), height=2)
        assert Counter(map(tuple, got.collect())) == tree_by_force(few, 2)


def test_manifest_detects_any_change(spark, rows):
    """Every claimed digest that is not the leaf fails, every true one passes."""
    wrong = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("wrong").cast("binary"), 256)).otherwise(merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS]))
    got = merkle.verified_manifest(frame(spark, rows).where("doc_id is not null"), claimed=wrong).collect()
    assert all(r.verified == (r.doc_id % 2 == 1) for r in got)


def test_manifest_of_other_ids_and_columns(spark, rows):
    table = frame(spark, rows).where("doc_id is not null").select(F.concat(F.lit("d"), F.lpad("doc_id", 4, "0")).alias("name"), "text", "lang")
    got = merkle.verified_manifest(table, columns=["text", "name"], order="name").collect()
    assert len(got) == table.count() and all(r.verified for r in got) and len({r.root for r in got}) == 1


def by_force(q, start, rounds):
    c = start.copy()
    for r in range(rounds + 1):
        d = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            for j in set(own.tolist()):
                mine = q[own == j]
                c[j] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    return own, d[np.arange(len(q)), own], c


def vectors_of(n, size, seed, groups=5):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (groups, size))
    x = (centres[r.integers(0, groups, n)] + r.normal(0, 0.05, (n, size))).astype(np.float32)
    x[: n // 3] = x[0]  # one hot vector
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]


@pytest.mark.parametrize("n, size, k, seed", [(400, 64, 40, 1), (300, 8, 12, 2), (200, 2, 9, 3), (50, 4, 3, 4), (30, 4, 1, 5), (7, 4, 40, 6)])
def test_clusters_equal_brute_force(spark, n, size, k, seed):
    rows = vectors_of(n, size, seed)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in clashing(drake.cluster_report(clashing(table), k, 5, size)).collect()}
    q = np.floor(np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64) * 256).astype(np.int64)
    first = sorted(range(n), key=lambda i: sha(f"2:{i}"))[:k]
    own, d, c = by_force(q, q[first], 5)
    assert len(got) == n
    for i, r in got.items():
        assert (r.cluster, r.distance) == (own[i], d[i])
        assert r.cluster_inertia == d[own == own[i]].sum() and r.inertia == d.sum()
        assert r.centroid_sha256 == sha(",".join(map(str, c[own[i]].tolist())))


def test_bounds_hold_and_save_scans(spark):
    """Bounds stay on their side of the true distances, and most rows are certified without a scan."""
    rng = np.random.default_rng(8)
    q = np.concatenate([rng.integers(-40, 40, (300, 6)) + rng.integers(-900, 900, 6) for _ in range(8)]).astype(np.int64)
    c = q[rng.choice(len(q), 16, replace=False)]
    state, listed, seen = drake.scanned(q, c, 5), 5, []
    for r in range(6):
        own, upper, near, low, rest = state
        d = np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(axis=2))
        assert (upper >= d[np.arange(len(q)), own]).all() and (own == d.argmin(axis=1)).all()
        assert (low <= np.take_along_axis(d, near, 1)).all()
        others = np.ones_like(d, dtype=bool)
        np.put_along_axis(others, np.concatenate([own[:, None], near], axis=1), False, 1)
        assert (rest <= np.where(others, d, np.inf).min(axis=1)).all()
        after = np.array([q[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
        moves = drake._above(drake.squared(after, c))
        listed = max(2, listed - 1)
        c = after
        *state, asked, full = drake.reassigned(q, c, own, *drake.moved_bounds(*state, moves, listed))
        seen.append(full.sum())
    assert sum(seen) < 6 * len(q) / 4


def test_unfit_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (None, [0.0, 0.0], 0), (2, None, 0), (3, [1.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0, 3.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = drake.cluster_report(table, 3, 5, 2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0)]
    empty = drake.cluster_report(table.where("vec_id = 2"), 3, 5, 2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        drake.cluster_report(spark.createDataFrame([(1, [1e30, 1.0], 0)], table.schema), 3, 5, 2)
