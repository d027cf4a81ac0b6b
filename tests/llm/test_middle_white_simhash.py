"""Fill-in-the-middle, whitening and covering SimHash against plain versions of the same contracts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import BIG, by_key

from statuta.llm import fill_middle, simhash, whitening

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill in the middle ------------------------------------------------------------

def cut(key, text):
    """(n, form, prefix, middle, output) by slicing lists of units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_slices_and_restores(spark, documents, odd):
    awkward = [(1000 + i, t, "en", "a", 1) for i, t in enumerate(
        ["<P> inside", "a <S> b", "x<M>", "<", "<P", "a <P <S <M b < P>", " ", "\n\n a", "a b   c", "😀 😀\U0001d538 é", "$1 \\ $0 {2}+", "x " * 70_000, "é" * 40_000,
         " \t" * 30_000] * 6)]
    docs = documents.unionByName(odd).unionByName(spark.createDataFrame(awkward, documents.schema))
    done = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    forms = set()
    for r in done.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.doc_id, r.text)
        assert r.back == r.text
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"} and done.count() == docs.count()


def test_fill_middle_draws_by_key_and_rates(documents, empty, odd):
    rows = {r.doc_id: r.form for r in fill_middle.transform(documents, rate=100, spm_rate=0).collect()}
    assert set(rows.values()) <= {"psm", "plain"} and "psm" in rows.values()
    assert {r.form for r in fill_middle.transform(documents, rate=0).collect()} == {"plain"}
    assert fill_middle.digests(documents).collect() == fill_middle.digests(documents).collect()
    assert fill_middle.digests(empty).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("n", "form", "output", "h1", "key", "prefix_chars")})
    assert by_key(fill_middle.digests(clash)) == by_key(fill_middle.digests(odd))


# --- whitening ------------------------------------------------------------------------

def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")


def check_whitened(spark, rows, components=8, kind="array<float>"):
    """Compares with the eigenvectors of numpy over the same whole numbers."""
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int) + 100_000) for i, v, _ in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    x, n = np.stack([v for _, v in kept]), len(kept)
    s = x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    got = whitening.whitened(frame(spark, rows, kind), components=components).toPandas()
    assert len(got) == n * len(values) and set(got["n"]) == {n}
    deviation = sorted(sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True)) for _, v in kept)
    assert sorted(map(int, got.loc[got["component"] == 1, "deviation"])) == deviation
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / (centred ** 2).sum() * n, rtol=1e-9)
    assert set(got["identity_error"]).pop() < 1e-9
    for c in range(1, len(values) + 1):
        one = np.sort(got.loc[got["component"] == c, "whitened"].to_numpy())
        want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(one - np.sort(want)).max(), np.abs(one - np.sort(-want)).max()) < 1e-6


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)) * np.linspace(0.1, 2, 12) + rng.normal(size=12)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    rows += [(None, rows[0][1], 1), (3, rows[3][1], 1), (BIG, rows[5][1], 0)]
    odd = [(900, None, 0), (901, [None, *rows[0][1][1:]], 0), (902, [float("nan")] * 12, 0), (903, [float("inf"), *rows[0][1][1:]], 0), (904, [], 0)]
    check_whitened(spark, rows + odd)
    check_whitened(spark, rows, components=3, kind="array<double>")
    ids = {r.vec_id for r in whitening.whitened(frame(spark, rows + odd)).select("vec_id").distinct().collect()}
    assert BIG in ids and None in ids and not ids & {900, 901, 902, 903, 904}


def test_whitening_of_few_equal_or_no_vectors(spark):
    one = [(1, [1.0, 2.0, 3.0], 0)]
    for rows in ([], one, one * 5, [(1, None, 0)], [(1, [None], 0)]):
        out = whitening.whitened(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = whitening.whitened(frame(spark, one + [(2, [1.0, 2.0, 5.0], 0), (9, [1.0], 0)])).collect()
    assert [(r.vec_id, r.component, r.n) for r in two] == [(1, 1, 2), (2, 1, 2)] and {round(abs(r.whitened), 9) for r in two} == {1.0}
    clash = frame(spark, one + [(2, [1.0, 2.0, 5.0], 0)]).withColumns({c: F.lit("x") for c in ("key", "vector", "n", "component")})
    assert whitening.whitened(clash).count() == 2


def test_whitening_sums_stay_exact_beyond_64_bits():
    held = whitening.Fit(1 << 40, [100_000 << 40, 3], np.eye(2), np.ones(2), np.ones(2))
    got = whitening._deviations(np.array([[100_900.0, 5.0]]), held).to_pylist()
    assert int(got[0]) == (900 << 40) ** 2 + ((5 << 40) - 3) ** 2


@pytest.mark.parametrize("spectrum", ["spread", "clusters", "tight", "equal", "rank", "graded", "diagonal", "zero"])
def test_solver_finds_singular_pairs(spectrum):
    rng = np.random.default_rng(9)
    d = 40
    s = {"spread": np.linspace(1, 9, d), "clusters": np.r_[np.full(15, 3.0), np.full(25, 1.0)], "tight": 1 + 1e-9 * np.arange(d), "equal": np.ones(d),
         "rank": np.r_[np.zeros(d - 5), np.arange(1.0, 6)], "graded": np.logspace(-10, 0, d), "diagonal": np.arange(1.0, d + 1), "zero": np.zeros(d)}[spectrum]
    left, right = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
    r = np.diag(s) if spectrum == "diagonal" else np.linalg.qr(left * s @ right, mode="r")
    values, v = whitening.singular_pairs(r, 8)
    assert np.allclose(values, np.sort(s)[::-1], atol=1e-13 * max(s.max(), 1))
    assert np.abs(v.T @ v - np.eye(8)).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * values[:8] ** 2).max() <= 1e-13 * max(s.max(), 1) ** 2


def test_small_singular_values_keep_their_digits():
    """Relative accuracy: a graded bidiagonal matrix against its values in exact arithmetic of its 2 x 2 parts."""
    a, b = np.array([1.0, 1e-12]), np.array([0.5])
    got = whitening._block_values((a ** 2).tolist(), (b ** 2).tolist())
    assert math.isclose(math.sqrt(min(got)) * math.sqrt(max(got)), 1e-12, rel_tol=1e-12)  # their product is the determinant


# --- SimHash ---------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius):
    """Least index of every fingerprint's component, by all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_components_equal_all_pairs(documents, odd):
    docs = documents.unionByName(odd)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hexed(F.col("fp"))).collect()
    prints = sorted({plain_fingerprint(r.text) for r in rows})
    component = dict(zip(prints, groups(prints, 2), strict=True))
    least = {}
    for r in rows:
        c = component[plain_fingerprint(r.text)]
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{plain_fingerprint(r.text):016x}", least.get(component[plain_fingerprint(r.text)])) for r in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.hex, r.component_id)) for r in got)
    assert any(h == "0" * 16 for _, h, _ in want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_every_pair_within_the_radius_meets_under_a_mask(radius):
    rnd = random.Random(radius)
    tables = simhash.masks(radius)
    assert len(tables) == (1 << (radius + 1)) - 1
    for _ in range(3000):
        apart = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(apart & m == 0 for m in tables)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_crowded_buckets(spark, radius):
    """A large group around one fingerprint: compared pairwise or over shared points, the components are the same."""
    rnd = random.Random(radius)
    center = rnd.getrandbits(64)
    prints = {center, *(center ^ (1 << i) for i in range(0, 64, 2)), *(center ^ (3 << i) for i in range(63)), *(rnd.getrandbits(64) for _ in range(30))}
    at = center
    for _ in range(150):
        for _ in range(rnd.randint(1, radius + 1)):
            at ^= 1 << rnd.randrange(64)
        prints.add(at)
    prints = sorted(prints)
    place = {p: i for i, p in enumerate(prints)}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = groups(prints, radius)
    for compared in (1, 16, 1_000_000):
        found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(frame, radius, compared).collect()]
        assert all(0 < (u ^ v).bit_count() <= radius for u, v in found)
        label = list(range(len(prints)))
        for u, v in found:
            a, b = label[place[u]], label[place[v]]
            label = [min(a, b) if x in (a, b) else x for x in label]
        assert [min(i for i, x in enumerate(label) if x == own) for own in label] == want


def test_simhash_of_empty_table_copies_and_clashing_columns(spark, empty, odd):
    assert simhash.near_duplicates(empty).count() == 0
    copies = spark.createDataFrame([(i, "the same five words here", "en", "a", 1) for i in range(500, 0, -1)] + [(None, "", "en", "a", 0)], odd.schema)
    out = simhash.near_duplicates(copies).collect()
    assert {r.component_id for r in out if r.doc_id is not None} == {1} and [r.component_id for r in out if r.doc_id is None] == [None]
    clash = odd.withColumns({c: F.lit("x") for c in ("fp", "key", "component_id", "label", "least")})
    assert by_key(simhash.near_duplicates(clash)) == by_key(simhash.near_duplicates(odd))
