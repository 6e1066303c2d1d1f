"""HyperMinHash near-duplicates against all pairs."""

import numpy as np
import pytest

from palimpsest.llm import hyperminhash as h
from palimpsest.llm.common import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def plain_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def plain(rows):
    sets = [(d, plain_set(t)) for d, t in rows if d is not None]
    least = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {(d, len(plain_set(t)), least.get(d), d is None or least[d] == d) for d, t in rows}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in more:
        df = df.withColumn(name, __import__("pyspark").sql.functions.lit(7))
    return {tuple(r) for r in h.near_duplicates(df.repartition(3)).collect()}


def corpus(n=160, seed=5):
    """Chains of copies with edits, in which links lead from one to the next, a block of shared words, and short texts."""
    rng, rows = np.random.default_rng(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    for i in range(n):
        if i % 4 and rows:
            words = rows[int(rng.integers(max(0, len(rows) - 12), len(rows)))][1].split(" ")
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = vocabulary[int(rng.integers(0, 400))]
        else:
            words = [vocabulary[k] for k in rng.integers(0, 400, int(rng.integers(1, 90)))] + (passage if i % 8 == 0 else [])
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == plain(rows)


def test_a_large_cell_is_compared_in_blocks(spark, monkeypatch):
    """Copies of one text with two or more edits each, in one cell, of which many aren't linked with the pivot."""
    monkeypatch.setattr(h, "BLOCK", 4)
    monkeypatch.setattr(h, "PART_ROWS", 50)
    rng = np.random.default_rng(3)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(120):
        words = list(base)
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 9))}"
        rows.append((i, " ".join(words)))
    want = plain(rows)
    assert 1 < len({r[2] for r in want}) < 120
    assert found(spark, rows) == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "one"), (None, "one two"), (None, "x y z a b c d e")]
    rows += [(8, "É b c d e f g h i j"), (9, "é b c d e f g h i j"), (10, "x y z a b c d e"), (10, "x y z a b c d e"), (11, "a b\x00c d e f g h")]
    assert found(spark, rows, regs=1, node=1, label=1) == plain(rows)
    assert found(spark, []) == set()


def test_a_doc_id_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = found(spark, [(1, one), (1, two), (2, one), (3, two), (4, two + " c")])
    assert got == {(1, 28, 1, True), (2, 28, 1, False), (3, 28, 1, False), (4, 29, 1, False)}


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    other = [*words[:1000], "new", *words[1000:]]
    assert found(spark, [(5, " ".join(words)), (3, " ".join(other))]) == {(5, 149_998, 3, False), (3, 149_999, 3, True)}


@pytest.mark.parametrize("n", [6, 7, 13, 20, 60, 400, 5000])
def test_bands_and_estimates_let_links_pass(n):
    """Pairs of the least Jaccard that links: each shares a band, and its estimate isn't discarded."""
    rng, near = np.random.default_rng(n), []
    for _ in range(200 if n < 1000 else 30):
        union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(0.15 * len(union))
        half = int(rng.integers(0, drop + 1))
        a, b = union[half:], union[: len(union) - (drop - half)]
        both = np.random.default_rng(1).permutation(union)
        a, b = np.sort(both[half:]), np.sort(both[: len(union) - (drop - half)])
        ra, rb = h.registers(a)[None], h.registers(b)[None]
        (ba, full), (bb, _) = h.bands_of(ra), h.bands_of(rb)
        assert ((ba == bb) & full).any()
        sizes = np.array([len(a)]), np.array([len(b)])
        assert h.may_link(ra, rb, *sizes)[0]
        near.append(h.estimate(ra, rb, *sizes)[0][0] - len(np.intersect1d(a, b)) / len(union))
    assert abs(np.mean(near)) < 0.03


def test_registers_keep_zeros_and_mantissa():
    """Against a plain reading of the definition, for one hash function."""
    hashes = np.unique(np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.uint64))
    got = h.registers(hashes).reshape(h.REPLICATES, h.BUCKETS)
    for r in (0, 7):
        least = {}
        for x in hashes.tolist():
            y = x * int(h._ODD[r, 0]) % 2**64
            y = (y ^ (y >> 32)) * int(h._ODD2[r, 0]) % 2**64
            least[y >> 61] = min(least.get(y >> 61, 2**64), y & (2**61 - 1))
        for b in range(h.BUCKETS):
            if b not in least:
                assert got[r, b] == h.EMPTY
            else:
                bits = f"{least[b]:061b}"
                zeros = len(bits) - len(bits.lstrip("0"))
                assert got[r, b] == zeros << h.MANTISSA | int(bits[zeros + 1 : zeros + 1 + h.MANTISSA], 2)


def test_unlike_pairs_are_discarded_and_chance_is_corrected():
    a, b = (np.random.default_rng(i).integers(0, 2**63, 3000, dtype=np.uint64) for i in (1, 2))
    ra, rb = h.registers(np.unique(a))[None], h.registers(np.unique(b))[None]
    n = np.array([3000])
    assert not h.may_link(ra, rb, n, n)[0]
    assert abs(h.estimate(ra, rb, n, n)[0][0]) < 0.03
    # Registers of one bit of mantissa would be equal by chance far more often than those of ten.
    assert 1e-4 < h.chance(n, n)[0] < 3e-4
