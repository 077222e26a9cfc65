import hashlib
import random

import pytest

from pricerank.llm import fingerprint as fp
from tests.llm.helpers import documents, prose, values


def slow_fingerprint(text):
    """The definition, byte by byte."""
    def mixed(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2**64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % 2**64
        return x ^ x >> 33

    rolled = []
    for i in range(len(text)):
        h = sum((text[i - k] + 1) * 0x01000193**k for k in range(min(16, i + 1))) % 2**32
        h ^= h >> 16
        h = h * 0x85EBCA6B % 2**32
        rolled.append(h ^ h >> 13)

    def chunks(bits):
        out, start = [], 0
        for i, h in enumerate(rolled):
            if h % 2**bits == 2**bits - 1:
                if len(out) < 63:
                    out.append(text[start : i + 1])
                    start = i + 1
        return out + [text[start:]] * (start < len(text))

    bits, count = 2, lambda j: sum(h % 2**j == 2**j - 1 for h in rolled)
    while count(bits) >= 64 and count(bits + 1) >= 16:
        bits += 1
    char = lambda c: fp.ALPHABET.tobytes().decode()[mixed(sum((b + 1) * fp.BASE**j for j, b in enumerate(c)) % 2**64) >> 58]
    return ":".join([str(2**bits), *("".join(map(char, chunks(j))) for j in (bits, bits + 1))])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] if x == y else len(a) + len(b)))
    return row[-1]


def test_fingerprints_by_definition():
    rng = random.Random(3)
    texts = [b"", b"a", b"aaaaaaa", "ñandú".encode(), b"\x00" * 50, b"ab" * 3_000] + [prose(rng, n).encode() for n in (1, 2, 5, 30, 200, 1_500)]
    for t in texts:
        assert fp.fingerprint(t) == slow_fingerprint(t)
        assert max(map(len, fp.fingerprint(t).split(":"))) <= 64
    assert fp.fingerprint(None) == fp.fingerprint(b"") == "4::"
    long = prose(rng, 300_000).encode()  # beyond the kept powers
    assert len(long) > fp.KEPT and max(map(len, fp.fingerprint(long).split(":"))) <= 64 and fp.likeness(fp.fingerprint(long), fp.fingerprint(long[40_000:])) > 0.9


def test_distance_and_likeness():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(70))) for _ in "ab")
        assert fp.edit_distance(a, b) == fp.edit_distance(b, a) == distance(a, b)
    assert fp.likeness("4::", "4::") == 1 and fp.likeness("4::", "4:A:A") == 0 and fp.likeness(None, "4::") is None
    assert fp.likeness("8:abcdefgh:ijkl", "8:abcdxfgh:zzzz") == pytest.approx(1 - 2 / 16)
    assert fp.likeness("8:abcdefgh:ijkl", "16:ijkl:mn") == 1 == fp.likeness("16:ijkl:mn", "8:abcdefgh:ijkl") and fp.likeness("8:abcd:ab", "32:abcd:ab") == 0
    assert fp.likeness("8:abcxdefyghizjkl:a", "8:abc1def2ghi3jkl:b") == 0  # nothing of four characters in common


def test_edits_stay_near_and_others_far():
    rng = random.Random(5)
    near, far = [], []
    for _ in range(200):
        a, b = ([f"{rng.randrange(20_000):x}" for _ in range(rng.choice([40, 200, 2_000]))] for _ in "ab")
        edited = a[:]
        edited[rng.randrange(len(a))] = "new words here"
        x, y, z = (fp.fingerprint(" ".join(t).encode()) for t in (a, edited, b))
        near.append(fp.likeness(x, y))
        far.append(fp.likeness(x, z))
    assert sorted(near)[10] > 0.85 and sorted(far)[-10] == 0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        own, other, following = (slow_fingerprint(x.encode()) for x in (t, edited, after))
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, following)))
    return out


@pytest.mark.parametrize("parts", [1, 7, 90])
def test_query(spark, parts):
    rows = [(d, t) for d, t, *_ in values() if t is None or len(t) < 1_000] + [(-5, "ñ" * 41), (900, "𝄞𝄞𝄞𝄞"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS edge", "3 AS fingerprint", "4 AS `next`")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in fp.report(docs.repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_odd_tables(spark):
    docs = documents(spark, odd=True)
    assert fp.report(docs.limit(0)).count() == 0 and fp.report(docs.union(docs)).count() == 120
    one = fp.report(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    marked = fp.fingerprinted(docs.withColumn("fingerprint", docs.doc_id))
    assert marked.columns == [*docs.columns, "fingerprint"] and {r.doc_id: r.fingerprint for r in marked.collect()} == {d: fp.fingerprint((t or "").encode()) for d, t, *_ in values()}
    pairs = spark.createDataFrame([("4:AB:A", "4:AB:A"), (None, "4::")], "a string, b string")
    assert [r.likeness for r in fp.compared(pairs).collect()] == [1.0, None]
