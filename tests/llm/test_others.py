import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricerank.llm import preference, quality, token_counts, toxicity
from tests.llm.helpers import documents, prose, values

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    out = []
    for k in range(10):
        out += [(k, 0, "system", "be kind"), (k, 1, "user", f"question {k // 2}"), (k, 2, "assistant", f"answer {k}"), (k, 3, "user", "more?"), (k, 5, "assistant", f"final {k if k < 8 else 8}")]
    return out + [(20, 0, "user", "alone"), (21, 0, "assistant", None), (20, 1, None, "odd"), (None, 0, "user", "x"), (30, None, "user", "x"), (4, 9, "user", "unanswered")]


def test_preference_pairs(spark):
    turns = spark.createDataFrame(conversations(), TURNS)
    got = {r.pair_id: r for r in preference.format_pairs(*preference.swapped_replies(turns)).collect()}
    assert sorted(got) == list(range(10))
    r = got[4]
    assert r.n_prompt_turns == 4 and r.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nquestion 2<|end|>\n<|assistant|>\nanswer 4<|end|>\n<|user|>\nmore?<|end|>\n"
    assert (r.chosen, r.rejected) == ("<|assistant|>\nfinal 4<|end|>\n", "<|assistant|>\nfinal 5<|end|>\n")
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["final 4<|end|>\n"]
    assert got[8].chosen == got[8].rejected == "" and got[8].n_prompt_turns == 5  # equal sides are all prompt
    assert preference.report(turns).count() == 10 and preference.report(turns.limit(0)).count() == 0
    assert sorted(preference.report(turns.union(turns)).collect()) == sorted(preference.report(turns).collect())


def test_pairs_in_chunks(spark):
    schema = "pair_id long, turn long, role string, text string, end long"
    a = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", "so", 0), (1, 3, "assistant", "é", 0), (2, 0, "user", "only chosen", 0)], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "no", 0)], schema)
    got = {(r.pair_id, r.chunk): r for r in preference.format_pairs(a, b, most_turns=2).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0)] and got[1, 0].n_prompt_turns == got[1, 1].n_prompt_turns == 1
    assert got[1, 0].rejected.endswith("no<|end|>\n") and got[1, 1].rejected == "" and got[1, 1].prompt == ""
    assert [got[1, 1].chosen[s.start : s.end] for s in got[1, 1].chosen_spans] == ["é<|end|>\n"]
    assert got[2, 0].prompt == "" and got[2, 0].chosen != ""
    whole = {r.pair_id: r for r in preference.format_pairs(a, b).collect()}
    assert sorted(whole) == [1, 2] and whole[1].chosen == got[1, 0].chosen + got[1, 1].chosen


@pytest.mark.parametrize("step", [1, 1_000, 10**12])
def test_a_pair_is_one_row_whatever_its_turn_numbers(spark, step):
    schema = "pair_id long, turn long, role string, text string"
    turns = [(p, step * n, "user" if n % 2 else "assistant", f"t{n}") for p in (1, 2) for n in range(600)]
    a, b = (spark.createDataFrame([*turns, (1, 9000 * step, "assistant", x)], schema) for x in ("yes", "no"))
    rows = {r.pair_id: r for r in preference.format_pairs(a, b).collect()}
    assert len(rows) == 2 and all(r.chunk == 0 and r.n_prompt_turns == 600 and r.prompt.count("<|user|>") == 300 for r in rows.values())
    assert "yes" in rows[1].chosen and "no" in rows[1].rejected and rows[2].chosen == rows[2].rejected == ""


def formatted(a, b):
    """The definition, pair by pair: prompt turns, prompt, completions."""
    render = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for _, said in sorted(turns.items()) for r, t in sorted(said))
    end = min((n for n in a.keys() | b.keys() if a.get(n) != b.get(n)), default=10**9)
    before, after = (lambda turns: {n: x for n, x in turns.items() if n < end}), (lambda turns: {n: x for n, x in turns.items() if n >= end})
    return sum(map(len, before(a).values())), render(before(a)), render(after(a)), render(after(b))


def test_random_pairs_by_definition(spark):
    rng, sides = random.Random(8), ([], [])
    want = {}
    for p in range(150):
        shared = {rng.randrange(5_000): {(rng.choice(["user", "assistant"]), rng.choice(["x", "é", ""])) for _ in range(rng.choice([1, 1, 2]))} for _ in range(rng.randrange(6))}
        pair = [dict(shared), dict(shared)]
        for side in pair:
            for _ in range(rng.randrange(3)):
                side[rng.randrange(5_000)] = {("assistant", rng.choice("ab"))}
        for side, turns in zip(sides, pair):
            side += [(p, n, r, t) for n, said in turns.items() for r, t in said]
        if pair[0] or pair[1]:
            want[p] = formatted(*pair)
    made = preference.format_pairs(*[spark.createDataFrame(side, "pair_id long, turn long, role string, text string") for side in sides])
    assert {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in made.collect()} == want


def test_token_counts(spark):
    encoder = token_counts.encoding()
    lengths = sorted(len(encoder.encode_ordinary(t)) if t else 0 for _, t, *_ in values())
    sums = token_counts.suffix_sums(token_counts.histogram(documents(spark))).cache()
    rows = {r.length: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for x, r in rows.items():
        assert r.n_docs == lengths.count(x) and r.docs_at_least == sum(n >= x for n in lengths) and r.tokens_at_least == sum(n for n in lengths if n >= x)
        assert r.truncated_total == sum(min(n, x) for n in lengths) and r.share_up_to == pytest.approx(sum(n <= x for n in lengths) / len(lengths))
    assert token_counts.quantile(sums, 0.5).first().length == lengths[29]
    limits = [0, 1, 100, 10**6]
    assert {r.limit: r.total for r in token_counts.truncated_totals(sums, limits).collect()} == {x: sum(min(n, x) for n in lengths) for x in limits}
    empty = token_counts.suffix_sums(token_counts.histogram(documents(spark).limit(0)))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5).first().length is None


def labelled(spark, n=600):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        text, toxic = prose(rng, rng.choice([20, 60, 150])).split(), int(k % 5 == 0)
        for i in range(0, len(text) * toxic, 20):
            text[i] = rng.choice(["grumbleface", "Snarkwit", "blighter"]) + rng.choice(["", "s", "y", "ish"])
        rows.append((k, " ".join(text), None if k % 2 else "en", f"s{k % 3}", 0))
        labels.append((k, toxic, 1 - toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.95
    odd = docs.limit(3).withColumn("text", F.lit("a grumblefacely blightering snarkwitted w1 w2 w3")).select("doc_id", "text")  # unseen spellings
    assert all(r.score > 0.5 for r in toxicity.scores(docs.select("doc_id", "text").union(odd.withColumn("doc_id", F.col("doc_id") + 9000)), labels).where("doc_id >= 9000").collect())


def test_toxicity_odd_tables(spark):
    docs, labels = documents(spark, odd=True), labelled(spark)[1]
    assert toxicity.report(docs.limit(0), labels).count() == 0
    assert toxicity.report(docs, labels.limit(0)).where("score < 1e-9 AND predicted = 0").count() == 60
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns
    twice = toxicity.report(docs.union(docs), labels)
    assert twice.count() == 120 and twice.where("score IS NULL OR isnan(score)").count() == 0
    assert toxicity.scores(docs, labels.union(labels.withColumn("doc_id", F.lit(None).cast("long")))).count() == 60


def test_subwords():
    ids, count = toxicity.subwords([b"ab", b"idiot", b"ab", "Straße".encode(), b"x"])
    parts = np.split(ids, np.cumsum(count)[:-1])
    assert sorted(parts[0]) == sorted(parts[2]) and len(set(parts[0]) & set(parts[1])) == 0
    assert count.tolist() == [1 + 2 + 1, 1 + 5 + 4 + 3, 1 + 2 + 1, 1 + 7 + 6 + 5, 1 + 1]


def test_quality(spark):
    docs, labels = labelled(spark)
    bad = docs.join(labels, "doc_id").withColumn("text", F.when(F.col("quality") == 0, F.upper(F.regexp_replace("text", " ", "### "))).otherwise(F.col("text"))).select(docs.columns)
    got = quality.scores(bad, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in got if r.held_out]) >= 0.97
    assert all(0 <= r.score <= 1 and 0 < r.host_rate < 1 and 0 < r.path_rate < 1 for r in got)


def test_sparse_sites_lean_on_the_whole(spark):
    rows = [(k, "good plain words here " * 5 if k < 300 else "### $$$ " * 9, "en", "big" if k < 150 else "junk" if k >= 300 else f"site{k}", 0) for k in range(450)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(k, int(k < 300), 0) for k in range(450)], "doc_id long, quality int, toxic int")
    rate = {r.source: r.host_rate for r in quality.scores(docs, labels).join(docs.select("doc_id", "source"), "doc_id").collect()}
    assert rate["big"] > rate["site200"] > rate["junk"] and abs(rate["site200"] - 2 / 3) < 0.1


def test_site_rates_by_hand(spark):
    """Beliefs are training labels or the classifier's probabilities; own parts are left out."""
    docs, labels = labelled(spark)
    labels = labels.where("doc_id % 3 <> 0")
    got = quality.scores(docs, labels, levels=("source", "lang")).join(docs.select("doc_id", "source"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    base = np.mean([r.quality for r in got if r.quality is not None and not r.held_out])
    base = np.log(base / (1 - base))
    belief = {r.doc_id: float(r.quality) if r.quality is not None and not r.held_out else 1 / (1 + np.exp(-(r.evidence + base))) for r in got}
    rate = (sum(belief.values()) + 1) / (len(got) + 2)
    for source in ("s0", "s1", "s2"):
        rows = [r for r in got if r.source == source]
        good, n = sum(belief[r.doc_id] for r in rows), len(rows)
        strength = {round((good - belief[r.doc_id] - (n - 1) * r.host_rate) / (r.host_rate - rate), 3) for r in rows if abs(r.host_rate - rate) > 1e-4}
        assert len({x for x in strength if not 0.99 < x < 1e4 * 1.01}) == 0 and max(strength, default=1) - min(strength, default=1) <= 0.02 * max(strength, default=1)


def test_toxicity_learns_from_long_texts(spark):
    docs, labels = labelled(spark)
    long = docs.withColumn("text", F.concat_ws(" ", F.array_repeat("text", F.when(F.col("doc_id") % 5 == 0, 400).otherwise(1))))  # all toxic texts are beyond 200,000 bytes or near it
    got = toxicity.report(long, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got if r.held_out]) >= 0.9


def test_quality_odd_tables(spark):
    docs, labels = documents(spark, odd=True), labelled(spark)[1]
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.scores(docs, labels.limit(0)).where("score IS NULL OR evidence <> 0").count() == 0
    assert quality.scores(docs.union(docs), labels).count() == 120


def test_url_levels(spark):
    df = spark.createDataFrame([("https://A.example.com/en/7?x=1",), ("http://b.example.org",), ("no url at all",), (None,)], "url string")
    assert [tuple(r) for r in df.select(*quality.url_levels(F.col("url"))).collect()] == [("a.example.com", "en"), ("b.example.org", None), (None, None), (None, None)]
