"""The quality model, the source audit and fill-in-middle beyond their SQL."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from helpers import documents, prose, write_tables
from pyspark.sql import functions as F

from boundlab.llm import divergence, infill, quality_model
from boundlab.llm.common import table

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("hard"))


def held(doc_id):
    return crc32(str(doc_id).encode()) % 5 == 0


def test_quality_of_held_out_rows(spark):
    found = {r["doc_id"]: r for r in quality_model.op11_quality_model(spark, LARGE).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{LARGE}/labels.parquet')").fetchall()
    assert len(found) == 10_000 and all(r["held_out"] == held(d) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in found.items())
    rows = [(found[d]["score"], found[d]["predicted"], q) for d, q in labels if held(d) and d in found]
    good, bad = ([r for r in rows if r[2] == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 80
    assert sum(g[0] > b[0] for g in good for b in bad) / (len(good) * len(bad)) > 0.99
    assert sum(g[1] for g in good) / len(good) > 0.99 and sum(1 - b[1] for b in bad) / len(bad) > 0.9
    assert abs(np.mean([r[0] for r in rows]) - np.mean([r[2] for r in rows])) < 0.05  # calibrated


def test_quality_hard_cases(spark, hard):
    docs, labels = table(spark, hard, "documents"), table(spark, hard, "labels").withColumn("quality", F.when(F.col("doc_id") > 2, 0).otherwise(1))
    found = quality_model.classified(docs, labels)
    assert Counter(r["row"]["doc_id"] for r in found.collect()) == Counter(d[0] for d in documents())
    assert found.select("row.*").columns == docs.columns
    same = defaultdict(set)
    for r in found.collect():
        same[r["row"]["text"] or ""].add(r["score"])
        assert r["held_out"] == (r["row"]["doc_id"] is None or held(r["row"]["doc_id"]))
    assert all(len(x) == 1 for x in same.values())  # equal texts, equal scores; null is empty
    assert {r["score"] for r in quality_model.classified(docs, labels.limit(0)).collect()} == {0.5}
    again = quality_model.classified(docs.repartition(7), labels.repartition(3))
    score = lambda df: sorted((str(r["row"]["doc_id"]), r["row"]["text"] or "", round(r["score"], 9)) for r in df.collect())
    assert score(again) == score(found)


def test_fit_sample_is_bounded_and_blind_to_held_out_labels(spark):
    rows = [(i, prose(20 + i % 7, 5, i) + (" $$ ## $$" if i % 3 == 0 else "")) for i in range(300)] + [(4, "x " * 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 3 != 0)) for i in range(300)]
    wrong = [(i, 1 - q if held(i) else q) for i, q in labels]
    made = [quality_model.learn(docs, spark.createDataFrame(x, "doc_id long, quality int"), **(quality_model.FIT | {"most": most})) for x, most in ((labels, 100), (wrong, 100), (labels, 20))]
    assert np.allclose(made[0], made[1], rtol=1e-12, atol=1e-12) and np.abs(made[0] - made[2]).max() > 1e-3


def test_leader_minimises_the_regularised_sum():
    rng, alpha, beta, l1, l2 = np.random.default_rng(1), 0.7, 1.0, 0.3, 0.2
    leader = quality_model.Leader(alpha, beta, l1, l2)
    grid = np.linspace(-6, 6, 240_001)
    seen: list = []
    total, place, value = 0.0, np.array([5]), np.array([1.0])
    for _ in range(12):
        label = float(rng.random() < 0.8)
        w = float(leader.weights(place)[0])
        g = 1 / (1 + math.exp(-w)) - label
        sigma = (math.sqrt(total + g * g) - math.sqrt(total)) / alpha
        seen.append((w, g, sigma))
        total += g * g
        leader.learn(place, value, label)
        # the sum of linearised losses, each with a pull towards the weight it was taken at, and both penalties
        loss = sum(g * grid + sigma / 2 * (grid - w) ** 2 for w, g, sigma in seen) + l1 * np.abs(grid) + (l2 + beta / alpha) / 2 * grid**2
        assert abs(grid[loss.argmin()] - leader.weights(place)[0]) < 1e-4


def test_features_are_unit_shares():
    known = {}
    place, value = quality_model.features("a b a b, Ünder $$ $$".encode(), 3, known)
    assert abs((value**2).sum() - 1) < 1e-6 and (np.diff(place) > 0).all()
    assert quality_model.features(None, 2, known)[0].size == 0 == quality_model.features(b" \n", 2, known)[0].size
    one, two = (set(quality_model.features(t, 2, known)[0]) for t in (b"x x x", b"y y y"))
    assert len(one & two) == 1  # repetition has a place of its own


def plain_divergence(rows, least=3, ranks=200):
    """Every term for every pair."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalpha() and c.isascii() or ord(c) >= 128 else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(count, kept=kept):
            below = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // below for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 2])
def test_divergence_brute_force(spark, block):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("Ka", "lo", "é", "東", "MI") for b in ("ra", "NU", "to", "é", "s")]
    rows = [(("en", "de", None)[i % 3], (f"s{i % 11}", "", None)[0 if i % 13 else 1 + i % 2], " 1,".join(rng.choice(words, rng.integers(0, 30)))) for i in range(200)]
    rows += [("en", "alone", None), ("xx", "a", "one two"), ("xx", "b", ""), ("yy", "only", "w " * 4)] + [("en", "hot", "Kara " * 400 + "lo")] * 5
    found = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), ranks=7, block=block)
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows, ranks=7)


def test_divergence_counts_beyond_32_bits(spark):
    rows = spark.createDataFrame([(4 * 10**12, 8 * 10**12, 1000), (0, 0, 1), (10**9 - 1, 10**9, 5)], "n long, total long, kept long")
    for r in rows.select("*", divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["kept"])


def test_infill_hard_cases(spark, hard):
    docs = table(spark, hard, "documents")
    made = infill.transformed(docs)
    assert [c for c in made.columns if c in docs.columns] == [c for c in docs.columns if c != "n"] + ["n"]
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["back"]) for r in rows) == Counter((d[0], d[1] or "") for d in documents())
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        if r["form"] != "plain":
            parts = r["output"].replace("<P>", "\0").replace("<S>", "\0").replace("<M>", "\0").split("\0")[1:]
            assert len(r["text"]) == r["n"] == sum(map(len, parts)) and len(parts[2]) == r["middle_chars"] and len(parts[0 if r["form"] == "psm" else 1]) == r["prefix_chars"]


@pytest.mark.parametrize("sentinels", [("<P>", "<S>", "<M>"), ("[.*|p]", "$\\E(s", "\n^m x?"), ("前", "後", "\U0001f600")])
def test_infill_round_trip(spark, sentinels):
    inner = ["", "<", "<S", "a<P", "<<", ">", "\\E", "$", "\U0001f600x", "é́", "\r\n", "x" * 70_000, sentinels[0], f"a{sentinels[2]}b", "後"]
    rows = [(i, a + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in inner for b in inner[:6] for c in inner[:4])] + [(None, "null id"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.transformed(docs, seed=9, sentinels=sentinels, rearranged=100, suffix_first=50)
    back = made.select("doc_id", "form", "text", infill.restored(F.col("output"), F.col("form"), sentinels).alias("back")).collect()
    assert len(back) == len(rows) and all(r["back"] == (r["text"] or "") for r in back)
    assert all((r["form"] == "plain") == (not r["text"] or any(s in r["text"] for s in sentinels)) for r in back)


def test_infill_sentinels_that_can_be_misread():
    for bad in (("a", "a", "b"), ("ab", "b", "c"), ("aa", "xa", "y"), ("", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError, match="misread"):
            infill.apart(bad)
