"""Each dealt operator against SQL or brute force, on real rows, on the hard cases and on nothing."""

import itertools
import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from helpers import components, documents, duck, simhash, spark_rows, write_tables
from pyspark.sql import functions as F

from boundlab.llm import chat, language_model, licenses, mixing, pieces, sharding, simhash as sim, topk, toxicity
from boundlab.llm.common import prefix_length, running_total, table
from boundlab.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("hard"))


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("nothing"), empty=True)


@pytest.mark.parametrize("name", ORACLES)
def test_sql_on_real_rows(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck(ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ORACLES)
def test_sql_on_hard_cases(spark, hard, name):
    assert spark_rows(QUERIES[name](spark, hard)) == duck(ORACLES[name], hard)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == (1 if name.startswith("op5_") else 0)


@pytest.mark.parametrize("name", ["op2_simhash_near_dedup", "op3_sentencepiece", "op8_balanced_shards", "op9_language_model", "op10_toxicity"])
def test_every_row_comes_back(spark, hard, name):
    found = [r["doc_id"] for r in QUERIES[name](spark, hard).collect()]
    assert Counter(found) == Counter(d[0] for d in documents())


def near_copies():
    rng, rows = np.random.default_rng(5), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(12):
        text = list(rng.choice(words, 120))
        for _ in range(15):
            other = list(text)
            other[rng.integers(120)] = "changed"
            rows.append(" ".join(other))
    return [(i, t) for i, t in enumerate(rows + [None, "", "x"])]


@pytest.mark.parametrize(("distance", "hot"), [(0, 4096), (1, 4096), (2, 4096), (2, 3), (3, 3)])
def test_simhash_components(spark, distance, hot):
    rows = near_copies()
    found = sim.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance, hot).collect()
    prints = [simhash(t) for _, t in rows]
    want = components([i for i, _ in rows], prints, distance)
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in found} == {i: (p, c) for (i, _), p, c in zip(rows, prints, want, strict=True)}


def test_simhash_hard_cases(spark, hard):
    rows = documents()
    prints = [simhash(t) for _, t, *_ in rows]
    want = Counter((d[0], f"{p:016x}", c) for d, p, c in zip(rows, prints, components([d[0] for d in rows], prints), strict=True))
    assert Counter(tuple(r) for r in sim.op2_simhash_near_dedup(spark, hard).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_pairs_in_large_cells(monkeypatch):
    monkeypatch.setattr(sim, "HOT", 8)
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    a, b = sim.pairs_within(fp, 2)
    assert len(set(sim.forest(len(fp), a, b))) == 1


def test_sentencepiece_equals_library(spark, hard):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = table(spark, hard, "documents")
    made = pieces.encode_pieces(docs, pieces.read_model(path), back=True).select("text", "tokens", "decoded").collect()
    assert len(made) == len(documents())
    for r in made:
        assert r["tokens"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    apart = pieces.decode_pieces(pieces.encode_pieces(docs, pieces.read_model(path)), pieces.read_model(path))
    assert Counter(r["decoded"] for r in apart.collect()) == Counter(t or "" for _, t, *_ in documents())


def test_chat_reads_back(spark, hard):
    rows = table(spark, hard, "conversations")
    back = chat.read_back(chat.format_chats(rows)).collect()
    want = defaultdict(list)
    for r in rows.collect():
        want[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back} == {k: [x[1:] for x in sorted(v)] for k, v in want.items()}
    assert {r["conv_id"]: r["valid"] for r in back} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True, None: False}
    odd = chat.TEMPLATE | {"close": ".*[end]+$\n", "codes": chat.TEMPLATE["codes"] | {".": "\\d"}, "text_codes": ["\\", "#", "."]}
    again = chat.read_back(chat.format_chats(rows, odd), odd).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in again} == {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    rows += [(i + 300, v) for i, v in rows[:40]]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 7 == 0, 5, pivots=9)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = []
    for q in range(0, len(rows), 7):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(len(rows)) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == want


def test_top_k_large_and_null_ids(spark):
    big = 2**60
    rows = [(None, [9.0, 9.0])] * 3 + [(big + 1, [1.0, 0.5]), (big + 2, [0.5, 1.0]), (-big - 3, [1.0, 1.0]), (0, [0.25, 0.5])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.col("vec_id") >= 0, 5).collect()
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None}
    want = []
    for q in (big + 1, big + 2, 0):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_mixing_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * (3 + i % 5)), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(90)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in made)
    wanted = mixing.targets({"a": sum(r["size"] for r in made if "a" in r["source"]), "b": sum(r["size"] for r in made if "b" in r["source"])})
    most = 2 * sum(r["size"] for r in made)
    assert abs(sum(r["taken"] for r in made) - min(most, sum(wanted.values()))) <= 2


def test_flow_costs_are_least():
    sent = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 12, "b": 8})
    assert sent[("a",), "a"] + sent[("a", "b"), "a"] == 12 and sent[("a", "b"), "b"] == 8
    assert sent[("a",), "a"] == 10  # nothing is repeated where fresh words are left


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_gapless(spark, hard, shards):
    made = sharding.balanced_shards(table(spark, hard, "documents"), shards).collect()
    slots = defaultdict(list)
    for r in made:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(documents())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_keep_copies_together(spark):
    rows = [(i, f"group {i % 20}" if i < 100 else f"alone {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, again = (sorted((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.balanced_shards(docs, 8).collect()) for _ in range(2))
    assert made == again
    groups = defaultdict(set)
    for d, crc, shard in made:
        if d < 100:
            groups[crc].add(shard)
    assert sum(len(g) for g in groups.values()) <= 30  # 20 groups; 5 rows each fall into about 4 of 8 shards by chance


def test_language_model_base_and_gain(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ZZ zz unseenword")], docs.schema)).unionByName(docs.limit(3))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    made = language_model.score_texts(docs, held).collect()
    count, rows = Counter(), docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), "<end>"]
    for d, t in rows:
        if crc32(str(d).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    base = {d: (sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), len(tokens(t)), sum(count[w] > 0 for w in tokens(t))) for d, t in rows}
    assert len(made) == len(rows)
    for r in made:
        b, k, known = base[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (k, known)
        assert r["score"] < 0 and r["base_score"] == pytest.approx(b, rel=1e-9) and r["train_tokens"] == n
    again = language_model.score_texts(docs, held).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))
    out = [r for r in made if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(base[r["doc_id"]][0] for r in out)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables hold out six toxic rows or fewer
    made = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    labels = [(r["toxic"], made[r["doc_id"]]) for r in table(spark, folder, "labels").collect() if r["doc_id"] in made]
    test = [(y, r["score"]) for y, r in labels if r["held_out"]]
    pos, neg = [s for y, s in test if y], [s for y, s in test if not y]
    assert pos and neg
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in made.values())


def test_toxicity_without_positives(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic long")
    assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.0, 0.0]


def spread(spark, texts, shards):
    """How many shards each text with copies lies in; counts must be even."""
    made = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards).collect()
    loads = Counter(r["shard"] for r in made)
    assert len(made) == len(texts) and max(loads.values()) - min(loads[s] for s in range(shards)) <= 1
    where = defaultdict(set)
    for r in made:
        where[r["doc_id"]].add(r["shard"])
    groups, counts = defaultdict(set), Counter(texts)
    for i, t in enumerate(texts):
        if counts[t] > 1:
            groups[t] |= where[i]
    return {t: len(s) for t, s in groups.items()}


def test_shards_of_pairs_alone(spark):
    found = spread(spark, [f"pair {i // 2}" for i in range(2000)], 8)
    assert sum(found.values()) - len(found) <= 7


def test_shards_of_a_large_group(spark):
    found = spread(spark, ["hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"alone {i}" for i in range(3000)], 40)
    assert found.pop("hot") == 14  # 1000 rows, 75 a shard
    assert sum(found.values()) == len(found)


def test_toxicity_screen_counts_all_rows(spark):
    texts = {i: f"common w{i % 50}" + (" rare" if i % 100 == 0 else "") for i in range(9000)}
    rows = spark.createDataFrame([(i % 3, t.encode()) for i, t in texts.items()], "part int, text binary")
    counts = toxicity.document_counts(rows, 3)
    place = lambda w: crc32(w.encode()) % toxicity.DIMENSIONS
    assert counts[:, -1].tolist() == [3000] * 3
    assert counts[:, place("common")].sum() == 9000 and counts[:, place("rare")].sum() == 90
    seen = []
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in texts], "doc_id long, toxic long")
    keep, toxicity.telling = toxicity.telling, lambda p, u, n, *more: seen.append(n) or keep(p, u, n, *more)
    try:
        toxicity.toxicity(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels, most_p=20, most_u=50, epochs=1)
    finally:
        toxicity.telling = keep
    train = sum(crc32(str(i).encode()) % 5 != 0 for i in texts)
    assert sum(seen) == 2 * train  # each model sees the counts of two parts of three, not of the sample


def test_toxicity_sample_is_bounded(spark):
    """Thousands of rows of one toxic id don't enlarge the sample."""
    rows = [(1, f"bad words number {i % 500}") for i in range(5000)] + [(i, f"calm words {i}") for i in range(2, 60)] + [(2, "bad words once")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic long")
    seen = []
    keep, toxicity.ensemble = toxicity.ensemble, lambda p, u, *more: seen.append((len(p), len(u))) or keep(p, u, *more)
    try:
        made = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_p=30, most_u=40, epochs=1).collect()
    finally:
        toxicity.ensemble = keep
    assert len(made) == len(rows) and seen and seen[0][0] <= 30 and seen[0][1] <= 40


def test_toxicity_risk_and_gradient():
    rng = np.random.default_rng(2)
    w = np.zeros(toxicity.DIMENSIONS + 1)
    w[:6], w[-1] = rng.normal(size=6), -0.4
    rows = lambda n: [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(n)]
    for p, u, prior in ((rows(5), rows(9), 0.2), (rows(4), rows(6), 0.9), ([np.array([0], np.int32)], [np.zeros(0, np.int32)], 0.95)):
        loss = lambda w, y, x: math.log1p(math.exp(-y * (sum(w[i] for i in x) + w[-1])))
        parts = lambda w: (prior * sum(loss(w, 1, x) for x in p) / len(p), sum(loss(w, -1, x) for x in u) / len(u) - prior * sum(loss(w, -1, x) for x in p) / len(p))  # noqa: E731, B023
        first, second, g = toxicity.gradient(w, p, u, prior)
        assert (first, second) == pytest.approx(parts(w))
        sought = (lambda w: sum(parts(w))) if second >= 0 else (lambda w: -parts(w)[1])
        for i in [*range(6), -1]:
            step = np.zeros(len(w))
            step[i] = 1e-6
            assert g[i] == pytest.approx((sought(w + step) - sought(w - step)) / 2e-6, abs=1e-6)


def test_mixing_odd_sources_and_words_by_source(spark):
    rows = [(1, "a b c", None), (2, "a b", []), (3, "a b c d", ["x", None]), (4, "a", ["x", "x"]), (5, None, ["y"]), (None, "a b c d e", ["x"]), (None, "q r s t u", ["x"])]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(made) == len(rows)
    totals = {"x": 4 + 1 + 5 + 5, "y": 0, None: 3 + 2 + 4}
    wanted, got = mixing.targets(totals), Counter()
    for r in made:
        assert sum(x["taken"] for x in r["by_source"]) == r["taken"] <= 2 * r["size"]
        got.update({x["source"]: x["taken"] for x in r["by_source"]})
    assert all(abs(got[s] - wanted[s]) <= 1 for s in wanted)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), most_patterns=2)


def test_flow_against_every_integer_flow():
    from itertools import product

    rng = np.random.default_rng(9)
    names = "abc"
    for _ in range(12):
        patterns = {p: int(rng.integers(1, 4)) for p in (("a",), ("a", "b"), ("b", "c")) if rng.random() < 0.8}
        quotas = {s: int(rng.integers(0, 5)) for s in names}
        arcs = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in product(*(range(min(2 * patterns[p], quotas[s]) + 1) for p, s in arcs)):
            out, into = Counter(), Counter()
            for (p, s), n in zip(arcs, amounts, strict=True):
                out[p] += n
                into[s] += n
            if all(out[p] <= 2 * patterns[p] for p in out) and all(into[s] <= quotas[s] for s in into):
                key = (-sum(amounts), sum(max(0, out[p] - patterns[p]) for p in out))
                best = key if best is None else min(best, key)
        sent = mixing.route(patterns, quotas)
        used, into = Counter(), Counter()
        for (p, s), n in sent.items():
            used[p] += n
            into[s] += n
        assert all(used[p] <= 2 * patterns[p] for p in used) and all(into[s] <= quotas[s] for s in into)
        assert (-sum(sent.values()), sum(max(0, used[p] - patterns[p]) for p in patterns)) == (best or (0, 0))


def test_flow_of_ten_thousand_patterns_is_greatest_and_cheapest():
    rng = np.random.default_rng(4)
    names = [f"s{i:02d}" for i in range(40)]
    patterns = {}
    while len(patterns) < 10_000:
        patterns[tuple(sorted(rng.choice(names, int(rng.integers(1, 5)), replace=False)))] = int(rng.integers(1, 1000))
    whole = sum(patterns.values())
    quotas = {s: int(w * 1.6 * whole) for s, w in zip(names, rng.dirichlet(np.full(40, 0.6)), strict=True)}
    sent = mixing.route(patterns, quotas)
    assert sent == mixing.route(dict(reversed(patterns.items())), quotas)
    used, into = Counter(), Counter()
    for (p, s), n in sent.items():
        used[p] += n
        into[s] += n
    assert all(used[p] <= 2 * n for p, n in patterns.items()) and all(into[s] <= quotas[s] for s in names)

    def closure(found, spread):
        while (more := found | spread(found)) != found:
            found = more
        return found

    # unmet sources, and those whose words could be handed to them, touch used-up patterns alone
    short = closure({s for s in names if into[s] < quotas[s]}, lambda r: {s for p in patterns if r & set(p) for s in p if sent[p, s]})
    assert all(used[p] == 2 * n for p, n in patterns.items() if short & set(p))
    # no repeated word could come from a pattern that still has a first copy to give
    again = closure({s for p, n in patterns.items() if used[p] > n for s in p if sent[p, s]}, lambda r: {s for p in patterns if r & set(p) for s in p if sent[p, s]})
    assert all(used[p] >= n for p, n in patterns.items() if again & set(p))
    assert short and again and any(used[p] > n for p, n in patterns.items())


@pytest.mark.parametrize("groups", [None, 6])
def test_top_k_prunes_clusters(spark, groups):
    """Twenty clusters: a group of queries needs few of the rows, and nothing is lost. Hot and repeated vectors included."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 12))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, 120, axis=0) + rng.normal(scale=0.02, size=(2400, 12))
    x[:300] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(0, rows[0][1]), (7, rows[2000][1])]  # a repeated query row, and an id with two vectors
    seen = []
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 7 == 0, 5, groups=groups, seen=seen)
    y = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    ids = [i for i, _ in rows]
    want = Counter()
    for q, i in enumerate(ids):
        if i % 7 == 0:
            best = sorted((-int(y[q] @ y[j]), ids[j]) for j in range(len(rows)) if ids[j] != i)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert Counter(map(tuple, found.collect())) == want
    assert seen[0].total <= len(rows) if groups is None else seen[0].share < 0.3


def test_license_notice_however_wrapped(spark):
    mit = dict(reversed([(label, words) for label, words in licenses.NOTICES if label == "mit"]))["mit"]
    lines = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    noise = lambda n: " ".join(f"w{i}" for i in range(n))
    words = mit.split()
    rows = [(1, lines), (2, mit.upper()), (3, noise(5001) + "\n" + lines + "\n" + noise(70)), (4, " ".join(words[: len(words) // 2])), (5, " ".join(w + " " + noise(5) for w in words)), (6, " ".join(words[::-1])), (7, None), (8, " ".join(w for w in words if w != "merge")), (9, "x" * 200_000 + " " + mit)]
    made = {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(made[i] == ("mit", 1.0) for i in (1, 2, 3, 6, 9)) and made[8][0] == "mit" and 0.8 <= made[8][1] < 1
    assert made[4][0] == made[5][0] == made[7][0] == ""
    brute = lambda t: {label for label, ws in licenses.NOTICES for c in [licenses.size_class(ws)] for k in range(0, max(1, len(t)), c) if len(set(ws.split()) & set(t[k : k + 2 * c])) >= math.ceil(0.8 * len(set(ws.split())) - 1e-9)}
    assert all(",".join(sorted(brute((t or "").lower().split()))) == made[i][0] for i, t in rows)


def unigram_model():
    """A hand-made model file: pieces with scores, no normalisation, no dummy prefix."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    import struct

    rng = np.random.default_rng(12)
    words = sorted({"".join(rng.choice(list("abcd\u2581"), n)) for n in (1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 4, 5) for _ in range(4)} | set("abcd\u2581"))
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((w, float(np.float32(-rng.uniform(1, 9))), 1) for w in words)]
    raw = b"".join(message(1, message(1, w.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t)) for w, s, t in pieces_)
    flag = lambda n, v: varint(n << 3) + varint(v)
    return raw + message(2, flag(3, 1)) + message(3, message(1, b"identity") + flag(3, 0) + flag(4, 0) + flag(5, 1)), pieces_


def test_unigram_best_path_by_brute_force(spark):
    """The relaxation against the library, and against every segmentation of short texts."""
    raw, known = unigram_model()
    model = pieces.Model(raw)
    assert not model.bpe
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(raw)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd "), n, p=[0.22, 0.22, 0.22, 0.22, 0.12])) for n in [*range(1, 12), 40, 90, 300] for _ in range(4)] + ["", None, "abz cd", "a" * 3000]
    made = pieces.encode_pieces(spark.createDataFrame([(t,) for t in texts], "text string"), model, back=True).collect()
    score = {i: s for i, (_, s, kind) in enumerate(known) if kind == 1}
    by = {w.replace("\u2581", " "): i for i, (w, _, kind) in enumerate(known) if kind == 1}

    def best(t):
        found = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            found[e] = max((found[s] + score[by[t[s:e]]] for s in range(max(0, e - 5), e) if t[s:e] in by), default=-math.inf)
        return found[-1]

    def every(t):
        return max([0.0] if not t else [score[by[t[:k]]] + every(t[k:]) for k in range(1, min(5, len(t)) + 1) if t[:k] in by], default=-math.inf)

    for r in made:
        text = r["text"] or ""
        if "z" in text:
            assert model.unknown in r["tokens"]
            continue
        assert r["decoded"] == text
        got = sum(score[i] for i in r["tokens"])
        assert got == pytest.approx(best(text), abs=1e-3)
        assert got == pytest.approx(sum(score[i] for i in library.encode(text)), abs=1e-3)
        if len(text) <= 9:
            assert got == pytest.approx(every(text), abs=1e-4)


def test_sentencepiece_query_columns(spark, hard):
    model = pieces.read_model()
    made = pieces.op3_sentencepiece(spark, hard).collect()
    texts = {t or "" for _, t, *_ in documents()}
    assert {pieces.decode(model, r["tokens"]) for r in made} == texts
    for r in made:
        text = pieces.decode(model, r["tokens"])
        assert r["n_tokens"] == len(r["tokens"]) and r["round_trip"] and r["decoded_crc32"] == crc32(text.encode())
        assert r["ids_crc32"] == crc32(np.array(r["tokens"], "<i4").tobytes()) and r["n_bytes"] == sum(i in set(model.bytes_.tolist()) for i in r["tokens"])


def brute_model(docs, train, sweeps=3, burn_in=1):
    """The same sampler, dish by dish in plain Python: log10 probability of each document."""
    lm = language_model
    hashed = [lm.token_hashes((t or "").encode()) for t in docs]
    pairs = [list(zip(map(int, h), map(int, lm.before(h)), strict=True)) for h in hashed]
    count = Counter(p for ps, ok in zip(pairs, train, strict=True) if ok for p in ps)
    words, seats = Counter(), Counter()
    for (w, v), n in count.items():
        words[w] += n
        seats[v] += n
    first = Counter(w for w, _ in count)
    rate = lambda xs: min(0.95, max(0.05, sum(x == 1 for x in xs) / max(1, sum(x == 1 for x in xs) + 2 * sum(x == 2 for x in xs))))
    d0, d1, base = rate(list(count.values())), rate(list(first.values())), 1 / (len(words) + 1)
    draw = lambda key, sweep, turn: float(lm.uniform(np.array([key], np.uint64), sweep, turn)[0])
    key_of = {p: int(lm.dish_key(np.array([p[0]], np.uint64), np.array([p[1]], np.uint64))[0]) for p in count}
    root_key = {w: int(lm.mixed(np.array([w], np.uint64))[0]) for w in words}

    def sit(sizes, a, d, x):
        held = np.cumsum([max(s - d, 0) for s in sizes]) if sizes else np.zeros(1)
        at = x * (held[-1] + a)
        if at < a or held[-1] <= 0:
            sizes.append(1)
        else:
            sizes[int(np.argmax(held > at - a))] += 1

    def leave(sizes, x):
        held = np.cumsum(sizes)
        sizes[int(np.argmax(held > x * held[-1]))] -= 1

    def seated(c, a, d, key):
        sizes = [1] if c else []
        for j in range(1, c):
            sit(sizes, a, d, draw(key, 0, j))
        return sizes

    def again(sizes, want, a, d, key, sweep):
        sizes, have = list(sizes), sum(sizes)
        for j in range(abs(want - have)):
            leave(sizes, draw(key, sweep, 1 << 20 | j)) if want < have else sit(sizes, a, d, draw(key, sweep, 1 << 20 | j))
        for j in range(min(want, lm.TURNS) if want > 1 else 0):
            leave(sizes, draw(key, sweep, 2 * j))
            sit(sizes, a, d, draw(key, sweep, 2 * j + 1))
        return [s for s in sizes if s]

    dish, root = {p: [n] for p, n in count.items()}, {w: [n] for w, n in first.items()}
    samples = []
    for k in range(sweeps + 1):
        tables, customers, top = Counter(), Counter(), sum(len(r) for r in root.values())
        for (w, v), s in dish.items():
            tables[v] += len(s)
            customers[w] += len(s)
        total = sum(customers.values())
        prob = {w: (max(customers[w] - d1 * len(root[w]), 0) + (1 + d1 * top) * base) / (1 + total) for w in words}
        new = {}
        for (w, v), s in dish.items():
            a = (1 + d0 * tables[v]) * prob[w]
            new[w, v] = s if count[w, v] == 1 else seated(count[w, v], a, d0, key_of[w, v]) if k == 0 else again(s, count[w, v], a, d0, key_of[w, v], k)
        after = Counter()
        for (w, _), s in new.items():
            after[w] += len(s)
        weight = (1 + d1 * top) * base
        root = {w: seated(after[w], weight, d1, root_key[w]) if k == 0 else again(root[w], after[w], weight, d1, root_key[w], k) for w in words}
        dish = new
        samples.append((dish, root))
    out = []
    for ps in pairs:
        score = 0.0
        for w, v in ps:
            p = 0.0
            for dish, root in samples[burn_in + 1 :]:
                tables, customers = sum(len(s) for (_, c), s in dish.items() if c == v), sum(len(s) for (x, _), s in dish.items() if x == w)
                top, total = sum(len(r) for r in root.values()), sum(len(s) for s in dish.values())
                up = (max(customers - d1 * len(root.get(w, [])), 0) + (1 + d1 * top) * base) / (1 + total)
                p += (max(count[w, v] - d0 * len(dish.get((w, v), [])), 0) + (1 + d0 * tables) * up) / (1 + seats[v])
            score += math.log10(p / len(samples[burn_in + 1 :]))
        out.append(score)
    return out


@pytest.mark.parametrize(("bucket_bytes", "parts"), [(10**9, 4), (400, 4), (400, 64)])
def test_language_model_brute_force(spark, bucket_bytes, parts):
    """One bucket or many, with hot words or without, 4 or 64 shuffle partitions: the plain sampler's scores."""
    rng = np.random.default_rng(4)
    words = ["the", "the", "the", "of", "a", "b", "c", "d", "e", "f"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 14)))) for _ in range(30)] + [None, "", "unseen the words", "the " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.createDataFrame([(None, "the of a")], "doc_id long, text string"))
    texts.append("the of a")
    held = F.col("doc_id") % 5 == 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        made = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, held, bucket_bytes=bucket_bytes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = [*range(len(texts) - 1), None]
    want = brute_model(texts, [i is None or i % 5 != 2 for i in ids])
    assert [made[i] for i in ids] == pytest.approx(want, rel=1e-9)


def test_seatings_keep_their_customers():
    rng = np.random.default_rng(2)
    c = np.r_[rng.integers(1, 40, 300), 70, 500, 40_000]
    key, a = language_model.mixed(np.arange(len(c))), rng.uniform(0.01, 30, len(c))
    t, sizes = language_model.first_seats(c, a, 0.6, key)
    for sweep in (1, 2):
        owner = np.repeat(np.arange(len(c)), t)
        assert np.array_equal(np.bincount(owner, sizes, len(c)), c) and (sizes > 0).all() and (t <= c).all() and (t >= 1).all()
        want = np.maximum(c + rng.integers(-3, 4, len(c)), 1)
        t, sizes = language_model.gibbs(t, sizes, c, want, a, 0.6, key, sweep)
        c = want


def repeated_rows(spark):
    """Rows equal in id and text by the hundred, among others; their order mustn't matter."""
    rows = [(7, "same text here", "a")] * 300 + [(None, None, "b")] * 90 + [(8, "another text", None)] * 150 + [(100 + i, f"alone {i}" + " w" * (i % 7), "ab"[i % 2]) for i in range(260)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("piece", [4, 40, 1000])
def test_mixing_of_repeated_rows(spark, piece):
    docs = repeated_rows(spark)
    made = mixing.mix(docs, piece=piece).drop("source", "by_source").withColumn("target", F.round("target", 4))
    assert spark_rows(made) == duck(mixing.ORACLE, SMALL, documents=docs.toArrow())


@pytest.mark.parametrize("piece", [4, 40, 1000])
def test_running_total_of_repeated_rows(spark, piece):
    docs = mixing.sizes(repeated_rows(spark)).select("source", "key", "size")
    made = running_total(docs, ["source"], ["key", "size"], "size", "before", prefix_length(docs.count(), piece), piece)
    assert made.columns == ["source", "key", "size", "before"]
    groups, want = defaultdict(list), []
    for r in docs.collect():
        groups[r["source"]].append((r["key"], r["size"]))
    for source, rows in groups.items():
        before = 0
        for key, size in sorted(rows):
            want.append((source, key, size, before))
            before += size
    assert Counter(map(tuple, made.collect())) == Counter(want)


@pytest.mark.parametrize("piece", [4, 1000])
def test_shards_of_repeated_rows(spark, piece):
    docs = repeated_rows(spark)
    made = sharding.balanced_shards(docs, 8, piece=piece).collect()
    slots = defaultdict(list)
    for r in made:
        slots[r["shard"]].append(r["slot"])
    assert [sorted(slots[s]) for s in range(8)] == [list(range(100))] * 8
    assert Counter(r["doc_id"] for r in made) == Counter(r["doc_id"] for r in docs.collect())
    assert len({r["shard"] for r in made if r["doc_id"] == 7}) == 3  # 300 rows, 100 a shard


def least_cuts(groups, want):
    """Fewest further shards that groups of these sizes need, over all layouts into shards of these sizes."""
    best = {tuple(sorted(want)): 0}
    for n in groups:
        after = {}
        for free, cuts in best.items():
            for parts in itertools.product(*(range(min(n, f) + 1) for f in free)):
                if sum(parts) == n:
                    left = tuple(sorted(f - p for f, p in zip(free, parts, strict=True)))
                    after[left] = min(after.get(left, math.inf), cuts + sum(p > 0 for p in parts) - 1)
        best = after
    return min(best.values())


@pytest.mark.parametrize("sizes, shards", [((2, 2, 2), 2), ((3, 3, 2), 2), ((4, 4, 4), 3), ((5, 2, 2), 3), ((7, 3), 3), ((2,) * 6, 4)])
def test_shards_against_every_layout(spark, sizes, shards):
    alone = 6
    total = sum(sizes) + alone
    want = [total // shards + (s < total % shards) for s in range(shards)]
    best = least_cuts(sizes, want)
    found = spread(spark, [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(alone)], shards)
    cuts = sum(found.values()) - len(found)
    assert cuts == best
