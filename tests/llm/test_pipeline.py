"""The pipeline against the operators' brute-force versions, stage by stage."""

import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers
import sentencepiece
from helpers import components, documents, prose, simhash, write_tables
from pyspark.sql import functions as F

import corpus_pipeline
from boundlab.llm import toxicity
from boundlab.llm.common import packed, table
from boundlab.llm.registry import ORACLES

GAPS = dict.fromkeys(map(ord, "\t\v\f\r"), " ")


def cleaned(con, rows):
    """Rows that the rules keep, without boilerplate lines, by the SQL's verdicts and an own reading of the limits."""
    plain = lambda line: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in line).translate(GAPS).split(" ")).strip()
    squeezed = lambda line: re.sub(" +", " ", plain(line))
    held, hosts = defaultdict(set), defaultdict(set)
    for doc, text, _, source, _ in rows:
        hosts[source].add((doc, text))
        for line in (text or "").split("\n"):
            if squeezed(line):
                held[source, squeezed(line)].add((doc, text))
    bad = {k for k, docs in held.items() if len(docs) >= 10 and (len(docs) > 0.05 * len(hosts[k[0]]) or len(docs) >= 200)}
    order = con.execute(f"SELECT kept FROM ({ORACLES['op1_quality_rules']}) ORDER BY doc_id").fetchall()  # ids are made unique below
    out = []
    for (doc, text, lang, source, n), (kept,) in zip(rows, order, strict=True):
        if kept:
            text = text and "\n".join(x for x in text.split("\n") if (source, squeezed(x)) not in bad)
            out.append((doc, text, lang, source, n))
    return out


def brute(spark, folder):
    """Rows, not ids, are what the stages decide on; `number` tells them apart here."""
    docs = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]]
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in docs.itertuples(index=False)]
    con = duckdb.connect()
    # only whether a row's id differs from another's counts for the rules; repeated rows stay one document
    number = {}
    alias = [number.setdefault((r[0], r[1], r[3]), len(number)) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: alias[i])
    rows = [rows[i] for i in order]
    con.register("documents", pd.DataFrame([(alias[i], *r[1:]) for i, r in zip(order, rows, strict=True)], columns=docs.columns))
    rows = cleaned(con, rows)
    frame = spark.createDataFrame([(None if r[0] is None else int(r[0]), r[1]) for r in rows], "doc_id long, text string")
    calm = Counter((r["doc_id"], r["text"]) for r in toxicity.toxicity(frame, table(spark, folder, "labels")).where("predicted = 0").collect())
    rows = [r for r in rows if (r[0], r[1]) in calm]
    groups = defaultdict(list)
    for r, c in zip(rows, components(list(range(len(rows))), [simhash(r[1]) for r in rows]), strict=True):
        groups[c].append(r)
    found = Counter()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    least = {c: min((r[0] is None, r[0] or 0) for r in rs) for c, rs in groups.items()}
    # of rows with the smallest id and different texts the stage takes one by hash: read which from the stage itself
    made = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:4], int(r[4])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), folder)
    kept = [tuple(r) for r in made.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert len(kept) == len(groups)
    which = {r: c for c, rs in groups.items() for r in rs}
    assert sorted(which[r] for r in kept) == sorted(groups) and all((r[0] is None, r[0] or 0) == least[which[r]] for r in kept)
    con.register("documents", pd.DataFrame(kept, columns=docs.columns).astype({"doc_id": "Int64"}))
    taken = con.execute(f"SELECT doc_id, taken, size FROM ({ORACLES['op7_source_mixing']})").fetchall()
    by = defaultdict(list)
    for d, t, s in taken:
        by[d, s].append(-(-t // s) if s else 0)
    for r in kept:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        assert len(set(by[r[0], size])) == 1  # rows of one id and size would be told apart by text alone
        if by[r[0], size][0]:
            found[r[0], tuple(library.encode(r[1] or ""))] += by[r[0], size][0]
    return found


def check(spark, folder):
    made = corpus_pipeline.run(spark, folder).collect()
    assert all(r["round_trip"] for r in made)
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in made) == brute(spark, folder)
    return made


def test_pipeline_on_real_rows(spark):
    assert check(spark, "/root/testdata/sf0.001")


def test_pipeline_on_hard_cases(spark, tmp_path):
    folder = write_tables(tmp_path)
    made = check(spark, folder)
    assert made and len({r["doc_id"] for r in made}) < len(documents())


def test_stages_keep_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_null_and_repeated_ids_lose_no_document(spark):
    """Rows without an id, and rows that share one, are documents of their own at every stage."""
    text = lambda k: " ".join(f"w{k}x{i * i % 101}y{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (8, text(4)), (9, text(4)), (None, text(4)), (None, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), {"k": 1}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, more map<string, int>")
    kept = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    good = Counter(r for r in rows if r[1])
    assert kept(corpus_pipeline.quality_stage(spark, docs, "")) == good
    folder = "/root/testdata/sf0.001"  # its labels name none of these rows
    assert kept(corpus_pipeline.toxicity_stage(spark, docs, folder)) == Counter(rows)
    once = Counter({(None, text(0)): 1, (None, text(1)): 1, (7, text(2)): 1, (7, text(3)): 1, (8, text(4)): 1})
    near = corpus_pipeline.near_duplicate_stage(spark, docs.where("text <> ''"), folder)
    assert kept(near) == once and near.columns == docs.columns
    mixed = kept(corpus_pipeline.mixing_stage(spark, docs.where("text <> ''"), folder))
    assert set(mixed) == set(good)  # 1.5 of all words: each document once or twice
    assert all(good[k] <= n <= 2 * good[k] for k, n in mixed.items())


def test_rows_that_differ_in_a_map_are_documents_of_their_own(spark):
    """Maps, maps inside other types and variants tell rows apart; the order of a map's entries doesn't."""
    text = prose(60)
    rows = spark.createDataFrame([(i, text, "en", "a", len(text)) for i in range(6)], "i int, text string, lang string, source string, n_chars long")
    at = lambda *cases: F.get(F.array(*cases), F.col("i"))
    pair = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    docs = rows.select(
        F.lit(7).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars",
        at(pair("a", 1, "b", 9), pair("b", 9, "a", 1), pair("a", 2), F.lit(None), pair("a", 1), pair("a", 1)).alias("tags"),
        at(*(F.array(pair("k", v)) for v in (1, 1, 1, 1, 2, 1))).alias("deep"),
        F.parse_json(at(*(F.lit(x) for x in ("1", "1", "1", "1", "1", "2")))).alias("v"),
    )
    keys = packed(docs).select("k1", "k2").collect()
    assert len(set(keys)) == 5 and keys[0] == keys[1]
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    found = mixed.groupBy(F.array_sort(F.map_entries("tags")).alias("t"), F.to_json(F.struct("deep", "v")).alias("d")).count().collect()
    assert {(str(r["t"]), r["d"]) for r in found} <= {(str(r["t"]), r["d"]) for r in docs.select(F.array_sort(F.map_entries("tags")).alias("t"), F.to_json(F.struct("deep", "v")).alias("d")).collect()}
    assert len(found) == 5
