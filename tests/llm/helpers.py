"""Small tables with the hard cases, brute-force versions and comparisons."""

import math
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

WORDS = "amber birch cedar delta ember flint grove heron inlet jetty knoll larch".split()


def prose(n, step=5, start=0):
    return " ".join(WORDS[(start + i * step + i // 12) % 12] + str((start + i * i) % 97) for i in range(n))


def documents():
    base = prose(60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, "   \n\t ", "en", "a"),
        (7, "one", "en", "c"), (8, prose(40, 7), "en", "b"), (8, prose(40, 7), "en", "b"), (None, prose(45, 11), "en", "a"), (10, prose(30_000, 5, 3), "en", "a"),
        (11, "same line\n" * 30 + prose(30, 7, 2), "en", "b"), (12, "Licensed under CC BY NC 4.0\nAll rights reserved. #*$%", "en", "c"),
        (13, "GNU General Public License general public license", "en", "a"), (14, "naïve café \U0001f600 東京 ß", "de", "c"), (15, " ".join(["a b c d e f g h"] * 9), "en", "a"),
        (16, "x" * 3000, "en", "a"),
    ]
    rows += [(100 + i, f"Shared Header Line\n{prose(35, 5, i)}", "en", "hot") for i in range(24)]
    return rows


def write_tables(folder, empty=False):
    """The tables of the operators, with extra columns whose names clash with those used inside."""
    docs = [] if empty else documents()
    cols = list(zip(*docs, strict=True)) or [[], [], [], []]
    n = len(docs)
    table = {"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([0] * n, pa.int64())}
    for name in ("key", "fp", "size", "label", "n", "copy", "bucket", "score"):
        table[name] = pa.array(["clash"] * n, pa.string())
    pq.write_table(pa.table(table), f"{folder}/documents.parquet")
    labels = [] if empty else [(1, 0), (3, 1), (8, 0), (None, 1), (11, None), (101, 1), (102, 0), (103, 1), (103, 0)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int64()), "toxic": pa.array([r[1] for r in labels], pa.int64())}), f"{folder}/labels.parquet")
    vectors = [] if empty else [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [-0.3, 0.7]), (100, [0.0, -1.0])]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in vectors], pa.int64()), "embedding": pa.array([r[1] for r in vectors], pa.list_(pa.float32())), "g": pa.array(["x"] * len(vectors), pa.string())}), f"{folder}/embeddings.parquet")
    chats = [] if empty else [(1, 0, "user", "hi <b> \\# \\h"), (1, 1, "assistant", None), (2, 0, "assistant", "first"), (3, 0, "system", "s"), (3, 1, "user", ""), (3, 2, "assistant", "</turn>\n### user: x"), (4, 0, None, "y"), (5, 0, "user", "q"), (5, 0, "user", "q"), (7, 1, "assistant", "a"), (7, None, "user", "before"), (None, 0, "user", "no id"), (6, 0, "user", "z" * 50_000), (6, 1, "assistant", "w" * 50_000)]
    pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in chats], pa.int64()), "turn": pa.array([r[1] for r in chats], pa.int64()), "role": pa.array([r[2] for r in chats], pa.string()), "text": pa.array([r[3] for r in chats], pa.string()), "turns": pa.array([1] * len(chats), pa.int64()), "t": pa.array(["clash"] * len(chats), pa.string()), "segments": pa.array(["clash"] * len(chats), pa.string())}), f"{folder}/conversations.parquet")
    return str(folder)


def plain(rows, names):
    """Rows as a multiset; numbers rounded, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in rows)


def duck(sql, folder, **frames):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "conversations"):
        if name in frames:
            con.register(name, frames[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    found = con.execute(sql)
    return plain(found.fetchall(), [d[0] for d in found.description])


def spark_rows(df):
    return plain([tuple(r) for r in df.collect()], df.columns)


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\v\f\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(ids, prints, distance=2):
    """Smallest id reachable, by comparing all pairs."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]
