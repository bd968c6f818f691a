"""Periodic runs, chat formatting and whitening: brute force, round trips, SQL, templates of all kinds, awkward rows."""

import hashlib
import os
import random
from zlib import crc32

import duckdb
import numpy as np
import pytest

from statspark.llm import chat, queries, runs, whitening

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ------------------------------------------------------------


def all_runs(w, least=12):
    """Every maximal stretch by trying all periods and starts; the smallest period of a stretch counts."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, q, length) for (s, length), q in out.items())


def collapsed(w, found):
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w + w if rng.random() < 0.3 else w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_solve(least):
    rng = random.Random(least)
    for _ in range(150):
        parts = [periodic(rng, rng.randint(0, 90), rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(1, 6))]
        found = [{} for _ in parts]
        for k, q, s, m in zip(*runs.solve([np.array(p, np.int64) for p in parts], 1, 1 << 10, least)):
            old = found[k].get((int(s), int(m + q - s)), q)
            found[k][int(s), int(m + q - s)] = int(min(old, q))
        assert [sorted((s, q, n) for (s, n), q in f.items()) for f in found] == [all_runs(p, least) for p in parts]


def test_settled_by_words(monkeypatch):
    """Equal hashes of different blocks do no harm."""
    monkeypatch.setattr(runs, "_PRIME", 13)
    monkeypatch.setattr(runs, "_powers", np.ones(1, np.int64))
    monkeypatch.setattr(runs, "_inverse", np.ones(1, np.int64))
    rng = random.Random(3)
    for _ in range(40):
        w = periodic(rng, 70, 3)
        found = {}
        for _k, q, s, m in zip(*runs.solve([np.array(w, np.int64)], 1, 1 << 8)):
            found[int(s), int(m + q - s)] = min(int(q), found.get((int(s), int(m + q - s)), 1 << 30))
        assert sorted((s, q, n) for (s, n), q in found.items()) == all_runs(w)


def run_texts():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "a b " * 6 + "a", "x\x0b\x0cy é\u00a0z " * 7, "q " * 400 + "r " * 400]
    texts += [" ".join(map(str, periodic(rng, rng.randint(0, 200), 4))) for _ in range(40)]
    return texts


def by_hand(text):
    w = [x.decode() for x in (text or "").encode().split()]
    found = all_runs(w)
    return len(w), found, collapsed(w, found)


@pytest.mark.parametrize("tile", [8192, 64])
def test_find_runs(spark, monkeypatch, tile):
    """Also with short tiles, so that runs are cut and stitched; nulls, repeated rows and keys, clashing columns."""
    texts = run_texts()
    rows = [(i if i % 7 else None, t, 1, "s", 2.0) for i, t in enumerate(texts)] + [(1, "", 1, "s", 2.0), (5, texts[5], 1, "s", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, runs string, codes double")
    monkeypatch.setattr(runs, "TILE", tile)
    monkeypatch.setattr(runs, "_BASE", tile // 4)
    want = sorted(((r[0] if r[0] is not None else -1, *by_hand(r[1])) for r in rows), key=str)
    # the functions travel by value, so the executors' module has the usual sizes: solve the tiles here as well
    got = runs.find_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [(x["start"], x["period"], x["length"]) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    assert sorted(found, key=str) == want
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_tiles_cover(spark, monkeypatch):
    """Pieces from overlapping tiles, stitched, are the runs of the whole."""
    monkeypatch.setattr(runs, "TILE", 64)
    monkeypatch.setattr(runs, "_BASE", 16)
    rng, pieces, want = random.Random(8), [], {}
    for row in range(60):
        w = np.array(periodic(rng, rng.randint(60, 500), rng.choice([1, 2, 40])), np.int64)
        want[row] = all_runs(w.tolist())
        for lo, hi, start, stop in runs.tiles(len(w)):
            _, q, s, m = runs.solve([w[start:stop]], lo, hi)
            pieces += [(row, *map(int, x)) for x in zip(q, s + start, m + start)]
    got = {row: [] for row in want}
    for r in runs.stitch(spark.createDataFrame(pieces, "row long, q long, s long, m long")).collect():
        got[r["row"]].append((r["start"], r["period"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_long_texts(spark):
    """Texts over one tile: a long period, a short one that crosses tiles, and none."""
    rng = random.Random(2)
    unlike = [str(rng.random()) for _ in range(30_000)]
    texts = [" ".join(unlike), " ".join(unlike[:9000] * 3), " ".join(unlike[:100] + ["a", "b", "c"] * 6000 + unlike[100:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(docs, texts=False).collect()}
    assert [[tuple(x) for x in got[i]["runs"]] for i in range(3)] == [[], [(0, 9000, 27_000)], [(100, 3, 18_000)]]
    assert got[1]["collapsed_sha256"] == sha(" ".join(unlike[:9000]))
    assert got[2]["collapsed_sha256"] == sha(" ".join(unlike[:100] + ["a", "b", "c"] + unlike[100:]))


def contract_runs(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    head = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return len(found), *head, sha("".join(f"{s},{length},{q}\n" for s, q, length in found)), sha(collapsed(w, found))


@needs_tables
def test_runs_query(spark):
    want = {i: contract_runs(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' where length(text) < 6000").fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_runs(spark, FOLDER).collect()}
    assert len(want) > 100 and {i: got[i] for i in want} == want and any(v[0] for v in want.values())


# --- chat formatting ----------------------------------------------------------

ODD = ["", "</s>", "\\</s>", "\\\\[INST]", "[INST] ok [/INST]</s>", "a\\", "[ROLE][SAYS]", "\n", " é日 ", "[ANS", "]</s", "<s>\\n"]


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "[SAYS]"]), "".join(rng.choice(ODD + ["[", "\\", " "]) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        assert chat.parse(chat.render(turns)) == turns


def spans_text(turns, template):
    out = chat.format_turns(turns, template)
    return out, [template.unescape(out.text[s[2] : s[3]]) for s in out.spans]


def test_spans_of_templates():
    turns = [("system", "be kind"), ("user", "hi a"), ("assistant", "ab</s>"), ("user", "a"), ("assistant", "")]
    same = str
    opening = lambda t: "<bos>" + "".join(f"{r}: {x}\n" for r, x in t)
    closing = lambda t: opening(t) + "<eos>"
    rewriting = lambda t: "".join(f"{r}: {x if k > len(t) - 2 else x[:2]}\n" for k, (r, x) in enumerate(t))
    for render, unescape, local in ((chat.render, chat.unescape, True), (chat.render, chat.unescape, False), (opening, same, False), (closing, same, False)):
        out, texts = spans_text(turns, chat.Template(render, unescape, local))
        assert out.text == render(turns) and texts == [x for _, x in turns] and out.rewrites_at is None and not out.altered
        assert all(a[1] <= b[0] for a, b in zip(out.spans, out.spans[1:]))
    out = chat.format_turns(turns, chat.Template(rewriting, same, False))
    assert out.rewrites_at == 1 and not out.spans and out.text == rewriting(turns)
    stripped = chat.Template(lambda t: "".join(f"{r}: {x.strip()}\n" for r, x in t), same, False)
    assert chat.format_turns([("user", " a ")], stripped).altered == 1
    with pytest.raises(ValueError):
        chat.format_turns(turns, chat.Template(opening, same, True))


CHAT = "conv_id long, turn long, role string, text string, block string, conv string, spans long"


def chat_rows():
    rng, rows = random.Random(4), []
    for conv in (None, 1, 2, 3):
        for k in range({None: 70, 1: 1, 2: 150, 3: 9}[conv]):
            rows.append((conv, k, ["user", "assistant"][k % 2], rng.choice(ODD) + str(k), "b", "c", 1))
    rows += [(3, 4, None, None, None, None, None)] + [(3, 5, "assistant", "again", None, None, None)] * 70
    return rows


@pytest.mark.parametrize("local", [True, False])
def test_conversations(spark, tmp_path, local):
    """Long ones in blocks, null ids, roles and texts, repeated rows, columns whose names the operator uses."""
    rows = chat_rows()
    frame = spark.createDataFrame(rows, CHAT)
    template = chat.Template(local=local)
    chat.write_conversations(frame, str(tmp_path / "out"), template)
    got = {r["conv_id"]: r for r in chat.read_conversations(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {None, 1, 2, 3}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        whole = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said), len(chat.render(turns)), False, 0)
        assert tuple(r)[1:] == whole
    chat.write_conversations(frame.limit(0), str(tmp_path / "none"), template)
    assert chat.read_conversations(spark, str(tmp_path / "none")).count() == 0


def test_rows_without_turn(spark, tmp_path):
    rows = [(1, None, "user", f"t{i}") for i in range(50)] + [(1, 0, "assistant", "last")]
    chat.write_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), str(tmp_path / "x"))
    r = chat.read_conversations(spark, str(tmp_path / "x")).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (51, 4, sha("last"))


@needs_tables
def test_chat_query(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    cur = con.execute(queries.SQL["op12_chat"])
    names = [d[0] for d in cur.description]
    want = {r[0]: dict(zip(names, r)) for r in cur.fetchall()}
    assert {r["conv_id"]: r.asDict() for r in queries.op12_chat(spark, FOLDER).collect()} == want and -1 in want


# --- whitening ----------------------------------------------------------------


def whiten_by_hand(vectors):
    """Covariance of the distinct vectors with exact integers, then numpy."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = [[n * a - s for a, s in zip(v, sums)] for v in fit]
    cov = np.array([[sum(v[i] * v[j] for v in d) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    values, axes = np.linalg.eigh(cov)
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    return n, deviation, values[::-1], centred @ axes[:, ::-1]


def check_whitened(got, vectors, k=16):
    n, deviation, values, projected = whiten_by_hand(vectors)
    k = min(k, len(values))
    assert len(got) == len(vectors) * k
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12
        assert abs(abs(r["whitened"]) - abs(projected[i, c]) / values[c] ** 0.5) < 1e-6


def test_exact_squares():
    rng = np.random.default_rng(1)
    for high in (10, 1 << 30, 1 << 45, 1 << 60):
        t = rng.integers(-high, high, (40, 7))
        assert whitening.exact_squares(t) == [sum(int(v) ** 2 for v in c) for c in t.T]
    assert whitening.exact_squares(np.zeros((0, 3), np.int64)) == [0, 0, 0]


def test_whiten(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20))
    vectors = (rng.normal(size=(300, 20)) @ mix * 3).astype(np.float32).tolist()
    vectors += vectors[:50]  # copies count once in the fit
    bad = [None, [], [1.0] * 19, [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [0.0] * 19 + [float("-inf")]]
    rows = [(i, v, 7, "x") for i, v in enumerate(vectors)] + [(1000 + i, v, 7, "x") for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, id string")
    check_whitened(whitening.whiten(frame).collect(), vectors)
    nulls = whitening.whiten(frame.selectExpr("cast(null as long) AS vec_id", "embedding")).collect()
    assert len(nulls) == 350 * 16 and all(r["vec_id"] is None for r in nulls)


def test_whiten_awkward(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], kind)).collect()  # one direction only
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 5.0]), (3, [0.0, 1.0])], kind)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in huge} == {(1, None), (2, None), (3, 65536)} and len(huge) == 6


@needs_tables
def test_whiten_query(spark):
    vectors = dict(duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall())
    assert sorted(vectors) == list(range(len(vectors)))
    check_whitened(queries.op13_whitening(spark, FOLDER).collect(), [vectors[i] for i in range(len(vectors))])
