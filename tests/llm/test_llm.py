"""The text operators: brute force, round trips, held-out accuracy, SQL twins, and awkward rows."""

import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import duckdb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from statspark.llm import decontaminate, html, langid, linededup, linefreq, mixing, queries, simhash, suffix, tokens, toxicity  # noqa: E402
from statspark.llm.common import fold  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k long, id long, h long, t string, host string"
WORDS = "the of river stone light and cloud paper garden house yellow song bread winter silver table music horse".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def awkward(spark, empty=False):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    copy = words(60, 1)
    texts = [None, "", "  \n\t ", "x", copy, copy, words(30_000, 2), "aaaa " * 400, copy + " more", "<|endoftext|> tab\tx  y", "é\n\nñ 日本 语", "l one two\nl two\nl three\nl four\nl one two\nl two\nl three"]
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "src1", "src2"][i % 3], 1, "s", 5, 6, 7, "t", "h") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no key " + copy, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


@pytest.fixture(scope="module", params=[False, True], ids=["rows", "empty"])
def docs(request, spark):
    return awkward(spark, request.param).cache()


def keyed(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_tokens_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 255, 256, 257, 3000):
        for high in (1, 2, 16, 300, 50_000, 1 << 40):
            ids = rng.integers(0, high, n).astype(np.uint64)
            if n > 10:
                ids[3], ids[7] = 1 << 63, (1 << 60) - 1
            data = tokens.pack_shard(np.arange(2), np.array([n // 2, n - n // 2]), ids)
            assert (tokens.decode_shard(data)[2] == ids).all() and len(data) % 8 == 0
            if n:
                blocks = [tokens.decode_block(data, k) for k in range(len(tokens.open_shard(data)["offsets"]))]
                assert (np.concatenate(blocks) == ids).all()


def test_pieces_equal_whole_texts():
    enc = tokens.PieceEncoder(queries.tokenizer_path(), cap=500)
    r = random.Random(3)
    texts = ["", "a", " a", "a ", "a  b", "a\n\nb", "\n", "foo.\nBar's 's x", "x<|endoftext|> y", "a\0b", "don't 've.", "1²a. b_c. x²!", "日本 語。 x", "a\x1cb c\x1c d"]
    texts += ["".join(r.choice("ab .\n'1,é\t　") for _ in range(r.randint(0, 12))) for _ in range(1500)]
    for lo in range(0, len(texts), 97):
        part = texts[lo : lo + 97]
        ids, sizes = enc.encode(part)
        cuts = np.cumsum(sizes) - sizes
        for t, a, n in zip(part, cuts, sizes):
            assert ids[a : a + n].tolist() == enc._tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    path = tokens.write_tokens(docs, str(tmp_path / "t"), queries.tokenizer_path(), shard_ids=100, parts=3)
    got = tokens.read_tokens(spark, path, keep_ids=True).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert len(got) == len(want)
    start = 0
    for g, (key, text) in zip(got, want):
        ids = tk.encode(text, add_special_tokens=False).ids + [2]
        assert (g["doc_id"], g["start"], g["n_tokens"], list(g["ids"])) == (key, start, len(ids), ids)
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows):
        b = text.encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[key] = (len(b), sum(covered), sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk,crowd", [(1 << 20, 32), (700, 1)])
def test_repeated_strings(spark, monkeypatch, chunk, crowd):
    monkeypatch.setattr(suffix, "_CHUNK", chunk)
    monkeypatch.setattr(suffix, "_CROWD", crowd)
    r = random.Random(9)
    shared, hot = words(120, 5), words(25, 6)
    rows = []
    for i in range(120):
        cut = r.randint(0, 400)
        rows.append((i, words(r.randint(0, 80), 1000 + i) + shared[cut : cut + r.randint(0, 400)] + (" " + hot) * (i % 3) + ("ab" * r.randint(0, 200) if i % 7 == 0 else "")))
    rows += [(200, "z" * 5000), (201, "z" * 99), (202, rows[3][1]), (203, "é" * 300 + "ab" * 90)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_repeats(rows, 100)


def test_repeated_strings_awkward(docs):
    got = suffix.remove_repeats(docs, keep_bytes=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    if got:
        by = {r["doc_id"]: r for r in got}
        assert by[5]["n_removed"] == by[5]["n_bytes"] and by[0]["n_bytes"] == 0 and by[None]["n_removed"] == 0


def brute_print(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_links(spark):
    for t in (None, "", "A b", "One two  three\vfour É", words(50, 3)):
        assert simhash.fingerprint(t) == brute_print(t)
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()["h"]
    assert simhash.fingerprint("ONE two Three") == spark_hash % (1 << 64)
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        prints.append(r.choice(prints) ^ (1 << r.randrange(64)) ^ (r.getrandbits(1) << r.randrange(64)))
    prints = list(dict.fromkeys(prints))
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    for limit in (2000, 1):  # the second deals every shared shard again
        comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, max_shard=limit)).collect()}
        assert [comp.get(i, i) for i in range(len(prints))] == group


def test_near_duplicates_awkward(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    if got:
        by = {r["doc_id"]: r for r in got}
        assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0 and by[5]["component_id"] == 4
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and 5 not in kept


def test_keep_one_of_each_component(spark):
    a, b, c, d = (words(60, 300 + k) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (2, c), (3, None), (4, ""), (None, " "), (None, d)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # every text is a component; keys come before null keys
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got)) == sorted([(0, a), (0, b), (1, c), (1, d), (3, "")])
    by = {simhash.fingerprint(r["text"]) for r in got}
    assert by == {simhash.fingerprint(t) for _, t in rows} and len(by) == len(got)


def brute_coverage(item, doc, min_match):
    a, b = decontaminate.normal_words(item), decontaminate.normal_words(doc)
    min_match = min(min_match, max(1, len(a)))
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                k = 0
                while p + k < len(a) and q + k < len(b) and free_a[p + k] and free_b[q + k] and a[p + k] == b[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, q)
        k, p, q = best
        if k < min_match:
            return covered / len(a) if a else 0.0
        covered += k
        free_a[p : p + k] = [False] * k
        free_b[q : q + k] = [False] * k


def test_tiling(spark, docs):
    items = [(i, words(24, 50 + i)) for i in range(4)] + [(10, "one two"), (11, None), (12, ""), (None, "x")]
    parts = items[0][1].split()
    texts = ["", None, words(50, 99), "pre " + items[0][1] + " post", " ".join(parts[12:] + ["gap"] + parts[:12]), "so one two go", " ".join(parts[:6]) + " " + words(9, 77), " ".join(x for k, x in enumerate(parts) if k % 4 != 3)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): brute_coverage(t, x, 4) for d, x in rows for i, t in items if i is not None and decontaminate.normal_words(t)}
    want = {k: v for k, v in want.items() if v >= 0.6}
    for size in (20_000, 2):
        got = decontaminate.contaminated(frame, bench, block_items=size).collect()
        assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in got} == want
    assert (3, 0) in want and (4, 0) in want and (6, 0) not in want
    clean = [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()]
    assert 11 not in clean and len(clean) == docs.where("doc_id is null or doc_id <> 11").count()
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    # each row by its own text: null and repeated keys, empty texts
    odd = spark.createDataFrame([(None, items[1][1]), (None, "quite clean"), (1, items[2][1]), (1, "clean"), (2, None), (3, "")], "doc_id long, text string")
    for size in (20_000, 2):
        kept = sorted(map(str, decontaminate.decontaminate(odd, bench, block_items=size).collect()))
        assert kept == sorted(map(str, odd.where("text is null or text in ('quite clean', 'clean', '')").collect()))


def test_tiling_of_repeated_words():
    r = random.Random(8)
    for k in (1, 2, 3, 5):
        for _ in range(25):
            item, doc = (" ".join(r.choice("abcde"[:k]) for _ in range(r.randint(1, n))) for n in (14, 24))
            got = decontaminate.Seeds([(7, item.split())], 4).matches(doc, 0.6)
            want = brute_coverage(item, doc, 4)
            assert [m[:2] for m in got] == ([(7, want)] if want >= 0.6 else [])


def test_tiling_work_is_bounded():
    """A run shared by 20,000 items is never tiled where it can't reach the coverage; a text of one word is a few passes."""
    items = [(i, [f"u{i}x{j}" for j in range(20)] + "one common run here".split()) for i in range(20_000)]
    seeds = decontaminate.Seeds(items, 4)
    start = time.time()
    assert seeds.matches("say one common run here now", 0.6) == []
    assert [m[0] for m in seeds.matches(" ".join(items[5][1]), 0.6)] == [5]
    same = decontaminate.Seeds([(1, ["x"] * 200)], 4)
    assert same.matches("x " * 20_000, 0.6) == [(1, 1.0, 1, 200)]
    assert time.time() - start < 5


def test_blocks_are_cut_by_words(spark, monkeypatch):
    bench = spark.createDataFrame([(i, words(400 if i == 3 else 8, i)) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, words(400 if i == 3 else 8, i)) for i in range(0, 30, 3)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 4, 10))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _, _ in b.value.items) == list(range(30))
    got = decontaminate.contaminated(docs, bench, block_items=10).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(0, 30, 3)]


def run_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.SQL[name]).fetchall()
    cols = [d[0] for d in con.description]
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))), sorted(map(repr, want))


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    got, want = run_twin(spark, name)
    assert got == want


def test_lines_awkward(spark, docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "n_spans"] and out.count() == docs.count()
    if docs.count():
        r = keyed(out)
        assert r[11]["text"] == "l one two\nl two\nl three\nl four" and (r[11]["n_lines"], r[11]["n_removed"], r[11]["n_spans"]) == (7, 3, 1)
        assert r[0]["text"] is None and r[1]["text"] == ""


def test_quality_awkward(spark, docs):
    out = linefreq.quality(docs, min_docs=1, min_share=0.0)
    assert out.count() == docs.count()
    if docs.count():
        r = keyed(out)
        assert r[0]["base_failed"] and r[7]["n_repeat_words"] == 400 and r[7]["base_failed"] and r[6]["kept"]
        assert r[11]["n_dup_lines"] == 3 and r[11]["n_repeat_words"] == 14


def test_frequent_lines_removed(spark, docs):
    rows = [(i, f"{words(12, i)}\n\nPage {i % 8} OF  9\n{words(12, i + 50)}", "a" if i < 8 else None) for i in range(16)]
    rows += [(0, "Page 7 of 9\npage 1 of 9", "a"), (20, "page 3 of 9\nelse", "b"), (21, None, "a"), (22, "  \n", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["source"], r["text"], r["removed_chars"]) for r in linefreq.remove_frequent(frame, min_docs=3, min_share=0.1).collect()}
    want = {(i, f"{words(12, i)}\n\n{words(12, i + 50)}", s, len("Page1OF9")) for i, _, s in rows[:16]}
    want |= {(0, "", "a", 16), (20, "page 3 of 9\nelse", "b", 0), (21, None, "a", 0), (22, "  \n", "a", 0)}
    assert got == {(i, s, x, n) for i, x, s, n in want}
    out = linefreq.quality(frame, min_docs=3, min_share=0.1, with_text=True).collect()
    assert {(r["doc_id"], r["text"], r["removed_chars"]) for r in out} == {(i, x, n) for i, x, _, n in want} and len(out) == len(rows)
    assert linefreq.remove_frequent(docs, min_docs=1, min_share=0.0).count() == docs.count()


def test_mix(spark, docs):
    d = docs.withColumn("domain", F.lit(None).cast("string"))
    plan = mixing.plan_mix(d, budget_share=0.5, max_epochs=2)
    nameless = d.where("doc_id is null").select(F.coalesce("text", F.lit(""))).distinct().count()
    assert plan.count() == d.where("doc_id is not null").select("doc_id").distinct().count() + nameless
    mixed = mixing.mix(d, budget_share=0.5)
    assert mixed.columns == d.columns
    rows = [(i, "a" if i < 4 else "b", "x" if i % 2 else "y", f"s{i % 3}", "w " * (5 + i)) for i in range(40)]
    small = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, text string")
    got = mixing.plan_mix(small, weights={("a",): 3.0}, budget_share=0.5, max_epochs=2).collect()
    total = sum(len(r[4].split()) for r in rows)
    own = sum(r["tokens_taken"] for r in got if r["domain"] == "a")
    assert own == 2 * sum(len(r[4].split()) for r in rows if r[1] == "a")  # short of its share: all it has, twice
    assert total // 2 - 6 <= sum(r["tokens_taken"] for r in got) <= total // 2  # the rest went to the other domain


def test_mix_without_keys(spark):
    rows = [(None, "a b c"), (None, words(100, 1)), (None, words(100, 1)), (None, None), (4, "d e"), (4, "d e"), (5, "")]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, domain string, lang string, source string")
    plan = mixing.plan_mix(frame, budget_share=1.0, max_epochs=1).collect()
    got = sorted((r["doc_id"] or 0, r["tokens"], r["copies"], r["tokens_taken"]) for r in plan)
    assert got == [(0, 0, 1, 0), (0, 3, 1, 3), (0, 100, 1, 100), (4, 2, 1, 2), (5, 0, 1, 0)]
    assert sorted(map(str, mixing.mix(frame, budget_share=1.0, max_epochs=1).collect())) == sorted(map(str, frame.collect()))
    half = mixing.plan_mix(frame, budget_share=0.5, max_epochs=1).collect()
    assert sum(r["tokens_taken"] for r in half) == 52


def test_language(spark, docs):
    r = random.Random(1)
    syllables = {"en": "th er on ing", "de": "sch ung en ich", "fr": "eau oi re le"}
    rows = [(i, " ".join("".join(r.choice(syllables[v].split()) for _ in range(3)) for _ in range(r.randint(5, 60))), v) for i in range(300) for v in [list(syllables)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language_model(table.where(fold("doc_id") != 0), quota=60)
    out = langid.identify_language(table, model).where(fold("doc_id") == 0).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) >= 0.97 * len(out)
    got = langid.identify_language(docs, model)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    if docs.count():
        by = keyed(got)
        assert by[0]["lang_pred"] == "und" and by[0]["rejected"] and by[2]["score"] == 0.0 and by[6]["lang_pred"] in syllables
    none = langid.train_language_model(table.limit(0))
    assert {x["lang_pred"] for x in langid.identify_language(table.limit(5), none).collect()} == {"und"}
    text = langid._normalise("thering " * 400_000)  # cut into overlapping pieces
    cut = langid._sums([text], model.table, model.bits)[1][0]
    whole = sum(int(ok.sum()) for _, ok in langid._buckets(np.frombuffer(b" " + text + b"    ", np.uint8), model.bits))
    assert cut == whole


def test_language_sums_against_brute_force():
    """Every window of three and four bytes one by one, over texts that are joined or cut."""
    r = np.random.default_rng(4)
    bits = 9
    table = np.vstack([r.normal(size=(1 << bits, 3)), np.zeros((1, 3))]).astype(np.float32)
    texts = ["", " ", "a", "ab cd", "Häuser über 12 Straßen", "x" * 50, "日本語 text", "  two   words  ", *(words(30, i) for i in range(20))]
    total, count = langid._sums([langid._normalise(t) for t in texts], table, bits)
    for t, got, n in zip(texts, total, count):
        b = b" " + langid._normalise(t) + b"    "
        found = []
        for x, y, z, w in zip(b, b[1:], b[2:], b[3:]):
            three = x | y << 8 | z << 16
            if y != 32 and (x != 32 or z != 32):
                found.append((three * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits))
            if y != 32 and z != 32:
                four = three | w << 24
                found.append(((four ^ four >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits))
        assert n == len(found) and got == pytest.approx(table[found].sum(axis=0, dtype=np.float64) if found else np.zeros(3), abs=1e-5)


def test_only_letters_make_a_language():
    assert not any(map(langid._has_letter, ["", "12 ½ ²", "_ ٣ Ⅷ", "!?"]))
    assert all(map(langid._has_letter, ["½ a", "é", "日", "1²b"]))


def test_toxicity_features_against_brute_force():
    """Words one by one, every pair of a lexicon and a second-person word, every window of 25 words."""
    stems = {0: frozenset(["crumb"]), 4: frozenset(["zark"])}
    pool = ["you", "Your", "idiot", "IDIOT!", "1d1ot", "f.o.o.l", "st*pid", "zarkblob", "crumb", "crumbs", "don't", "ab1cd", "a-b", "x", "OK", "plain", "word", "12", "?!", "é", "$hit", "..."]
    r = random.Random(3)
    symbols = "#*$%&|<>", ".,;:'\"()"
    for size in [0, 1, 2, 5, 30, 400]:
        for share in (2, 9):
            ws = [r.choice(pool) if r.randint(0, share) == 0 else "plain" for _ in range(size)]
            text = " ".join(ws)
            hit, listed, stem, you, mixed, hidden, caps = [], 0, 0, [], 0, 0, 0
            for i, word in enumerate(ws):
                while word and not (word[0].isalnum() or word[0] in "_@$*"):
                    word = word[1:]
                while word and not (word[-1].isalnum() or word[-1] in "_@$*"):
                    word = word[:-1]
                low = word.lower()
                odd = any(c.isalpha() for c in low) and not low.isalpha()
                mended = "".join((toxicity.MENDED.get(ord(c), c) or "") if ord(c) in toxicity.MENDED else c for c in low)
                is_hidden = odd and mended != low and mended in toxicity.LEXICON
                is_stem = low == "crumb" or low.startswith("zark")
                listed += low in toxicity.LEXICON or is_hidden
                stem += is_stem
                hidden += is_hidden
                mixed += odd and not all(c.isalpha() for c in low[1:-1]) and "'" not in low and "-" not in low
                caps += len(word) > 1 and word.isupper()
                if low in toxicity.LEXICON or is_hidden or is_stem:
                    hit.append(i)
                if low in toxicity.SECOND_PERSON:
                    you.append(i)
            near = sum(any(abs(i - j) <= 5 for j in you) for i in hit)
            dense = max((sum(i <= j < i + 25 for j in hit) for i in hit), default=0)
            raw = text.encode()
            upper = sum(65 <= c <= 90 for c in raw)
            letters = max(1, upper + sum(97 <= c <= 122 for c in raw))
            chars = [sum(text.count(c) for c in group) / max(1, len(raw)) for group in ("!", "?", *symbols)]
            n = max(1, size)
            want = [math.log1p(size), listed / n, stem / n, len(hit) / n, math.log1p(len(hit)), near / n, len(you) / n, upper / letters, caps / n, *chars, mixed / n, hidden / n, dense / 25]
            assert toxicity.features_of(text, toxicity._Codes(stems)) == pytest.approx(want if size else [0.0] * len(want))


def test_toxicity(spark, docs):
    rows = [(i, words(40, i) + (" you zarkblob" + str(i % 3) + "oid idiot " if i % 4 == 0 else " ") + words(10, -i), int(i % 4 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity_model(table, table, trees=5)
    out = toxicity.score_toxicity(table.drop("toxic"), model).join(table.select("doc_id", "toxic"), "doc_id").where(fold("doc_id") == 0).collect()
    assert sum(x["predicted"] == x["toxic"] for x in out) >= 0.95 * len(out) and all(0 <= x["score"] <= 1 for x in out)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == docs.count() and got.where("score is null").count() == 0
    twice = table.unionByName(table.withColumn("toxic", F.lit(0)))  # a second, lower label changes nothing
    again = toxicity.train_toxicity_model(table, twice, trees=5)
    assert sorted(map(tuple, toxicity.score_toxicity(table, again).collect())) == sorted(map(tuple, toxicity.score_toxicity(table, model).collect()))
    none = toxicity.train_toxicity_model(table, table.limit(0))
    assert {x["score"] for x in toxicity.score_toxicity(table.limit(3), none).collect()} == {0.0}


PAGE = (
    "<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>if(a<b)x='</p>'</script></head><body><header><h1>Site</h1></header>"
    "<div class='side-bar'><p>s{0}</p></div><div id=cookie-notice>c</div><div><div>Fixed line of the host</div><article><h1>A &amp; {0}</h1><p>One <b>two</b><br>"
    "three {0}<p>Four &lt;{0}<!-- x --><form><p>f</p></form><ul><li>a{0}<li>b</ul><p>Read more on this site</p><div class='comments'><p>nice</p></div></article></div>"
    "<p>out {0}</p><footer>f</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, "http://H.example/x", PAGE.format(i)) for i in range(12)] + [(20, None, None), (21, "http://b.example", ""), (22, "bad url", "plain &amp; text"), (23, "http://b.example/2", "<p>only<div>x</div>")]
    rows.append(rows[0])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = html.extract_main(frame)
    by = keyed(got, "page_id")
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "html", "host", "text"]
    assert by[3]["text"] == "A & 3\nOne two three 3\nFour <3\na3"  # list item b and the last line stand under every title
    assert (by[20]["text"], by[21]["text"], by[22]["text"], by[23]["text"]) == ("", "", "plain & text", "only\nx")
    assert html.extract_main(frame.limit(0)).count() == 0


LONG = "a long story of {0} that goes on for a while in part {0}"
WRAPPED = [
    "<body class='has-sidebar'><article><p>{x}</article>", "<body><div class='page with-comments'><p>{x}</div>", "<div id=content class=no-ads><p>{x}</div>",
    "<article class='post has-comments'><p>{x}</article>", "<div class='post-header'><p>{x}</div>", "<div class='widget'><div class=social><p>{x}</div></div>",
    "<body class='page sidebar'><main><p>{x}</main>",
]


@pytest.mark.parametrize("body", WRAPPED)
def test_wrapper_names_keep_text(body):
    assert html.main_blocks(body.format(x=LONG.format(1))) == [LONG.format(1)]


def test_names_and_parts():
    story = LONG.format(1)
    for name in ("sidebar", "cookie-notice", "site-footer", "postComments", "nav-menu", "related"):
        assert html.main_blocks(f"<div class='{name}'><p>{LONG.format(2)}</div><div class=text><p>{story}<p>{LONG.format(3)}</div>") == [story, LONG.format(3)]
        assert html.main_blocks(f"<article><p>{story}<div id={name}><p>{LONG.format(2)}</div></article>") == [story]
    assert html.main_blocks(f"<article><div class=post-header><h1>Title</h1></div><p>{story}</article>") == ["Title", story]
    # text that goes on beside the article, with its short heading; a short line alone is none
    page = f"<article><p>{story}</article><div><h2>On</h2><p>{LONG.format(4)}</div><div>3 views</div>"
    assert html.main_blocks(page) == [story, "On", LONG.format(4)]
    # a named list of other articles, and readers' comments that are articles
    other = f"<article><p>{story}</article><div class=related><article><p>{LONG.format(5)}</article></div><article class=comment><p>{LONG.format(6)}</article>"
    assert html.main_blocks(other) == [story]


def test_broken_and_deep_pages(spark):
    """Linear time and no lost text, whatever the markup; deep trees also go through alignment and Spark."""
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000 + "<p>after"
    assert html.main_blocks(deep) == ["deep text", "after"]
    start = time.time()
    for piece, end in (("<a ", ""), ("<a x='", ""), ("<p a=\"", ">t"), ("<!", ""), ("<!--", ""), ("<script>", ""), ("< ", "")):
        html.main_blocks(piece * (1_000_000 // len(piece)) + end)
    assert time.time() - start < 20
    assert html.main_blocks("<p title='a>b'>one<p title=\"x>two</p><p>three") == ["one", "two", "three"]
    assert html.main_blocks("1 < 2 <3> <p>x</p") == ["1 < 2 <3>", "x</p"]
    assert html.main_blocks("<header>site</header><article><header><h1>Title</h1></header><p>t <math><mi>z</mi></math></p><footer>f</footer></article>") == ["Title", "t z"]
    assert html.main_blocks("<nav>" + "<div>" * 300 + "<p>menu</p>" + "</div>" * 300 + "</nav><p>text") == ["text"]
    skeleton = html.skeleton(html.parse(deep)[0])
    assert html.merge(skeleton, html.skeleton(html.parse(deep + "<ul><li>x")[0]))[0] == "#"
    rows = [(i, f"http://deep.example/{i}", deep + f" {i}") for i in range(6)]
    got = html.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"after {i}" for i in range(6)}


def test_links_through_null_keys(spark):
    prints = {1: 0x1, None: 0x7, 2: 0x1F}
    shown = dict(zip(prints, ("one", "none", "two")))
    real = simhash.add_fingerprint
    by_text = {v: prints[k] for k, v in shown.items()}
    try:
        simhash.add_fingerprint = lambda docs, text="text", shingle=3, name="fp": docs.withColumn(name, F.coalesce(*[F.when(F.col(text) == t, F.lit(p).cast("long")) for t, p in by_text.items()]))
        got = simhash.near_duplicates(spark.createDataFrame(list(shown.items()), "doc_id long, text string")).collect()
    finally:
        simhash.add_fingerprint = real
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (2, 1)}


def test_template_without_titles(spark):
    page = "{t}<div><ul><li>Home<li>News</ul><p>All about {0} today, part {0}</p><p>Printed by the host</p></div>"
    title = {"none": "", "one": "<title>Site</title>", "own": "<title>T{0}</title>"}
    rows = [(f"{k}{n}/{i}", f"http://{k}{n}.example/{i}", page.format(i, t=v.format(i))) for k, v in title.items() for n in (2, 3, 40) for i in range(n)]
    rows += [("copy", "http://copies.example/1", page.format(1, t=""))] * 4  # true copies are one page
    got = html.extract_main(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    for r in got:
        i = r["page_id"].split("/")[-1]
        want = f"All about {i} today, part {i}" if i != "copy" else "Home\nNews\nAll about 1 today, part 1\nPrinted by the host"
        assert r["text"] == want, r["page_id"]


def test_tree_matching():
    a, b = ["d", ["p"], ["u", ["l"]], ["q"]], ["d", ["u", ["l"], ["m"]], ["q"], ["z"]]
    assert html._match(a, b)[0] == 4
    both = html.merge(a, b)
    assert both == ["d", ["p"], ["u", ["l"], ["m"]], ["q"], ["z"]]
    assert html.align(both, b) == {(): "", (1,): ".2", (1, 1): ".2.1", (1, 2): ".2.2", (2,): ".3", (3,): ".4"}


@needs_tables
def test_pipeline(spark):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r["doc_id"] for r in out}
    assert out and all(r["n_tokens"] > 0 for r in out)
    leaks = {r["doc_id"] for r in queries.op3_decontaminate(spark, FOLDER).collect()}
    first = {r["component_id"] for r in queries.op10_simhash(spark, FOLDER).collect()}
    assert not ids & leaks and ids <= first


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_awkward(spark, docs, name, stage, tmp_path):
    spark.createDataFrame([(1, words(20, 5))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.count() >= 0
    if name != "token_shards":
        assert out.columns == docs.columns


def test_pieces_with_marks_equal_whole_texts():
    from tokenizers import Tokenizer

    enc, whole = tokens.PieceEncoder(queries.tokenizer_path(), cap=50), Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(8)
    parts = ["ab", "É", "ß9", "²", "٣", "_", ".", ",!", "***", " ", "  ", "\n", "\t", "Ⅷ", "'s", "\u180e", "\u00a0", "日本"]
    for _ in range(30):
        texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(20)]
        ids, sizes = enc.encode(texts)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pieces_met_again_are_kept():
    from tokenizers import Tokenizer

    enc, whole = tokens.PieceEncoder(queries.tokenizer_path(), cap=60, frugal=True), Tokenizer.from_file(queries.tokenizer_path())
    for i in range(60):
        texts = [f"so common x{i}a{k}" for k in range(10)]
        ids, sizes = enc.encode(texts)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(enc._places) <= 60 + 13
    runs = []
    each, enc._each = enc._each, lambda texts: (runs.extend(texts), each(texts))[1]
    for i in range(60):
        enc.encode([f"so common y{i}b{k}" for k in range(10)])
    assert not any("common" in t for t in runs)  # forgetting never asks the tokenizer for it again


def test_token_files_do_not_depend_on_pieces(spark, docs, tmp_path):
    got = []
    for pieces in (3, None):
        path = tokens.write_tokens(docs, str(tmp_path / str(pieces)), queries.tokenizer_path(), parts=2, pieces=pieces)
        got.append(sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"]))
    assert len(got[0]) == docs.count() and got[0] == got[1]
