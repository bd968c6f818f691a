"""The operators over whole tables with production parameters, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.llm import chat, decontaminate, html, langid, linededup, linefreq, mixing, runs, simhash, suffix, tokens, toxicity, whitening
from statspark.llm.common import fold, table, words_native
from statspark.session import scratch_dir

#: Language weights inside a domain and domain weights; what is not named weighs 1.
MIX_WEIGHTS = {("d0",): 2.0, ("d1",): 1.0, ("d2",): 1.0, **{(f"d{k}", "en"): 2.0 for k in range(3)}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17
LINE_DOCS, LINE_SHARE, LINE_LEFT = 10, 0.002, 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources are numbered; a source's domain is its number modulo 3."""
    number = F.regexp_extract(F.col("source"), r"\d+", 0)
    return docs.withColumn("domain", F.concat(F.lit("d"), (F.when(number != "", number).cast("long") % 3).cast("string")))


def op1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return tokens.read_tokens(spark, path)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_domain(table(spark, folder, "documents"))
    return mixing.plan_mix(docs, ("domain", "lang", "source"), MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return linefreq.quality(table(spark, folder, "documents"), min_docs=LINE_DOCS, min_share=LINE_SHARE, min_left=LINE_LEFT)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold("doc_id") != 0)
    model = toxicity.train_toxicity_model(docs, labels)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.train_language_model(docs.where(fold("doc_id") != 0).select("doc_id", "text", "lang"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify_language(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    out = html.extract_main(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def with_period(docs: DataFrame) -> DataFrame:
    """The texts that the run query is about: in a tenth of the documents the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    worded = docs.select("doc_id", "text", h.alias("h"), words_native(F.col("text")).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    turned = F.concat(F.slice("w", 1, a), F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), 1, n - a))
    changed = (F.col("h") % 10 == 0) & (n > 0)
    return worded.select("doc_id", F.when(changed, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(with_period(table(spark, folder, "documents")), texts=False)
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    )
    listed = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = found.select("*", F.try_element_at(longest, F.lit(1)).alias("best"))
    length = -F.col("best.l")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.l div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op12_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    path = scratch_dir(spark, "conversations")
    chat.write_conversations(rows.unionByName(probe), path)
    return chat.read_conversations(spark, path)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_tokens, op2_line_dedup, op3_decontaminate, op4_mix, op5_quality, op6_suffix_dedup, op7_toxicity, op8_language, op9_main_text, op10_simhash,
    op11_runs, op12_chat, op13_whitening,
)}

_WS = r"[ \t\n\x0B\x0C\r]"
_WORD = r"[^ \t\n\x0B\x0C\r]+"

_OP2 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(raw, '^{_WS}+', ''), '{_WS}+$', '') AS x,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM lines WHERE regexp_matches(raw, '{_WORD}')),
windows AS (
  SELECT doc_id, pos, list_value(x, lead(x, 1) OVER win, lead(x, 2) OVER win) AS body, lead(x, 2) OVER win AS third
  FROM worded WINDOW win AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM windows WHERE third IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
marked AS (SELECT w.doc_id, w.i, w.pos, g.pos IS NOT NULL AS gone FROM worded w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos),
spans AS (SELECT doc_id, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans FROM spans GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.i = m.i WHERE NOT coalesce(m.gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       md5(coalesce(k.text, '')) AS kept_md5
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_OP5 = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, body) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM hits),
repeats AS (SELECT doc_id, sum(g) AS n_repeat_words FROM gaps GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, raw,
         trim(regexp_replace(translate(lower(raw), '123456789', '000000000'), '{_WS}+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM base)),
dups AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines WHERE line <> '' GROUP BY doc_id),
frequent AS (
  SELECT f.source, f.line FROM (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT doc_id, source, line FROM lines WHERE line <> '') GROUP BY source, line) f
  JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.n > {LINE_DOCS} AND f.n > {LINE_SHARE} * h.total),
removed AS (
  SELECT doc_id, sum(length(replace(l.line, ' ', ''))) AS gone FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS g
  FROM base b LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (
  SELECT *, least(g, word_chars) AS removed_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       CAST(removed_chars AS BIGINT) AS removed_chars, NOT base_failed AND word_chars - removed_chars >= {LINE_LEFT} * word_chars AS kept
FROM judged
"""


def _sql_weight(path: int) -> str:
    names = ("domain", "lang", "source")[:path]
    cases = [f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(names, key))} THEN {w}" for key, w in MIX_WEIGHTS.items() if len(key) == path]
    return f"CAST(CASE {' '.join(cases)} ELSE 1 END AS DOUBLE)" if cases else "CAST(1 AS DOUBLE)"


def _sql_level(k: int, parent: str) -> str:
    names = ["domain", "lang", "source"][:k]
    cols, up = ", ".join(names), names[:-1]
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    join = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in up) or "true"
    family = f"{part} ORDER BY ratio NULLS FIRST, {', '.join(f'{c} NULLS FIRST' for c in names)}"
    return f"""
n{k} AS (SELECT {cols}, sum(cap) AS cap, {_sql_weight(k)} AS weight FROM caps GROUP BY {cols}),
r{k} AS (SELECT n.*, n.cap / n.weight AS ratio, p.budget AS parent_budget FROM n{k} n JOIN {parent} p ON {join}),
l{k} AS (
  SELECT *, (parent_budget - coalesce(sum(cap) OVER ({family} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER ({family} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{k}),
o{k} AS (
  SELECT *, first(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER ({family} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open
  FROM l{k}),
b{k} AS (SELECT {cols}, CASE WHEN open IS NULL THEN cap ELSE least(cap, greatest(open, 0) * weight) END AS budget FROM o{k})"""


_OP4 = rf"""
WITH small AS (
  SELECT doc_id, 'd' || CAST(CAST(nullif(regexp_extract(source, '\d+'), '') AS BIGINT) % 3 AS VARCHAR) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM small GROUP BY domain, lang, source),
caps AS (SELECT *, CAST(tokens * {MIX_EPOCHS} AS DOUBLE) AS cap FROM leaves),
root AS (SELECT CAST(floor(sum(tokens) * CAST({MIX_SHARE} AS DOUBLE)) AS DOUBLE) AS budget FROM leaves),{_sql_level(1, "root")},{_sql_level(2, "b1")},{_sql_level(3, "b2")},
plan AS (
  SELECT l.*, CAST(floor(b.budget + 0.000001) AS BIGINT) AS budget FROM leaves l JOIN b3 b
  ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
parts AS (SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, {MIX_EPOCHS}) ELSE 0 END AS epochs FROM plan),
rows_ AS (
  SELECT s.*, p.epochs, p.budget - p.epochs * p.tokens AS rest, md5('{MIX_SEED}:' || p.epochs || ':' || s.doc_id) AS turn
  FROM small s JOIN parts p ON s.domain IS NOT DISTINCT FROM p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source),
placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(epochs * tokens + CASE WHEN before < rest THEN least(tokens, rest - before) ELSE 0 END AS BIGINT) AS tokens_taken
FROM placed
"""

_CONTROL = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)


def _sql_escaped(text: str) -> str:
    return rf"regexp_replace({text}, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')"


_OP12 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) p(turn, role)),
marked AS (
  SELECT *, length({_sql_escaped("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 23 + length({_sql_escaped("role")}) END AS size FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars, false AS rewrites, CAST(0 AS BIGINT) AS altered
FROM marked GROUP BY conv_id
"""

SQL = {"op12_chat": _OP12, "op2_line_dedup": _OP2, "op4_mix": _OP4, "op5_quality": _OP5}

