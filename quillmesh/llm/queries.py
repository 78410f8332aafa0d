"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import chat, decontaminate, html_text, licenses, lm_score, ngram_join, packing, repair, spelling, substring_dedup, toxicity, warc
from quillmesh.llm import exact_dedup as dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (norm)
"""


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.read_back(chat.conversations(chat.chain(rows.unionByName(extra))))


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\#\\#\\#'), '</turn>', '\\<\\/\\t\\u\\r\\n\\>') AS body FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(body) + 15) AS formatted_chars
  FROM esc GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), with_payload=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_score.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (size, win)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_sql() -> str:
    """Sentences as runs of lines, found by joins; rules step by step, each at the first place after the last.

    Only the fixed sentences and rules are shared with the operator.
    """
    known = ", ".join(f"('{i}', '{s}')" for i, s in licenses.known_sentences())
    rules = [(n, kind, free, len(ids), k + 1, i) for n, kind, free, ids in licenses.known_rules() for k, i in enumerate(ids)]
    steps = ", ".join(f"({place}, '{n}', '{kind}', {free}, {size}, {k}, '{i}')" for place, (n, kind, free, size, k, i) in enumerate(rules))
    within = ", ".join(f"('{a}', '{b}')" for a, b in licenses.WITHIN.items())
    return f"""
WITH RECURSIVE known(ids, s) AS (VALUES {known}),
steps(place, rule, licence, free, size, step, id) AS (VALUES {steps}),
within(inner_rule, outer_rule) AS (VALUES {within}),
d AS (
  SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?]+[ \t\r\n]', chr(10) || chr(10), 'g'), chr(10)) AS parts
  FROM documents
), l AS (
  SELECT doc_id, i, array_to_string(regexp_extract_all(part, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS line
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM d)
), span AS (
  SELECT doc_id, i, i AS j, line AS s FROM l WHERE line <> ''
  UNION ALL
  SELECT span.doc_id, span.i, l.i, s || ' ' || line FROM span JOIN l ON l.doc_id = span.doc_id AND l.i = span.j + 1
  WHERE line <> '' AND length(s) < (SELECT max(length(s)) FROM known)
), found AS (
  SELECT doc_id, i, max(j) AS j, arg_max(ids, j) AS ids FROM span JOIN known USING (s) GROUP BY doc_id, i
), after AS (
  SELECT a.doc_id, a.i, min(b.i) AS then_i FROM found a JOIN found b ON b.doc_id = a.doc_id AND b.i > a.j GROUP BY a.doc_id, a.i
), walk AS (
  SELECT doc_id, min(i) AS i FROM found GROUP BY doc_id
  UNION ALL
  SELECT walk.doc_id, then_i FROM walk JOIN after ON after.doc_id = walk.doc_id AND after.i = walk.i
), one AS (
  SELECT doc_id, i, unnest(string_split(ids, '|')) AS id, generate_subscripts(string_split(ids, '|'), 1) AS k FROM walk JOIN found USING (doc_id, i)
), seq AS (
  SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pos FROM one
), met AS (
  SELECT doc_id, rule, 1 AS step, min(pos) AS pos FROM seq JOIN steps USING (id) WHERE step = 1 GROUP BY doc_id, rule
  UNION ALL
  SELECT met.doc_id, met.rule, met.step + 1, min(seq.pos) FROM met JOIN steps ON steps.rule = met.rule AND steps.step = met.step + 1
    JOIN seq ON seq.doc_id = met.doc_id AND seq.id = steps.id AND seq.pos > met.pos GROUP BY met.doc_id, met.rule, met.step
), hit AS (
  SELECT doc_id, rule, licence, free, place FROM met JOIN steps USING (rule, step) WHERE step = size
), kept AS (
  SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM within JOIN hit h ON h.rule = outer_rule WHERE inner_rule = hit.rule AND h.doc_id = hit.doc_id)
), said AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM seq GROUP BY doc_id
), rule AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT licence) AS n, bool_or(NOT free) AS bars FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(said.n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences,
  coalesce(rule.n, 0) AS n_licences, coalesce(bars, FALSE) AS restricted
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN rule USING (doc_id)
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1
), gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS p FROM win JOIN twice USING (k)
), word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), spoil=199)


#: crc32 of ``s`` (its characters below U+0800), by a table of byte values that a recursion fills.
CRC_TABLE = """
bits(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(s: str) -> str:
    """An expression for crc32 of the text ``s``; ``t`` is the table."""
    octets = "CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END"
    all_octets = f"list_transform(flatten(list_transform(string_split({s}, ''), lambda x: {octets})), lambda x: x::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {all_octets}), lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT)"


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) GROUP BY 1, 2
), hashed AS (SELECT w, n, {crc_sql("concat(doc_id, ':', w)")} AS h FROM run, tab
), spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS wild, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (wild) WHERE a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = less UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = less
), best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(n := -n, b := b)) AS top FROM near JOIN words ON words.word = b GROUP BY a
), forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 5 * n THEN top.b END AS form, CASE WHEN -top.n >= 5 * n THEN CAST(-top.n AS BIGINT) END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (SELECT word, word AS root, form AS up FROM forms UNION ALL SELECT chain.word, up, forms.form FROM chain JOIN forms ON forms.word = chain.up)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE up IS NULL
"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(given), given)


def _state_sql(state: int) -> str:
    """Costs and letters of one row's edits from a state, costs to go and letters of the rest behind them: the best, then with inserts."""
    fill, word = {0: 2, 1: 2, 2: 3, 3: 2}[state], "assistant" if state == 2 else "user"
    row = lambda cost, letter, to, line: f"{{'c': g{to}.c + {cost}, 'a': '{letter}' || g{to}.a, 'x': {line} || g{to}.x}}"
    keep = {0: "CASE r.i WHEN 's' THEN g1 WHEN 'u' THEN g2 END", 1: "CASE r.i WHEN 'u' THEN g2 END", 2: "CASE r.i WHEN 'a' THEN g3 END", 3: "CASE r.i WHEN 'u' THEN g2 END"}[state]
    kept = f"CASE WHEN NOT gone AND ({keep}) IS NOT NULL THEN {{'c': ({keep}).c + extra, 'a': 'K' || ({keep}).a, 'x': chr(10) || role || ':' || text || ({keep}).x}} END"
    other = "CASE WHEN NOT gone THEN " + row("1 + extra", "R", fill, f"chr(10) || '{word}:' || text") + " END"
    return f"list_min(list_filter([{row('2', 'D', state, chr(39) * 2)}, {kept}, {other}], lambda v: v IS NOT NULL))"


def op13_sql() -> str:
    """Rows from the last to the first, with the best (cost, letters, text) from each of the four states of the form."""
    ins = lambda h, to, word: f"{{'c': {h}{to}.c + 5, 'a': 'I' || {h}{to}.a, 'x': chr(10) || '{word}:' || {h}{to}.x}}"
    states = ", ".join(f"{_state_sql(q)} AS h{q}" for q in range(4))
    # An insertion before the row, or two.
    once = "list_min([h2, " + ins("h", 3, "assistant") + "]) AS k2, list_min([h3, " + ins("h", 2, "user") + "]) AS k3, h0, h1"
    closed = f"list_min([h0, {ins('k', 2, 'user')}]) AS g0, list_min([h1, {ins('k', 2, 'user')}]) AS g1, list_min([k2, {ins('k', 3, 'assistant')}]) AS g2, list_min([k3, {ins('k', 2, 'user')}]) AS g3"
    return f"""
WITH RECURSIVE {CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(generate_series(1, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE k <> 0)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d
), r AS (
  SELECT *, last = '' AS blank, last <> '' AND NOT first AS duplicate, last <> '' AND first AND last NOT IN ('.', '!', '?') AS truncated, last = '' OR NOT first AS gone, CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
    lead(i) OVER (PARTITION BY conv_id ORDER BY t) AS then_i
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY t) = 1 AS first FROM n)
), go AS (
  SELECT conv_id, max(t) + 1 AS t, {{'c': 0, 'a': '', 'x': ''}} AS g0, {{'c': 10, 'a': 'II', 'x': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS g1, {{'c': 5, 'a': 'I', 'x': chr(10) || 'assistant:'}} AS g2, {{'c': 0, 'a': '', 'x': ''}} AS g3 FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, t, {closed} FROM (SELECT conv_id, t, {once} FROM (
    SELECT r.conv_id, r.t, {states} FROM go JOIN r ON r.conv_id IS NOT DISTINCT FROM go.conv_id AND r.t = go.t - 1
  ))
), best AS (SELECT conv_id, g0.c AS cost, g0.a AS audit, g0.x AS x FROM go WHERE t = 1
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE then_i IS NOT NULL AND i || then_i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(x[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_html_text": op1_html_text, "op2_ngram_join": op2_ngram_join, "op3_chat_formatting": op3_chat_formatting, "op4_warc": op4_warc, "op5_exact_dedup": op5_exact_dedup, "op6_toxicity": op6_toxicity,
        "op7_lm_score": op7_lm_score, "op8_decontamination": op8_decontamination, "op9_packing": op9_packing, "op10_license_scan": op10_license_scan,
        "op11_substring_dedup": op11_substring_dedup, "op12_spelling_variants": op12_spelling_variants,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op10_license_scan": op10_sql(), "op11_substring_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_structure_repair": op13_sql()}
