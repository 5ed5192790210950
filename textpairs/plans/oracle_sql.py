"""DuckDB oracle SQL for the query catalogue (tables registered as views by name).

Shared fragments mirror the Spark plans: ``p`` = question/answer pairs of the
documents, ``v`` = vocabulary, ``e`` = encoded pairs, ``s`` = 80/20 split of all
pairs, ``tb`` / ``vb`` = train / validation batches; ``b`` = pairs within the length
budget, for the queries that ask for it.
Floating-point results are rounded to 6 decimals on both sides (summation order
differs between engines).
"""

from __future__ import annotations

from textpairs.functions.text import WHITESPACE_CODEPOINTS

SEED = "42"
WS = "||".join(f"chr({c})" for c in WHITESPACE_CODEPOINTS)


def chars(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"


def enc(x: str, toks: str = "toks") -> str:
    return f"([2] || [CAST(coalesce(list_position({toks}, ch) - 1, 0) AS INTEGER) for ch in {chars(x)}] || [1])"


def dec(x: str, toks: str = "toks") -> str:
    return f"array_to_string([coalesce({toks}[i + 1], '<unk>') for i in {x}], '')"


L = (
    "l AS (SELECT doc_id, lang AS folder, source AS module, unnest(string_split(text, chr(10))) AS v, "
    "CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ln FROM documents)"
)
LA = "la AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY ln) AS a FROM l)"
P = (
    f"p AS (SELECT doc_id, folder, module, CAST(ln // 2 AS BIGINT) AS pair_idx, trim(v, {WS}) AS question, "
    f"trim(a, {WS}) AS answer FROM la WHERE ln % 2 = 0 AND a IS NOT NULL)"
)
PAIRS = f"{L}, {LA}, {P}"


def vocab_ctes(src: str = "p", c: str = "c", v: str = "v", vt: str = "vt", toks: str = "toks") -> str:
    return (
        f"{c} AS (SELECT ch AS token, count(*) AS freq FROM (SELECT unnest({chars('question')}) AS ch FROM {src} "
        f"UNION ALL SELECT unnest({chars('answer')}) AS ch FROM {src}) GROUP BY ch), "
        f"{v} AS (SELECT token, CAST(freq AS BIGINT) AS freq, CAST(id AS INTEGER) AS id FROM (VALUES ('<unk>', 0, 0), "
        f"('<eos>', 0, 1), ('<bos>', 0, 2), ('<pad>', 0, 3)) s(token, freq, id) "
        f"UNION ALL SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + 3 AS INTEGER) FROM {c}), "
        f"{vt} AS (SELECT list(token ORDER BY id) AS {toks} FROM {v})"
    )


VOCAB = vocab_ctes()
E = (
    f"e AS (SELECT doc_id, folder, module, pair_idx, question, answer, {enc('question')} AS question_ids, "
    f"{enc('answer')} AS answer_ids FROM p, vt)"
)
ENCODED = f"{PAIRS}, {VOCAB}, {E}"
B = "b AS (SELECT * FROM e WHERE len(question_ids) <= 200 AND len(answer_ids) <= 201)"


def split_cte(name: str, src: str) -> str:
    return (
        f"{name} AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', doc_id, pair_idx)), "
        f"doc_id, pair_idx) - 1 < (count(*) OVER ()) * 4 // 5 THEN 'train' ELSE 'val' END AS split FROM {src})"
    )


S = split_cte("s", "e")
S_BUDGET = split_cte("s", "b")
TB = (
    "tr AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '0', doc_id, pair_idx)), doc_id, pair_idx) - 1 AS rk "
    "FROM s WHERE split = 'train'), "
    "tb AS (SELECT *, CAST(rk // 32 AS BIGINT) AS batch_id, CAST(rk % 32 AS INTEGER) AS pos_in_batch FROM tr)"
)
VB = (
    "va AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id, pair_idx)), doc_id, pair_idx) - 1 AS rk "
    "FROM s WHERE split = 'val'), "
    "vb AS (SELECT *, CAST(rk // 32 AS BIGINT) AS batch_id, CAST(rk % 32 AS INTEGER) AS pos_in_batch FROM va)"
)
BATCHES = f"{ENCODED}, {S}, {TB}, {VB}"
BUDGET_BATCHES = f"{ENCODED}, {B}, {S_BUDGET}, {TB}"


def padded(src: str, name: str) -> str:
    return (
        f"{name} AS (SELECT *, list_resize(question_ids, max(len(question_ids)) OVER (PARTITION BY batch_id), 3) AS questions, "
        f"list_resize(answer_ids, max(len(answer_ids)) OVER (PARTITION BY batch_id), 3) AS answers FROM {src})"
    )


# prediction stand-in: echo of the padded answer, junk (7) on pad positions, and <unk> at the
# first character position of rows whose md5 key starts with 0-4.
PRED = (
    "pr AS (SELECT *, [CASE WHEN x = 3 THEN 7 WHEN i = 2 AND substr(md5(concat_ws('|', 'p', doc_id, pair_idx)), 1, 1) < '5' "
    "THEN 0 ELSE x END for x, i in answers] AS pred_ids FROM vp), "
    "mt AS (SELECT *, (len(answers) = len(pred_ids) AND list_bool_and([a = pred_ids[i] OR a = 3 for a, i in answers])) AS match FROM pr)"
)
EVAL = f"{BATCHES}, {padded('vb', 'vp')}, {PRED}"

# greedy decoding: the most frequent next id after (question, step, last id), else after the last two ids, else after the last
DECODED = (
    "tq AS (SELECT question, unnest(range(1, len(answer_ids))) AS step, answer_ids AS a FROM tb), "
    "tn AS (SELECT question, step, CASE WHEN step > 1 THEN a[step - 1] ELSE -1 END AS before, a[step] AS prev, a[step + 1] AS nxt FROM tq), "
    "na AS (SELECT question, step, prev, nxt, count(*) AS n FROM tn WHERE question IN (SELECT question FROM vp) GROUP BY question, step, prev, nxt), "
    "nb AS (SELECT before, prev, nxt, count(*) AS n FROM tn GROUP BY before, prev, nxt), "
    "nc AS (SELECT prev, nxt, count(*) AS n FROM tn GROUP BY prev, nxt), "
    "ma AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, step, prev ORDER BY n DESC, nxt) AS r FROM na) WHERE r = 1), "
    "mb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY before, prev ORDER BY n DESC, nxt) AS r FROM nb) WHERE r = 1), "
    "mc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, nxt) AS r FROM nc) WHERE r = 1), "
    "gq AS MATERIALIZED (SELECT doc_id, pair_idx, question, len(answers) AS max_len FROM vp), "
    "gen AS (SELECT *, CAST(0 AS BIGINT) AS pos, -1 AS before, 2 AS prev FROM gq "
    "UNION ALL SELECT g.doc_id, g.pair_idx, g.question, g.max_len, g.pos + 1, g.prev, coalesce(ma.nxt, mb.nxt, mc.nxt, 1) FROM gen g "
    "LEFT JOIN ma ON ma.question = g.question AND ma.step = g.pos + 1 AND ma.prev = g.prev LEFT JOIN mb ON mb.before = g.before AND mb.prev = g.prev "
    "LEFT JOIN mc ON mc.prev = g.prev WHERE g.pos + 1 < g.max_len AND g.prev <> 1), "
    "gp AS (SELECT doc_id, pair_idx, list(prev ORDER BY pos) AS made FROM gen GROUP BY doc_id, pair_idx), "
    "gd AS (SELECT vp.doc_id, vp.pair_idx, folder, answers, list_resize(made, len(answers), 1) AS pred_ids FROM vp JOIN gp USING (doc_id, pair_idx)), "
    "gm AS (SELECT *, list_bool_and([a = pred_ids[i] OR a = 3 for a, i in answers]) AS match FROM gd)"
)
OLDER = (
    "older AS (SELECT doc_id, pair_idx, question, CASE WHEN doc_id % 7 = 2 THEN answer || ' (old)' ELSE answer END AS answer FROM p WHERE doc_id % 5 <> 3 "
    "UNION ALL SELECT doc_id, -1 - pair_idx, question, answer FROM p WHERE doc_id % 11 = 4)"
)

# driver tables read as files: all lines of one (lang, source, doc_id div 4000) in doc order form one file
FILE_LINES = (
    "fl AS (SELECT lang, source, chunk, v, row_number() OVER (PARTITION BY lang, source, chunk ORDER BY doc_id, ln) - 1 AS fln FROM "
    "(SELECT doc_id, lang, source, CAST(doc_id // 4000 AS BIGINT) AS chunk, "
    "unnest(string_split(text, chr(10))) AS v, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)), "
    "fa AS (SELECT *, lead(v) OVER (PARTITION BY lang, source, chunk ORDER BY fln) AS a FROM fl), "
    f"fp AS (SELECT lang, source, chunk, CAST(fln // 2 AS BIGINT) AS pair_idx, trim(v, {WS}) AS question, trim(a, {WS}) AS answer "
    "FROM fa WHERE fln % 2 = 0 AND a IS NOT NULL)"
)

EMB = "x AS (SELECT vec_id // 100 AS seq_id, vec_id % 100 AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ODD = (
    "od AS (SELECT ['', '7', '07', '007', 'a b', 'x/y=z%', 'null', NULL][doc_id % 8 + 1] AS key, doc_id, pair_idx, "
    "' ' || question || ' ' AS question, chr(1) || answer || chr(2) AS answer FROM p)"
)


def attention_ctes(causal: bool) -> str:
    cond = "AND k.pos <= q.pos" if causal else ""
    return (
        f"{EMB}, "
        f"sc AS (SELECT q.seq_id, q.pos AS q_pos, k.pos AS k_pos, list_inner_product(q.v, k.v) / sqrt(len(q.v)) AS score, k.v AS kv "
        f"FROM x q JOIN x k ON q.seq_id = k.seq_id {cond}), "
        "mx AS (SELECT *, max(score) OVER (PARTITION BY seq_id, q_pos) AS m FROM sc), "
        "w AS (SELECT *, exp(score - m) AS ew FROM mx), "
        "nrm AS (SELECT seq_id, q_pos, count(*) AS n_keys, max(m) AS max_score, sum(ew) AS se, sum(ew * score) AS sws, "
        "min(k_pos) FILTER (WHERE score = m) AS best_key FROM w GROUP BY seq_id, q_pos), "
        "dm AS (SELECT seq_id, q_pos, i, sum(ew * xv) AS sx FROM (SELECT seq_id, q_pos, ew, unnest(kv) AS xv, "
        "generate_subscripts(kv, 1) AS i FROM w) GROUP BY seq_id, q_pos, i), "
        "pool AS (SELECT d.seq_id, d.q_pos, list(round(d.sx / n.se, 6) + 0.0 ORDER BY d.i) AS pooled FROM dm d "
        "JOIN nrm n ON d.seq_id = n.seq_id AND d.q_pos = n.q_pos GROUP BY d.seq_id, d.q_pos), "
        "poolraw AS (SELECT d.seq_id, d.q_pos, list(d.sx / n.se ORDER BY d.i) AS pooled FROM dm d "
        "JOIN nrm n ON d.seq_id = n.seq_id AND d.q_pos = n.q_pos GROUP BY d.seq_id, d.q_pos)"
    )


def mask_digest(ids: str) -> str:
    """Row i of a mask has ones at the valid places up to i; all padding is at the end."""
    return (
        f"WITH {BATCHES}, {padded('tb', 'tp')}, m AS (SELECT doc_id, pair_idx, len({ids}) AS n, len([x for x in {ids} if x <> 3]) AS k FROM tp) "
        "SELECT doc_id, pair_idx, CAST(n AS INTEGER) AS mask_len, md5(array_to_string([md5(repeat('1', least(i, k)) || repeat('0', n - least(i, k))) "
        "for i in range(1, n + 1)], '')) AS digest FROM m"
    )


ORACLE: dict[str, str] = {
    # ---- sources / pairing
    "qa_pairs": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p",
    "qa_capped": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p WHERE pair_idx < 3",
    "qa_unpaired": f"WITH {L}, {LA} SELECT doc_id, folder, module, ln, v AS text FROM la WHERE ln % 2 = 0 AND a IS NULL",
    "qa_conv": (
        "SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole "
        "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'"
    ),
    "qa_conv_unanswered": (
        "SELECT conv_id, turn, text AS question FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole "
        "FROM conversations) WHERE role = 'user' AND (nrole IS NULL OR nrole <> 'assistant')"
    ),
    "folder_selected": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p WHERE folder IN ('en', 'fr', 'xx')",
    "file_selected": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p WHERE module IN ('src1', 'src7', 'nope')",
    "ingest_report": (
        f"WITH {PAIRS} SELECT d.lang AS folder, d.source AS module, count(DISTINCT d.doc_id) AS files, count(p.doc_id) AS pairs "
        "FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY ROLLUP (d.lang, d.source)"
    ),
    "null_report": (
        f"WITH {PAIRS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE question IS NULL) AS null_question, "
        "count(*) FILTER (WHERE answer IS NULL) AS null_answer FROM p"
    ),
    "split_folder": f"WITH {PAIRS} SELECT folder AS split_key, doc_id, pair_idx, question, answer FROM p",
    "split_by_folder": f"WITH {PAIRS} SELECT folder AS split_key, doc_id, pair_idx, question, answer FROM p",
    "split_odd_keys": f"WITH {PAIRS}, {ODD} SELECT key AS split_key, key, doc_id, pair_idx, question, answer FROM od",
    "csv_odd_cells": f"WITH {PAIRS}, {ODD} SELECT key, doc_id, pair_idx, question, answer FROM od",
    "dataset_modules": f"WITH {PAIRS}, {ODD} SELECT key AS name, key, doc_id, pair_idx FROM od WHERE key IN ('7', '07', '007')",
    "qa_only": f"WITH {PAIRS} SELECT question, answer FROM p",
    "checked": f"WITH {PAIRS} SELECT true AS has_rows, count(*) AS n_rows FROM p",
    "file_unpaired": f"WITH {FILE_LINES} SELECT lang, source, chunk, CAST(fln AS BIGINT) AS ln, v AS text FROM fa WHERE fln % 2 = 0 AND a IS NULL",
    "stream_unpaired": f"WITH {FILE_LINES} SELECT lang, source, chunk, CAST(fln AS BIGINT) AS ln, v AS text FROM fa WHERE fln % 2 = 0 AND a IS NULL",
    "stream_pieces_unpaired": f"WITH {FILE_LINES} SELECT lang, source, chunk, CAST(fln AS BIGINT) AS ln, v AS text FROM fa WHERE fln % 2 = 0 AND a IS NULL",
    "ingest_observed": (
        f"WITH {FILE_LINES} SELECT count(*) > 0 AS has_rows, count(*) FILTER (WHERE question IS NULL) > 0 AS null_question, "
        "count(*) FILTER (WHERE answer IS NULL) > 0 AS null_answer FROM fp"
    ),
    "file_report": (
        f"WITH {FILE_LINES}, f AS (SELECT DISTINCT lang, source, chunk FROM fl) SELECT f.lang, f.source, f.chunk, CAST(1 AS BIGINT) AS files, "
        "count(fp.pair_idx) AS pairs FROM f LEFT JOIN fp ON f.lang = fp.lang AND f.source = fp.source AND f.chunk = fp.chunk "
        "GROUP BY f.lang, f.source, f.chunk"
    ),
    "split_module": f"WITH {PAIRS} SELECT module AS split_key, doc_id, pair_idx, question, answer FROM p",
    "folder_files_selected": f"WITH {FILE_LINES} SELECT lang, source, chunk, pair_idx, question, answer FROM fp WHERE lang IN ('en', 'fr', 'xx')",
    "module_files_selected": f"WITH {FILE_LINES} SELECT lang, source, chunk, pair_idx, question, answer FROM fp WHERE source IN ('src1', 'src7', 'nope')",
    "listed_files": "SELECT lang, source, count(DISTINCT doc_id // 4000) AS folders FROM documents GROUP BY lang, source",
    "split_rerun": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p",
    "file_source": f"WITH {FILE_LINES} SELECT lang, source, chunk, pair_idx, question, answer FROM fp",
    "file_source_lines": f"WITH {FILE_LINES} SELECT lang, source, chunk, pair_idx, question, answer FROM fp",
    **dict.fromkeys(
        ("stream_ingest", "stream_pieces", "stream_listed"),
        f"WITH {PAIRS}, {VOCAB}, {FILE_LINES} SELECT lang, source, chunk, pair_idx, question, answer, {enc('question')} AS question_ids, "
        f"{enc('answer')} AS answer_ids FROM fp, vt"
    ),
    # ---- vocabulary / encoding
    "char_freq": f"WITH {PAIRS}, {VOCAB} SELECT token, freq FROM c",
    "vocab_build": f"WITH {PAIRS}, {VOCAB} SELECT token, freq, id FROM v",
    "encode": f"WITH {ENCODED} SELECT doc_id, pair_idx, question_ids, answer_ids FROM e",
    "encode_oov": (
        f"WITH {PAIRS}, pe AS (SELECT * FROM p WHERE folder = 'en'), {vocab_ctes('pe')} "
        f"SELECT doc_id, pair_idx, {enc('question')} AS question_ids, {enc('answer')} AS answer_ids FROM p, vt"
    ),
    "encode_benchmark": f"WITH {PAIRS}, {VOCAB} SELECT item_id, {enc('text')} AS text_ids FROM benchmark, vt",
    "decode": f"WITH {PAIRS} SELECT doc_id, pair_idx, '<bos>' || question || '<eos>' AS question_text, '<bos>' || answer || '<eos>' AS answer_text FROM p",
    "over_budget": (
        f"WITH {PAIRS} SELECT folder, count(*) AS pairs, count(*) FILTER (WHERE length(question) + 2 > 200) AS over_question, "
        "count(*) FILTER (WHERE length(answer) + 2 > 201) AS over_answer, "
        "count(*) FILTER (WHERE length(question) + 2 > 200 OR length(answer) + 2 > 201) AS dropped, "
        "count(*) FILTER (WHERE NOT (length(question) + 2 > 200 OR length(answer) + 2 > 201)) AS kept FROM p GROUP BY folder"
    ),
    "test_batches": (
        "SELECT conv_id, turn, CAST(rk // 32 AS BIGINT) AS batch_id, CAST(rk % 32 AS INTEGER) AS pos_in_batch FROM "
        "(SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rk FROM (SELECT conv_id, turn, "
        "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, role FROM conversations) WHERE role = 'user' AND nrole = 'assistant')"
    ),
    # ---- profiling
    "value_counts": f"WITH {PAIRS} SELECT module, count(*) AS count FROM p WHERE module IS NOT NULL GROUP BY module",
    "value_share": (
        f"WITH {PAIRS} SELECT folder, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM p "
        "WHERE folder IS NOT NULL GROUP BY folder"
    ),
    "value_counts_events": "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "length_stats": (
        f"WITH {PAIRS}, ln AS (SELECT length(question) AS q, length(answer) AS a FROM p), "
        "g AS (SELECT count(q)::DOUBLE AS qc, avg(q) AS qm, stddev_samp(q) AS qs, min(q)::DOUBLE AS qmin, "
        "quantile_cont(q, [0.25, 0.5, 0.75]) AS qq, max(q)::DOUBLE AS qmax, count(a)::DOUBLE AS ac, avg(a) AS am, "
        "stddev_samp(a) AS as_, min(a)::DOUBLE AS amin, quantile_cont(a, [0.25, 0.5, 0.75]) AS aq, max(a)::DOUBLE AS amax FROM ln) "
        "SELECT stat, round_even(qv::DOUBLE, 1) AS question_length, round_even(av::DOUBLE, 1) AS answer_length FROM ("
        "SELECT 'count' AS stat, qc AS qv, ac AS av FROM g UNION ALL SELECT 'mean', qm, am FROM g UNION ALL "
        "SELECT 'std', qs, as_ FROM g UNION ALL SELECT 'min', qmin, amin FROM g UNION ALL SELECT '25%', qq[1], aq[1] FROM g "
        "UNION ALL SELECT '50%', qq[2], aq[2] FROM g UNION ALL SELECT '75%', qq[3], aq[3] FROM g UNION ALL SELECT 'max', qmax, amax FROM g)"
    ),
    "length_hist": (
        f"WITH {PAIRS} SELECT 'question' AS column, CAST(length(question) AS INTEGER) AS length, count(*) AS count FROM p GROUP BY 2 "
        "UNION ALL SELECT 'answer', CAST(length(answer) AS INTEGER), count(*) FROM p GROUP BY 2"
    ),
    "length_extent": (
        f"WITH {PAIRS} SELECT 'question' AS column, count(DISTINCT length(question)) AS distinct_lengths, "
        "CAST(max(length(question)) AS INTEGER) AS max_length FROM p UNION ALL SELECT 'answer', count(DISTINCT length(answer)), "
        "CAST(max(length(answer)) AS INTEGER) FROM p"
    ),
    "box_stats": (
        f"WITH {PAIRS}, ln AS (SELECT folder, CAST(length(question) AS INTEGER) AS length FROM p), "
        "f AS (SELECT folder, quantile_cont(length, [0.25, 0.5, 0.75]) AS q FROM ln GROUP BY folder), "
        "f2 AS (SELECT folder, q[1]::DOUBLE AS q1, q[2]::DOUBLE AS median, q[3]::DOUBLE AS q3, q[1] - 1.5 * (q[3] - q[1]) AS lo, "
        "q[3] + 1.5 * (q[3] - q[1]) AS hi FROM f) "
        "SELECT ln.folder, q1, median, q3, count(*) AS n, min(length) FILTER (WHERE length >= lo AND length <= hi) AS whisker_lo, "
        "max(length) FILTER (WHERE length >= lo AND length <= hi) AS whisker_hi, "
        "count(*) FILTER (WHERE NOT (length >= lo AND length <= hi)) AS n_outliers FROM ln JOIN f2 ON ln.folder = f2.folder "
        "GROUP BY ln.folder, q1, median, q3"
    ),
    "box_outliers": (
        f"WITH {PAIRS}, ln AS (SELECT doc_id, pair_idx, folder, CAST(length(question) AS INTEGER) AS length FROM p), "
        "f AS (SELECT folder, quantile_cont(length, [0.25, 0.5, 0.75]) AS q FROM ln GROUP BY folder) "
        "SELECT doc_id, pair_idx, ln.folder, length FROM ln JOIN f ON ln.folder = f.folder "
        "WHERE length < q[1] - 1.5 * (q[3] - q[1]) OR length > q[3] + 1.5 * (q[3] - q[1])"
    ),
    "head_sample": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p ORDER BY doc_id, pair_idx LIMIT 5",
    "random_sample": (
        f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p "
        "ORDER BY md5(concat_ws('|', '42', doc_id, pair_idx)), doc_id, pair_idx LIMIT 5"
    ),
    # ---- split / batches / collation
    "split_80_20": f"WITH {PAIRS}, {split_cte('s0', 'p')} SELECT doc_id, pair_idx, split FROM s0",
    "shuffle_batches": f"WITH {BATCHES} SELECT doc_id, pair_idx, batch_id, pos_in_batch FROM tb",
    "ordered_batches": f"WITH {BATCHES} SELECT doc_id, pair_idx, batch_id, pos_in_batch FROM vb",
    "padded": f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, batch_id, questions, answers FROM tp",
    "epoch_bucketed": (
        f"WITH {BATCHES}, sh AS (SELECT *, rk // 2048 AS shard FROM tr), "
        "so AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', '42', '1', doc_id, pair_idx)), doc_id, pair_idx) - 1 AS k FROM sh), "
        "sb AS (SELECT *, CAST(shard * 64 + k // 32 AS BIGINT) AS batch_id, CAST(k % 32 AS INTEGER) AS pos_in_batch FROM so), "
        f"{padded('sb', 'sp')} SELECT doc_id, pair_idx, batch_id, pos_in_batch, questions, answers FROM sp"
    ),
    "prepare_train": f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, batch_id, questions, answers FROM tp",
    "src_mask": f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, [x <> 3 for x in questions] AS questions_mask FROM tp",
    "trg_mask": (
        f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, CAST(len(answers) AS INTEGER) AS mask_len, "
        "CAST(len([x for x in answers if x <> 3]) AS INTEGER) AS valid_len FROM tp"
    ),
    "trg_mask_matrix": (
        f"WITH {BUDGET_BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, [x <> 3 for x in questions] AS questions_mask, "
        "[array_to_string([CASE WHEN x <> 3 AND j <= i THEN '1' ELSE '0' END for x, j in answers], '') for y, i in answers] AS answers_mask "
        "FROM tp"
    ),
    "shifted_mask": (
        f"WITH {BUDGET_BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, "
        "[array_to_string([CASE WHEN x <> 3 AND j <= i THEN '1' ELSE '0' END for x, j in answers[1:len(answers) - 1]], '') "
        "for y, i in answers[1:len(answers) - 1]] AS decoder_mask FROM tp"
    ),
    "trg_mask_digest": mask_digest("answers"),
    "shifted_mask_compact": (
        f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, CAST(len(answers) - 1 AS INTEGER) AS mask_len, "
        "CAST(len([x for x in answers[1:len(answers) - 1] if x <> 3]) AS INTEGER) AS valid_len FROM tp"
    ),
    "shifted_mask_digest": mask_digest("answers[1:len(answers) - 1]"),
    "prepare_budget": (
        f"WITH {PAIRS}, pb AS (SELECT * FROM p WHERE length(question) + 2 <= 200 AND length(answer) + 2 <= 201), {vocab_ctes('pb')}, "
        f"b AS (SELECT doc_id, pair_idx, {enc('question')} AS question_ids, {enc('answer')} AS answer_ids FROM pb, vt), {S_BUDGET}, {TB}, "
        f"{padded('tb', 'tp')} SELECT doc_id, pair_idx, batch_id, questions, answers, (SELECT count(*) FROM p) - (SELECT count(*) FROM pb) AS dropped FROM tp"
    ),
    "prepare_loaded": f"WITH {BATCHES}, {padded('vb', 'vp')} SELECT doc_id, pair_idx, batch_id, questions, answers FROM vp",
    "prepare_changed": f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, batch_id, questions, answers FROM tp",
    "cache_report": (
        f"WITH {PAIRS}, {OLDER}, st AS (SELECT CASE WHEN p.doc_id IS NULL THEN 'gone' WHEN o.doc_id IS NULL THEN 'new' "
        "WHEN o.question = p.question AND o.answer = p.answer THEN 'reused' ELSE 'changed' END AS state "
        "FROM p FULL JOIN older o ON o.doc_id = p.doc_id AND o.pair_idx = p.pair_idx) SELECT 'train' AS \"table\", state, count(*) AS rows FROM st GROUP BY state"
    ),
    "prepare_test": (
        f"WITH {PAIRS}, {VOCAB}, cv AS (SELECT conv_id, turn, text AS question, nxt AS answer, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rk "
        "FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
        "WHERE role = 'user' AND nrole = 'assistant'), "
        f"ce AS (SELECT conv_id, turn, CAST(rk // 32 AS BIGINT) AS batch_id, {enc('question')} AS question_ids, {enc('answer')} AS answer_ids FROM cv, vt), "
        f"{padded('ce', 'cp')} SELECT conv_id, turn, batch_id, questions, answers FROM cp"
    ),
    "collate_extra": (
        f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, batch_id, CAST(len(questions) AS INTEGER) AS width, "
        "CAST(len(question_ids) AS INTEGER) AS used FROM tp"
    ),
    "shifted": (
        f"WITH {BATCHES}, {padded('tb', 'tp')} SELECT doc_id, pair_idx, answers[1:len(answers) - 1] AS decoder_input, "
        "answers[2:len(answers)] AS target FROM tp"
    ),
    # ---- evaluation
    "exact_match": f"WITH {EVAL} SELECT doc_id, pair_idx, batch_id, match FROM mt",
    "accuracy": f"WITH {EVAL} SELECT count(*) AS n, count(*) FILTER (WHERE match) AS matches, avg(match::DOUBLE) AS accuracy FROM mt",
    "accuracy_by_folder": (
        f"WITH {EVAL} SELECT folder, count(*) AS n, count(*) FILTER (WHERE match) AS matches, avg(match::DOUBLE) AS accuracy "
        "FROM mt GROUP BY folder"
    ),
    "accuracy_by_quality": (
        f"WITH {EVAL} SELECT l.quality, count(*) AS n, count(*) FILTER (WHERE match) AS matches, avg(match::DOUBLE) AS accuracy "
        "FROM mt JOIN labels l ON mt.doc_id = l.doc_id GROUP BY l.quality"
    ),
    "accuracy_fraction": (
        f"WITH {EVAL}, nb AS (SELECT max(batch_id) + 1 AS n_batches FROM mt), k AS (SELECT n_batches, "
        "CAST(floor(n_batches * 0.5) AS BIGINT) AS used FROM nb) SELECT any_value(n_batches) AS n_batches, any_value(used) AS used_batches, "
        "count(*) AS n, count(*) FILTER (WHERE match) AS matches, avg(match::DOUBLE) AS accuracy FROM mt, k WHERE batch_id < used"
    ),
    "greedy_eval": (
        f"WITH {EVAL}, nb AS (SELECT max(batch_id) + 1 AS n_batches FROM vp), k AS (SELECT n_batches, "
        "CAST(floor(n_batches * 0.5) AS BIGINT) AS used FROM nb), "
        "g AS (SELECT *, list_resize(questions[1:len(answers)], len(answers), 3) AS rq FROM vp, k WHERE batch_id < used), "
        "gm AS (SELECT *, (len(answers) = len(rq) AND list_bool_and([a = rq[i] OR a = 3 for a, i in answers])) AS m FROM g) "
        "SELECT any_value(n_batches) AS n_batches, any_value(used) AS used_batches, count(*) AS n, "
        "count(*) FILTER (WHERE m) AS matches, avg(m::DOUBLE) AS accuracy FROM gm"
    ),
    "greedy_decode": f"WITH RECURSIVE {BATCHES}, {padded('vb', 'vp')}, {DECODED} SELECT doc_id, pair_idx, pred_ids, match FROM gm",
    "greedy_decode_accuracy": (
        f"WITH RECURSIVE {BATCHES}, {padded('vb', 'vp')}, {DECODED} SELECT folder, count(*) AS n, count(*) FILTER (WHERE match) AS matches, "
        "avg(match::INTEGER::DOUBLE) AS accuracy FROM gm GROUP BY folder"
    ),
    "batch_examples": (
        f"WITH {EVAL} SELECT doc_id, pair_idx, batch_id, {dec('questions')} AS question_text, {dec('answers')} AS answer_text, "
        f"{dec('pred_ids')} AS predicted_text FROM pr, vt WHERE pos_in_batch = 0"
    ),
    "batch_predict": f"WITH {ENCODED} SELECT doc_id, pair_idx, list_reverse(question_ids) AS pred_ids FROM e",
    "greedy_argmax": "SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings",
    "greedy_argmax_long": "SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings",
    "token_xent": (
        "WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS lg FROM embeddings) SELECT vec_id, label, "
        "round(list_max(lg) + ln(list_sum([exp(t - list_max(lg)) for t in lg])) - lg[label + 1], 6) + 0.0 AS xent FROM x"
    ),
    "softmax": (
        "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS lg FROM embeddings), "
        "y AS (SELECT vec_id, [exp(t - list_max(lg)) for t in lg] AS ex FROM x) "
        "SELECT vec_id, [round(t / list_sum(ex), 6) + 0.0 for t in ex] AS weights FROM y"
    ),
    "masked_xent": (
        "WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS lg FROM embeddings), "
        "y AS (SELECT label, list_max(lg) + ln(list_sum([exp(t - list_max(lg)) for t in lg])) - lg[label + 1] AS xe FROM x) "
        "SELECT count(*) AS positions, round(avg(xe), 6) + 0.0 AS loss, round(exp(avg(xe)), 6) + 0.0 AS perplexity FROM y WHERE label <> 3"
    ),
    # ---- vectors
    "attn_stats": (
        f"WITH {attention_ctes(True)} SELECT seq_id, q_pos, n_keys, best_key, round(max_score, 6) + 0.0 AS max_score, "
        "round(max_score + ln(se), 6) + 0.0 AS log_norm FROM nrm"
    ),
    "attn_blocks": (
        f"WITH {attention_ctes(True)} SELECT pool.seq_id, pool.q_pos, nrm.n_keys, pooled FROM pool JOIN nrm "
        "ON pool.seq_id = nrm.seq_id AND pool.q_pos = nrm.q_pos"
    ),
    "attn_pool": f"WITH {attention_ctes(True)} SELECT seq_id, q_pos, pooled FROM pool",
    "dot_scores": (
        f"WITH {attention_ctes(False)} SELECT seq_id, q_pos, n_keys, best_key, round(max_score, 6) + 0.0 AS max_score, "
        "round(max_score + ln(se), 6) + 0.0 AS log_norm FROM nrm"
    ),
    "attn_softmax": (
        f"WITH {attention_ctes(True)} SELECT seq_id, q_pos, round(1.0 / se, 6) + 0.0 AS max_weight, "
        "round(max_score + ln(se) - sws / se, 6) + 0.0 AS entropy FROM nrm"
    ),
    "attn_pool_full": f"WITH {attention_ctes(False)} SELECT seq_id, q_pos, pooled FROM pool",
    "attn_bind": (
        f"WITH {attention_ctes(True)} SELECT p.seq_id, p.q_pos, [round(a * x.v[i], 6) + 0.0 for a, i in p.pooled] AS bound "
        "FROM poolraw p JOIN x ON p.seq_id = x.seq_id AND p.q_pos = x.pos"
    ),
    # ---- round trips through sinks
    "csv_roundtrip": f"WITH {PAIRS} SELECT doc_id, folder, module, pair_idx, question, answer FROM p",
    "parquet_roundtrip": f"WITH {ENCODED} SELECT doc_id, pair_idx, question_ids, answer_ids FROM e",
    "vocab_roundtrip": f"WITH {PAIRS}, {VOCAB} SELECT token, freq, id FROM v",
    "dataset_layout": (
        f"WITH {PAIRS}, {split_cte('s0', 'p')} SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS kind, doc_id, folder, module, "
        "pair_idx, question, answer, CAST(length(question) AS INTEGER) AS question_length FROM s0"
    ),
}
