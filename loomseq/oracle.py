"""DuckDB SQL for the queries of loomseq.queries."""

from __future__ import annotations

from loomseq.functions.sequence import WORD
from loomseq.plans.records import NGRAM_VOCAB, SPECIALS, TOKEN_VOCAB, Shape

S = Shape()
L = S.max_seq_length
MIN_COUNT, SEED, RATE = 5, 42, 0.15
BASE = len(SPECIALS)

_TOKS = f"toks AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS tokens FROM documents)"
_CUT = f"cut AS (SELECT doc_id, tokens[1:{L - 2}] AS tokens FROM toks)"


def _windows(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, s AS start_pos, n AS len, array_to_string(tokens[s + 1:s + n], ' ') AS ngram
  FROM (SELECT doc_id, tokens, unnest(range(0, len(tokens) - {S.low} + 1)) AS s FROM {src} WHERE len(tokens) >= {S.low}) a,
       (SELECT unnest(range({S.low}, {S.high} + 1)) AS n) b
  WHERE s + n <= len(tokens))"""


_DICT = f"""{_windows('wins', 'toks')},
dict AS (SELECT ngram, CAST(row_number() OVER (ORDER BY c DESC, ngram) AS INTEGER) AS ngram_id
         FROM (SELECT ngram, count(*) AS c FROM wins GROUP BY ngram HAVING count(*) >= {MIN_COUNT} ORDER BY c DESC, ngram LIMIT {NGRAM_VOCAB}))"""
_HITS = f"""{_TOKS}, {_CUT}, {_DICT}, {_windows('cwins', 'cut')},
hits AS (SELECT doc_id, ngram, ngram_id, start_pos, start_pos + len AS end_pos, len FROM cwins JOIN dict USING (ngram))"""
_MATCHED = f"""{_HITS},
spans AS (SELECT doc_id, ngram_id, start_pos, len, unnest(range(start_pos + 1, end_pos + 1)) AS pos FROM hits),
grouped AS (SELECT doc_id, ngram_id, min(start_pos * 1000 + len) AS first, list_sort(list_distinct(list(pos))) AS positions FROM spans GROUP BY ALL),
matched AS (SELECT * FROM (SELECT doc_id, ngram_id, positions, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS rk FROM grouped) WHERE rk <= {S.cap})"""
_VOCAB = f"""vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY c DESC, token) + {BASE - 1} AS INTEGER) AS id
  FROM (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token ORDER BY c DESC, token LIMIT {TOKEN_VOCAB - BASE}))"""
_SPECIAL = " ".join(f"WHEN '{t}' THEN {i}" for t, i in SPECIALS.items())
_ENC = f"""framed AS (SELECT doc_id, list_concat(list_concat(['[CLS]'], tokens), ['[SEP]']) AS t FROM cut),
padded AS (SELECT doc_id, list_concat(t, list_transform(range(0, {L} - len(t)), lambda x: '[PAD]')) AS t FROM framed),
flat AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM padded),
rows_ AS (SELECT doc_id, pos, CAST(coalesce(CASE token {_SPECIAL} END, id, {SPECIALS['[UNK]']}) AS INTEGER) AS id, CAST(token <> '[PAD]' AS INTEGER) AS mask
          FROM flat LEFT JOIN vocab USING (token)),
enc AS (SELECT doc_id, list(id ORDER BY pos) AS ids, list(mask ORDER BY pos) AS masks FROM rows_ GROUP BY doc_id)"""
_TOKEN_HALF = f"{_TOKS}, {_CUT}, {_VOCAB}, {_ENC}"


def _u(salt: str) -> str:
    """The draw for (doc_id, 0-based position i - 1), where i is a list index."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR), CAST(i - 1 AS VARCHAR), '{salt}')), 1, 8) AS BIGINT) / 4294967296.0)"


_CANDS = f"""cands AS (SELECT doc_id, ids, list_filter(list_transform(ids, lambda t, i: CASE WHEN t NOT IN (2, 3, 0) AND {_u('select')} < {RATE} THEN i - 1 END), lambda p: p IS NOT NULL) AS cand FROM enc)"""
_NEW = f"""list_transform(ids, lambda t, i: CASE WHEN list_contains(cand, i - 1) THEN
  CASE WHEN {_u('branch')} < 0.8 THEN {SPECIALS['[MASK]']} WHEN {_u('branch')} < 0.9 THEN CAST(floor({_u('replace')} * {TOKEN_VOCAB}) AS INTEGER) ELSE t END ELSE t END)"""
_LABELS = "list_transform(ids, lambda t, i: CASE WHEN list_contains(cand, i - 1) THEN t ELSE -100 END)"
_GRAMS = "grams AS (SELECT doc_id, list({'id': ngram_id, 'pos': positions} ORDER BY rk) AS gs FROM matched GROUP BY doc_id)"
_FOLD = f"""{_MATCHED}, {_VOCAB}, {_ENC}, {_CANDS}, {_GRAMS},
folded AS (
  SELECT doc_id, ids, gs, CASE WHEN gs IS NULL THEN {{'id': 0, 'pos': cand, 'gone': CAST([] AS INTEGER[])}} ELSE
    list_reduce(list_transform(gs, lambda g: {{'id': g.id, 'pos': g.pos, 'gone': CAST([] AS INTEGER[])}}),
      lambda a, g: CASE WHEN list_has_any(a.pos, g.pos) THEN {{'id': 0, 'pos': list_distinct(list_concat(a.pos, g.pos)), 'gone': list_append(a.gone, g.id)}} ELSE a END,
      {{'id': 0, 'pos': cand, 'gone': CAST([] AS INTEGER[])}}) END AS f
  FROM cands LEFT JOIN grams USING (doc_id)),
whole AS (SELECT doc_id, ids, f.pos AS cand, f.gone AS gone, coalesce(list_transform(gs, lambda g: g.id), CAST([] AS INTEGER[])) AS gids FROM folded)"""

_LOGITS = "lg AS (SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred, label FROM embeddings)"


def _conf(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""conf AS (SELECT {b}label, CAST(pred AS INTEGER) AS pred, count(*) AS n FROM {src} GROUP BY ALL),
cls AS (SELECT {b}c, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(tp) AS DOUBLE) AS tp FROM (
  SELECT {b}label AS c, n AS t, 0 AS p, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT {b}pred, 0, n, 0 FROM conf) GROUP BY ALL),
sc AS (SELECT {b}round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t + p = 0 THEN 0 ELSE 2 * tp / (t + p) END), 6) AS f1,
  round(CASE WHEN (sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t)) = 0 THEN 0 ELSE
    (sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) END, 6) AS matthews_correlation,
  round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END), 6) AS "precision", round(avg(CASE WHEN t = 0 THEN 0 ELSE tp / t END), 6) AS recall
  FROM cls {'GROUP BY ' + by if by else ''})"""


_METRICS = 'accuracy, f1, matthews_correlation, "precision", recall'
_VECS = "vs AS (SELECT vec_id // 10 AS seq_id, CAST(vec_id % 10 AS INTEGER) AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_ATTN = f"""{_VECS}, sc AS (SELECT a.seq_id, a.pos AS qpos, b.pos AS kpos, list_dot_product(a.v, b.v) / 8.0 - 0.5 * abs(b.pos - a.pos) AS s FROM vs a JOIN vs b USING (seq_id)),
ex AS (SELECT seq_id, qpos, kpos, exp(s - max(s) OVER (PARTITION BY seq_id, qpos)) AS e FROM sc),
wt AS (SELECT seq_id, qpos, kpos, e / sum(e) OVER (PARTITION BY seq_id, qpos) AS w FROM ex)"""
_J = "array_to_string"
_KMERS = "CASE WHEN length(text) >= 6 THEN list_transform(range(1, length(text) - 4), lambda i: substr(text, i, 6)) ELSE [] END"


def _kmers4(c: str) -> str:
    return f"CASE WHEN length({c}) >= 4 THEN array_to_string(list_transform(range(1, length({c}) - 2), lambda i: substr({c}, i, 4)), ' ') ELSE '' END"


_SLOPES = """hs AS (SELECT h AS heads, i AS head, CASE WHEN i < w THEN power(2.0, -8.0 * (i + 1) / w) ELSE power(2.0, -8.0 * (2 * (i - w) + 1) / (2 * w)) END AS slope
  FROM (SELECT h, w, unnest(range(0, h)) AS i FROM (VALUES (8, 8), (12, 8), (16, 16)) t(h, w)))"""

ORACLE = {
    "seq_complement": "SELECT item_id, translate(translate(text, 'acgt', 'ACGT'), 'ATCG', 'TAGC') AS seq, reverse(translate(translate(text, 'acgt', 'ACGT'), 'ATCG', 'TAGC')) AS rev FROM benchmark",
    "seq_kmer6": f"SELECT item_id, {_J}({_KMERS}, ' ') AS kmers FROM benchmark",
    "seq_kmer_counts": f"SELECT kmer, count(*) AS n FROM (SELECT unnest({_KMERS}) AS kmer FROM benchmark) GROUP BY kmer",
    "tok_truncate": f"WITH {_TOKS}, {_CUT} SELECT doc_id, {_J}(tokens, ' ') AS toks, CAST(len(tokens) AS BIGINT) AS n FROM cut",
    "tok_encode": f"WITH {_TOKEN_HALF} SELECT doc_id, {_J}(ids, ' ') AS input_ids, {_J}(masks, ' ') AS attention_mask FROM enc",
    "pair_encode": f"""WITH p AS (SELECT conv_id, min_by(text, turn) AS a, max_by(text, turn) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id AS doc_id, {_J}(list_concat(list_concat(['[CLS]'], list_concat(regexp_extract_all(a, '{WORD}'), regexp_extract_all(b, '{WORD}'))[1:{L - 2}]), ['[SEP]']), ' ') AS toks FROM p""",
    "ngram_hits": f"WITH {_HITS} SELECT doc_id, ngram, start_pos, end_pos FROM hits",
    "ngram_match_topk": f"WITH {_MATCHED} SELECT doc_id, ngram_id, rk, {_J}(positions, ' ') AS positions FROM matched",
    "ngram_matrix_rows": f"WITH {_MATCHED} SELECT doc_id, rk, unnest(positions) AS pos FROM matched",
    "ngram_record": f"""WITH {_MATCHED}, g AS (SELECT doc_id, list(ngram_id ORDER BY rk) AS ids, sum(len(positions)) AS ones FROM matched GROUP BY doc_id),
r AS (SELECT doc_id, list_concat(coalesce(ids, CAST([] AS INTEGER[])), list_transform(range(0, {S.cap} - len(coalesce(ids, CAST([] AS INTEGER[])))), lambda x: 0)) AS ids, coalesce(ones, 0) AS ones FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, {_J}(ids, ' ') AS ngram_input_ids, {_J}(list_transform(ids, lambda x: CAST(x <> 0 AS INTEGER)), ' ') AS ngram_attention_mask, CAST(ones AS BIGINT) AS match_ones, CAST({S.cap} AS BIGINT) AS match_rows FROM r""",
    "ngram_position_matrix": f"""WITH {_MATCHED}, c AS (SELECT doc_id, pos, count(*) AS n FROM (SELECT doc_id, unnest(positions) AS pos FROM matched) GROUP BY ALL),
grid AS (SELECT doc_id, unnest(range(0, {L})) AS pos FROM documents)
SELECT doc_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY pos) AS per_position, CAST({S.cap} AS BIGINT) AS n_types FROM grid LEFT JOIN c USING (doc_id, pos) GROUP BY doc_id""",
    "mask_select": f"WITH {_TOKEN_HALF}, {_CANDS} SELECT doc_id, unnest(cand) AS pos FROM cands",
    "mask_tokens": f"WITH {_TOKEN_HALF}, {_CANDS} SELECT doc_id, {_J}({_NEW}, ' ') AS input_ids, {_J}({_LABELS}, ' ') AS labels FROM cands",
    "mask_whole_ngram": f"""WITH {_FOLD} SELECT doc_id, {_J}({_NEW}, ' ') AS input_ids, {_J}({_LABELS}, ' ') AS labels,
{_J}(list_concat(list_filter(gids, lambda g: NOT list_contains(gone, g)), list_transform(gone, lambda g: 0)), ' ') AS ngram_input_ids FROM whole""",
    "mlm_positions": f"""WITH {_FOLD}, fl AS (SELECT doc_id, unnest({_LABELS}) AS label, generate_subscripts(ids, 1) - 1 AS pos FROM whole)
SELECT doc_id, pos, CAST(label AS INTEGER) AS label, label > 0 AS in_loss FROM fl WHERE label > 0 OR pos = 0""",
    "label_stats": "SELECT count(*) AS n_rows, count(DISTINCT quality) AS num_labels FROM labels",
    "pred_argmax": f"WITH {_LOGITS} SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM lg",
    "cls_confusion": f"WITH {_LOGITS}, {_conf('lg')} SELECT label, pred, n FROM conf",
    "cls_metrics": f"WITH {_LOGITS}, {_conf('lg')} SELECT {_METRICS} FROM sc",
    "cls_metrics_ignore": f"WITH {_LOGITS}, ok AS (SELECT * FROM lg WHERE vec_id % 7 <> 0), {_conf('ok')} SELECT {_METRICS} FROM sc",
    "metrics_history": f"""WITH {_LOGITS}, st AS (SELECT vec_id % 4 AS step, label, pred FROM lg), {_conf('st', 'step')}
SELECT 'epoch_' || CAST(step // 2 AS VARCHAR) AS epoch_key, {_METRICS} FROM sc WHERE step % 2 = 1""",
    "ragged_cu_seqlens": f"""WITH {_TOKEN_HALF}, n AS (SELECT doc_id, CAST(list_sum(masks) AS BIGINT) AS n FROM enc)
SELECT doc_id, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cu_start, max(n) OVER () AS max_n FROM n""",
    "ragged_unpad": f"WITH {_TOKEN_HALF} SELECT doc_id, pos, id FROM rows_ WHERE mask = 1",
    "ragged_pad": f"WITH {_TOKEN_HALF} SELECT doc_id, string_agg(CAST(CASE WHEN mask = 1 THEN id ELSE 0 END AS VARCHAR), ' ' ORDER BY pos) AS ids FROM rows_ GROUP BY doc_id",
    "alibi_bias": f"""WITH {_SLOPES}, p AS (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS x)
SELECT heads, CAST(head AS INTEGER) AS head, a.x AS qpos, b.x AS kpos, round(0.0 - slope * abs(b.x - a.x), 9) AS bias FROM hs, p a, p b""",
    "attn_weights": f"WITH {_ATTN} SELECT seq_id, qpos, kpos, round(w, 6) AS weight FROM wt",
    "attn_output": f"""WITH {_ATTN}, dv AS (SELECT seq_id, pos AS kpos, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM vs)
SELECT seq_id, qpos, CAST(dim AS INTEGER) AS dim, round(sum(w * x), 5) AS "value" FROM wt JOIN dv USING (seq_id, kpos) GROUP BY ALL""",
    "ngram_fusion": f"""WITH {_MATCHED}, e AS (SELECT vec_id, unnest(embedding[1:4]) AS x, generate_subscripts(embedding[1:4], 1) - 1 AS dim FROM embeddings)
SELECT doc_id, pos, CAST(dim AS INTEGER) AS dim, round(sum(CAST(x AS DOUBLE)), 6) AS "value"
FROM (SELECT doc_id, ngram_id % (SELECT count(*) FROM embeddings) AS vec_id, unnest(positions) AS pos FROM matched) JOIN e USING (vec_id) GROUP BY ALL""",
    "embed_lookup_add": "SELECT doc_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 0.5)), 5) AS total FROM labels JOIN embeddings ON vec_id = doc_id % 500",
    "layer_norm": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_avg(v) AS mu FROM v), s AS (SELECT vec_id, v, mu, sqrt(list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) + 1e-12) AS sd FROM m)
SELECT vec_id, round((v[1] - mu) / sd, 6) AS "first", round((v[64] - mu) / sd, 6) AS "last", round(tanh((v[1] - mu) / sd), 6) AS pooled FROM s""",
    "additive_mask": f"WITH {_TOKEN_HALF} SELECT doc_id, pos, (1 - mask) * CAST(-10000.0 AS DOUBLE) AS bias FROM rows_",
    "pool_first": f"WITH {_VECS} SELECT seq_id, round(list_sum(v), 5) AS total FROM vs WHERE pos = 0",
    "loss_ce": """WITH l AS (SELECT list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings)
SELECT round(avg(ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) + list_max(x) - x[label + 1]), 6) AS loss FROM l""",
    "loss_mse": "SELECT round(avg((CAST(label AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) * (CAST(label AS DOUBLE) - CAST(embedding[1] AS DOUBLE))), 6) AS loss FROM embeddings",
    "loss_bce": """SELECT round(avg(ln(1 + exp(-abs(x))) + greatest(x, 0) - x * y), 6) AS loss
FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(label % 2 AS DOUBLE) AS y FROM embeddings)""",
    "ragged_cu_wide": "SELECT doc_id, lang, source, md5(text) AS digest, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cu_start FROM documents",
    "scan_by_source": """SELECT doc_id, source, CAST(sum(n_chars) OVER w AS BIGINT) AS chars, CAST(count(*) OVER w AS BIGINT) AS nth FROM documents
WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "subset_positions": f"""WITH {_FOLD}, fl AS (SELECT doc_id, unnest({_LABELS}) > 0 AS hit, generate_subscripts(ids, 1) - 1 AS pos FROM whole),
o AS (SELECT doc_id, hit, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM fl WHERE hit OR pos = 0)
SELECT doc_id, coalesce(string_agg(CAST(place AS VARCHAR), ' ' ORDER BY pos) FILTER (hit), '') AS places, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS needed FROM o GROUP BY doc_id""",
    "debug_head": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 16",
    "dummy_token": f"""WITH {_TOKEN_HALF}, e AS (SELECT doc_id, list(id ORDER BY pos) AS ids, len(any_value(tokens)) + 2 AS n FROM rows_ JOIN cut USING (doc_id) GROUP BY doc_id)
SELECT doc_id, {_J}(list_concat(ids[1:n], [0]), ' ') AS input_ids, {_J}(list_concat(list_transform(range(0, n), lambda x: 1), [0]), ' ') AS attention_mask FROM e""",
    "csv_labels": "SELECT md5(text) AS digest, CAST(length(text) AS INTEGER) AS n, quality AS label FROM documents JOIN labels USING (doc_id)",
    "csv_pairs": f"""WITH k AS (SELECT item_id, text, reverse(text) AS back FROM benchmark)
SELECT md5({_kmers4('text')}) AS a, md5({_kmers4('back')}) AS b, CAST(item_id AS INTEGER) AS label FROM k""",
    "csv_errors": """SELECT CASE doc_id % 5 WHEN 0 THEN 'too few fields' WHEN 1 THEN 'label is not an integer' ELSE 'none' END AS problem, count(*) AS n
FROM (SELECT doc_id FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 2 FROM range(16)) GROUP BY ALL""",
    "ngram_hits_large": f"""WITH {_TOKS}, {_CUT}, {_windows('wins', 'toks')}, dict AS (SELECT ngram FROM wins GROUP BY ngram HAVING count(*) > 1), {_windows('cwins', 'cut')}
SELECT doc_id, ngram, start_pos, start_pos + len AS end_pos FROM cwins JOIN dict USING (ngram)""",
    "metrics_history_split": f"""WITH lg AS (SELECT CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, vec_id % 12 // 6 AS epoch, vec_id // 12 % 4 AS step,
  list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred, label FROM embeddings), {_conf('lg', 'split, epoch, step')},
top AS (SELECT *, row_number() OVER (PARTITION BY split, epoch ORDER BY step DESC) AS nth FROM sc)
SELECT split, epoch, step, {_METRICS} FROM top WHERE nth = 1""",
    "cls_metrics_observed": f"WITH lg AS (SELECT list_position(embedding, list_max(embedding)) - 1 AS pred, label FROM embeddings), {_conf('lg')} SELECT {_METRICS} FROM sc",
    "loss_ce_whole": """WITH l AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings)
SELECT round(avg(ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) + list_max(x) - x[label + 1]), 6) AS loss FROM l""",
    "flat_logits": "SELECT label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred, count(*) AS n FROM embeddings GROUP BY ALL",
    "ngram_fusion_whole": f"""WITH {_MATCHED}, g AS (SELECT doc_id, ngram_id % (SELECT count(*) FROM embeddings) AS vec_id, unnest(positions) AS pos FROM matched),
v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s, list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) AS w FROM embeddings)
SELECT doc_id, pos, round(sum(s), 4) AS total, round(sum(w), 3) AS weighted FROM g JOIN v USING (vec_id) GROUP BY ALL""",
    "embed_tokens": f"""WITH {_TOKEN_HALF}, v AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 0.5)) AS s FROM embeddings)
SELECT doc_id, round(sum(s), 3) AS total FROM rows_ JOIN v ON vec_id = id % (SELECT count(*) FROM embeddings) GROUP BY doc_id""",
}
