"""DuckDB twins of the pipeline stages, as named CTEs.

``sql(final, "cte", ...)`` returns ``WITH <cte and its dependencies> <final>``.
The twins are written independently of the Spark plans (relational n-gram
counting, list-reduce LCS, window-function numbering) so that the oracle check
compares two different computations of the same definition.
"""

from __future__ import annotations

from ..functions.prompts import sql_extract_answer, sql_render_inference_prompt
from ..functions.text import sql_bleu_tokens, sql_cap_words, sql_ngrams, sql_rouge_tokens, sql_strip
from ..operators.generate import END_MARK, MAX_NEW_WORDS, NATIVE_GENERATORS
from ..operators.split import sql_seeded_split
from ..operators.triplets import sql_facts_to_triplets
from ..sources.fixtures import (CONV_TRIPLETS_SQL, FACTS_SQL, ID_TRIPLETS_SQL, PARAMETERS_SQL, REGISTRY_SQL, RUNS_SQL,
                                WEIGHTS_SQL)

K = "model_id, variant, distribution, example_id"

LCS = """list_reduce({a},
  lambda row, tok: (list_transform([list_filter(range(1, len({b}) + 1), lambda k: {b}[k] = tok)],
      lambda M: list_transform(range(0, len({b}) + 1), lambda j:
          row[j + 1] + CASE WHEN j > 0 AND list_max(list_filter(M, lambda k: k <= j)) IS NOT NULL
                             AND row[list_max(list_filter(M, lambda k: k <= j))] = row[j + 1] THEN 1 ELSE 0 END)))[1],
  list_transform(range(0, len({b}) + 1), lambda j: 0))[len({b}) + 1]"""


def sql_lcs(a: str, b: str) -> str:
    """LCS length of two token lists (DP row carried through list_reduce)."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {LCS.format(a=a, b=b)} END"


_ROW = """list_transform([list_filter(range(1, len(c) + 1), lambda k: c[k] = tok)],
      lambda M: list_transform(range(0, len(c) + 1), lambda j:
          old[j + 1] + CASE WHEN j > 0 AND list_max(list_filter(M, lambda k: k <= j)) IS NOT NULL
                             AND old[list_max(list_filter(M, lambda k: k <= j))] = old[j + 1] THEN 1 ELSE 0 END))[1]"""
# full LCS table of token lists r (rows) and c (columns), 1-based: T(i, j) = t[i + 1][j + 1]
LCS_TABLE = ("list_reduce(r, lambda rows, tok: list_append(rows, " + _ROW.replace("old", "rows[len(rows)]")
             + "), [list_transform(range(0, len(c) + 1), lambda j: 0)])")
# 1-based positions in r of the LCS found by the standard backtrack of table t
LCS_BACKTRACK = """list_reduce(range(len(r) + len(c)), lambda s, step:
    CASE WHEN s.i > 0 AND s.j > 0 THEN
      CASE WHEN r[s.i] = c[s.j] THEN {'i': s.i - 1, 'j': s.j - 1, 'acc': list_prepend(s.i, s.acc)}
           WHEN t[s.i + 1][s.j] > t[s.i][s.j + 1] THEN {'i': s.i, 'j': s.j - 1, 'acc': s.acc}
           ELSE {'i': s.i - 1, 'j': s.j, 'acc': s.acc} END
    ELSE s END,
    {'i': len(r), 'j': len(c), 'acc': []::INTEGER[]}).acc"""


def _line_tokens_sql(e: str) -> str:
    return (f"list_transform(list_filter(string_split({e}, chr(10)), lambda x: length(x) > 0), "
            f"lambda l: {sql_rouge_tokens('l')})")


def f1(hit: str, lp: str, lr: str) -> str:
    p = f"({hit}) / greatest({lp}, 1)"
    r = f"({hit}) / greatest({lr}, 1)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def _continuation(model: str) -> str:
    if model == "lead":
        return sql_cap_words("split_part(observations, chr(10), 1)", MAX_NEW_WORDS)
    if model == "last_line":
        return sql_cap_words("split_part(observations, chr(10), -1)", MAX_NEW_WORDS)
    return sql_cap_words("question", MAX_NEW_WORDS)


def _gen_case(models=NATIVE_GENERATORS) -> str:
    return "CASE " + " ".join(f"WHEN m.model_id = '{m}' THEN {_continuation(m)}" for m in models) + " END"


def _overlap(a: str, b: str, n: int) -> str:
    ga, gb = sql_ngrams(a, n), sql_ngrams(b, n)
    return f"""SELECT {K}, sum(least(x.c, y.c)) AS o FROM
  (SELECT {K}, g, count(*) AS c FROM (SELECT {K}, unnest({ga}) AS g FROM tok) GROUP BY ALL) x
  JOIN (SELECT {K}, g, count(*) AS c FROM (SELECT {K}, unnest({gb}) AS g FROM tok) GROUP BY ALL) y
  USING (model_id, variant, distribution, example_id, g) GROUP BY ALL"""


def _nonempty_lines(e: str) -> str:
    return f"len(list_filter(string_split({e}, chr(10)), lambda x: length(x) > 0))"


def _encode_sql(src: str, keys=("example_id",)) -> str:
    k = ", ".join(keys)

    def ids(col: str, out: str) -> str:
        return f"""(SELECT {k}, list(coalesce(v.token_id, 2) ORDER BY i) AS {out} FROM
            (SELECT {k}, i, toks[i] AS token FROM
               (SELECT {k}, toks, unnest(range(1, len(toks) + 1)) AS i FROM
                  (SELECT {k}, {sql_rouge_tokens(col)} AS toks FROM {src})))
            LEFT JOIN vocab v USING (token) GROUP BY {k})"""
    sel = ", ".join(f"e.{c}" for c in keys)
    return f"""SELECT {sel}, coalesce(p.prompt_ids, []::INTEGER[]) AS prompt_ids,
        coalesce(a.answer_ids, []::INTEGER[]) AS answer_ids
        FROM {src} e LEFT JOIN {ids('prompt', 'prompt_ids')} p USING ({k})
        LEFT JOIN {ids('response', 'answer_ids')} a USING ({k})"""


# One-sided Jacobi on the columns of a weight matrix: every step rotates 32 disjoint pairs of the 64 columns (a round
# robin of 63 steps meets all pairs) until all are orthogonal; their squared lengths are then the eigenvalues of W'W.
WIDTH, SWEEPS = 64, 11
STEPS = (WIDTH - 1) * SWEEPS
_TURN = f"(2 * (p.step % {WIDTH - 1}) - p.i + {WIDTH - 1}) % {WIDTH - 1}"
SINGULAR = f"""
  SELECT 0 AS step, model_id, variant, layer, i, list("values"[i + 1] ORDER BY row_id) AS x
  FROM weights, range(0, {WIDTH}) t(i) GROUP BY model_id, variant, layer, i
  UNION ALL
  SELECT step + 1, model_id, variant, layer, i,
         CASE WHEN abs(g) <= 1e-15 * sqrt(a * b) THEN x
              ELSE list_transform(list_zip(x, y), lambda z: z[1] * co + z[2] * si) END
  FROM (SELECT *, 1 / sqrt(1 + t * t) AS co, (CASE WHEN i < j THEN -1 ELSE 1 END) * t / sqrt(1 + t * t) AS si
        FROM (SELECT *, CASE WHEN g = 0 THEN 0 ELSE (CASE WHEN (b - a) / (2 * g) < 0 THEN -1 ELSE 1 END)
                        / (abs((b - a) / (2 * g)) + sqrt(1 + ((b - a) / (2 * g)) ** 2)) END AS t
              FROM (SELECT p.step, p.model_id, p.variant, p.layer, p.i, q.i AS j, p.x, q.x AS y,
                           list_dot_product(p.x, q.x) AS g,
                           CASE WHEN p.i < q.i THEN list_dot_product(p.x, p.x) ELSE list_dot_product(q.x, q.x) END AS a,
                           CASE WHEN p.i < q.i THEN list_dot_product(q.x, q.x) ELSE list_dot_product(p.x, p.x) END AS b
                    FROM singular p JOIN singular q ON q.model_id = p.model_id AND q.variant = p.variant AND q.layer = p.layer
                     AND q.i = CASE WHEN p.i = {WIDTH - 1} THEN p.step % {WIDTH - 1} WHEN {_TURN} = p.i THEN {WIDTH - 1}
                               ELSE {_TURN} END)))
  WHERE step < {STEPS}"""

CTES: dict[str, tuple[str, list[str]]] = {
    "singular": (SINGULAR, ["weights"]),
    "eig": (f"""SELECT model_id, variant, layer, ev, row_number() OVER (PARTITION BY model_id, variant, layer ORDER BY ev) AS k
        FROM (SELECT *, max(ev) OVER (PARTITION BY model_id, variant, layer) AS top FROM
               (SELECT model_id, variant, layer, list_dot_product(x, x) AS ev FROM singular WHERE step = {STEPS}))
        WHERE ev > top * 1e-10""", ["singular"]),
    "slope": ("""SELECT a.model_id, a.variant, a.layer, a.k, a.ev AS xmin, count(*) AS n, 1.0 + count(*) / sum(ln(b.ev / a.ev)) AS alpha
        FROM eig a JOIN eig b ON a.model_id = b.model_id AND a.variant = b.variant AND a.layer = b.layer AND b.k >= a.k
        GROUP BY ALL HAVING sum(ln(b.ev / a.ev)) > 0""", ["eig"]),
    "power_law": ("""SELECT model_id, variant, layer, alpha FROM (
        SELECT *, row_number() OVER (PARTITION BY model_id, variant, layer ORDER BY dist, k) AS place FROM (
          SELECT s.model_id, s.variant, s.layer, s.k, s.alpha, max(greatest(
              abs((e.k - s.k + 1) / n::DOUBLE - (1.0 - pow(e.ev / xmin, 1.0 - alpha))),
              abs((e.k - s.k) / n::DOUBLE - (1.0 - pow(e.ev / xmin, 1.0 - alpha))))) AS dist
          FROM slope s JOIN eig e ON s.model_id = e.model_id AND s.variant = e.variant AND s.layer = e.layer AND e.k >= s.k
          GROUP BY ALL)) WHERE place = 1""", ["slope"]),
    "layer_stats": ("""SELECT model_id, variant, layer, metric, round(value, 6) AS value FROM (
        WITH w AS (SELECT e.model_id, e.variant, e.layer, sum(ev) AS total, max(ev) AS top, any_value(alpha) AS alpha,
                          log10(sum(pow(ev, alpha))) AS log_alpha_norm
                   FROM eig e LEFT JOIN power_law p ON e.model_id = p.model_id AND e.variant = p.variant AND e.layer = p.layer
                   GROUP BY e.model_id, e.variant, e.layer)
        SELECT model_id, variant, layer, 'log_norm' AS metric, log10(total) AS value FROM w
        UNION ALL SELECT model_id, variant, layer, 'log_spectral_norm', log10(top) FROM w
        UNION ALL SELECT model_id, variant, layer, 'stable_rank', total / top FROM w
        UNION ALL SELECT model_id, variant, layer, 'alpha', alpha FROM w
        UNION ALL SELECT model_id, variant, layer, 'alpha_weighted', alpha * log10(top) FROM w
        UNION ALL SELECT model_id, variant, layer, 'log_alpha_norm', log_alpha_norm FROM w) WHERE value IS NOT NULL""",
                    ["eig", "power_law"]),
    "spectra": ("""SELECT model_id, variant, metric, round(avg(value), 6) AS value FROM layer_stats GROUP BY ALL""", ["layer_stats"]),
    "spectra_cmp": ("""SELECT model_id, metric, b.value AS baseline, f.value AS finetuned, round(f.value - b.value, 6) AS delta
        FROM (SELECT * FROM spectra WHERE variant = 'baseline') b JOIN (SELECT * FROM spectra WHERE variant = 'finetuned') f
        USING (model_id, metric)""", ["spectra"]),
    "id_trip": (ID_TRIPLETS_SQL, []),
    "id_split": (sql_seeded_split("SELECT * FROM id_trip", "triplet_id"), ["id_trip"]),
    "id_ex": (f"""SELECT triplet_id AS example_id, dataset, form, split,
        {sql_render_inference_prompt('observations', 'question')} AS prompt, {sql_strip('answer')} AS response
        FROM id_split""", ["id_split"]),
    "facts": (FACTS_SQL, []),
    "od_trip": (sql_facts_to_triplets("SELECT * FROM facts"), ["facts"]),
    "od_ex": (f"""SELECT triplet_id AS example_id, dataset, form, 'od_val' AS split,
        {sql_render_inference_prompt('observations', 'question')} AS prompt, {sql_strip('answer')} AS response
        FROM od_trip""", ["od_trip"]),
    "examples": ("SELECT *, prompt || response AS text FROM (SELECT * FROM id_ex UNION ALL BY NAME SELECT * FROM od_ex)",
                 ["id_ex", "od_ex"]),
    "parsed": (f"""SELECT example_id, dataset, form, split, prompt,
        {sql_strip("replace(split_part(prompt, 'Question:' || chr(10), 1), 'Training Observations:' || chr(10), '')")}
            AS observations,
        {sql_strip("split_part(split_part(prompt, 'Question:' || chr(10), 2), chr(10) || chr(10) || 'Answer:' || chr(10), 1)")}
            AS question,
        {sql_strip('response')} AS reference, contains(prompt, 'Question:' || chr(10)) AS parse_ok
        FROM examples""", ["examples"]),
    "inputs": ("""SELECT CASE WHEN split = 'id_val' THEN 'id' ELSE 'od' END AS distribution, example_id,
        observations, question, reference FROM parsed WHERE split IN ('id_val', 'od_val')""", ["parsed"]),
    "base_gen": (f"""SELECT m.model_id, distribution, example_id, observations, question, reference, prompt,
        prompt || {_gen_case()} || chr(10) || '{END_MARK}' AS full_text
        FROM (SELECT *, {sql_render_inference_prompt('observations', 'question')} AS prompt FROM inputs),
             (VALUES {', '.join(f"('{m}')" for m in NATIVE_GENERATORS)}) m(model_id)""", ["inputs"]),
    "train": ("SELECT example_id, observations, reference AS response FROM parsed WHERE split = 'train'", ["parsed"]),
    "tt": (f"""SELECT DISTINCT train_id, token FROM
        (SELECT example_id AS train_id, unnest({sql_rouge_tokens('observations')}) AS token FROM train)""", ["train"]),
    "token_weights": ("SELECT token, 1000000000 // count(*) AS weight FROM tt GROUP BY token", ["tt"]),
    "train_sizes": ("SELECT train_id, count(*) AS size FROM tt GROUP BY train_id", ["tt"]),
    "vt": (f"""SELECT DISTINCT distribution, example_id, token FROM
        (SELECT distribution, example_id, unnest({sql_rouge_tokens('observations')}) AS token FROM inputs)""",
           ["inputs"]),
    "scores": ("""SELECT distribution, example_id, train_id, CAST(sum(weight) * 1000 // any_value(size) AS BIGINT) AS score
        FROM vt JOIN token_weights USING (token) JOIN tt USING (token) JOIN train_sizes USING (train_id) GROUP BY ALL""",
               ["vt", "tt", "token_weights", "train_sizes"]),
    "best": ("""SELECT distribution, example_id, train_id, score FROM (SELECT *, row_number() OVER
        (PARTITION BY distribution, example_id ORDER BY score DESC, train_id ASC) AS rn FROM scores) WHERE rn = 1""",
             ["scores"]),
    "hits": ("""SELECT b.distribution, b.example_id, b.train_id, b.score, t.response AS answer
        FROM best b JOIN train t ON t.example_id = b.train_id""", ["best", "train"]),
    "ft_gen": (f"""SELECT g.model_id, g.distribution, g.example_id, g.observations, g.question, g.reference, g.prompt,
        g.prompt || coalesce(h.answer, substr(g.full_text, length(g.prompt) + 1)) ||
        CASE WHEN h.answer IS NOT NULL THEN chr(10) || '{END_MARK}' ELSE '' END AS full_text
        FROM base_gen g LEFT JOIN hits h USING (distribution, example_id)""", ["base_gen", "hits"]),
    "preds": (f"""SELECT model_id, 'baseline' AS variant, distribution, example_id, observations, question, reference,
            {sql_extract_answer('prompt', 'full_text')} AS prediction FROM base_gen
        UNION ALL
        SELECT model_id, 'finetuned' AS variant, distribution, example_id, observations, question, reference,
            {sql_extract_answer('prompt', 'full_text')} AS prediction FROM ft_gen""", ["base_gen", "ft_gen"]),
    "tok": (f"""SELECT {K}, prediction, reference,
        {sql_rouge_tokens('prediction')} AS rp, {sql_rouge_tokens('reference')} AS rr,
        {sql_bleu_tokens('prediction')} AS bp, {sql_bleu_tokens('reference')} AS br FROM preds""", ["preds"]),
    "ov_r1": (_overlap("rp", "rr", 1), ["tok"]),
    "ov_r2": (_overlap("rp", "rr", 2), ["tok"]),
    **{f"ov_b{n}": (_overlap("bp", "br", n), ["tok"]) for n in range(1, 5)},
    "ex_scores": (f"""SELECT {K}, lp, lr, sys_len, ref_len,
        {f1('o1', 'lp', 'lr')} AS rouge1,
        {f1('o2', 'greatest(lp - 1, 0)', 'greatest(lr - 1, 0)')} AS rouge2,
        CASE WHEN lp = 0 OR lr = 0 THEN 0.0 ELSE {f1('lcs', 'lp', 'lr')} END AS rougeL,
        -- summary-level LCS equals LCS when each side has at most one non-empty line
        CASE WHEN lp = 0 OR lr = 0 THEN 0.0 WHEN pl <= 1 AND rl <= 1 THEN {f1('lcs', 'lp', 'lr')} END AS rougeLsum,
        m1, m2, m3, m4
      FROM (SELECT t.model_id, t.variant, t.distribution, t.example_id,
              len(rp) AS lp, len(rr) AS lr, len(bp) AS sys_len, len(br) AS ref_len,
              {_nonempty_lines('prediction')} AS pl, {_nonempty_lines('reference')} AS rl,
              coalesce(a.o, 0) AS o1, coalesce(b.o, 0) AS o2, {sql_lcs('rp', 'rr')} AS lcs,
              coalesce(c1.o, 0) AS m1, coalesce(c2.o, 0) AS m2, coalesce(c3.o, 0) AS m3, coalesce(c4.o, 0) AS m4
            FROM tok t
            LEFT JOIN ov_r1 a USING (model_id, variant, distribution, example_id)
            LEFT JOIN ov_r2 b USING (model_id, variant, distribution, example_id)
            LEFT JOIN ov_b1 c1 USING (model_id, variant, distribution, example_id)
            LEFT JOIN ov_b2 c2 USING (model_id, variant, distribution, example_id)
            LEFT JOIN ov_b3 c3 USING (model_id, variant, distribution, example_id)
            LEFT JOIN ov_b4 c4 USING (model_id, variant, distribution, example_id))""",
                  ["tok", "ov_r1", "ov_r2", "ov_b1", "ov_b2", "ov_b3", "ov_b4"]),
    "corpus": ("""SELECT model_id, variant, distribution, count(*) AS n_examples,
        avg(rouge1) AS rouge1, avg(rouge2) AS rouge2, avg(rougeL) AS rougeL, avg(rougeLsum) AS rougeLsum,
        CAST(sum(m1) AS DOUBLE) AS M1, CAST(sum(m2) AS DOUBLE) AS M2, CAST(sum(m3) AS DOUBLE) AS M3,
        CAST(sum(m4) AS DOUBLE) AS M4,
        CAST(sum(sys_len) AS DOUBLE) AS T1, CAST(sum(greatest(sys_len - 1, 0)) AS DOUBLE) AS T2,
        CAST(sum(greatest(sys_len - 2, 0)) AS DOUBLE) AS T3, CAST(sum(greatest(sys_len - 3, 0)) AS DOUBLE) AS T4,
        CAST(sum(sys_len) AS DOUBLE) AS S, CAST(sum(ref_len) AS DOUBLE) AS R
        FROM ex_scores GROUP BY ALL""", ["ex_scores"]),
    "bleu_g": ("""SELECT model_id, variant, distribution, n_examples,
        CASE WHEN M1 = 0 OR T4 = 0 OR S = 0 THEN 0.0 ELSE
          (CASE WHEN S >= R THEN 1.0 ELSE exp(1.0 - R / S) END) * exp((
             ln(CASE WHEN M1 > 0 THEN 100.0 * M1 / T1 ELSE 100.0 / (pow(2, z1) * T1) END) +
             ln(CASE WHEN M2 > 0 THEN 100.0 * M2 / T2 ELSE 100.0 / (pow(2, z2) * T2) END) +
             ln(CASE WHEN M3 > 0 THEN 100.0 * M3 / T3 ELSE 100.0 / (pow(2, z3) * T3) END) +
             ln(CASE WHEN M4 > 0 THEN 100.0 * M4 / T4 ELSE 100.0 / (pow(2, z4) * T4) END)) / 4.0) END AS bleu
        FROM (SELECT *, CAST(M1 = 0 AS INT) AS z1, CAST(M1 = 0 AS INT) + CAST(M2 = 0 AS INT) AS z2,
                 CAST(M1 = 0 AS INT) + CAST(M2 = 0 AS INT) + CAST(M3 = 0 AS INT) AS z3,
                 CAST(M1 = 0 AS INT) + CAST(M2 = 0 AS INT) + CAST(M3 = 0 AS INT) + CAST(M4 = 0 AS INT) AS z4
              FROM corpus)""", ["corpus"]),
    "metrics": ("""SELECT model_id, variant, distribution, metric, round(value, 6) AS value, n_examples FROM (
        SELECT model_id, variant, distribution, n_examples, 'rouge1' AS metric, rouge1 AS value FROM corpus
        UNION ALL SELECT model_id, variant, distribution, n_examples, 'rouge2', rouge2 FROM corpus
        UNION ALL SELECT model_id, variant, distribution, n_examples, 'rougeL', rougeL FROM corpus
        UNION ALL SELECT model_id, variant, distribution, n_examples, 'rougeLsum', rougeLsum FROM corpus
        UNION ALL SELECT model_id, variant, distribution, n_examples, 'bleu', bleu FROM bleu_g)""",
                ["corpus", "bleu_g"]),
    "comparison": ("""SELECT model_id, distribution, metric,
        max(CASE WHEN variant = 'baseline' THEN value END) AS baseline,
        max(CASE WHEN variant = 'finetuned' THEN value END) AS finetuned,
        round(max(CASE WHEN variant = 'finetuned' THEN value END) - max(CASE WHEN variant = 'baseline' THEN value END), 6)
            AS delta
        FROM metrics GROUP BY ALL""", ["metrics"]),
    "train_ex": ("SELECT example_id, prompt, response FROM examples WHERE split = 'train'", ["examples"]),
    "val_ex": ("SELECT dataset, example_id, prompt, response FROM examples WHERE split IN ('id_val', 'od_val')",
               ["examples"]),
    "vocab": (f"""SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 2 AS INTEGER) AS token_id,
        cnt AS count FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(list_concat(
            {sql_rouge_tokens('prompt')}, {sql_rouge_tokens('response')})) AS token FROM train_ex) GROUP BY token)""",
              ["train_ex"]),
    "enc": (_encode_sql("train_ex"), ["train_ex", "vocab"]),
    "enc_val": (_encode_sql("val_ex", ["dataset", "example_id"]), ["val_ex", "vocab"]),
    "masked": ("""SELECT example_id, prompt_ids, answer_ids, input_ids, kept_prompt,
        list_concat(list_transform(range(kept_prompt), lambda x: -100),
                    list_slice(input_ids, kept_prompt + 1, len(input_ids))) AS labels,
        list_transform(range(len(input_ids)), lambda x: 1) AS attention_mask
        FROM (SELECT *, CASE WHEN len(prompt_ids) + len(answer_ids) > 512
                 THEN list_slice(list_concat(prompt_ids, answer_ids), len(prompt_ids) + len(answer_ids) - 511,
                                 len(prompt_ids) + len(answer_ids))
                 ELSE list_concat(prompt_ids, answer_ids) END AS input_ids,
              CAST(least(len(prompt_ids), greatest(0, 512 - len(answer_ids))) AS INTEGER) AS kept_prompt
              FROM enc)""", ["enc"]),
    "conv_trip": (CONV_TRIPLETS_SQL, []),
    "conv_gen": (f"""SELECT m.model_id, distribution, example_id, observations, question, reference, prompt,
        prompt || {_gen_case()} || chr(10) || '{END_MARK}' AS full_text
        FROM (SELECT 'conv' AS distribution, triplet_id AS example_id, observations, question, answer AS reference,
                     {sql_render_inference_prompt('observations', 'question')} AS prompt FROM conv_trip),
             (VALUES {', '.join(f"('{m}')" for m in NATIVE_GENERATORS)}) m(model_id)""", ["conv_trip"]),
    "conv_preds": (f"""SELECT model_id, 'baseline' AS variant, distribution, example_id, reference,
        {sql_extract_answer('prompt', 'full_text')} AS prediction FROM conv_gen""", ["conv_gen"]),
    "lsum_lines": (f"""SELECT {K}, {_line_tokens_sql('reference')} AS rl, {_line_tokens_sql('prediction')} AS pl
        FROM conv_preds""", ["conv_preds"]),
    "lsum_pairs": (f"""SELECT {K}, ri, rl[ri] AS r, pl[ci] AS c FROM
        (SELECT *, unnest(range(1, len(pl) + 1)) AS ci FROM
           (SELECT *, unnest(range(1, len(rl) + 1)) AS ri FROM lsum_lines))""", ["lsum_lines"]),
    "lsum_idx": (f"""SELECT {K}, ri, r, CASE WHEN len(r) = 0 OR len(c) = 0 THEN []::INTEGER[]
        ELSE (SELECT {LCS_BACKTRACK} FROM (SELECT {LCS_TABLE} AS t)) END AS acc FROM lsum_pairs""", ["lsum_pairs"]),
    "lsum_union": (f"""SELECT {K}, token, count(*) AS u FROM
        (SELECT {K}, r[p] AS token FROM
           (SELECT {K}, r, unnest(ps) AS p FROM
              (SELECT {K}, ri, any_value(r) AS r, list_distinct(flatten(list(acc))) AS ps FROM lsum_idx GROUP BY ALL)))
        GROUP BY ALL""", ["lsum_idx"]),
    "lsum_pred_counts": (f"""SELECT {K}, token, count(*) AS c FROM
        (SELECT {K}, unnest(flatten(pl)) AS token FROM lsum_lines) GROUP BY ALL""", ["lsum_lines"]),
    "lsum_scores": (f"""SELECT l.model_id, l.variant, l.distribution, l.example_id,
        CASE WHEN len(rl) = 0 OR len(pl) = 0 OR len(flatten(rl)) = 0 OR len(flatten(pl)) = 0 THEN 0.0
             ELSE {f1('coalesce(h.hits, 0)', 'len(flatten(pl))', 'len(flatten(rl))')} END AS rougeLsum
        FROM lsum_lines l LEFT JOIN
          (SELECT {K}, sum(least(u, c)) AS hits FROM lsum_union JOIN lsum_pred_counts
           USING (model_id, variant, distribution, example_id, token) GROUP BY ALL) h
        USING (model_id, variant, distribution, example_id)""",
                    ["lsum_lines", "lsum_union", "lsum_pred_counts"]),
    "runs": (RUNS_SQL, []),
    "params": (PARAMETERS_SQL, []),
    "weights": (WEIGHTS_SQL, []),
    "registry": (REGISTRY_SQL, ["runs"]),
}


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    body = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    return f"WITH RECURSIVE {body}\n{final}"
