"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from qualispark.llm.chat_format import Template
from qualispark.llm.quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _quality(rules=RULES) -> str:
    ratio = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    }
    tests = [
        f"{ratio.get(r.measure, r.measure)} {op} {bound!r}"
        for r in rules
        for op, bound in ((">=", r.low), ("<=", r.high))
        if abs(bound) != float("inf")
    ]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d)
), wc AS (
  SELECT rid, count(*) AS n_words, sum(length(x)) AS word_chars,
         sum(CASE WHEN lower(x) IN ({stop}) THEN 1 ELSE 0 END) AS n_stop_words
  FROM w GROUP BY rid
), g AS (
  SELECT * FROM (
    SELECT rid, i, concat_ws(' ', x, lead(x, 1) OVER r, lead(x, 2) OVER r) AS gram, lead(x, 2) OVER r AS last
    FROM w WINDOW r AS (PARTITION BY rid ORDER BY i))
  WHERE last IS NOT NULL
), rep AS (
  SELECT DISTINCT rid, i + k AS i
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g), (VALUES (0), (1), (2)) AS v(k)
  WHERE n >= 2
), rc AS (SELECT rid, count(*) AS n_repeat_words FROM rep GROUP BY rid),
l AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS ln FROM d
), lc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT ln) AS n_dup_lines
  FROM l WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN rc USING (rid) LEFT JOIN lc USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(tests)}) AS kept
FROM b"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat(t: Template = Template()) -> str:
    def escaped(x: str) -> str:
        for raw, code in t.escapes:
            x = f"replace({x}, {_quoted(raw)}, {_quoted(code)})"
        return x

    loss = ", ".join(_quoted(r) for r in t.loss_roles)
    starts = ", ".join(_quoted(r) for r in t.start)
    accept = ", ".join(_quoted(r) for r in t.accept)
    steps = " OR ".join(
        f"(prev = {_quoted(a)} AND role IN ({', '.join(_quoted(r) for r in rs)}))" for a, rs in t.follows.items()
    )
    marks = len(t.open_mark) + len(t.after_role)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, {_quoted(chr(92) + "### Assistant: </turn> ok")}
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
       sum(length({escaped("role")}) + {marks} + length({escaped("text")})
           + {len(t.close_mark)})::BIGINT AS formatted_chars,
       bool_and(coalesce((prev IS NULL AND role IN ({starts})) OR {steps}, false)
                AND (i < n OR role IN ({accept}))) AS valid
FROM o GROUP BY conv_id"""


_DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT rid, i, n, item_id FROM pos JOIN win USING (n, gram)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain Lloyd rounds, each from all rows."""
    w = f"(len(v) // {parts})"
    steps = [
        f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({1024} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT rid, p, v[p * {w} + 1 : (p + 1) * {w}] AS x FROM kept, range({parts}) AS t(p)
), c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM x WHERE rid <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM x JOIN c{r} USING (p) GROUP BY rid, p)"""
        )
        if r < rounds:
            steps.append(
                f"""
c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT p, e, list(q ORDER BY i) AS c FROM (
      SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS q
      FROM a{r}, range(1, (SELECT max(len(x)) FROM x) + 1) AS t(i) GROUP BY ALL)
    GROUP BY p, e) AS m USING (p, e))"""
            )
    return (
        ",".join(steps)
        + f""",
coded AS (
  SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY rid
), book AS (
  SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS s FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (rid), book
"""
    )


def _audit() -> str:
    """Every order on every mask, without transforms or closed forms."""
    f = "ABCDE"
    letters = "(VALUES " + ", ".join(f"('{x}')" for x in f) + ")"
    bit = "(1 << (ascii({}) - 65))"
    prefix = " + ".join(f"CASE WHEN strpos(o, '{x}') < step THEN {1 << i} ELSE 0 END" for i, x in enumerate(f))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM {letters} AS a(x), {letters} AS b(x), {letters} AS c(x), {letters} AS d(x), {letters} AS e(x)
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT o, step, {prefix} AS before, {bit.format("o[step]")} AS own FROM o, range(1, 6) AS t(step)
), r AS (
  SELECT part, o AS filter_order, step::INT AS step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


SQL = {
    "op6_decontamination": _DECONTAMINATION,
    "op8_quality_rules": _quality(),
    "op9_chat_format": _chat(),
    "op11_product_codes": _codes(),
    "op12_filter_audit": _audit(),
}
