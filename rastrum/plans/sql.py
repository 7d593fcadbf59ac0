"""Building blocks of the SQL that queries must agree with; written for DuckDB, and by self joins where the plans use windows."""

from __future__ import annotations

GRID = """grid AS (
  SELECT image_id, CAST((rn - 1) // 64 AS INT) AS y, CAST((rn - 1) % 64 AS INT) AS x, v, r, g, b FROM (
    SELECT CAST(l_suppkey // 4 AS INT) AS image_id,
           row_number() OVER (PARTITION BY l_suppkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS rn,
           CAST(CAST(l_quantity AS BIGINT) * 64 + CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS INT) AS v,
           CAST(floor(l_quantity * 5) AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b
    FROM lineitem))"""

FULL = GRID + """,
full_rows AS (
  SELECT image_id, y, x, v, r, g, b FROM grid
  UNION ALL SELECT image_id, y, CAST(p AS INT), 0, 0, 0, 0 FROM (SELECT image_id, y, count(*) AS c FROM grid GROUP BY image_id, y), unnest(range(c, 64)) AS t(p))"""

NEAR = GRID + """,
near AS (
  SELECT g.*, a.v AS w, b.v AS n, c.v AS nw, coalesce(d.v, c.v) AS ne FROM grid g
  LEFT JOIN grid a ON a.image_id = g.image_id AND a.y = g.y AND a.x = g.x - 1
  LEFT JOIN grid b ON b.image_id = g.image_id AND b.y = g.y - 1 AND b.x = g.x
  LEFT JOIN grid c ON c.image_id = g.image_id AND c.y = g.y - 1 AND c.x = g.x - 1
  LEFT JOIN grid d ON d.image_id = g.image_id AND d.y = g.y - 1 AND d.x = g.x + 1)"""

_ROOM = "((abs(w - nw) + abs(n - nw)) >> 1)"
_INNER = {
    "avg": "(w + n) >> 1",
    "grad": f"((w + n) >> 1) + greatest(-{_ROOM}, least({_ROOM}, (ne - nw) >> 3))",
    "med": "CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE w + n - nw END",
    "paeth": "CASE WHEN abs(n - nw) <= abs(w - nw) AND abs(n - nw) <= abs(w + n - 2 * nw) THEN w WHEN abs(w - nw) <= abs(w + n - 2 * nw) THEN n ELSE nw END",
}


def prediction(name: str) -> str:
    if name == "left":
        return "coalesce(w, 0)"
    return f"coalesce(CASE WHEN w IS NULL THEN n WHEN n IS NULL THEN w ELSE {_INNER[name]} END, 0)"


def residuals(name: str) -> str:
    """A common table `res` of image_id, y, x, v, pred, residual."""
    return NEAR + f""",
res AS (SELECT image_id, y, x, v, CAST({prediction(name)} AS INT) AS pred, CAST(v - {prediction(name)} AS INT) AS residual FROM near)"""


SIGNALS = """signals AS (
  SELECT vec_id, CAST(i - 1 AS INT) AS x, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1024) + 32768 AS INT) AS v
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""

SYMBOLS = """symbols AS (
  SELECT doc_id, i - 1 AS seq, CAST(unicode(substr(text, i, 1)) AS INT) AS sym FROM documents, unnest(range(1, length(text) + 1)) AS t(i))"""

HIST = SYMBOLS + """,
hist AS (SELECT doc_id, sym, count(*) AS cnt FROM symbols GROUP BY doc_id, sym)"""

STATS = HIST + """,
stats AS (SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n, CAST(max(sym) + 1 AS BIGINT) AS sym_len, count(*) AS distinct_syms, max(cnt) AS max_cnt FROM hist GROUP BY doc_id)"""

LOGS = STATS + """,
logs AS (
  SELECT *, CASE WHEN n > 2 AND sym_len > 1 THEN CAST(least(greatest(least(raised, source), 5), 16) AS INT) END AS table_log FROM (
    SELECT *, CASE WHEN sym_len > 512 AND n // sym_len > 16 AND base < 13 THEN 13
                   WHEN base < 12 AND ((n // sym_len > 64 AND sym_len > 256) OR (n // sym_len > 32 AND sym_len > 128)) THEN 12 ELSE base END AS raised FROM (
      SELECT *, length(bin(n - 1)) - 3 AS source, greatest(least(11, length(bin(n - 1)) - 3), least(length(bin(n - 1)), length(bin(sym_len - 1)) + 1)) AS base FROM stats)))"""

FRAMES = """frames AS (
  SELECT series, CAST((rn - 1) // 64 AS INT) AS frame, CAST((rn - 1) % 64 AS INT) AS px, v & 1023 AS v FROM (
    SELECT CAST(user_id // 8 AS INT) AS series, CAST(floor(value) AS INT) AS v, row_number() OVER (PARTITION BY user_id // 8 ORDER BY ts, event_id) AS rn FROM events))"""

RUNS = GRID + """,
s AS (SELECT image_id, CAST(y AS BIGINT) * 64 + x AS seq, CAST(v // 512 AS INT) AS sym FROM grid),
a AS (SELECT *, CASE WHEN sym = lag(sym) OVER (PARTITION BY image_id ORDER BY seq) THEN 0 ELSE 1 END AS b FROM s),
r AS (SELECT image_id, run, min(seq) AS s0, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY image_id ORDER BY seq) AS run FROM a) GROUP BY image_id, run),
f AS (SELECT *, CASE WHEN n >= 3 OR coalesce(lag(n) OVER (PARTITION BY image_id ORDER BY s0), 3) >= 3 THEN 1 ELSE 0 END AS nb FROM r),
i AS (SELECT image_id, isl, max(n) >= 3 AS same, min(s0) AS s0, sum(n) AS n FROM (SELECT *, sum(nb) OVER (PARTITION BY image_id ORDER BY s0) AS isl FROM f) GROUP BY image_id, isl),
l AS (SELECT *, CASE WHEN NOT same AND coalesce(lead(same) OVER (PARTITION BY image_id ORDER BY s0), false) THEN 2 ELSE 0 END AS la FROM i),
k AS (SELECT *, CAST(greatest(0, ceil((n + la - 6) / 4.0)) AS BIGINT) AS k FROM l),
runs AS (SELECT k.image_id, s0 + j * 4 AS start_seq, CASE WHEN same THEN 'same' ELSE 'diff' END AS kind, CAST(CASE WHEN j < k THEN 4 ELSE n - 4 * k END AS BIGINT) AS len FROM k, unnest(range(0, k + 1)) AS t(j)),
pieces AS (SELECT runs.*, s.sym AS value FROM runs JOIN s ON s.image_id = runs.image_id AND s.seq = start_seq)"""


def lifted(source: str, keys: str, at: str, name: str) -> str:
    """Common tables that end in `name`: forward lifting of v along `at`."""
    w = f"OVER (PARTITION BY {keys} ORDER BY {at})"
    return f"""{name}_o AS (SELECT * EXCLUDE (v), CASE WHEN {at} % 2 = 1 THEN v - ((lag(v) {w} + coalesce(lead(v) {w}, lag(v) {w})) >> 1) ELSE v END AS v FROM {source}),
{name} AS (SELECT * EXCLUDE (v), CASE WHEN {at} % 2 = 1 OR count(*) OVER (PARTITION BY {keys}) < 2 THEN v ELSE v + ((coalesce(lag(v) {w}, lead(v) {w}) + coalesce(lead(v) {w}, lag(v) {w}) + 2) >> 2) END AS v FROM {name}_o)"""


def wavelet_2d(levels: int) -> str:
    """Common tables that end in `coeffs`: image_id, y, x, v, level, band in separated layout."""
    out = [FULL, "l0 AS (SELECT image_id, y, x, v, max(y) OVER (PARTITION BY image_id) + 1 AS rows, max(x) OVER (PARTITION BY image_id) + 1 AS cols FROM full_rows)"]
    for k in range(1, levels + 1):
        half = lambda c, s: f"CASE WHEN {c} % 2 = 0 THEN {c} // 2 ELSE ({s} + 1) // 2 + {c} // 2 END"
        out += [lifted(f"l{k - 1}", "image_id, y", "x", f"h{k}"), lifted(f"h{k}", "image_id, x", "y", f"g{k}")]
        out.append(f"m{k} AS (SELECT image_id, {half('y', 'rows')} AS y, {half('x', 'cols')} AS x, v, (rows + 1) // 2 AS rows, (cols + 1) // 2 AS cols FROM g{k})")
        out.append(f"l{k} AS (SELECT * FROM m{k} WHERE y < rows AND x < cols)")
    details = [f"SELECT image_id, y, x, v, {k} AS level, CASE WHEN y < rows THEN 'HL' WHEN x < cols THEN 'LH' ELSE 'HH' END AS band FROM m{k} WHERE y >= rows OR x >= cols" for k in range(1, levels + 1)]
    out.append("coeffs AS (" + " UNION ALL ".join([*details, f"SELECT image_id, y, x, v, {levels} AS level, 'LL' AS band FROM l{levels}"]) + ")")
    return ",\n".join(out)
