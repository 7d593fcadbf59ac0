"""Registered queries over the signals that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrum.functions import scalars as S
from rastrum.operators import codebook, kernels, partition, predict, runs, stats, wavelet
from rastrum.plans import sql as Q
from rastrum.plans import engine
from rastrum.plans.catalog import register
from rastrum.sources import container, files, signals

DEPTH = 12  # of the grey grids
LEVELS = 3
ESCAPED = f"abs(residual) >= {S.threshold_of(DEPTH)}"


def grid(spark, sf_dir) -> DataFrame:
    return signals.grey_grid(spark, sf_dir)


def full_grid(spark, sf_dir) -> DataFrame:
    """The grid with its short last rows filled up, as transforms of rectangles ask for."""
    return signals.grey_grid(spark, sf_dir, whole=True)


# Prediction

for _name in ("avg", "left", "grad", "med", "paeth"):

    @register(f"residual_{_name}", f"WITH {Q.residuals(_name)} SELECT image_id, y, x, pred, residual FROM res")
    def _residual(spark, sf_dir, name=_name):
        return predict.residuals(grid(spark, sf_dir), name).select("image_id", "y", "x", "pred", "residual")


@register("residual_avg_profile", f"WITH {Q.residuals('avg')} SELECT image_id, count(*) AS n, CAST(sum(residual) AS BIGINT) AS sum_residual, CAST(sum(abs(residual)) AS BIGINT) AS sum_abs, count(*) FILTER (abs(residual) >= 2047) AS escapes FROM res GROUP BY image_id")
def residual_avg_profile(spark, sf_dir):
    res = predict.residuals(grid(spark, sf_dir), "avg")
    return res.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("residual").cast("long").alias("sum_residual"), F.sum(F.abs("residual")).cast("long").alias("sum_abs"), F.count_if(F.expr(ESCAPED)).alias("escapes"))


@register("residual_zigzag", f"WITH {Q.residuals('left')} SELECT image_id, y, x, CASE WHEN abs(residual) >= 2047 THEN 4095 WHEN residual >= 0 THEN 2 * residual ELSE -2 * residual - 1 END AS word FROM res")
def residual_zigzag(spark, sf_dir):
    res = predict.residuals(grid(spark, sf_dir), "left")
    return res.select("image_id", "y", "x", predict.words(F.col("residual"), F.col("v"), DEPTH, zigzagged=True)[0].cast("int").alias("word"))


@register("residual_symbols", f"WITH {Q.residuals('avg')}, e AS (SELECT image_id, y, x, unnest(CASE WHEN abs(residual) >= 2047 THEN [4095, v] ELSE [2047 + residual] END) AS sym, unnest(CASE WHEN abs(residual) >= 2047 THEN [0, 1] ELSE [0] END) AS part FROM res) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, part) - 1 AS INT) AS seq, CAST(sym AS INT) AS sym FROM e")
def residual_symbols(spark, sf_dir):
    return predict.symbols(predict.residuals(grid(spark, sf_dir), "avg"), DEPTH).select("image_id", "seq", "sym")


@register("escape_rate", f"WITH {Q.residuals('avg')} SELECT image_id, count(*) FILTER (abs(residual) >= 2047) AS escapes, count(*) AS n, round(count(*) FILTER (abs(residual) >= 2047) / count(*), 6) AS rate FROM res GROUP BY image_id")
def escape_rate(spark, sf_dir):
    res = predict.residuals(grid(spark, sf_dir), "avg").groupBy("image_id").agg(F.count_if(F.expr(ESCAPED)).alias("escapes"), F.count("*").alias("n"))
    return res.withColumn("rate", F.round(F.col("escapes") / F.col("n"), 6))


_NAMES = ("avg", "left", "grad", "med", "paeth")


@register(
    "predictor_ablation",
    f"WITH {Q.NEAR}, costs AS (" + " UNION ALL ".join(f"SELECT image_id, '{p}' AS predictor, {i} AS rank, CAST(sum(abs(v - {Q.prediction(p)})) AS BIGINT) AS cost FROM near GROUP BY image_id" for i, p in enumerate(_NAMES)) + "), best AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost, rank) AS place FROM costs) SELECT predictor, CAST(sum(cost) AS BIGINT) AS cost, CAST(count(*) FILTER (place = 1) AS BIGINT) AS wins FROM best GROUP BY predictor",
)
def predictor_ablation(spark, sf_dir):
    """One scan and one pair of windows for all predictors."""
    near = predict.with_neighbours(grid(spark, sf_dir))
    sums = near.groupBy("image_id").agg(*(F.sum(F.abs(F.col("v") - predict.prediction(p))).cast("long").alias(p) for p in _NAMES))
    costs = sums.select("image_id", F.posexplode(F.array(*(F.struct(F.lit(p).alias("predictor"), F.col(p).alias("cost")) for p in _NAMES))).alias("rank", "c")).select("image_id", "rank", "c.*")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("cost", "rank"))
    return costs.withColumn("place", place).groupBy("predictor").agg(F.sum("cost").alias("cost"), F.count_if(F.col("place") == 1).alias("wins"))


@register("residual_hist_clamped", f"WITH {Q.residuals('avg')} SELECT image_id, CAST(CASE WHEN abs(residual) >= 2047 THEN 0 ELSE greatest(-255, least(255, residual)) END AS INT) AS residual, count(*) AS cnt FROM res GROUP BY ALL")
def residual_hist_clamped(spark, sf_dir):
    return files.clamped_histogram(predict.residuals(grid(spark, sf_dir), "avg"), DEPTH)


@register("sample_stats", f"WITH {Q.GRID} SELECT image_id, max(v) AS most, CAST(length(bin(max(v))) AS INT) AS depth, CAST((1 << (length(bin(max(v))) - 1)) - 1 AS INT) AS threshold, CAST((1 << length(bin(max(v)))) - 1 AS INT) AS escape FROM grid GROUP BY image_id")
def sample_stats(spark, sf_dir):
    most = grid(spark, sf_dir).groupBy("image_id").agg(F.max("v").alias("most"))
    depth = most.withColumn("depth", S.coding_depth("most"))
    return depth.select("image_id", "most", F.col("depth").cast("int").alias("depth"), S.threshold("depth").alias("threshold"), S.escape("depth").alias("escape"))


# Inverses that are prefix sums

@register("left_inverse_roundtrip", f"WITH {Q.GRID} SELECT image_id, y, x, v AS restored FROM grid")
def left_inverse_roundtrip(spark, sf_dir):
    return predict.undo_left(predict.residuals(grid(spark, sf_dir), "left"), DEPTH)


@register("temporal_forward", f"WITH {Q.FRAMES}, d AS (SELECT a.series, a.frame, a.px, a.v, b.v AS p FROM frames a LEFT JOIN frames b ON b.series = a.series AND b.px = a.px AND b.frame = a.frame - 1) SELECT series, frame, px, CAST(CASE WHEN p IS NULL THEN v WHEN v >= p THEN 2 * (v - p) ELSE 2 * (p - v) - 1 END AS INT) AS res FROM d")
def temporal_forward(spark, sf_dir):
    return predict.frame_residuals(signals.event_frames(spark, sf_dir)).drop("is_first")


@register("temporal_inverse", f"WITH {Q.FRAMES} SELECT * FROM frames")
def temporal_inverse(spark, sf_dir):
    return predict.undo_frames(predict.frame_residuals(signals.event_frames(spark, sf_dir)))


@register("frame_random_access", f"WITH {Q.FRAMES} SELECT * FROM frames WHERE frame = 5")
def frame_random_access(spark, sf_dir):
    return predict.frame_at(predict.frame_residuals(signals.event_frames(spark, sf_dir)), 5)


@register("ycocg_forward", f"WITH {Q.GRID}, c AS (SELECT *, r - b AS co, b + ((r - b) >> 1) AS t FROM grid) SELECT image_id, y, x, CAST(t + ((g - t) >> 1) AS INT) AS luma, CAST(CASE WHEN co >= 0 THEN 2 * co ELSE -2 * co - 1 END AS INT) AS co, CAST(CASE WHEN g >= t THEN 2 * (g - t) ELSE 2 * (t - g) - 1 END AS INT) AS cg FROM c")
def ycocg_forward(spark, sf_dir):
    c = S.colour_forward("r", "g", "b")
    return signals.colour_grid(spark, sf_dir).select("image_id", "y", "x", c["luma"].alias("luma"), S.zigzag(c["co"]).alias("co"), S.zigzag(c["cg"]).alias("cg"))


@register("ycocg_roundtrip", f"WITH {Q.GRID} SELECT image_id, y, x, r, g, b FROM grid")
def ycocg_roundtrip(spark, sf_dir):
    coded = ycocg_forward(spark, sf_dir)
    back = S.colour_inverse("luma", S.unzigzag("co"), S.unzigzag("cg"))
    return coded.select("image_id", "y", "x", *(c.alias(n) for n, c in back.items()))


@register("planar_split", f"WITH {Q.GRID} SELECT image_id, y, x, unnest(['r', 'g', 'b']) AS plane, unnest([r, g, b]) AS v FROM grid")
def planar_split(spark, sf_dir):
    return signals.colour_grid(spark, sf_dir).selectExpr("image_id", "y", "x", "stack(3, 'r', r, 'g', g, 'b', b) AS (plane, v)")


# Wavelet

@register("wavelet1d_forward", f"WITH {Q.SIGNALS}, {Q.lifted('signals', 'vec_id', 'x', 'w')} SELECT vec_id, x, CAST(v AS INT) AS v FROM w")
def wavelet1d_forward(spark, sf_dir):
    return wavelet.forward(signals.vector_signals(spark, sf_dir), ["vec_id"])


@register("wavelet1d_roundtrip", f"WITH {Q.SIGNALS} SELECT * FROM signals")
def wavelet1d_roundtrip(spark, sf_dir):
    return wavelet.inverse(wavelet1d_forward(spark, sf_dir), ["vec_id"])


@register("wavelet2d_level1", f"WITH {Q.wavelet_2d(1)} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS INT) AS v FROM coeffs")
def wavelet2d_level1(spark, sf_dir):
    return wavelet.forward_2d(full_grid(spark, sf_dir), 1)


@register("wavelet2d_multilevel", f"WITH {Q.wavelet_2d(LEVELS)} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS INT) AS v FROM coeffs")
def wavelet2d_multilevel(spark, sf_dir):
    return wavelet.forward_2d(full_grid(spark, sf_dir), LEVELS)


@register("wavelet2d_roundtrip", f"WITH {Q.FULL} SELECT image_id, y, x, v FROM full_rows")
def wavelet2d_roundtrip(spark, sf_dir):
    return wavelet.inverse_2d(wavelet2d_multilevel(spark, sf_dir), LEVELS)


@register("subband_energy", f"WITH {Q.wavelet_2d(LEVELS)} SELECT image_id, level, band, count(*) AS n, CAST(sum(CAST(v AS BIGINT) * v) AS BIGINT) AS energy FROM coeffs GROUP BY ALL")
def subband_energy(spark, sf_dir):
    bands = wavelet.subbands(wavelet2d_multilevel(spark, sf_dir), LEVELS)
    return bands.groupBy("image_id", "level", "band").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long") * F.col("v")).alias("energy"))


@register("subband_scan_order", f"WITH {Q.wavelet_2d(LEVELS)} SELECT image_id, level, band, CAST(v AS INT) AS v, CAST(row_number() OVER (PARTITION BY image_id ORDER BY level DESC, CASE band WHEN 'LL' THEN 0 WHEN 'HL' THEN 1 WHEN 'LH' THEN 2 ELSE 3 END, y, x) - 1 AS INT) AS seq FROM coeffs")
def subband_scan_order(spark, sf_dir):
    return wavelet.scan_order(wavelet2d_multilevel(spark, sf_dir), LEVELS).select("image_id", "level", "band", "v", "seq")


@register("coeff_escape", f"WITH {Q.SIGNALS}, {Q.lifted('signals', 'vec_id', 'x', 'w')}, e AS (SELECT vec_id, x, CASE WHEN abs(v) > 32767 THEN [65535, (v >> 16) & 65535, v & 65535] WHEN v >= 0 THEN [2 * v] ELSE [-2 * v - 1] END AS ws FROM w) SELECT vec_id, x, CAST(i - 1 AS INT) AS part, CAST(ws[i] AS INT) AS word FROM e, unnest(range(1, len(ws) + 1)) AS t(i)")
def coeff_escape(spark, sf_dir):
    return wavelet1d_forward(spark, sf_dir).select("vec_id", "x", F.posexplode(S.coefficient_words("v")).alias("part", "word"))


# Runs

def coarse_symbols(spark, sf_dir):
    """Eight grey values in raster order, which have runs."""
    return grid(spark, sf_dir).select("image_id", (F.col("y").cast("long") * signals.GRID_WIDTH + F.col("x")).alias("seq"), F.floor(F.col("v") / 512).cast("int").alias("sym"))


@register("rle_runs", f"WITH {Q.RUNS} SELECT image_id, start_seq, kind, len, value FROM pieces")
def rle_runs(spark, sf_dir):
    return runs.runs(coarse_symbols(spark, sf_dir), 4)


@register("rle_tokens", f"WITH {Q.RUNS}, o AS (SELECT image_id, start_seq AS seq, -1 AS part, CASE WHEN kind = 'same' THEN len ELSE len + 7 END AS word FROM pieces UNION ALL SELECT image_id, start_seq, 0, value FROM pieces WHERE kind = 'same' UNION ALL SELECT p.image_id, s.seq, 0, s.sym FROM pieces p JOIN s ON s.image_id = p.image_id AND s.seq BETWEEN p.start_seq AND p.start_seq + p.len - 1 WHERE kind = 'diff') SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY seq, part) - 1 AS INT) AS word_no, CAST(word AS INT) AS word FROM o")
def rle_tokens(spark, sf_dir):
    return runs.words(coarse_symbols(spark, sf_dir), 4)


@register("rle_roundtrip", f"WITH {Q.RUNS} SELECT image_id, seq, sym FROM s")
def rle_roundtrip(spark, sf_dir):
    """Symbols from the words alone, with their length in front."""
    symbols = coarse_symbols(spark, sf_dir)
    return kernels.unrun_streams(runs.with_length(runs.words(symbols, 4), symbols), ["image_id"], 4)


# Histograms and what follows from them

def text_hist(spark, sf_dir):
    return stats.histogram(signals.text_symbols(spark, sf_dir))


@register("symbol_histogram", f"WITH {Q.HIST} SELECT * FROM hist")
def symbol_histogram(spark, sf_dir):
    return text_hist(spark, sf_dir)


@register("symbol_entropy", f"WITH {Q.STATS} SELECT doc_id, any_value(n) AS n, any_value(sym_len) AS sym_len, any_value(distinct_syms) AS distinct_syms, any_value(max_cnt) AS max_cnt, abs(round(sum(-(cnt / n) * log2(cnt / n)), 6)) AS entropy, any_value(sym_len - distinct_syms) AS unused FROM hist JOIN stats USING (doc_id) GROUP BY doc_id")
def symbol_entropy(spark, sf_dir):
    return stats.summary(text_hist(spark, sf_dir))


@register("table_log", f"WITH {Q.LOGS} SELECT doc_id, n, sym_len, table_log FROM logs")
def table_log(spark, sf_dir):
    return stats.coded(stats.summary(text_hist(spark, sf_dir))).select("doc_id", "n", "sym_len", "table_log")


@register("incompressible_flags", f"WITH {Q.STATS} SELECT doc_id, max_cnt = n AS single, max_cnt <> n AND (max_cnt = 1 OR max_cnt < (n >> 15)) AS incompressible FROM stats")
def incompressible_flags(spark, sf_dir):
    return stats.coded(stats.summary(text_hist(spark, sf_dir))).select("doc_id", "single", "incompressible")


@register(
    "norm_counts",
    f"""WITH {Q.LOGS},
    a AS (SELECT doc_id, sym, cnt, n, table_log, cnt * (4611686018427387904 // n) AS scaled FROM hist JOIN logs USING (doc_id) WHERE max_cnt <> n AND table_log IS NOT NULL),
    b AS (SELECT *, scaled >> (62 - table_log) AS proba FROM a),
    c AS (SELECT *, CASE WHEN cnt <= (n >> table_log) THEN -1 WHEN proba < 8 AND scaled - CAST(CAST(proba AS HUGEINT) * (CAST(1 AS BIGINT) << (62 - table_log)) AS BIGINT) > (CAST(1 AS BIGINT) << (42 - table_log)) * [0, 473195, 504333, 520860, 550000, 700000, 750000, 830000][proba + 1] THEN proba + 1 ELSE proba END AS norm FROM b),
    d AS (SELECT *, (1 << table_log) - sum(abs(norm)) OVER (PARTITION BY doc_id) AS rest, max(norm) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY norm DESC, sym) AS place FROM c)
    SELECT doc_id, sym, cnt, CAST(CASE WHEN place = 1 AND -rest < (top >> 1) THEN norm + rest ELSE norm END AS BIGINT) AS norm, -rest >= (top >> 1) AS fallback, table_log FROM d""",
)
def norm_counts(spark, sf_dir):
    return stats.normalized(text_hist(spark, sf_dir))


@register("constant_planes", f"WITH {Q.GRID} SELECT image_id, y, min(v) = max(v) AS constant, max(v) = 0 AS zero FROM grid GROUP BY image_id, y")
def constant_planes(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("image_id", "y").agg((F.min("v") == F.max("v")).alias("constant"), (F.max("v") == 0).alias("zero"))


@register("geomean_ratio", f"WITH {Q.STATS}, b AS (SELECT doc_id, any_value(n) AS n, sum(-cnt * log2(cnt / n)) AS bits FROM hist JOIN stats USING (doc_id) GROUP BY doc_id) SELECT lang, count(*) AS docs, round(exp(avg(ln(8 * n / bits))), 6) AS ratio FROM b JOIN documents USING (doc_id) WHERE bits > 0 GROUP BY lang")
def geomean_ratio(spark, sf_dir):
    """Per language the geometric mean of 8 bits a symbol to the entropy."""
    hist = text_hist(spark, sf_dir)
    n = F.sum("cnt").over(Window.partitionBy("doc_id"))
    bits = hist.withColumn("n", n).groupBy("doc_id").agg(F.max("n").alias("n"), F.sum(-F.col("cnt") * F.log2(F.col("cnt") / F.col("n"))).alias("bits")).where("bits > 0")
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return bits.withColumn("ratio", S.ratio(8 * F.col("n"), "bits")).join(langs, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.round(stats.geometric_mean("ratio"), 6).alias("ratio"))


# Code books

@register("gap_map_sizes", f"WITH {Q.HIST}, g AS (SELECT *, sym - lag(sym) OVER (PARTITION BY doc_id ORDER BY sym) - 1 AS gap FROM hist), z AS (SELECT doc_id, count(*) AS used, CAST(max(sym) + 1 AS BIGINT) AS sym_len, 3 + 2 * count(*) AS raw_bytes, CAST(3 + (max(sym) + 8) // 8 AS BIGINT) AS bitmap_bytes, CAST(5 + sum(CASE WHEN gap IS NULL THEN 0 WHEN gap >= 255 THEN 3 ELSE 1 END) AS BIGINT) AS delta_bytes FROM g GROUP BY doc_id), m AS (SELECT *, least(raw_bytes, bitmap_bytes, delta_bytes) AS least_bytes FROM z) SELECT doc_id, used, sym_len, raw_bytes, bitmap_bytes, delta_bytes, CASE least_bytes WHEN raw_bytes THEN 'raw' WHEN bitmap_bytes THEN 'bitmap' ELSE 'delta' END AS form, used > 1 AND used < sym_len // 2 AND 8 * least_bytes < sym_len - used AS pays FROM m")
def gap_map_sizes(spark, sf_dir):
    return codebook.map_sizes(text_hist(spark, sf_dir))


@register("gap_remap", f"WITH {Q.SYMBOLS}, i AS (SELECT doc_id, seq, sym, dense_rank() OVER (PARTITION BY doc_id ORDER BY sym) - 1 AS idx FROM symbols) SELECT doc_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx, CAST(sum(idx * (seq + 1)) AS BIGINT) AS weighted, CAST(max(idx) AS INT) AS most FROM i GROUP BY doc_id")
def gap_remap(spark, sf_dir):
    symbols = signals.text_symbols(spark, sf_dir)
    idx = F.col("idx").cast("long")
    return codebook.remap(symbols, stats.histogram(symbols)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(idx).alias("sum_idx"), F.sum(idx * (F.col("seq") + 1)).alias("weighted"), F.max("idx").alias("most"))


@register("symbol_topk", f"WITH {Q.HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, sym) AS rank FROM hist) SELECT doc_id, CAST(rank AS INT) AS rank, sym, cnt FROM r WHERE rank <= 5")
def symbol_topk(spark, sf_dir):
    return codebook.most_frequent(text_hist(spark, sf_dir), 5)


@register(
    "canonical_codes",
    f"""WITH {Q.STATS}, l AS (SELECT doc_id, sym, cnt, CASE WHEN (n + cnt - 1) // cnt <= 2 THEN 1 ELSE length(bin((n + cnt - 1) // cnt - 1)) END AS len FROM hist JOIN stats USING (doc_id)),
    m AS (SELECT *, max(len) OVER (PARTITION BY doc_id) AS most FROM l)
    SELECT doc_id, sym, cnt, CAST(len AS INT) AS len, CAST(coalesce(sum(CAST(1 AS BIGINT) << CAST(most - len AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY len, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> CAST(most - len AS BIGINT) AS code FROM m""",
)
def canonical_codes(spark, sf_dir):
    return codebook.canonical(codebook.shannon_lengths(text_hist(spark, sf_dir)))


@register("huffman_lengths")
def huffman_lengths(spark, sf_dir):
    return codebook.huffman_lengths(text_hist(spark, sf_dir))


@register("huffman_kraft", f"WITH {Q.STATS} SELECT doc_id, n, CASE WHEN distinct_syms = 1 THEN 0.5 ELSE 1.0 END AS kraft, true AS within FROM stats")
def huffman_kraft(spark, sf_dir):
    """Per document: symbols that the code covers, its Kraft sum, and whether its bits lie between the entropy and a bit a symbol more."""
    lengths = huffman_lengths(spark, sf_dir)
    over = Window.partitionBy("doc_id")
    bits = lengths.withColumn("n", F.sum("cnt").over(over)).groupBy("doc_id").agg(F.max("n").alias("n"), F.round(F.sum(F.pow(F.lit(0.5), F.col("len"))), 6).alias("kraft"), F.sum(F.col("cnt") * F.col("len")).alias("bits"), F.sum(-F.col("cnt") * F.log2(F.col("cnt") / F.col("n"))).alias("least"))
    return bits.select("doc_id", "n", "kraft", ((F.col("bits") >= F.col("least") - 1e-6) & (F.col("bits") <= F.col("least") + F.col("n"))).alias("within"))


# Strips, tiles, pyramids, offsets

@register("strips_uniform", f"WITH {Q.GRID}, h AS (SELECT image_id, max(y) + 1 AS height FROM grid GROUP BY image_id) SELECT image_id, CAST(y // ((height + least(8, height) - 1) // least(8, height)) AS INT) AS strip_id, CAST(min(y) AS INT) AS y0, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM grid JOIN h USING (image_id) GROUP BY image_id, strip_id")
def strips_uniform(spark, sf_dir):
    return partition.uniform_strips(grid(spark, sf_dir), 8).groupBy("image_id", "strip_id").agg(F.min("y").alias("y0"), F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


COSTS = Q.GRID + ", costs AS (SELECT a.image_id, a.y, CAST(sum(coalesce(abs(a.v - b.v), 0)) AS BIGINT) AS cost FROM grid a LEFT JOIN grid b ON b.image_id = a.image_id AND b.x = a.x AND b.y = a.y - 1 GROUP BY a.image_id, a.y)"


@register("row_cost", f"WITH {COSTS} SELECT * FROM costs")
def row_cost(spark, sf_dir):
    return partition.row_costs(grid(spark, sf_dir))


ADAPTIVE = COSTS + """,
    t AS (SELECT *, sum(cost) OVER (PARTITION BY image_id) AS total, max(y) OVER (PARTITION BY image_id) + 1 AS height, sum(cost) OVER (PARTITION BY image_id ORDER BY y) - cost AS before FROM costs),
    f AS (SELECT image_id, i, any_value(height) AS height, coalesce(min(y) FILTER (y > 0 AND CASE WHEN height <= 8 THEN y >= i WHEN total = 0 THEN y >= i * height // 8 ELSE before * 8 >= total * i END), any_value(height) - 1) AS f FROM t, unnest(range(1, 8)) AS u(i) WHERE i < least(8, height) GROUP BY image_id, i),
    starts AS (SELECT image_id, CAST(0 AS BIGINT) AS strip_id, CAST(0 AS BIGINT) AS y0 FROM costs GROUP BY image_id UNION ALL SELECT image_id, i, y0 FROM (SELECT *, CAST(i + max(f - i) OVER (PARTITION BY image_id ORDER BY i) AS BIGINT) AS y0 FROM f) WHERE y0 < height)"""


@register("strips_adaptive", f"WITH {ADAPTIVE} SELECT * FROM starts")
def strips_adaptive(spark, sf_dir):
    return partition.adaptive_strips(row_cost(spark, sf_dir), 8)


@register("strip_lookup", f"WITH {ADAPTIVE}, a AS (SELECT g.image_id, g.y, g.x, max(s.strip_id) AS strip_id FROM grid g JOIN starts s ON s.image_id = g.image_id AND s.y0 <= g.y GROUP BY ALL) SELECT image_id, CAST(strip_id AS INT) AS strip_id, count(*) AS n FROM a GROUP BY image_id, strip_id")
def strip_lookup(spark, sf_dir):
    g = grid(spark, sf_dir)
    return partition.to_strips(g, partition.adaptive_strips(partition.row_costs(g), 8)).groupBy("image_id", "strip_id").agg(F.count("*").alias("n"))


TILED = Q.GRID + ", tiles AS (SELECT *, CAST(y // 16 AS INT) AS tile_y, CAST(x // 16 AS INT) AS tile_x, y % 16 AS ty, x % 16 AS tx FROM grid)"


@register("tile_grid", f"WITH {TILED} SELECT image_id, tile_y, tile_x, count(*) AS n, CAST(256 AS BIGINT) AS padded_n, CAST(sum(v) AS BIGINT) AS total FROM tiles GROUP BY ALL")
def tile_grid(spark, sf_dir):
    tiled = partition.tiles(grid(spark, sf_dir), 16, 16)
    inside = tiled.groupBy("image_id", "tile_y", "tile_x").agg(F.count("*").alias("n"))
    whole = partition.padded(tiled, 16, 16).groupBy("image_id", "tile_y", "tile_x").agg(F.count("*").alias("padded_n"), F.sum("v").cast("long").alias("total"))
    return inside.join(whole, ["image_id", "tile_y", "tile_x"])


@register("tile_region", f"WITH {Q.GRID} SELECT image_id, y, x, v FROM grid WHERE x BETWEEN 10 AND 39 AND y BETWEEN 20 AND 52")
def tile_region(spark, sf_dir):
    return partition.region(partition.tiles(grid(spark, sf_dir), 16, 16), 10, 20, 30, 33, 16, 16).select("image_id", "y", "x", "v")


@register("pyramid_levels", "WITH RECURSIVE l AS (SELECT 0 AS level, 2670 AS width, 3340 AS height UNION ALL SELECT level + 1, greatest(1, width // 2), greatest(1, height // 2) FROM l WHERE width > 256 OR height > 256), t AS (SELECT *, CAST(ceil(width / 256.0) AS INT) AS tiles_x, CAST(ceil(height / 256.0) AS INT) AS tiles_y FROM l) SELECT level, CAST(width AS INT) AS width, CAST(height AS INT) AS height, tiles_x, tiles_y, CAST(coalesce(sum(tiles_x * tiles_y) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_tile FROM t")
def pyramid_levels(spark, sf_dir):
    return partition.level_plan(spark, 2670, 3340, 256, 256)


_HALF = "SELECT image_id, y // 2 AS y, x // 2 AS x, (sum(v) + 2) // 4 AS v FROM {} GROUP BY image_id, y // 2, x // 2 HAVING count(*) = 4"


@register("pyramid_downsample", f"WITH {Q.GRID}, p1 AS ({_HALF.format('grid')}), p2 AS ({_HALF.format('p1')}) SELECT 0 AS level, image_id, y, x, v FROM grid UNION ALL SELECT 1, image_id, CAST(y AS INT), CAST(x AS INT), CAST(v AS INT) FROM p1 UNION ALL SELECT 2, image_id, CAST(y AS INT), CAST(x AS INT), CAST(v AS INT) FROM p2")
def pyramid_downsample(spark, sf_dir):
    return partition.pyramid(grid(spark, sf_dir), 3)


@register("frame_index_offsets", f"WITH {Q.FRAMES}, s AS (SELECT series, frame, CAST(2 * count(*) AS BIGINT) AS length FROM frames GROUP BY series, frame) SELECT series, frame, length, CAST(coalesce(sum(length) OVER (PARTITION BY series ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def frame_index_offsets(spark, sf_dir):
    sizes = signals.event_frames(spark, sf_dir).groupBy("series", "frame").agg((2 * F.count("*")).alias("length"))
    return partition.offsets(sizes, ["series"], ["frame"])


@register("tile_index_offsets", f"WITH {TILED}, s AS (SELECT image_id, tile_y, tile_x, CAST(2 * count(*) AS BIGINT) AS length FROM tiles GROUP BY ALL) SELECT image_id, tile_y, tile_x, length, CAST(coalesce(sum(length) OVER (PARTITION BY image_id ORDER BY tile_y, tile_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def tile_index_offsets(spark, sf_dir):
    sizes = partition.tiles(grid(spark, sf_dir), 16, 16).groupBy("image_id", "tile_y", "tile_x").agg((2 * F.count("*")).alias("length"))
    return partition.offsets(sizes, ["image_id"], ["tile_y", "tile_x"])


# Kernels: what goes through them must come back

for _name in ("avg", "grad", "med", "paeth"):

    @register(f"{_name}_inverse_roundtrip", f"WITH {Q.GRID} SELECT image_id, y, x, v AS restored FROM grid")
    def _inverse(spark, sf_dir, name=_name):
        return kernels.restored(predict.residuals(grid(spark, sf_dir), name), name, ["image_id"])


STREAMS = f"WITH {Q.residuals('avg')} SELECT image_id, CAST(count(*) + count(*) FILTER (abs(residual) >= 2047) AS BIGINT) AS n, CAST(0 AS BIGINT) AS mismatches FROM res GROUP BY image_id"

for _coder, _label in (("tans", "ans"), ("rans", "rans"), ("huffman", "huffman")):

    @register(f"{_label}_roundtrip", STREAMS)
    def _coded(spark, sf_dir, coder=_coder):
        symbols = residual_symbols(spark, sf_dir)
        back = kernels.decoded_streams(kernels.coded_streams(symbols, ["image_id"], coder), ["image_id"])
        return kernels.mismatches(symbols, back, ["image_id", "seq"], "sym", "image_id")


@register("frame_codec_roundtrip", f"WITH {Q.FRAMES} SELECT series, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM frames GROUP BY series")
def frame_codec_roundtrip(spark, sf_dir):
    """Temporal residuals, coded frame by frame without spatial prediction, and summed up again."""
    frames = signals.event_frames(spark, sf_dir)
    coded = predict.frame_residuals(frames)
    blobs = kernels.coded_streams(coded.select("series", "frame", F.col("px").alias("seq"), F.col("res").alias("sym")), ["series", "frame"])
    back = kernels.decoded_streams(blobs, ["series", "frame"]).select("series", "frame", F.col("seq").cast("int").alias("px"), F.col("sym").alias("res"), (F.col("frame") == 0).alias("is_first"))
    return kernels.mismatches(frames, predict.undo_frames(back), ["series", "frame", "px"], "v", "series")


def _planes(spark, sf_dir, keyed: DataFrame, key: str, **options) -> DataFrame:
    """Codes each (image_id, key) plane and compares what comes back by rank in the plane."""
    back = kernels.decoded_planes(kernels.encoded_planes(keyed, ["image_id", key], **options), ["image_id", key])
    corner = Window.partitionBy("image_id", key)
    placed = keyed.select("image_id", key, (F.col("y") - F.min("y").over(corner)).alias("y"), (F.col("x") - F.min("x").over(corner)).alias("x"), "v")
    return kernels.mismatches(placed, back, ["image_id", key, "y", "x"], "v", "image_id")


ALL_FULL = f"WITH {Q.FULL} SELECT image_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM full_rows GROUP BY image_id"


@register("strip_codec_roundtrip", ALL_FULL)
def strip_codec_roundtrip(spark, sf_dir):
    return _planes(spark, sf_dir, partition.uniform_strips(full_grid(spark, sf_dir), 8), "strip_id", predictor="grad")


@register("tile_codec_roundtrip", ALL_FULL)
def tile_codec_roundtrip(spark, sf_dir):
    """Tiles of 16 by 16; the lowest ones may be lower."""
    tiled = partition.tiles(full_grid(spark, sf_dir), 16, 16)
    return _planes(spark, sf_dir, tiled.withColumn("tile", F.col("tile_y") * 1000 + F.col("tile_x")), "tile", coder="rans")


@register("rgb_codec_roundtrip", f"WITH {Q.FULL} SELECT image_id, 3 * count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM full_rows GROUP BY image_id")
def rgb_codec_roundtrip(spark, sf_dir):
    """Colour transform, one coded plane per component, and back."""
    rgb = signals.colour_grid(spark, sf_dir, whole=True)
    c = S.colour_forward("r", "g", "b")
    parts = rgb.select("image_id", "y", "x", c["luma"].alias("a"), S.zigzag(c["co"]).alias("b"), S.zigzag(c["cg"]).alias("c")).selectExpr("image_id", "y", "x", "stack(3, 0, a, 1, b, 2, c) AS (plane, v)")
    back = kernels.decoded_planes(kernels.encoded_planes(parts, ["image_id", "plane"], "avg", "huffman"), ["image_id", "plane"])
    wide = back.groupBy("image_id", "y", "x").agg(*(F.max(F.when(F.col("plane") == k, F.col("v"))).alias(n) for k, n in enumerate(("luma", "co", "cg"))))
    colours = S.colour_inverse("luma", S.unzigzag("co"), S.unzigzag("cg"))
    each = lambda d: d.selectExpr("image_id", "y", "x", "stack(3, 'r', r, 'g', g, 'b', b) AS (plane, v)")
    return kernels.mismatches(each(rgb), each(wide.select("image_id", "y", "x", *(e.alias(n) for n, e in colours.items()))), ["image_id", "y", "x", "plane"], "v", "image_id")


@register("wavelet_codec_roundtrip", ALL_FULL)
def wavelet_codec_roundtrip(spark, sf_dir):
    """Separated coefficients in scan order, zigzagged, coded as one stream per image, and transformed back; places follow from the pictures' sizes."""
    full = full_grid(spark, sf_dir)
    ordered = wavelet.scan_order(wavelet.forward_2d(full, LEVELS), LEVELS)
    blobs = kernels.coded_streams(ordered.select("image_id", "seq", S.zigzag("v").alias("sym")), ["image_id"])
    back = wavelet.placed(kernels.decoded_streams(blobs, ["image_id"]), wavelet.sizes(full), LEVELS)
    samples = wavelet.inverse_2d(back.select("image_id", "y", "x", S.unzigzag("sym").alias("v")), LEVELS)
    return kernels.mismatches(full, samples, ["image_id", "y", "x"], "v", "image_id")


@register("wavelet_words_codec_roundtrip", ALL_FULL)
def wavelet_words_codec_roundtrip(spark, sf_dir):
    """Coefficients as words with escapes, runs of them coded, and everything back from the coded streams and the pictures' sizes."""
    full = full_grid(spark, sf_dir)
    ordered = wavelet.scan_order(wavelet.forward_2d(full, LEVELS), LEVELS)
    words = ordered.select("image_id", (3 * F.col("seq")).alias("at"), F.posexplode(S.coefficient_words("v")).alias("part", "sym"))
    blobs = kernels.coded_streams(words.select("image_id", (F.col("at") + F.col("part")).alias("seq"), "sym"), ["image_id"], "rans", runs_depth=16)
    back = kernels.coefficients(kernels.decoded_streams(blobs, ["image_id"], runs_depth=16), ["image_id"])
    placed = wavelet.placed(back, wavelet.sizes(full), LEVELS).select("image_id", "y", "x", "v")
    return kernels.mismatches(full, wavelet.inverse_2d(placed, LEVELS), ["image_id", "y", "x"], "v", "image_id")


@register("interleaved_words_codec_roundtrip", ALL_FULL)
def interleaved_words_codec_roundtrip(spark, sf_dir):
    """As above, with one level of coefficients where their samples were, in raster order."""
    full = full_grid(spark, sf_dir)
    words = wavelet.forward_interleaved(full).select("image_id", (3 * (F.col("y") * signals.GRID_WIDTH + F.col("x"))).alias("at"), F.posexplode(S.coefficient_words("v")).alias("part", "sym"))
    blobs = kernels.coded_streams(words.select("image_id", (F.col("at") + F.col("part")).alias("seq"), "sym"), ["image_id"], "tans", runs_depth=16)
    back = kernels.coefficients(kernels.decoded_streams(blobs, ["image_id"], runs_depth=16), ["image_id"])
    placed = back.select("image_id", F.expr(f"CAST(seq div {signals.GRID_WIDTH} AS INT)").alias("y"), F.expr(f"CAST(seq % {signals.GRID_WIDTH} AS INT)").alias("x"), "v")
    return kernels.mismatches(full, wavelet.inverse_interleaved(placed), ["image_id", "y", "x"], "v", "image_id")


@register("adaptive_strip_codec_roundtrip", ALL_FULL)
def adaptive_strip_codec_roundtrip(spark, sf_dir):
    """Strips of equal cost, each coded with both predictors, the smaller coding kept in a container, and decoded from it."""
    full = full_grid(spark, sf_dir)
    strips = partition.to_strips(full, partition.adaptive_strips(partition.row_costs(full), 8))
    keys = ["image_id", "strip_id"]
    coded = kernels.encoded_planes(strips, keys, "grad").unionByName(kernels.encoded_planes(strips, keys, "avg"))
    best = coded.groupBy(*keys).agg(F.min_by(F.struct("data", "n_samples", "length"), F.struct("length", "data")).alias("b")).select(*keys, "b.*")
    packed = container.write(best, "image_id", "strip_id", "strips")
    found = container.slices(packed, container.read_index(packed, "image_id"), "image_id").select("image_id", F.col("attribute").cast("int").alias("strip_id"), "data")
    back = kernels.decoded_planes(found, keys)
    first = strips.groupBy(*keys).agg(F.min("y").alias("y0"))
    return kernels.mismatches(full, back.join(first, keys).select("image_id", (F.col("y") + F.col("y0")).alias("y"), "x", "v"), ["image_id", "y", "x"], "v", "image_id")


@register("frame_default_codec_roundtrip", f"WITH {Q.FRAMES} SELECT series, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM frames GROUP BY series")
def frame_default_codec_roundtrip(spark, sf_dir):
    """Independent frames of 8 by 8 samples: average, runs and tANS, to the end and back; a short last frame is cut by its length."""
    frames = signals.event_frames(spark, sf_dir)
    planes = frames.select("series", "frame", F.expr("CAST(px div 8 AS INT)").alias("y"), (F.col("px") % 8).alias("x"), "v")
    blobs = kernels.encoded_planes(planes, ["series", "frame"], "avg", "tans", True)
    back = kernels.decoded_planes(blobs, ["series", "frame"]).join(blobs.select("series", "frame", "n_samples"), ["series", "frame"])
    cells = back.select("series", "frame", (F.col("y") * 8 + F.col("x")).alias("px"), "v", "n_samples").where("px < n_samples")
    return kernels.mismatches(frames, cells, ["series", "frame", "px"], "v", "series")


@register("residual_frames_codec_roundtrip", f"WITH {Q.FRAMES} SELECT series, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM frames GROUP BY series")
def residual_frames_codec_roundtrip(spark, sf_dir):
    """Temporal residuals as runs under a coder."""
    frames = signals.event_frames(spark, sf_dir)
    coded = predict.frame_residuals(frames)
    blobs = kernels.coded_streams(coded.select("series", "frame", F.col("px").alias("seq"), F.col("res").alias("sym")), ["series", "frame"], "tans", runs_depth=11)
    back = kernels.decoded_streams(blobs, ["series", "frame"], runs_depth=11).select("series", "frame", F.col("seq").cast("int").alias("px"), F.col("sym").alias("res"), (F.col("frame") == 0).alias("is_first"))
    return kernels.mismatches(frames, predict.undo_frames(back), ["series", "frame", "px"], "v", "series")


@register("gap_gated_codec_roundtrip", STREAMS)
def gap_gated_codec_roundtrip(spark, sf_dir):
    """Compact indices only for the images whose map pays; the map is a list of symbols beside the stream, and decoding asks it alone."""
    symbols = residual_symbols(spark, sf_dir)
    hist = stats.histogram(symbols, "image_id")
    gate = codebook.map_sizes(hist, "image_id").select("image_id", "pays")
    maps = hist.groupBy("image_id").agg(F.array_sort(F.collect_list("sym")).alias("used")).join(gate, "image_id").select("image_id", F.when(F.col("pays"), F.col("used")).alias("used"))
    gated = symbols.join(gate, "image_id")
    compact = codebook.remap(gated.where("pays").select("image_id", "seq", "sym"), hist, "image_id").select("image_id", "seq", F.col("idx").cast("int").alias("sym"))
    idx = compact.unionByName(gated.where("NOT pays").select("image_id", "seq", "sym"))
    back = kernels.decoded_streams(kernels.coded_streams(idx, ["image_id"]), ["image_id"]).join(maps, "image_id")
    return kernels.mismatches(symbols, back.select("image_id", "seq", F.coalesce(F.get("used", F.col("sym")), F.col("sym")).alias("sym")), ["image_id", "seq"], "sym", "image_id")


@register("coded_size_bounds", f"WITH {Q.residuals('avg')} SELECT image_id, true AS above, true AS below FROM res GROUP BY image_id")
def coded_size_bounds(spark, sf_dir):
    """Whether each image's tANS stream lies between the entropy of its symbols and that and a tenth, with room for its table."""
    symbols = residual_symbols(spark, sf_dir)
    sizes = kernels.coded_streams(symbols, ["image_id"]).select("image_id", (8 * F.col("length")).alias("bits"))
    least = stats.summary(stats.histogram(symbols, "image_id"), "image_id").select("image_id", (F.col("n") * F.col("entropy")).alias("least"), "distinct_syms")
    both = sizes.join(least, "image_id")
    return both.select("image_id", (F.col("bits") >= F.col("least") * 0.99 - 64).alias("above"), (F.col("bits") <= 1.1 * F.col("least") + 64 * F.col("distinct_syms") + 1024).alias("below"))


@register("gap_codec_roundtrip", STREAMS)
def gap_codec_roundtrip(spark, sf_dir):
    """Residual symbols by compact index, coded, decoded and looked up again."""
    symbols = residual_symbols(spark, sf_dir)
    hist = stats.histogram(symbols, "image_id")
    compact = codebook.remap(symbols, hist, "image_id").select("image_id", "seq", F.col("idx").alias("sym"))
    back = kernels.decoded_streams(kernels.coded_streams(compact, ["image_id"]), ["image_id"]).select("image_id", "seq", F.col("sym").alias("idx"))
    return kernels.mismatches(symbols, codebook.unmap(back, hist, "image_id"), ["image_id", "seq"], "sym", "image_id")


@register("strip_choice")
def strip_choice(spark, sf_dir):
    """Per strip the smaller of two predictors' codings; the gradient wins ties."""
    strips = partition.uniform_strips(full_grid(spark, sf_dir), 8)
    keys = ["image_id", "strip_id"]
    size = lambda name: kernels.encoded_planes(strips, keys, name).select(*keys, F.col("length").alias(name))
    both = size("avg").join(size("grad"), keys)
    return both.select(*keys, F.col("avg").alias("avg_bytes"), F.col("grad").alias("grad_bytes"), F.when(F.col("grad") <= F.col("avg"), "grad").otherwise("avg").alias("predictor"))


@register("container_header_parse", f"WITH {Q.FRAMES} SELECT series, frame, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM frames GROUP BY series, frame")
def container_header_parse(spark, sf_dir):
    """Frames packed into a container per series, found again by its table, cut out and decoded."""
    frames = signals.event_frames(spark, sf_dir)
    blobs = kernels.coded_streams(frames.select("series", "frame", F.col("px").alias("seq"), F.col("v").alias("sym")), ["series", "frame"])
    packed = container.write(blobs, "series", "frame", "frames")
    found = container.slices(packed, container.read_index(packed, "series"), "series").select("series", F.col("attribute").cast("int").alias("frame"), "data")
    back = kernels.decoded_streams(found, ["series", "frame"]).select("series", "frame", F.col("seq").cast("int").alias("px"), F.col("sym").alias("v"))
    joined = frames.withColumn("key", F.struct("series", "frame"))
    return kernels.mismatches(joined, back.withColumn("key", F.struct("series", "frame")), ["key", "px"], "v", "key").select("key.series", "key.frame", "n", "mismatches")


@register("wavelet2d_interleaved", f"WITH {Q.FULL}, f AS (SELECT image_id, y, x, v FROM full_rows), {Q.lifted('f', 'image_id, y', 'x', 'h')}, {Q.lifted('h', 'image_id, x', 'y', 'g')} SELECT image_id, y, x, CAST(v AS INT) AS v FROM g")
def wavelet2d_interleaved(spark, sf_dir):
    return wavelet.forward_interleaved(full_grid(spark, sf_dir))


@register("wavelet2d_interleaved_roundtrip", f"WITH {Q.FULL} SELECT image_id, y, x, v FROM full_rows")
def wavelet2d_interleaved_roundtrip(spark, sf_dir):
    return wavelet.inverse_interleaved(wavelet2d_interleaved(spark, sf_dir))


@register("pyramid_region", f"WITH {Q.FULL}, p1 AS ({_HALF.format('full_rows')}) SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS INT) AS v FROM p1 WHERE x BETWEEN 5 AND 20 AND y BETWEEN 3 AND 28")
def pyramid_region(spark, sf_dir):
    """A rectangle of the second level, from the coded tiles of a pyramid."""
    blobs = engine.encode_pyramid(full_grid(spark, sf_dir), 2, 16, engine.Codec("med", "huffman"))
    return engine.decode_region(blobs, 1, 5, 3, 16, 26, 16)


_RGB_HALF = "SELECT image_id, y // 2 AS y, x // 2 AS x, (sum(r) + 2) // 4 AS r, (sum(g) + 2) // 4 AS g, (sum(b) + 2) // 4 AS b FROM {} GROUP BY image_id, y // 2, x // 2 HAVING count(*) = 4"


@register("rgb_pyramid_region", f"WITH {Q.FULL}, p1 AS ({_RGB_HALF.format('full_rows')}) SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM p1 WHERE x BETWEEN 5 AND 20 AND y BETWEEN 3 AND 28")
def rgb_pyramid_region(spark, sf_dir):
    """A rectangle of the second level, out of containers of coded colour tiles, found by their headers and tables."""
    packed = engine.encode_rgb_pyramid(signals.colour_grid(spark, sf_dir, whole=True), 2, 16, engine.Codec("med", "rans"))
    return engine.decode_rgb_region(packed, 1, 5, 3, 16, 26)


@register("pyramid_header_parse", f"WITH {Q.FULL} SELECT image_id, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, 16 AS tile, 2 AS levels FROM full_rows GROUP BY image_id")
def pyramid_header_parse(spark, sf_dir):
    return engine.pyramid_headers(engine.encode_rgb_pyramid(signals.colour_grid(spark, sf_dir, whole=True), 2, 16))


@register("run_word_entropy", f"WITH {Q.RUNS}, o AS (SELECT image_id, CASE WHEN kind = 'same' THEN len ELSE len + 7 END AS sym FROM pieces UNION ALL SELECT image_id, value FROM pieces WHERE kind = 'same' UNION ALL SELECT p.image_id, s.sym FROM pieces p JOIN s ON s.image_id = p.image_id AND s.seq BETWEEN p.start_seq AND p.start_seq + p.len - 1 WHERE kind = 'diff'), h AS (SELECT image_id, sym, count(*) AS cnt FROM o GROUP BY ALL), n AS (SELECT image_id, sum(cnt) AS n FROM h GROUP BY image_id) SELECT image_id, CAST(any_value(n) AS BIGINT) AS n, count(*) AS distinct_syms, abs(round(sum(-(cnt / n) * log2(cnt / n)), 6)) AS entropy FROM h JOIN n USING (image_id) GROUP BY image_id")
def run_word_entropy(spark, sf_dir):
    """What the words of runs would take, from one lazy plan."""
    signal = engine.Signal(coarse_symbols(spark, sf_dir), depth=4)
    return signal.run_words().histogram().summary().select("image_id", "n", "distinct_syms", "entropy")
