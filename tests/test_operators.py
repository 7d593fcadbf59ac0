"""Known values and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from rastrum.functions import scalars as S
from rastrum.plans import engine, raster_queries  # noqa: F401
from rastrum.plans.catalog import QUERIES
from rastrum.operators import codebook, kernels, partition, predict, runs, stats, wavelet


def grid_of(spark, planes):
    rows = [(i, y, x, v) for i, p in enumerate(planes) for y, row in enumerate(p) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, v int")


def test_colour_known_value_and_round_trip(spark):
    c = S.colour_forward("r", "g", "b")
    one = spark.sql("SELECT 9 r, 4 g, 2 b").select(*(e.alias(n) for n, e in c.items())).first()
    assert (one.luma, one.co, one.cg) == (4, 7, -1)  # co = 9 - 2, t = 2 + 3, cg = 4 - 5, luma = 5 - 1
    cube = spark.range(0, 1 << 24, 37).selectExpr("CAST(id & 255 AS INT) r", "CAST((id >> 8) & 255 AS INT) g", "CAST(id >> 16 AS INT) b")
    back = cube.select("r", "g", "b", *(e.alias(n) for n, e in c.items()))
    again = S.colour_inverse("luma", "co", "cg")
    assert back.where((again["r"] != F.col("r")) | (again["g"] != F.col("g")) | (again["b"] != F.col("b"))).isEmpty()


def test_zigzag_wrap_and_depth(spark):
    rows = spark.createDataFrame([(v,) for v in range(-70000, 70000, 13)], "x int")
    assert rows.where(S.unzigzag(S.zigzag("x")) != F.col("x")).isEmpty()
    assert [r[0] for r in spark.createDataFrame([(0,), (65535,), (-65535,), (32768,)], "x int").select(S.wrap16("x")).collect()] == [0, -1, 1, -32768]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (255,), (4095,)], "x int").select(S.bit_depth("x")).collect()] == [0, 1, 8, 12]


def test_temporal_wraps(spark):
    frames = spark.createDataFrame([(0, f, 0, v) for f, v in enumerate([0, 65535, 32768, 100])], "series int, frame int, px int, v int")
    coded = predict.frame_residuals(frames)
    assert [r.res for r in coded.orderBy("frame").collect()][:2] == [0, 1]
    assert [r.v for r in predict.undo_frames(coded).orderBy("frame").collect()] == [0, 65535, 32768, 100]
    same = spark.createDataFrame([(0, f, p, 7) for f in range(2) for p in range(4)], "series int, frame int, px int, v int")
    assert predict.frame_residuals(same).where("frame = 1 AND res <> 0").isEmpty()
    with pytest.raises(ValueError):
        predict.frame_at(coded, -1)


def test_box_filter(spark):
    grid = spark.createDataFrame([(0, y, x, 50 * x, 60 * y, 100) for y in range(3) for x in range(5)], "image_id int, y int, x int, r int, g int, b int")
    half = partition.halved(grid, values=("r", "g", "b")).orderBy("x").collect()
    assert [(h.y, h.x, h.r, h.g, h.b) for h in half] == [(0, 0, 25, 30, 100), (0, 1, 125, 30, 100)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (4, 6), (7, 5)])
def test_wavelet_round_trip_of_odd_sizes(spark, shape):
    plane = [[(31 * y * y + 17 * x + (x * y) % 5) % 4096 for x in range(shape[1])] for y in range(shape[0])]
    grid = grid_of(spark, [plane])
    back = wavelet.inverse_2d(wavelet.forward_2d(grid, 3), 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid.collect()))


def test_many_levels_and_places(spark):
    plane = [[(7 * y + 3 * x * x) % 251 for x in range(33)] for y in range(20)]
    grid = grid_of(spark, [plane])
    coded = wavelet.scan_order(wavelet.forward_2d(grid, 5), 5)
    placed = coded.select("image_id", "seq", "v").join(wavelet.places(wavelet.sizes(grid), 5), ["image_id", "seq"])
    assert sorted(map(tuple, wavelet.inverse_2d(placed, 5).collect())) == sorted(map(tuple, grid.collect()))


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (2, 3), (20, 33)])
def test_places_follow_from_sizes(spark, shape):
    """Two pictures at a time, and a coefficient beyond the end, which has no place."""
    grid = grid_of(spark, [[[0] * shape[1] for _ in range(shape[0])], [[0] * 3 for _ in range(4)]])
    coded = wavelet.scan_order(grid, 3).select("image_id", "seq", "y", "x")
    more = coded.select("image_id", "seq").union(spark.sql("SELECT 1, 12"))
    found = wavelet.placed(more, wavelet.sizes(grid), 3)
    assert sorted(map(tuple, found.where("x IS NOT NULL").collect())) == sorted(map(tuple, coded.collect()))
    assert [tuple(r) for r in found.where("x IS NULL OR y IS NULL").collect()] == [(1, 12, None, None)]


@pytest.mark.parametrize("name", ["wavelet_codec_roundtrip", "wavelet_words_codec_roundtrip"])
def test_no_cells_are_broadcast(spark, name):
    """What explode makes looks as small to Spark as what it is made from; it must not be sent whole."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    sent, deep = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-|*"))
        deep = None if deep is not None and at <= deep else deep
        sent += [line] if deep is not None else []
        deep = at if "BroadcastExchange" in line else deep
    assert not [line for line in sent if "Generate" in line or "Window" in line]


def test_coefficient_words_come_back(spark):
    values = [0, 1, -1, 32767, -32767, 32768, -32768, 70000, -(1 << 31), (1 << 31) - 1, 5]
    words = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "image_id int, at int, v int").select("image_id", "at", F.posexplode(S.coefficient_words("v")).alias("part", "sym"))
    back = kernels.coefficients(words.select("image_id", (3 * F.col("at") + F.col("part")).alias("seq"), "sym"), ["image_id"])
    assert [r.v for r in back.orderBy("seq").collect()] == values


def python_runs(stream, depth):
    """Count words and payload, taken symbol by symbol."""
    most, out, i, n = (1 << (depth - 1)) - 2, [], 0, len(stream)
    mid = (1 << (depth - 1)) - 1
    islands = []
    while i < n:
        j = i
        while j < n and stream[j] == stream[i]:
            j += 1
        if j - i < 3 and islands and not islands[-1][2]:
            islands[-1][1] = j
        else:
            islands.append([i, j, j - i >= 3])
        i = j
    for k, (i, j, same) in enumerate(islands):
        follows = 2 if not same and k + 1 < len(islands) else 0
        while i < j:
            size = j - i if j - i + follows <= most else most - 2
            out += [size, stream[i]] if same else [mid + size, *stream[i : i + size]]
            i += size
    return out


@pytest.mark.parametrize("stream", [[7, 7, 7, 7, 3, 12, 12, 12, 5, 5, 9], [1], [1, 1], [2] * 40, [1, 2] * 30, [0, 1] * 6 + [5] * 20 + [1, 1, 2, 2, 3, 3]])
def test_run_words(spark, stream):
    depth = max(4, max(stream).bit_length())
    symbols = spark.createDataFrame([(0, i, v) for i, v in enumerate(stream)], "image_id int, seq long, sym int")
    assert [r.word for r in runs.words(symbols, depth).orderBy("word_no").collect()] == python_runs(stream, depth)
    back = kernels.unrun_streams(runs.with_length(runs.words(symbols, depth), symbols), ["image_id"], depth)
    assert [r.sym for r in back.orderBy("seq").collect()] == stream


def test_normalized_counts_fill_the_table(spark):
    hist = spark.createDataFrame([(d, s, 1 + (s * 37 * (d + 1)) % 400) for d in range(3) for s in range(40)], "doc_id int, sym int, cnt long")
    rows = stats.normalized(hist).groupBy("doc_id").agg(F.sum(F.abs("norm")).alias("t"), F.max("table_log").alias("l"), F.max("fallback").alias("f")).collect()
    assert all(r.f or r.t == 1 << r.l for r in rows)


def test_code_books(spark):
    assert codebook.code_lengths([7]) == [1]
    for counts in ([1, 1], [5, 3, 1, 1], list(range(1, 60)), [1 << k for k in range(20)]):
        assert sum(2.0**-k for k in codebook.code_lengths(counts)) == 1
    assert max(codebook.code_lengths(sorted((1 << k for k in range(20)), reverse=True)[: codebook.chosen(sorted((1 << k for k in range(20)), reverse=True))])) <= 14
    hist = spark.createDataFrame([(0, s, c) for s, c in enumerate([50, 20, 20, 5, 5])], "doc_id int, sym int, cnt long")
    codes = [(format(r.code, f"0{r.len}b")) for r in codebook.canonical(codebook.shannon_lengths(hist)).collect()]
    assert all(a == b or not b.startswith(a) for a in codes for b in codes)


def test_adaptive_strips_have_rows(spark):
    costs = spark.createDataFrame([(0, y, 1000 if y == 19 else 0) for y in range(20)] + [(1, y, 0) for y in range(20)] + [(2, y, y) for y in range(5)], "image_id int, y int, cost long")
    starts = partition.adaptive_strips(costs, 8).orderBy("image_id", "strip_id").collect()
    per = {i: [s.y0 for s in starts if s.image_id == i] for i in range(3)}
    assert per[0][0] == 0 and all(a < b for a, b in zip(per[0], per[0][1:])) and per[0][-1] <= 19
    assert per[1] == [i * 20 // 8 for i in range(8)] and per[2] == [0, 1, 2, 3, 4]


def test_regions_are_checked(spark):
    tiled = partition.tiles(grid_of(spark, [[[1] * 8] * 8]), 4, 4)
    assert partition.region(tiled, 6, 6, 9, 9, 4, 4).count() == 4
    for bad in ((-1, 0, 1, 1), (0, 0, 0, 1)):
        with pytest.raises(ValueError):
            partition.region(tiled, *bad, 4, 4)
    assert partition.level_count(256, 256, 256, 256) == 1 and partition.level_count(2048, 1536, 256, 256) == 4


def test_colour_pyramid_is_checked(spark):
    rows = [(1, y, x, 3 * x, 5 * y, x ^ y) for y in range(20) for x in range(24)]
    packed = engine.encode_rgb_pyramid(spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int"), 2, 8)
    assert tuple(engine.pyramid_headers(packed).first()) == (1, 24, 20, 8, 2)
    got = engine.decode_rgb_region(packed, 0, 20, 15, 9, 9).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[1] >= 15 and r[2] >= 20)
    for bad in ((2, 0, 0, 1, 1), (1, 12, 0, 1, 1), (0, 0, 20, 1, 1)):
        with pytest.raises(Exception, match="no such level|outside"):
            engine.decode_rgb_region(packed, *bad).collect()
    with pytest.raises(ValueError):
        engine.decode_rgb_region(packed, 0, -1, 0, 1, 1)
    missing = spark.createDataFrame([(1, 0, 9, 9)], "image_id int, level int, tile_y int, tile_x int")
    with pytest.raises(Exception, match="no such tile"):
        engine.decode_rgb_tiles(packed, missing).collect()
