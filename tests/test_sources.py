import struct

import numpy as np
import pytest

from rastrum.sources import container, files


def test_raw_samples(spark, tmp_path):
    plane = np.arange(12, dtype="<u2").reshape(3, 4) * 5000
    (tmp_path / "a.raw").write_bytes(plane.tobytes())
    rows = files.raw_samples(spark, str(tmp_path / "a.raw"), 4, 3).orderBy("y", "x").collect()
    assert [r.v for r in rows] == plane.ravel().tolist()
    with pytest.raises(Exception, match="bytes"):
        files.raw_samples(spark, str(tmp_path / "a.raw"), 5, 3).collect()


def dicom(planes, instance=1, syntax=b"1.2.840.10008.1.2.1\0"):
    def explicit(group, element, vr, value):
        value += b"\0" * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if vr in files.LONG_VR else struct.pack("<H", len(value))
        return struct.pack("<HH", group, element) + vr + size + value

    u = lambda x: struct.pack("<H", x)
    body = explicit(2, 0x10, b"UI", syntax) + explicit(0x20, 0x13, b"IS", str(instance).encode()) + explicit(0x28, 2, b"US", u(1)) + explicit(0x28, 8, b"IS", str(len(planes)).encode())
    body += explicit(0x28, 0x10, b"US", u(planes[0].shape[0])) + explicit(0x28, 0x11, b"US", u(planes[0].shape[1])) + explicit(0x28, 0x100, b"US", u(16))
    return bytes(128) + b"DICM" + body + explicit(0x7FE0, 0x10, b"OW", b"".join(p.astype("<u2").tobytes() for p in planes))


def test_dicom(spark, tmp_path):
    planes = [np.full((2, 3), k * 100) + np.arange(3) for k in range(3)]
    (tmp_path / "m.dcm").write_bytes(dicom(planes))
    rows = files.dicom_samples(spark, str(tmp_path / "m.dcm")).orderBy("frame", "y", "x").collect()
    assert [r.v for r in rows] == np.concatenate([p.ravel() for p in planes]).tolist()
    series = tmp_path / "series"
    series.mkdir()
    for k, p in enumerate(planes):
        (series / f"{9 - k}.dcm").write_bytes(dicom([p], instance=k))
    rows = files.dicom_series(spark, str(series)).orderBy("frame", "y", "x").collect()
    assert [r.v for r in rows] == np.concatenate([p.ravel() for p in planes]).tolist()
    (series / "x.dcm").write_bytes(dicom([np.zeros((5, 5))], instance=9))
    with pytest.raises(Exception, match="differ in size"):
        files.dicom_series(spark, str(series)).collect()
    with pytest.raises(ValueError, match="transfer syntax"):
        files.parse_dicom(dicom(planes, syntax=b"1.2.840.10008.1.2.4.70"))


@pytest.mark.parametrize("end", ["<", ">"])
def test_tiff(spark, tmp_path, end):
    picture = np.arange(2 * 3 * 3, dtype="u1").reshape(2, 3, 3)
    tags = [(256, 3, 3), (257, 3, 2), (259, 3, 1), (273, 4, 200), (277, 3, 3), (279, 4, 18)]
    pack = lambda tag, kind, v: struct.pack(end + "HHI", tag, kind, 1) + (struct.pack(end + "HH", v, 0) if kind == 3 else struct.pack(end + "I", v))
    blob = (b"II" if end == "<" else b"MM") + struct.pack(end + "HIH", 42, 8, len(tags)) + b"".join(pack(*t) for t in tags)
    (tmp_path / "a.tif").write_bytes(blob.ljust(200, b"\0") + picture.tobytes())
    rows = files.tiff_colours(spark, str(tmp_path / "a.tif")).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b) for r in rows] == [tuple(p) for p in picture.reshape(-1, 3).tolist()]


def test_histogram_csv_and_pgm(spark, tmp_path):
    res = spark.createDataFrame([(0, 3), (0, 3), (0, -400), (0, 2047)], "image_id int, residual int")
    files.write_histogram_csv(res, str(tmp_path / "h"), 12)
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "h"))
    assert sorted(map(tuple, back.collect())) == [(0, -255, 1), (0, 0, 1), (0, 3, 2)]
    assert files.pgm(np.array([[1, 256]])) == b"P5\n2 1\n65535\n\0\1\1\0"


def test_benchmark_text(spark, tmp_path):
    (tmp_path / "b.txt").write_text("goos: linux\nBenchmarkDecode/fast/MR-8  10  123 ns/op  45.6 MB/s  3.4 ratio\nBenchmarkDecode/slow/MR-8  10  123 ns/op  5.5 MB/s\n")
    rows = files.by_codec(files.benchmark_lines(spark, str(tmp_path / "b.txt"))).collect()
    assert [r.asDict() for r in rows] == [{"image": "MR", "fast": 45.6, "slow": 5.5}]


def test_slide_is_deterministic(spark):
    one, two = (sorted(map(tuple, files.synthetic_slide(spark, 40, 30).collect())) for _ in range(2))
    assert one == two and any(r[2:] == (255, 255, 255) for r in one) and any(r[2] < 255 for r in one)


def test_containers(spark):
    blob = container.pack([b"abc", b"", b"defg"], "frames", (0, 1, 2))
    assert [container.entry(blob, k) for k in range(3)] == [b"abc", b"", b"defg"]
    for bad in (b"", b"XXXX" + blob[4:], blob[:20], blob[:-1]):
        with pytest.raises(container.BadContainer):
            container.header(bad)
    with pytest.raises(IndexError):
        container.entry(blob, 3)
    packed = spark.createDataFrame([(1, blob)], "series int, container binary")
    cut = container.slices(packed, container.read_index(packed, "series"), "series")
    assert [bytes(r.data) for r in cut.orderBy("entry_no").collect()] == [b"abc", b"", b"defg"]
    assert packed.select(container.format_of(packed.container)).first()[0] == "container"


def test_frame_residual_stream(spark, tmp_path):
    from rastrum.operators.predict import frame_residuals
    from rastrum.streaming.frames import frame_residual_stream

    rows = [(s, f, p, (f * f * 97 + p * 31 + s) % 65536) for s in range(2) for f in range(6) for p in range(3)]
    schema = "series int, frame int, px int, v int"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = frame_residual_stream(stream).writeStream.format("memory").queryName("residuals").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = frame_residuals(spark.createDataFrame(rows, schema)).drop("is_first")
    assert sorted(map(tuple, spark.table("residuals").collect())) == sorted(map(tuple, want.collect()))
