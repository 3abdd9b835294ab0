"""The matrix data source: NumPy and .mat files, split by rows."""

import struct
import zlib

import numpy as np
import pytest

from nearfield.sources import matrices


def mat_file(path, variables, packed=False):
    """variables: name -> matrix. As the format's description has it."""
    codes = {np.dtype(k): c for c, k in matrices.KINDS.items()}

    def part(code, data):
        return struct.pack("<II", code, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"test".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, m in variables.items():
        cls = 4 if m.dtype.kind == "S" else 6
        numbers = part(codes[m.dtype], m.tobytes(order="F")) if cls == 6 else part(1, b"text")
        body = part(6, struct.pack("<II", cls, 0)) + part(5, struct.pack("<ii", *m.shape)) + part(1, name.encode()) + numbers
        whole = struct.pack("<II", 14, len(body)) + body
        if packed:
            squeezed = zlib.compress(whole)
            whole = struct.pack("<II", 15, len(squeezed)) + squeezed
        out += whole
    path.write_bytes(out)


def read(spark, path, **options):
    df = matrices.register(spark).read.format("matrix").options(**options).load(str(path))
    return df, {(r.file.rsplit("/", 1)[-1], r.id): r.x for r in df.collect()}


@pytest.mark.parametrize(("kind", "order", "element"), [("<f8", "C", "double"), ("<f4", "F", "float"), (">i2", "C", "int"), ("<i8", "F", "bigint"), ("u1", "C", "int")])
def test_numpy_files_are_split_by_rows(spark, tmp_path, kind, order, element):
    m = np.asarray((np.random.default_rng(0).normal(size=(1000, 7)) * 50).astype(kind), order=order)
    np.save(tmp_path / "m.npy", m)
    df, got = read(spark, tmp_path / "m.npy", split_bytes=2000)
    assert df.schema["x"].dataType.simpleString() == f"array<{element}>"
    assert df.rdd.getNumPartitions() == -(-1000 // (2000 // (7 * np.dtype(kind).itemsize)))
    assert got == {("m.npy", k + 1): row.tolist() for k, row in enumerate(m)}


def test_a_sparse_file_of_more_than_two_gigabytes_is_many_tasks(spark, tmp_path):
    path = tmp_path / "large.npy"
    rows, columns = 300_000, 1000
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, columns)})
        start = f.tell()
        f.truncate(start + 8 * rows * columns)
        f.seek(start + 8 * columns * 299_999)
        f.write(np.arange(columns, dtype=float).tobytes())
    assert path.stat().st_size > 2**31
    reader = matrices.MatrixReader(str(path), None, matrices.SPLIT_BYTES)
    splits = reader.partitions()
    assert len(splits) > 30 and sum(s.last - s.first for s in splits) == rows
    last = list(reader.read(splits[-1]))
    assert last[-1].column(1)[-1].as_py() == rows and last[-1].column(2)[-1].as_py() == list(range(columns))


@pytest.mark.parametrize("packed", [False, True])
def test_mat_files(spark, tmp_path, packed):
    rng = np.random.default_rng(1)
    variables = {"note": np.zeros((1, 4), "S1"), "train_X": rng.normal(size=(50, 3)), "longer_labels_name": rng.integers(0, 9, (50, 1)).astype("u1")}
    mat_file(tmp_path / "d.mat", variables, packed)
    for name, want in (("train_X", variables["train_X"]), ("longer_labels_name", variables["longer_labels_name"]), (None, variables["train_X"])):
        df, got = read(spark, tmp_path / "d.mat", split_bytes=20, **({"variable": name} if name else {}))
        assert got == {("d.mat", k + 1): row.tolist() for k, row in enumerate(want)}
        assert (df.rdd.getNumPartitions() > 1) is not packed
    with pytest.raises(Exception, match="no numeric matrix named other"):
        read(spark, tmp_path / "d.mat", variable="other")


def test_folders_empty_files_and_other_files(spark, tmp_path):
    for k, n in enumerate((3, 0, 2)):
        np.save(tmp_path / f"m{k}.npy", np.full((n, 2), float(k)))
    np.save(tmp_path / "v.npy", np.arange(4.0))
    (tmp_path / "notes.txt").write_text("no matrix")
    _, got = read(spark, tmp_path)
    assert got == {**{("m0.npy", k): [0.0, 0.0] for k in (1, 2, 3)}, **{("m2.npy", k): [2.0, 2.0] for k in (1, 2)}, **{("v.npy", k + 1): [float(k)] for k in range(4)}}
    np.save(tmp_path / "w.npy", np.arange(3))
    with pytest.raises(Exception, match="different kinds"):
        read(spark, tmp_path)
    with pytest.raises(Exception, match="FileNotFound"):
        read(spark, tmp_path / "none.npy")


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(k, [k + 0.5, -k * 1.0]) for k in range(100)]
    df = matrices.register(spark).createDataFrame(rows, "id long, x array<double>").repartition(3)
    df.write.format("matrix").option("file_rows", 20).mode("append").save(str(tmp_path / "out"))
    _, got = read(spark, tmp_path / "out")
    assert sorted(got.values()) == sorted(x for _, x in rows)
    assert max(k for _, k in got) == 20
