import struct

import pytest
from pyspark.sql import functions as F

from pairwright.operators.graph import arcs_of
from pairwright.sources.csr import read_csr, write_csr
from pairwright.sources.dump import dump_communities
from pairwright.sources.memory import from_lists
from pairwright.sources.mtx import Kind, parse_banner, properties, read_complex, read_dense, read_mtx, write_dense, write_mtx
from tests.test_matching import GOLDEN, edges

ROWS = sorted([(a, b, w) for a, b, w in GOLDEN] + [(b, a, w) for a, b, w in GOLDEN])


def rows(df):
    return sorted((x.src, x.dst, x.w) for x in df.collect())


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_csr_round_trip(spark, tmp_path, pairs, parts):
    path = f"file://{tmp_path}/g"
    write_csr(arcs_of(edges(spark, GOLDEN)), path, vertices=9, pairs=pairs)
    assert rows(read_csr(spark, path, parts, pairs)) == ROWS


def test_csr_files_of_others(spark, tmp_path):
    file = tmp_path / "one.bin"
    arcs = struct.pack("<qdqdqd", 1, 0.5, 0, 0.5, 2, 1.5)
    file.write_bytes(struct.pack("<qq", 3, 99) + struct.pack("<qqqq", 10, 11, 13, 13) + arcs)  # offsets that don't begin at 0, a wrong count
    assert rows(read_csr(spark, str(file))) == [(0, 1, 0.5), (1, 0, 0.5), (1, 2, 1.5)]
    (tmp_path / "cut.bin").write_bytes(file.read_bytes()[:-4])
    with pytest.raises(Exception, match="cut short"):
        read_csr(spark, str(tmp_path / "cut.bin")).count()
    (tmp_path / "none.bin").write_bytes(struct.pack("<qqq", 0, 0, 0))
    assert read_csr(spark, str(tmp_path / "none.bin")).count() == 0


@pytest.mark.parametrize("field,symmetry", [("real", "general"), ("real", "symmetric"), ("integer", "symmetric"), ("pattern", "general"), ("pattern", "symmetric"), ("real", "skew-symmetric")])
def test_mtx_round_trip(spark, tmp_path, field, symmetry):
    path = f"file://{tmp_path}/m"
    write_mtx(arcs_of(edges(spark, GOLDEN)), path, 6, field, symmetry)
    weight = {"real": lambda w: w, "integer": lambda w: float(int(w)), "pattern": lambda w: 1.0}[field]
    sign = lambda a, b: -1.0 if symmetry == "skew-symmetric" and a < b else 1.0
    want = [(a, b, sign(a, b) * weight(w)) for a, b, w in ROWS]
    for split in (7, 1 << 20):
        assert rows(read_mtx(spark, path, split=split)) == want
    x = properties(spark, path).first()
    assert (x.n_rows, x.n_columns, x.nnz) == (6, 6, 16)


@pytest.mark.parametrize("split", [1, 5, 100, 1 << 20])
def test_mtx_text_of_others(spark, tmp_path, split):
    text = "%%MatrixMarket MATRIX coordinate Real symmetric\n% note\n%\n\n3 3 3\n1 1 2.5\n  3 1   -1e2 \n2 1 4\n"
    (tmp_path / "a.mtx").write_text(text)
    assert rows(read_mtx(spark, str(tmp_path / "a.mtx"), split=split)) == [(0, 0, 2.5), (0, 1, 4.0), (0, 2, -100.0), (1, 0, 4.0), (2, 0, -100.0)]
    (tmp_path / "b.mtx").write_text(text.rstrip("\n"))
    assert read_mtx(spark, str(tmp_path / "b.mtx"), split=split).count() == 5
    assert properties(spark, str(tmp_path / "b.mtx")).first().nnz == 5


@pytest.mark.parametrize("text", ["", "hello", "%%MatrixMarket matrix coordinate real hermitian", "%%MatrixMarket matrix array pattern general", "%%MatrixMarket matrix coordinate pattern skew-symmetric", "%%MatrixMarket vector coordinate real general"])
def test_bad_banners(text):
    with pytest.raises(ValueError):
        parse_banner(text)


def test_kinds(spark, tmp_path):
    assert Kind("coordinate", "complex", "hermitian").valid and not Kind("coordinate", "what", "general").valid
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 3\n")
    with pytest.raises(Exception, match="complex"):
        read_mtx(spark, str(tmp_path / "c.mtx")).count()
    assert [tuple(x) for x in read_complex(spark, str(tmp_path / "c.mtx")).collect()] == [(0, 0, 2.0, 3.0)]
    (tmp_path / "r.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n2 2 1\n2 1 5\n")
    assert sorted(map(tuple, read_complex(spark, str(tmp_path / "r.mtx")).collect())) == [(0, 1, 5.0, 0.0), (1, 0, 5.0, 0.0)]


def matrix(symmetry, n=5):
    """A complex matrix of that symmetry, as entries."""
    value = lambda i, j: complex((3 * i + 7 * j) % 5 - 1.5, (i * j) % 3 - 1) if (i + j) % 3 else 0
    other = {"general": None, "symmetric": lambda z: z, "skew-symmetric": lambda z: -z, "hermitian": lambda z: z.conjugate()}[symmetry]
    m = [[value(i, j) for j in range(n)] for i in range(n)]
    if other:
        m = [[m[i][j] if i > j else other(complex(m[j][i])) if i < j else {"symmetric": m[i][i], "skew-symmetric": 0, "hermitian": complex(m[i][i]).real}[symmetry] for j in range(n)] for i in range(n)]
    return sorted((i, j, complex(m[i][j]).real, complex(m[i][j]).imag) for i in range(n) for j in range(n) if m[i][j])


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric", "hermitian"])
def test_complex_round_trips(spark, tmp_path, symmetry):
    want = matrix(symmetry)
    entries = spark.createDataFrame(want, "src long, dst long, re double, im double").repartition(3)
    got = lambda df: sorted((a, b, x + 0.0, y + 0.0) for a, b, x, y in map(tuple, df.collect()))
    write_mtx(entries, f"{tmp_path}/m", 5, "complex", symmetry)
    write_dense(entries, f"{tmp_path}/d", 5, "complex", symmetry)
    for split in (11, 1 << 20):
        assert got(read_complex(spark, f"{tmp_path}/m", split=split)) == want
        assert got(read_dense(spark, f"{tmp_path}/d", split=split)) == want
    assert properties(spark, f"{tmp_path}/m").first().nnz == len(want)


@pytest.mark.parametrize("field,symmetry", [("real", "general"), ("integer", "symmetric"), ("real", "skew-symmetric")])
def test_dense_round_trip(spark, tmp_path, field, symmetry):
    sign = lambda a, b: -1.0 if symmetry == "skew-symmetric" and a < b else 1.0
    want = [(a, b, sign(a, b) * (round(w) + 1.0)) for a, b, w in ROWS]
    write_dense(spark.createDataFrame(want, "src long, dst long, w double"), f"{tmp_path}/d", 6, field, symmetry)
    for split in (9, 1 << 20):
        assert rows(read_dense(spark, f"{tmp_path}/d", split)) == want
    head = next(tmp_path.glob("d/0-header.mtx")).read_text()
    assert head == f"%%MatrixMarket matrix array {field} {symmetry}\n6 6\n"
    with pytest.raises(ValueError):
        write_dense(arcs_of(edges(spark, GOLDEN)), f"{tmp_path}/x", 6, "pattern")


def test_dense_ranges_are_many_tasks(spark, tmp_path):
    n = 40
    (tmp_path / "big.mtx").write_text(f"%%MatrixMarket matrix array real general\n{n} {n}\n" + "".join(f"{i + 1}.0\n" for i in range(n * n)))
    got = read_dense(spark, str(tmp_path / "big.mtx"), 100).select("w", F.spark_partition_id().alias("task")).collect()
    assert sorted(x.w for x in got) == [i + 1.0 for i in range(n * n)] and len({x.task for x in got}) > 30


def test_a_hub_is_read_by_many_tasks(spark, tmp_path):
    star = arcs_of(edges(spark, [(0, i, float(i)) for i in range(1, 400)]))
    write_csr(star, f"file://{tmp_path}/s")
    got = read_csr(spark, f"file://{tmp_path}/s", parts=8).withColumn("task", F.spark_partition_id())
    assert got.filter("src = 0").select("task").distinct().count() == 4 and rows(got) == rows(star)


@pytest.mark.parametrize("split", [1, 6, 1 << 20])
@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
def test_dense(spark, tmp_path, symmetry, split):
    n, sign = 4, {"general": 0, "symmetric": 1, "skew-symmetric": -1}[symmetry]
    m = [[(3 * i + 7 * j) % 5 - 1.5 if (i + j) % 3 else 0.0 for j in range(n)] for i in range(n)]
    if sign:
        m = [[m[i][j] if i > j else sign * m[j][i] if i < j else (m[i][i] if sign == 1 else 0.0) for j in range(n)] for i in range(n)]
    stored = [m[i][j] for j in range(n) for i in range(n) if not sign or i > j or i == j and sign == 1]
    (tmp_path / "d.mtx").write_text(f"%%MatrixMarket matrix array real {symmetry}\n% dense\n{n} {n}\n" + "\n".join(map(str, stored)) + "\n")
    assert rows(read_dense(spark, str(tmp_path / "d.mtx"), split)) == sorted((i, j, m[i][j]) for i in range(n) for j in range(n) if m[i][j])
    with pytest.raises(Exception, match="read_dense"):
        read_mtx(spark, str(tmp_path / "d.mtx")).count()


def test_dump(spark, tmp_path):
    comm = spark.createDataFrame([(2, 7), (0, 5), (1, 5)], "id long, c long")
    dump_communities(comm, f"{tmp_path}/d")
    assert [x.value for x in spark.read.text(f"{tmp_path}/d").coalesce(1).collect()] == ["5", "5", "7"]
    dump_communities(comm, f"{tmp_path}/e", spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "id long, idx long"))
    assert [x.value for x in spark.read.text(f"{tmp_path}/e").coalesce(1).collect()] == ["7", "5", "5"]


def test_lists(spark):
    arcs = from_lists(spark, [7, 3, 7], [3, 9, 9], [1.0, 2.0, 3.0], renumber=True)
    assert rows(arcs) == [(0, 2, 2.0), (1, 0, 1.0), (1, 2, 3.0)]
    assert rows(from_lists(spark, [1], [2])) == [(1, 2, 1.0)]
    with pytest.raises(ValueError):
        from_lists(spark, [1], [2], symmetric=True)
    with pytest.raises(ValueError):
        from_lists(spark, [1, 2], [2])
