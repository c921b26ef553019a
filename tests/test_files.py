"""Files by data sources: many pages in a file, a file for each row, and what failing tasks leave."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework import filesink, sinks
from linework.sources import multipage as M
from linework.sources import pages as P


def pgm(a, top=255, kind=b"P5"):
    return kind + b"\n# a note\n%d %d\n%d\n" % (a.shape[1], a.shape[0], top) + a.astype(np.uint8 if top < 256 else ">u2").tobytes()


@pytest.fixture
def pages():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 256, (int(h), int(w)), dtype=np.uint8) for h, w in rng.integers(1, 40, (60, 2))]


@pytest.mark.parametrize("split", [1, 97, 5000, 1 << 20])
def test_every_page_once_at_any_split(spark, tmp_path, pages, split):
    (tmp_path / "a.pgm").write_bytes(b"".join(map(pgm, pages)))
    (tmp_path / "b.pgm").write_bytes(pgm(pages[0]))
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    if split == 1:  # planned, not run: a task for each byte
        assert len(M.PageReader({"path": str(tmp_path), "split_bytes": "1"}).partitions()) == sum(p.stat().st_size for p in tmp_path.glob("*.pgm"))
        return
    read = M.paged_files(spark, str(tmp_path), split_bytes=split, mode="FAILFAST")
    assert read.rdd.getNumPartitions() == sum(-(-p.stat().st_size // split) for p in tmp_path.glob("*.pgm"))
    rows = {r["page_id"]: r for r in read.collect()}
    assert len(rows) == 61
    for i, a in enumerate(pages, 1):
        r = rows[f"{tmp_path}/a.pgm [page {i}]"]
        assert (r["page_no"], r["height"], r["width"], r["channels"], bytes(r["pixels"])) == (i, *a.shape, 1, a.tobytes())
    sizes = M.paged_files(spark, f"file://{tmp_path}/a.pgm", pixels=False)
    assert sizes.count() == 60 and sizes.where("pixels is not null").count() == 0


def test_a_task_takes_ranges_of_many_small_files(spark, tmp_path, pages):
    for i in range(30):
        (tmp_path / f"{i:02d}.pgm").write_bytes(b"".join(map(pgm, pages[i : i + 2])))
    size = sum(p.stat().st_size for p in tmp_path.glob("*.pgm"))
    parts = M.PageReader({"path": str(tmp_path), "split_bytes": "97", "task_bytes": "5000"}).partitions()
    bytes_of = [sum(r.stop - r.start for r in p.ranges) for p in parts]
    assert sum(bytes_of) == size and max(bytes_of) <= 5000 and len(parts) <= size // (5000 - 97) + 1
    rows = M.paged_files(spark, str(tmp_path), split_bytes=97, task_bytes=5000, mode="FAILFAST")
    assert rows.rdd.getNumPartitions() == len(parts)
    assert sorted((r["page_id"], bytes(r["pixels"])) for r in rows.collect()) == [(f"{tmp_path}/{i:02d}.pgm [page {k + 1}]", pages[i + k].tobytes()) for i in range(30) for k in range(2)]


def test_colour_and_deep_pages_as_the_decoder_has_them(spark, tmp_path):
    rng = np.random.default_rng(4)
    colour, deep = rng.integers(0, 256, (5, 12)), rng.integers(0, 1001, (6, 4))
    three = b"P6 4 5 255\n" + colour.astype(np.uint8).tobytes()
    four = pgm(deep, 1000)
    (tmp_path / "x.pnm").write_bytes(three + four)
    rows = M.paged_files(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [bytes(r["pixels"]) for r in rows] == [P.decode_pnm(x).tobytes() for x in (three, four)] and [r["channels"] for r in rows] == [3, 1]


def test_cut_and_foreign_files(spark, tmp_path, pages):
    whole = b"".join(map(pgm, pages[:3]))
    for name, data, n in (("cut", whole[:-1], 2), ("tail", whole + b"junk", 3), ("none", b"P2 1 1 255\n7", 0), ("empty", b"", 0)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "f.pgm").write_bytes(data)
        rows = M.paged_files(spark, str(folder), split_bytes=50).collect()
        assert sorted((r["page_no"], r["pixels"] is None) for r in rows) == [(k, False) for k in range(1, n + 1)] + ([(n + 1, True)] if data else [])
        if data:
            with pytest.raises(Exception, match="page"):
                M.paged_files(spark, str(folder), split_bytes=50, mode="failfast").collect()
    with pytest.raises(Exception, match="nowhere"):
        M.paged_files(spark, f"{tmp_path}/nowhere").collect()


def names_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_a_file_for_each_row(spark, tmp_path):
    out = f"{tmp_path}/out"
    rows = spark.range(50).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("id") != 7, F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "UTF-8")).alias("content"))
    filesink.save_files(rows.repartition(6), out)
    assert names_in(out) == sorted([f"d{i % 3}/{i}.txt" for i in range(50)] + ["_SUCCESS"])
    assert open(f"{out}/d1/49.txt", encoding="utf-8").read() == "é" * 49 and os.path.getsize(f"{out}/d1/7.txt") == 0
    filesink.save_files(rows.limit(1), out, "append")
    assert len(names_in(out)) == 51
    filesink.save_files(rows.where("name = 'd0/3.txt'"), out)
    assert names_in(out) == ["_SUCCESS", "d0/3.txt"]
    filesink.save_files(rows.where("false"), out)
    assert names_in(out) == ["_SUCCESS"]


def test_files_are_made_and_written_by_small_batches(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in filesink.BATCHES}

    @F.pandas_udf("binary")
    def sized(ids):
        return ids.map(lambda i: str(len(ids)).encode())

    filesink.save_files(spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("name"), sized("id").alias("content")), f"{tmp_path}/out")
    most = filesink.BATCHES["spark.sql.execution.arrow.maxRecordsPerBatch"]
    assert max(int((tmp_path / "out" / str(i)).read_bytes()) for i in range(3000)) <= most
    wide = spark.range(0, 64, 1, 1).select(F.col("id").cast("string").alias("name"), F.repeat(F.lit("x"), 1 << 20).alias("text"))

    @F.pandas_udf("binary")
    def together(texts):
        return texts.map(lambda t: str(len(texts)).encode())

    filesink.save_files(wide.select("name", together("text").alias("content")), f"{tmp_path}/wide")
    assert max(int((tmp_path / "wide" / str(i)).read_bytes()) for i in range(64)) <= 8
    assert {k: spark.conf.get(k) for k in filesink.BATCHES} == before


def test_files_are_read_by_their_lists(spark, tmp_path):
    out, lists = f"{tmp_path}/out", f"{tmp_path}/lists"
    rows = spark.range(3000).select(F.concat("id", F.lit("/é "), "id").alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))
    filesink.save_files(rows.repartition(5), out, lists=lists)
    assert len(os.listdir(lists)) == 5 and "_SUCCESS" in os.listdir(out)
    filesink.save_files(rows.limit(2).withColumn("content", F.encode(F.lit("new"), "UTF-8")), out, "append", lists)
    found = filesink.listed_files(spark, out, lists)
    assert found.rdd.getNumPartitions() < 100
    got = {r["name"]: bytes(r["content"]) for r in found.collect()}
    new = {n for n, c in got.items() if c == b"new"}
    assert len(new) == 2 and got == {f"{i}/é {i}": b"new" if f"{i}/é {i}" in new else b"x" * i for i in range(3000)}
    filesink.save_files(rows.where("id = 9"), out, lists=lists)
    assert [r["name"] for r in filesink.listed_files(spark, out, lists).collect()] == ["9/é 9"]
    filesink.save_files(rows.where("false"), out, lists=lists)
    assert filesink.listed_files(spark, out, lists).count() == 0


def test_document_files_read_in_few_tasks(spark, tmp_path):
    """Reading back takes tasks by cores, not by files, and the driver lists none."""
    from linework.plans import registry

    spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.QUERIES["document_files"](spark, str(tmp_path))
    assert not found.inputFiles() and found.count() == 600


@pytest.mark.parametrize("bad", ["F.raise_error(F.lit('broken'))", "F.lit('../out')", "F.lit('')"])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    out = f"{tmp_path}/out"
    name = F.when(F.col("id") == 777, eval(bad).cast("string")).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 800, 1, 8).select(name.alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        filesink.save_files(rows, out)
    assert [n for n in names_in(out) if not n.startswith("_temporary")] == []  # a task that still runs may write there


def test_files_get_their_names_at_commit(tmp_path):
    out = f"{tmp_path}/out"
    writer = filesink.FileWriter(out)
    done = writer.write(iter([{"name": "a", "content": b"1"}, {"name": "b/c", "content": b"2"}]))
    assert done.files == 2 and all(n.startswith("_temporary") for n in names_in(out))
    writer.abort([done, None])
    assert names_in(out) == []
    writer.commit([writer.write(iter([{"name": "a", "content": b"1"}])), None])
    assert names_in(out) == ["_SUCCESS", "a"] and open(f"{out}/a").read() == "1"


def test_names_of_documents(spark):
    paths = ["file:/a/b/page 1.pgm", "/x/y.tar.gz", "book.pdf [page 12]", "17"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(sinks.document_name(F.col("p"))).collect()] == ["page 1", "y.tar", "book [page 12]", "17"]
