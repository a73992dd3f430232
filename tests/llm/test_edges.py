"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkindex.llm import licenses, packing, positional, quality, sharding, simhash, sketch
from sparkindex.llm import pipeline as stages

LONG = "word soup " * 30_000
ROWS = [
    (1, "one two three four five six seven", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "one two three four five six seven", "a"),
    (4, "one two three four five six seven", "a"),
    (4, "same id other text here now", "a"),
    (None, "no id but words", "c"),
    (None, None, "c"),
    (7, LONG, "d"),
    (8, "  \n\t ", "d"),
    (9, "éè 你好 \U0001f600 x\u0000y", "d"),
]
#: Columns whose names the operators use inside themselves.
CLASH = ["id", "fp", "length", "rank", "salt", "key", "w", "donor", "node", "mark", "shard", "slot", "x", "y", "fold", "score", "row", "row_", "host", "wrapper", "digest", "component_id", "items", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    groups = {}
    for r in rows:
        groups.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(v) == 1 for v in groups.values())
    zero = [r for r in rows if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in rows if r.id in (1,)} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs)).collect()
    expected = sum(len(packing.cuts(len(packing.encoder(packing.default_vocabulary())(t or "")) + 1, 2048)) - 1 for _, t, _ in ROWS)
    assert len(rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(none)).count() == 0


def test_contamination(spark, docs, none):
    benchmark = spark.createDataFrame([(1, "one two three four"), (2, None), (None, "no id but words"), (3, ""), (4, "One, TWO three-four five six seven")], "item_id long, text string")
    rows = positional.contamination(docs, benchmark).collect()
    assert len(rows) == len(ROWS)
    hit = {(r.id, r.n_hit, tuple(r["items"])) for r in rows if r.n_hit}
    assert hit == {(1, 7, ("1", "4")), (4, 7, ("1", "4"))}
    assert positional.contamination(docs, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert positional.contamination(none, benchmark).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_sketch(docs, none):
    rows = sketch.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_chars for r in rows if r.id == 7} == {len(LONG)}
    alike = {repr(r.own) for r in rows if r.n_chars == len(ROWS[0][1])}
    assert len(alike) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sketch.fingerprints(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sorted(r["size"] for r in rows if r.id is None) == [8, 8 + len("no id but words")]
    assert sharding.shard_documents(none).count() == 0


def test_licenses(docs, none):
    rows = licenses.license_labels(docs).collect()
    assert len(rows) == len(ROWS) and {r.labels for r in rows} == {""}
    assert licenses.license_labels(none).count() == 0


def test_stages_keep_columns_and_rows(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "same id other text here now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        for name, stage in stages.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.where("row <> 'clash' or row_ <> 'clash'").count() == 0, name
    left = stages.one_of_each_group(spark, docs, str(tmp_path))
    assert left.count() == len({simhash.simhash(t) for _, t, _ in ROWS})
    clean = stages.without_benchmark(spark, docs, str(tmp_path))
    assert clean.count() == len(ROWS) - 1
    assert clean.where("doc_id is null").count() == 2
    assert stages.packed(spark, none, str(tmp_path)).count() == 0


def test_rows_of_a_stored_table_keep_their_numbers(spark, docs, none, tmp_path, monkeypatch):
    """However a scan cuts the files; names of files and columns are no matter."""
    path = f"{tmp_path}/odd é %20/docs.parquet"
    many = docs.crossJoin(spark.range(300).toDF("nth")).withColumns({"_metadata": F.lit(1), "path": F.lit("p"), "File": F.lit(2)})
    many.repartition(3).write.option("parquet.block.size", "20000").parquet(path)
    monkeypatch.setattr(stages, "materialize", lambda *a: pytest.fail("written again"))
    seen = []
    for most in ("4k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            table = spark.read.parquet(path)
            rows, row = stages.numbered(table)
            assert rows.columns == [*table.columns, row]
            seen.append((rows.rdd.getNumPartitions(), {(r[0], r[1], r[2]) for r in rows.select(row, "doc_id", F.sha2("text", 256)).collect()}))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (cuts, one), (fewer, other) = seen
    assert one == other and cuts > fewer
    assert len({n for n, *_ in one}) == len(one) == len(ROWS) * 300
    none.write.parquet(f"{tmp_path}/none.parquet")
    assert stages.numbered(spark.read.parquet(f"{tmp_path}/none.parquet"))[0].count() == 0


def test_only_stored_tables_are_numbered_by_place(spark, docs, tmp_path):
    """What a join, a union or an explosion repeats, or no file holds, is written with its numbers."""
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    table = spark.read.parquet(f"{tmp_path}/docs.parquet")
    assert stages.stored(table) and not stages.stored(docs)
    for made in (table.union(table), table.crossJoin(spark.range(2).toDF("twice")), table.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))):
        assert not stages.stored(made)
        rows, row = stages.numbered(made)
        assert rows.select(row).distinct().count() == rows.count() == 2 * len(ROWS)
    docs.limit(2).write.csv(f"{tmp_path}/docs.csv")
    assert not stages.stored(spark.read.csv(f"{tmp_path}/docs.csv"))


def tables_with(spark, column):
    """The written tables, by name, that have this column."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {d.name for d in pathlib.Path(shared, "sparkindex").glob("*") if any(column in pq.read_schema(f).names for f in list(d.glob("*.parquet"))[:1])}


def test_stages_leave_no_copy_of_the_texts(spark, docs, tmp_path):
    """A stored table stays where it is: its texts are not beside the stage's result once more."""
    docs.repartition(2).write.parquet(f"{tmp_path}/docs.parquet")
    table = spark.read.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame([(1, "same id other text here now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = tables_with(spark, "text")
    for k, (stage, want) in enumerate(((stages.one_of_each_group, len({simhash.simhash(t) for _, t, _ in ROWS})), (stages.without_benchmark, len(ROWS) - 1))):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        assert spark.read.parquet(f"{tmp_path}/{k}.parquet").count() == want
        assert tables_with(spark, "text") == before


def test_pipeline_keeps_one_stage_at_a_time(spark):
    """Of the texts that stages pass on, only those of the last are still there."""
    before = tables_with(spark, "text")
    stages.run_stages(spark, "/root/testdata/sf0.001")
    assert [x.rpartition("-")[0] for x in tables_with(spark, "text") - before] == ["decontamination"]
