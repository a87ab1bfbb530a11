import os

import pytest

from reticula.plans import lineage


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_dir_is_read_from_the_session(spark):
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_unset_shared_dir():
    assert lineage.shared_dir(Session(spark_master="local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.shared_dir(Session(spark_master=master))


def _folder(spark):
    return lineage.shared_dir(spark).removeprefix("file://") + "/reticula"


def test_cut_drop_and_scope(spark):
    df = spark.range(10)
    a = lineage.cut(df)
    assert a.count() == 10 and spark.conf.get(lineage.CLEAN_SHUFFLES, "false") == "false"
    before = set(os.listdir(_folder(spark)))
    lineage.drop(a, df)  # a table that isn't ours stays as it is
    assert len(before - set(os.listdir(_folder(spark)))) == 1
    before = set(os.listdir(_folder(spark)))
    with lineage.scope():
        b = lineage.cut(df.selectExpr("id", "id % 2 AS k"), by="k")
        assert b.where("k = 1").count() == 5
    assert set(os.listdir(_folder(spark))) == before


def test_cut_with_known_rows_writes_few_files(spark, monkeypatch):
    df = spark.range(100).repartition(8)
    assert len(lineage.cut(df, rows=100).inputFiles()) == 1
    monkeypatch.setattr(lineage, "FILE_ROWS", 40)
    table = lineage.cut(df, rows=100)
    assert len(table.inputFiles()) == 3 and table.count() == 100
    assert lineage.cut(df.where("id < 0"), rows=0).count() == 0


def test_small_tables_in_many_partitions_go_to_few_files(spark, monkeypatch):
    table = lineage.cut(spark.range(400).repartition(100))
    slots = lineage.SLOT_FILES * spark.sparkContext.defaultParallelism
    scanned = table.selectExpr("id", "id % 40 AS k")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        grouped = scanned.groupBy("id").count()
        assert len(lineage.cut(scanned).inputFiles()) > slots and len(lineage.cut(grouped).inputFiles()) > slots
        for df, shuffled in ((scanned, False), (grouped, True)):
            out = lineage.cut(lineage.pack(df, shuffled))
            assert len(out.inputFiles()) <= slots and sorted(r.id for r in out.collect()) == list(range(400))
        # Enough input for each partition: nothing changes.
        monkeypatch.setattr(lineage, "FILE_BYTES", 1)
        assert lineage.pack(grouped) is grouped and len(lineage.cut(lineage.pack(scanned, False)).inputFiles()) > slots
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k in ("adaptive.coalescePartitions.enabled", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{k}")
